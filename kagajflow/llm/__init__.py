"""Operators of a training-data pipeline: fingerprints, packing, language, PII, extraction, decontamination, fixity, dedup, token counts."""
