"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import op1_fingerprint, op2_packing, op3_language, op4_pii, op5_html, op6_decontamination, op7_warc_fixity, op8_simhash, op9_line_dedup, op10_token_counts, op11_exact_dedup, op12_source_divergence, op13_periodic_runs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": op1_fingerprint.query,
        "op2_best_fit_packing": op2_packing.query,
        "op3_language_id": op3_language.query,
        "op4_pii": op4_pii.query,
        "op5_html_extraction": op5_html.query,
        "op6_decontamination": op6_decontamination.query,
        "op7_warc_fixity": op7_warc_fixity.query,
        "op8_simhash_near_dedup": op8_simhash.query,
        "op9_line_dedup": op9_line_dedup.query,
        "op10_token_counts": op10_token_counts.query,
        "op11_exact_dedup": op11_exact_dedup.query,
        "op12_source_divergence": op12_source_divergence.query,
        "op13_periodic_runs": op13_periodic_runs.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc_fixity": op7_warc_fixity.ORACLE_SQL,
        "op9_line_dedup": op9_line_dedup.ORACLE_SQL,
        "op11_exact_dedup": op11_exact_dedup.ORACLE_SQL,
        "op12_source_divergence": op12_source_divergence.ORACLE_SQL,
    }
