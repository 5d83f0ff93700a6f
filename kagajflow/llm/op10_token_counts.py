"""Token counts: the exact count at every prefix, by a dynamic program over prefixes.

`token_counts` gives each text's total and where its first `limit` tokens end; `prefix_counts` stores the count at every prefix
(in code points), from which `tokens_of_prefix` and `longest_prefix` answer truncation and budget questions without encoding again.

Null text counts as empty (0 tokens). Repeated rows give repeated rows, an empty table none; only the named columns are read, so
others may clash. Texts of any length are processed whole; memory is bounded by a block of 1 MB or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 1 << 20


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.DEFAULT_TOKENIZER, limit: int = 1024) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit, limit_bytes (what the first `limit` tokens cover)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache, program = tokens.vocabulary(tokenizer), tokens.count_cache(tokenizer), tokens.counter(tokenizer)
        for batch in batches:
            data, offsets = common.utf8_of(batch.column(1))
            total, covered = np.zeros(len(batch), np.int64), np.diff(offsets)
            for a, b in common.blocks(offsets, BLOCK):
                at = offsets[a : b + 1] - offsets[a]
                pieces = tokens.Pieces(data[offsets[a] : offsets[b]], at, own)
                count = np.array(cache.get(pieces.words), np.int64)[pieces.index]
                running = np.concatenate([[0], np.cumsum(count)])
                first = running[pieces.text_bounds[:-1]]
                total[a:b] = running[pieces.text_bounds[1:]] - first
                for i in np.flatnonzero(total[a:b] > limit):
                    k = int(np.searchsorted(running, first[i] + limit, "right")) - 1  # the piece that reaches beyond the limit
                    ids = program.encode(pieces.words[pieces.index[k]])[: int(first[i] + limit - running[k])]
                    covered[a + i] = pieces.starts[k] - at[i] + sum(len(program.token_of[x]) for x in ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit), pa.array(covered)], names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "limit_bytes"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def prefix_table(text: str, tokenizer: str = tokens.DEFAULT_TOKENIZER) -> np.ndarray:
    """Token count of text[:k] for k from 0 to len(text).

    A cut moves no earlier piece's bounds, but for two cases: white space that a cut leaves at the end is one piece, though its
    last character belongs to what follows in the whole text; and a contraction that is cut short falls apart.
    """
    own, program = tokens.vocabulary(tokenizer), tokens.counter(tokenizer)
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    pieces = tokens.Pieces(data, np.array([0, len(raw)]), own)
    ends = np.append(pieces.starts[1:], len(raw)) if len(raw) else pieces.starts
    at_byte = np.zeros(len(raw) + 1, np.int32)
    before, space_from, space_before, from_here, from_before = 0, 0, 0, 0, 0
    for start, end, k in zip(pieces.starts.tolist(), ends.tolist(), pieces.index.tolist(), strict=True):
        word = pieces.words[k]
        if word in own.special:  # cut short it is ordinary text, which may join the piece before
            for cut in range(start + 1, end):
                inner = tokens.Pieces(data[from_here:cut], np.array([0, cut - from_here]), own)
                each = [inner.words[i] for i in inner.index]
                at_byte[cut] = from_before + sum(1 if w in own.special else n for w, n in zip(each, program.counts(each), strict=True))
            from_here, from_before = end, before + 1
            at_byte[end] = before = before + 1
            space_from, space_before = end, before
            continue
        from_here, from_before = start, before
        count, _ = program.table(word)
        at_byte[start + 1 : end + 1] = [before + c for c in count[1:]]
        if word[:1] == b"'" and len(word) > 1 and word[1:2].isalpha():
            at_byte[start + 2 : end] = [before + 1 + c for c in program.table(word[1:])[0][1:-1]]
        shown = word.decode()
        if not shown.isspace() and shown[0] != " ":
            space_from, space_before = end, before + count[-1]
        else:  # the white space so far, as one piece
            lead = start + (len(word) if shown.isspace() else 1)
            if start > space_from:
                at_byte[lead] = space_before + program.counts([raw[space_from:lead]])[0]
            if not shown.isspace():
                space_from, space_before = end, before + count[-1]
        before += count[-1]
    heads = np.flatnonzero((data & 0xC0) != 0x80) if len(raw) else np.zeros(0, np.int64)
    return at_byte[np.append(heads, len(raw))]


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.DEFAULT_TOKENIZER) -> DataFrame:
    """id, prefix_tokens: the token count at every prefix of the text, in code points, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                part = batch.slice(i, 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([prefix_table(t or "", tokenizer) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=[id_col, "prefix_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column) -> Column:
    return F.element_at(prefix_tokens, F.least(n_chars, F.size(prefix_tokens) - 1).cast("int") + 1)


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """The most code points whose encoding has at most `budget` tokens."""
    return F.size(prefix_tokens) - 1 - F.coalesce(F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), True) - 1, F.lit(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
