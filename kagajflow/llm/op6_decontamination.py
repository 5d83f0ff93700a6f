"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as their lower-cased words (letters and digits; each character of a script that is written without blanks is a
word). An item of m words may differ from a passage in k words, a fifth of m: cut into k + 1 pieces, at least one piece then occurs
in the passage as it is. All pieces of a block of items are searched in a text at once (an Aho-Corasick automaton); around each hit
Myers' bit-parallel algorithm gives the smallest edit distance of the item to any passage there, in words. What is within the
budget contaminates the document. An item of fewer than MIN_WORDS words must occur as it is: its budget is 0.

Items come in blocks of bounded size, each block broadcast by itself. The documents are read once: a task takes them in groups of
bounded size and searches each group for one block after the other, so it holds one automaton at a time, and texts are never
shuffled. Each row is judged by itself: rows that share an id are each reported by what they hold, whatever the number of blocks.
Items without a word aren't searched. Null and empty texts hit nothing; items that share an id are reported under it; an empty
benchmark contaminates nothing. Only id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARE, MIN_WORDS, BLOCK_BYTES = 0.2, 5, 2_000_000
#: Bytes of text that a task holds while it goes through several blocks.
HELD = 64 << 20
NOT_WORD = re.compile(r"[\W_]+")
#: Thai, Lao, Myanmar, Khmer; kana, bopomofo, Chinese characters and their extensions; half-width kana.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(text: str) -> str:
    """The words with one blank before, between and after them."""
    low = text.lower()
    return f" {NOT_WORD.sub(' ', low if low.isascii() else UNSPACED.sub(r' \1 ', low)).strip()} "


def pieces_of(words: list[str], budget: int) -> list[tuple[int, int]]:
    """budget + 1 ranges of almost equal length that cover the words."""
    cuts = [len(words) * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def least_distance(pattern: list[str], text: list[str]) -> int:
    """The smallest edit distance in words of the pattern to any part of the text: Myers' algorithm, a bit for each word of the pattern."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        best = min(best, score)
    return best


class Searcher:
    """A block of items, (id, text), ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float, min_words: int) -> None:
        self.items: list[tuple[int, list[str], int]] = []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text or "").split()
            if not words:
                continue
            budget = int(share * len(words) + 1e-9) if len(words) >= min_words else 0
            for a, b in pieces_of(words, budget):
                places.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.items), a))
            self.items.append((item_id, words, budget))
        for piece, where in places.items():
            self.automaton.add_word(piece, (piece.count(" ") - 1, where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, float]]:
        """(item id, likeness from 0 to 1) of the items within their budgets."""
        if not self.items:
            return []
        flat = words_of(text)
        hits = [(end, n, where) for end, (n, where) in self.automaton.iter(flat)]
        if not hits:
            return []
        words = flat.split()
        blanks = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 0x20)
        starts: dict[int, set[int]] = {}
        for end, n, where in hits:
            first = int(np.searchsorted(blanks, end)) - n  # the word at which the piece begins
            for item, offset in where:
                starts.setdefault(item, set()).add(first - offset)
        out = []
        for item, begins in starts.items():
            item_id, pattern, budget = self.items[item]
            best, done = budget + 1, -1
            for begin in sorted(begins):
                low, high = max(0, begin - budget), begin + len(pattern) + budget
                if low < done:  # windows that overlap are one
                    low = max(low, done - len(pattern) - budget)
                best = min(best, least_distance(pattern, words[low:high]))
                done = high
                if not best:
                    break
            if best <= budget:
                out.append((item_id, 1 - best / len(pattern)))
        return sorted(out)


def groups_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about `limit` bytes."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def hits_of(docs: DataFrame, blocks: Iterable[list[tuple[int, str]]], id_col: str, text_col: str, share: float, min_words: int) -> DataFrame:
    """id and hits, an array of (item_id, likeness), of every document."""
    shared = [docs.sparkSession.sparkContext.broadcast(items) for items in blocks]
    hit = pa.struct([("item_id", pa.int64()), ("likeness", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Searcher(shared[0].value, share, min_words) if len(shared) == 1 else None
        for group in groups_of(batches, HELD if len(shared) > 1 else 1):
            found: list[list[list[tuple[int, float]]]] = [[[] for _ in range(len(batch))] for batch in group]
            for block in shared:
                searcher = only or Searcher(block.value, share, min_words)
                for batch, rows in zip(group, found, strict=True):
                    for row, text in zip(rows, batch.column(1), strict=True):
                        row += searcher.find(text.as_py() or "")
            for batch, rows in zip(group, found, strict=True):
                hits = [[{"item_id": i, "likeness": s} for i, s in row] for row in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(hit))], names=[id_col, "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, hits array<struct<item_id:long,likeness:double>>")


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_bytes`, dealt by hash; equal items are one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """id, contaminated, item_ids (sorted) and likeness (the largest): one row per document."""
    found = hits_of(docs, item_blocks(benchmark, block_bytes), id_col, text_col, share, min_words)
    item_ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select(id_col, (F.size("hits") > 0).alias("contaminated"), item_ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["likeness"])), F.lit(0.0)).alias("likeness"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
