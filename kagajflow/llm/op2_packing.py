"""Best-fit packing by exact complements: documents into as few sequences of `capacity` tokens as possible.

Only documents longer than a sequence are cut, into pieces of the full length after a shorter first one. How to combine lengths
is decided on counts by length alone (at most `capacity` numbers, whatever the corpus): a gap is filled exactly by one, two or
three lengths whose sum it is, under the counts that remain, and what fits no gap exactly goes where it leaves least. That gives
recipes with multiplicities; every piece then finds its place by its number among the pieces of its length, which is computed
without a global sort: counts by (length, hash group) give each group's first number, and only groups are numbered one by one.

Null text is empty: such a document is its end id alone. Repeated rows are packed as often as they occur, an empty table gives no
rows; only the id and text columns are read. A text is tokenized whole, whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
BLOCK = 2 << 20
#: Hash groups for numbering have this many pieces of one length, or the square root of the commonest length's count if that is more.
GROUP = 256


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """id, piece, start, length, ids_crc32, nth: the pieces of every document's ids with the end id, counted in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = tokens.vocabulary(tokenizer), tokens.id_cache(tokenizer)
        last, done = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            data, offsets = common.utf8_of(batch.column(1))
            rows: list[tuple[int, int, int, int, int]] = []
            for a, b in common.blocks(offsets, BLOCK):
                found = tokens.Pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], own)
                ids, index, bounds = cache.get(found.words), found.index.tolist(), found.text_bounds.tolist()
                for i in range(b - a):
                    stream = b"".join([ids[k] for k in index[bounds[i] : bounds[i + 1]]]) + last
                    n = len(stream) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(a + i, k, x, y - x, zlib.crc32(stream[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
            row, *values = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(values[0].astype(np.int32)), *map(pa.array, values[1:]), pa.array(np.arange(done, done + len(row)))], names=names)
            done += len(row)

    names = [id_col, "piece", "start", "length", "ids_crc32", "nth"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, nth long")


def exact_fill(gap: int, left: np.ndarray) -> list[int] | None:
    """One, two or three available lengths whose sum is the gap, the largest first; left: how many of each length remain."""
    if left[gap]:
        return [gap]
    half = gap // 2
    large = np.arange(gap - 1, half - (gap % 2 == 0), -1)  # pairs (large, gap - large)
    if len(large):
        fits = (left[large] > 0) & (left[gap - large] > 0) & ((2 * large != gap) | (left[large] > 1))
        if fits.any():
            a = int(large[np.argmax(fits)])
            return [a, gap - a]
    for a in np.flatnonzero(left[:gap])[::-1].tolist():  # triples: the largest, then a pair of the rest
        if 3 * a < gap:
            break
        rest = gap - a
        high = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        low = rest - high
        need_a = 1 + (high == a) + (low == a)
        fits = (left[high] > 0) & (left[low] > 0) & (left[a] >= need_a) & ((high != low) | (left[high] > 1))
        if fits.any():
            b = int(high[np.argmax(fits)])
            return [a, b, rest - b]
    return None


def recipes(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths of a sequence): together they use every length as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    if left[capacity]:
        out.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    top = capacity - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            return out
        chosen, gap = [top], capacity - top
        left[top] -= 1
        while gap:
            fill = exact_fill(gap, left)
            if fill is None:
                below = np.flatnonzero(left[1 : gap + 1])
                if not len(below):
                    break
                fill = [int(below[-1]) + 1]
            for x in fill:
                left[x] -= 1
            chosen += fill
            gap -= sum(fill)
        lengths, each = np.unique(chosen, return_counts=True)
        more = int((left[lengths] // each).min())
        left[lengths] -= more * each
        out.append((1 + more, chosen))


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, sorted: the first number among its pieces, the first sequence, and the offset, of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            number = used.get(length, 0)
            runs.setdefault(length, []).append((number, sequence, offset))
            used[length] = number + times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut = common.stored(pieces(df, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    most = max(counts.values(), default=0)
    groups = max(1, -(-most // max(GROUP, math.isqrt(most))))
    place = df.sparkSession.sparkContext.broadcast(slots(recipes(counts, capacity)))
    grouped = cut.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece", "nth"), F.lit(groups)).cast("int"))  # equal rows differ in nth
    first = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    first = first.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n")
    in_group = F.row_number().over(Window.partitionBy("length", "_group").orderBy(id_col, "piece", "nth"))
    numbered = grouped.withColumn("_in", in_group).join(first, ["length", "_group"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_in") - 1).alias("_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = place.value
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    start, base, at = places[int(length[rows[0]])]
                    k = np.searchsorted(start, number[rows], "right") - 1
                    sequence[rows], offset[rows] = base[k] + number[rows] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = df.schema[id_col].dataType.simpleString()
    return numbered.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
