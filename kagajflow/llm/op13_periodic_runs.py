"""Periodic run detection: an all-lag scan over word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least max(MIN_LENGTH, MIN_EXP * q) words
long, that neither neighbouring word extends. For every shift q up to n / MIN_EXP the array of word ids is compared with itself q places
on; a run is a stretch of at least max(MIN_LENGTH - q, q) equal places. Up to DENSE all places are compared and stretches of equal ones
are run-length coded. Beyond, a stretch holds GRAM equal places in a row at one of the multiples of q - GRAM + 1, so hashes of GRAM words
are compared at those places alone (2 n / q for a shift, n log n for all) and only where they meet is the stretch measured word by word:
the skip loses nothing. A stretch whose period isn't the smallest (some q / prime is one) belongs to a smaller shift. Places in a known
run whose period divides q are not measured again.

The texts of a batch are scanned together as one array, longest first and each ended by an id of its own, so a shift costs one call for
all texts that are long enough for it; a stretch over an end is shorter than q. Texts of more than LAGS shifts are dealt to tasks in
ranges of shifts (document, range), of which each finds its runs by itself, and their runs meet by document; others stay where they are.

`smeared` applies the contract's rule that makes a tenth of the texts periodic, to be seen in the results.

Null and empty texts have no words and no runs. A row without id takes part as it is, unsmeared. Equal rows give equal results. An empty
table gives no rows. Other columns aren't read. Texts are taken whole; all runs are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH, MIN_EXP = 12, 2
DENSE, GRAM = 16, 8
#: Shifts that one task takes of one text.
LAGS = 1 << 16
BLOCK = 1 << 20
RUNS = "array<struct<start:int,length:int,period:int>>"


def needed(lag: int) -> int:
    """How many places in a row are equal at this shift in any run of that period."""
    return max(MIN_LENGTH - lag, (MIN_EXP - 1) * lag)


def smallest_period(ids: np.ndarray, a: int, b: int, period: int) -> int:
    """The smallest period of ids[a:b], which has a period at most half as long as itself: it divides that one."""
    left, prime = period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime:
            prime += 1
            continue
        left //= prime
        shorter = period // prime
        if np.array_equal(ids[a : b - shorter], ids[a + shorter : b]):
            period = shorter
    return period


def reach(ids: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many places from `at` on, going by step (1 or -1), are equal to those a shift further."""
    n, wide = 0, 64
    while True:
        a, b = (at + n, min(at + n + wide, len(ids) - lag)) if step > 0 else (max(0, at - n - wide + 1), at - n + 1)
        if b <= a:
            return n
        other = ids[a:b] != ids[a + lag : b + lag]
        first = int(np.argmax(other[::step]))
        if other[::step][first]:
            return n + first
        n, wide = n + b - a, wide * 4


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM ids from each place on."""
    out = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
    for k in range(GRAM if len(out) else 0):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def scan(ids: np.ndarray, lags: range, upto: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose periods are in lags. upto: by lag - lags.start, how far the texts go that are long enough for the lag."""
    found: list[tuple[int, int, int]] = []
    grams = gram_hashes(ids) if lags.stop > DENSE else ids
    cover, cover_end = np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def take(lag: int, a: int, b: int) -> None:
        """Equal places a to b at the shift: a run of ids[a : b + lag]."""
        period = smallest_period(ids, a, b + lag, lag)
        if period == lag:
            found.append((a, b + lag - a, lag))
        part = slice(a, b + lag)
        longer = cover_end[part] < b + lag
        cover[part][longer], cover_end[part][longer] = period, b + lag

    for lag in lags:
        n = int(upto[lag - lags.start])
        if n <= lag:
            break
        if lag <= DENSE:
            equal = np.flatnonzero(np.diff(np.concatenate([[False], ids[: n - lag] == ids[lag:n], [False]]).astype(np.int8)))
            starts, ends = equal[::2], equal[1::2]
            long = ends - starts >= needed(lag)
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                take(lag, a, b)
            continue
        step, last = needed(lag) - GRAM + 1, n - lag - GRAM + 1
        if last <= 0:
            continue
        hits = np.flatnonzero(grams[:last:step] == grams[lag : lag + last : step]) * step
        if not len(hits):
            continue
        hits = hits[(cover_end[hits] <= hits + lag) | (lag % cover[hits] != 0)]
        done = -1
        for hit in hits.tolist():
            if hit < done:
                continue
            after = reach(ids, lag, hit, 1)
            done = hit + after
            before = reach(ids, lag, hit - 1, -1) if hit else 0
            if before + after >= needed(lag):
                take(lag, hit - before, done)
    return found


def smeared(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's edit: which original word stands at each place, None where all stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def words_of(data: bytes, doc_id: int | None, smear: bool) -> list[bytes]:
    words = data.split()
    places = smeared(doc_id, len(words)) if smear else None
    return words if places is None else [words[i] for i in places.tolist()]


def runs_of(texts: list[list[bytes]], ranges: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """For each text the runs with periods from its range's first to its last shift, by start, then period. All of more than LAGS shifts must be alone."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lags = range(min(a for a, _ in ranges), max(b for _, b in ranges) + 1)
    order = sorted((k for k, t in enumerate(texts) if len(t) >= MIN_LENGTH and len(t) >= MIN_EXP * lags.start), key=lambda k: -len(texts[k]))
    if not order:
        return out
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(texts[k]) for k in order])
    ids, starts, at = np.empty(int(sizes.sum()) + len(order), np.int64), np.zeros(len(order), np.int64), 0
    for i, k in enumerate(order):
        n, starts[i] = len(texts[k]), at
        ids[at : at + n] = [numbers.setdefault(w, len(numbers)) for w in texts[k]]
        ids[at + n] = -1 - i
        at += n + 1
    lags = range(lags.start, min(lags.stop, int(sizes[0]) // MIN_EXP + 1))
    enough = len(sizes) - np.searchsorted(sizes[::-1], np.arange(lags.start, lags.stop) * MIN_EXP)
    ends = starts + sizes + 1
    for a, length, period in scan(ids, lags, ends[enough - 1]):
        i = int(np.searchsorted(starts, a, "right")) - 1
        out[order[i]].append((a - int(starts[i]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def last_lag(words: Column) -> Column:
    return F.floor(words / MIN_EXP).cast("int")


def long_runs(rows: DataFrame, smear: bool, lags: int) -> DataFrame:
    """(id, h, runs) of rows (id, h, text, shifts at most), each dealt in ranges of so many shifts; equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8_of(batch.column("text"))
            found = []
            for k, doc_id in enumerate(batch.column("id").to_pylist()):
                words, first = words_of(data[at[k] : at[k + 1]].tobytes(), doc_id, smear), batch.column("first")[k].as_py()
                found += runs_of([words], [(first, first + lags - 1)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], RUN_LIST)], names=["id", "h", "runs"])

    dealt = rows.select("id", "h", "text", F.explode(F.sequence(F.lit(1), "shifts", F.lit(lags))).alias("first"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt.repartition(partitions, "id", "h", "first").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, runs {RUNS}")
    return parts.groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))  # the runs of one text


RUN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", smear: bool = False, lags: int = LAGS) -> DataFrame:
    """For each row its id, runs (start, length, period; by start, then period), and collapsed, the SHA-256 of the words without repeats."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), common.text_hash(text).alias("h"), text.alias("text"))
    most = last_lag(F.ceil(F.octet_length("text") / 2))  # a word and its blank take two bytes
    kind = df.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their runs if these are known, else they are found here."""
        for batch in batches:
            data, at = common.utf8_of(batch.column("text"))
            ids, known = batch.column("id").to_pylist(), batch.column("runs")
            for a, b in common.blocks(at, BLOCK):
                texts = [words_of(data[at[k] : at[k + 1]].tobytes(), ids[k], smear) for k in range(a, b)]
                fresh = [k for k in range(a, b) if not known[k].is_valid]
                runs: dict[int, list[tuple[int, int, int]]] = {k: [(r["start"], r["length"], r["period"]) for r in known[k].as_py()] for k in range(a, b) if known[k].is_valid}
                if fresh:
                    own = [texts[k - a] for k in fresh]
                    runs |= dict(zip(fresh, runs_of(own, [(1, max(1, *map(len, own), 2) // MIN_EXP)] * len(own)), strict=True))
                hashes = [hashlib.sha256(collapsed(texts[k - a], runs[k])).hexdigest() for k in range(a, b)]
                lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs[k]] for k in range(a, b)], RUN_LIST)
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], lists, pa.array(hashes)], names=["id", "runs", "collapsed_sha256"])

    short = rows.where(most <= lags).select("id", "text", F.lit(None).cast(RUNS).alias("runs"))
    long = rows.where(most > lags)
    found = long_runs(long.select("id", "h", "text", most.alias("shifts")), smear, lags).withColumnsRenamed({"id": "_id", "h": "_h"})
    joined = long.join(found, long["id"].eqNullSafe(found["_id"]) & (long["h"] == found["_h"])).select("id", "text", "runs")
    return short.unionByName(joined).mapInArrow(judge, f"id {kind}, runs {RUNS}, collapsed_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(common.table(spark, sf_dir, "documents"), smear=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.withColumn("best", best).withColumns({"start": (-F.col("best.s")).cast("long"), "length": F.col("best.length").cast("long"), "period": (-F.col("best.p")).cast("long")})
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), "collapsed_sha256",
    )
