"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

Equal fingerprints are one node from the start. Two that differ in at most `budget` bits agree in one of budget + 1 runs of bits.
For each run there is a trie with that run's bits first; its subtrees below the run are dealt to tasks, so a fingerprint goes to
budget + 1 of them whatever the table's size, and large subtrees in pairs of slices (`blocks`). There pairs of nodes are traversed
together, level by level; differing bits add up, and a pair that exceeds the budget is pruned with all that hangs below it. A task
returns links that connect what it found, never all pairs, and the components of all links give the classes.

Null and empty texts have fingerprint zero and link like any other. Repeated rows are rows of one class; a row without id takes
part, and a class without any id has none. An empty table gives no rows. Only the id and text columns are read. Texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

SHINGLE, BITS, SEED = 3, 2, 42
CHUNK = 1 << 16


def word_chunks(data: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of lower-cased text in runs of bounded size, each beginning with the last shingle - 1 words of the one before."""
    tail: list[bytes] = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + (1 << 20))
        while end < n and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        tail += data[at:end].lower().split()
        at = end
        if len(tail) >= shingle:
            yield tail
            tail = tail[len(tail) - shingle + 1 :]
    if tail:
        yield tail


def shingle_hashes(data: bytes, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included; of the whole sequence where it has fewer words."""
    any_full = False
    for words in word_chunks(data, shingle):
        if len(words) >= shingle:
            any_full = True
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            yield np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
        elif not any_full:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def simhash(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    votes, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle, seed):
        for k in range(0, len(hashes), CHUNK):
            part = hashes[k : k + CHUNK]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8_of(batch.column(1))
            at = at.tolist()
            prints = np.fromiter((simhash(data[a:b].tobytes(), shingle) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def pairs_within(keys: np.ndarray, depth: int, starts: list[tuple[int, int, int, int]], budget: int, leaf: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sorted keys (rows of 64-bit words) that differ in at most `budget` bits, by traversing node pairs of their trie together.

    A node is a range of keys that agree in their first `depth` bits; starts are pairs of such ranges. Where a pair has few
    keys on both sides its keys are compared at once.
    """
    words = keys.shape[1]
    ones: dict[int, np.ndarray] = {}  # by depth: how many of the first i keys have that bit set

    def split(d: int, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        """In each range, where the keys with the bit begin."""
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum(keys[:, d // 64] >> np.uint64(63 - d % 64) & np.uint64(1), dtype=np.int64)])
        return x1 - (ones[d][x1] - ones[d][x0])

    rows = np.array(starts, np.int64).reshape(-1, 4)
    bits = np.bitwise_count((keys[rows[:, 0], 0] ^ keys[rows[:, 2], 0]) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(rows), np.int64)
    stack = [(depth, *rows.T, bits)]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > CHUNK // 8:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, bits))), (depth, *(x[half:] for x in (a0, a1, b0, b1, bits)))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (depth == 64 * words)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            wide = t1 - t0
            size = (s1 - s0) * wide
            row = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            i, j = s0[row] + k // wide[row], t0[row] + k % wide[row]
            near = ((s0[row] != t0[row]) | (i < j)) & (sum(np.bitwise_count(keys[i, w] ^ keys[j, w]).astype(np.int64) for w in range(words)) <= budget)
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a0, a1, b0, b1, bits = (x[~small] for x in (a0, a1, b0, b1, bits))
        am, bm = split(depth, a0, a1), split(depth, b0, b1)
        same = a0 == b0
        children = [(a0, am, b0, bm, bits, None), (am, a1, bm, b1, bits, None), (a0, am, bm, b1, bits + 1, None), (am, a1, b0, bm, bits + 1, ~same)]
        parts = []
        for x0, x1, y0, y1, d, only in children:
            keep = (x1 > x0) & (y1 > y0) & (d <= budget)
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (x0, x1, y0, y1, d)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def roots_of(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item that it reaches over the links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def runs_of(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, number of bits) of budget + 1 runs that cover the fingerprint."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def subtree_links(keys: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, run: tuple[int, int], budget: int) -> blocks.Links:
    """Links that connect, within each group of fingerprints that agree in the run, those that are near."""
    first, depth = run
    if first:
        keys = keys << np.uint64(first) | keys >> np.uint64(64 - first)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort([keys, group])
    keys, nodes = keys[order], nodes[order]
    starts = [(a, b, a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > 1]
    if not starts:
        return blocks.NONE
    root = roots_of(len(keys), pairs_within(keys[:, None], depth, starts, budget))
    hung = np.flatnonzero(root != np.arange(len(keys)))
    return nodes[root[hung]], nodes[hung]


def trie_links(prints: DataFrame, budget: int = BITS) -> DataFrame:
    """Links (a, b) between the nodes of prints (node, fp; each fp once) that connect all whose fp differ in at most `budget` bits."""
    runs = runs_of(budget)
    subtree = [F.struct(F.lit(k).alias("run"), F.shiftrightunsigned(F.shiftleft("fp", a), 64 - n).alias("top")) for k, (a, n) in enumerate(runs)]
    rows = prints.select("node", "fp", F.explode(F.array(*subtree)).alias("s")).select("node", "fp", "s.run", "s.top")

    def links(part: pa.Table, bounds: np.ndarray) -> blocks.Links:
        keys, nodes, run = part.column("fp").to_numpy().view(np.uint64), part.column("node").to_numpy(), part.column("run").to_numpy()[bounds[:-1]]
        found = []
        for k in np.unique(run).tolist():  # groups come in order of their run
            low, high = np.searchsorted(run, k), np.searchsorted(run, k, "right")
            a, b = bounds[low], bounds[high]
            found.append(subtree_links(keys[a:b], nodes[a:b], bounds[low : high + 1] - a, runs[k], budget))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return blocks.linked(blocks.dealt(rows, ["run", "top"]), ["run", "top"], links)


def classes(prints: DataFrame, budget: int = BITS, id_col: str = "doc_id") -> DataFrame:
    """prints (id, fp) with component_id, the smallest id that a row reaches."""
    nodes = prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")).where("node is not null")
    nodes = common.stored(nodes, "fingerprints")
    roots = components(trie_links(nodes, budget))
    by_print = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(by_print, "fp", "left").select(id_col, "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = common.stored(fingerprints(common.table(spark, sf_dir, "documents")), "simhash")
    return classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
