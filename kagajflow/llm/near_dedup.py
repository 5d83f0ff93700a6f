"""Near-dedup of documents: operator 8's trie join on wide fingerprints proposes pairs, their shingle sets decide.

SimHash bits of two texts differ in proportion to the angle between their shingle sets. A similarity of 0.8 lets 15 % of the bits
differ, too many for pruning over a whole corpus; so rows first meet in blocks: each document in those of its ANCHORS smallest
shingle hashes, of which texts with that similarity share nearly all. In a block the trie of 512-bit fingerprints is joined with
itself within BUDGET, six standard deviations beyond what a similarity of 0.8 lets differ on average (sets of four and five
shingles, whose bits differ most: three and a half).

What is connected so far is a group of candidates. Their texts are read again, and two of a group are linked only where they are
within BUDGET and their sets of shingles (64-bit hashes) have a similarity of SIMILARITY or more. Texts so alike have set sizes
within that ratio: a block of many texts (a shingle of boilerplate) falls apart by bands of sizes. A block or group beyond SLICE
documents (a group also beyond WEIGHT shingles) is dealt in slices, every pair of slices to a task of its own, so all its pairs
are looked at whatever its size. Equal texts are one node from the start; tasks return connecting links only.

Nodes are texts, not ids: texts that share an id are told apart. Of a class the row with the smallest id stays, a row without id
only where no other has one; of different texts with that id the one with the smallest hash; of equal rows one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .components import components
from .op8_simhash import pairs_within, roots_of, shingle_hashes

SHINGLE, WORDS, BUDGET, SIMILARITY = 5, 8, 128, 0.8
ANCHORS, WEIGHT = 8, 1 << 21
#: Sizes of sets that are so alike are in one band or in neighbouring ones.
BAND = math.log(1 / (SIMILARITY - 0.01))
CHUNK = 1 << 14


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes, by a 64-bit finalizer."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(data: bytes) -> np.ndarray:
    """The different shingles' hashes, in order."""
    found = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(data, SHINGLE):
        found = np.unique(np.concatenate([found, hashes]))
    return found


def sketch(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(the fingerprint's words, the smallest shingle hashes, the number of shingles) of a text; each shingle counts once."""
    found = shingle_set(data)
    votes = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK]
        for k in range(WORDS):
            votes[k] += np.unpackbits(mixed(part, k + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(found), axis=1, bitorder="little").view("<u8").ravel(), found[:ANCHORS], len(found)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h, bits, anchors, size of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8_of(batch.column(2))
            at = at.tolist()
            found = [sketch(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            bits, anchors = (pa.array([x[k].view(np.int64) for x in found], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits, anchors, pa.array([x[2] for x in found], pa.int64())], names=["doc_id", "h", "bits", "anchors", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(common.row_key().alias("k"), F.col("text").cast("string").alias("text")).select("k.doc_id", "k.h", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h long, bits array<long>, anchors array<long>, size long")


def group_links(keys: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, budget: int) -> blocks.Links:
    """Links that connect, within each group of rows, nodes whose keys are near."""
    out_a, out_b = [], []
    size = np.diff(bounds)
    for low, high in zip(bounds[:-1][size > 1].tolist(), bounds[1:][size > 1].tolist(), strict=True):
        part, own = keys[low:high], nodes[low:high]
        if len(own) == 2:
            near = np.bitwise_count(part[0] ^ part[1]).sum() <= budget
            if near:
                out_a.append(own[:1])
                out_b.append(own[1:])
            continue
        order = np.lexsort(part.T[::-1])
        part, own = part[order], own[order]
        root = roots_of(len(own), pairs_within(part, 0, [(0, len(own), 0, len(own))], budget, leaf=1024))
        hung = np.flatnonzero(root != np.arange(len(own)))
        out_a.append(own[root[hung]])
        out_b.append(own[hung])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else blocks.NONE


def alike_links(keys: np.ndarray, nodes: np.ndarray, shingles: np.ndarray, at: np.ndarray, budget: int, similarity: float) -> blocks.Links:
    """Links that connect, of one group, the nodes whose keys are near and whose sets, shingles[at[i]:at[i + 1]], are alike."""
    order = np.lexsort(keys.T[::-1])
    keys, nodes, first, size = keys[order], nodes[order], at[:-1][order], np.diff(at)[order]
    names = np.unique(shingles, return_inverse=True)[1]
    marked, root = np.zeros(len(names), bool), np.arange(len(nodes))
    for i, j in pairs_within(keys, 0, [(0, len(nodes), 0, len(nodes))], budget, leaf=1024):
        # sets whose sizes differ by more can't be so alike
        maybe = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        by = np.argsort(i[maybe], kind="stable")
        i, j = i[maybe][by], j[maybe][by]
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for x, others in zip(i[cuts].tolist(), np.split(j, cuts[1:]), strict=False):
            others = others[root[others] != root[x]]
            if not len(others):
                continue
            own, n = names[first[x] : first[x] + size[x]], size[others]
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(first[others] - (ends - n), n)
            marked[own] = True
            shared = np.add.reduceat(marked[names[places]], ends - n, dtype=np.int64)
            marked[own] = False
            alike = others[shared * (1 + similarity) >= similarity * (size[x] + n) - 1e-9]
            if len(alike):
                joined = np.unique(root[np.append(alike, x)])
                root[np.isin(root, joined)] = joined[0]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[hung]], nodes[hung]


def bits_of(part: pa.Table) -> np.ndarray:
    return part.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def block_links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) between nodes (node, bits, anchors, size) that share an anchor and differ in at most `budget` bits, of sizes that allow SIMILARITY."""
    rows = nodes.select("node", "bits", F.explode("anchors").alias("anchor"), F.floor(F.log(F.greatest("size", F.lit(1))) / BAND).cast("int").alias("band"))
    hot = rows.groupBy("anchor").count().where(F.col("count") > blocks.SLICE).select("anchor", F.lit(True).alias("hot"))
    bands = F.when(F.col("hot"), F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))
    rows = rows.join(hot, "anchor", "left").select("node", "bits", "anchor", F.explode(bands).alias("band"))

    def links(part: pa.Table, bounds: np.ndarray) -> blocks.Links:
        return group_links(bits_of(part), part.column("node").to_numpy(), bounds, budget)

    return blocks.linked(blocks.dealt(rows, ["anchor", "band"]), ["anchor", "band"], links)


def set_links(texts: DataFrame, budget: int = BUDGET, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of the same group of candidates (node, grp, i, j, bits, text) whose shingle sets are alike."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.utf8_of(batch.column(0))
            at = at.tolist()
            found = [shingle_set(data[a:b].tobytes()).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], names=["grp", "places", "node", "bits", "shingles"])

    def links(part: pa.Table, bounds: np.ndarray) -> blocks.Links:
        keys, nodes, column = bits_of(part), part.column("node").to_numpy(), part.column("shingles").combine_chunks()
        at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        shingles = column.flatten().to_numpy()
        found = [alike_links(keys[a:b], nodes[a:b], shingles[at[a] : at[b]], at[a : b + 1] - at[a], budget, similarity) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > 1]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else blocks.NONE

    rows = texts.select("text", "grp", "places", "node", "bits").mapInArrow(sets, "grp long, places array<struct<i:int,j:int>>, node long, bits array<long>, shingles array<long>")
    rows = rows.select("grp", F.explode("places").alias("p"), "node", "bits", "shingles").select("grp", "p.i", "p.j", "node", "bits", "shingles")
    return blocks.linked(rows, ["grp"], links)


def keepers(docs: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, bool]:
    """(doc_id, h) of the row that stays of each class of near duplicates, and whether equal rows repeat.

    Classes are found and reduced on different texts, each known by one of its rows, so copies are never dealt by their class.
    """
    rows = common.stored(sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")
    nodes = rows.groupBy("h", "bits").agg(first, F.first("anchors").alias("anchors"), F.first("size").alias("size"))
    nodes = common.stored(nodes.select(F.monotonically_increasing_id().alias("node"), "h", "m.doc_id", "bits", "anchors", "size"), "texts")
    groups = components(block_links(nodes.select("node", "bits", "anchors", "size"), budget)).withColumnRenamed("root", "grp")
    places = blocks.dealt(nodes.join(groups, "node").select("grp", "node", "doc_id", "h", "bits", "size"), ["grp"], "size", WEIGHT)
    places = places.groupBy("node").agg(*(F.first(c).alias(c) for c in ("doc_id", "h", "grp", "bits")), F.collect_list(F.struct("i", "j")).alias("places"))
    repeats = not rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    texts = docs.select(common.row_key().alias("k"), F.col("text").cast("string").alias("text")).select("k.doc_id", "k.h", "text")
    if repeats:
        texts = texts.dropDuplicates()
    places = common.stored(places, "candidates").withColumnsRenamed({"doc_id": "_id", "h": "_h"}).hint("merge")
    texts = texts.join(places, texts["doc_id"].eqNullSafe(places["_id"]) & (texts["h"] == places["_h"]))
    roots = components(set_links(texts, budget))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min(order).alias("m"))
    return common.stored(kept.select("m.doc_id", "m.h"), "keepers"), repeats


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates (five words, similarity 0.8)."""
    kept, repeats = keepers(docs)
    if repeats:  # of rows with the same id and text one stays
        docs = docs.dropDuplicates(["doc_id", "text"])
    return common.with_rows(docs, kept)
