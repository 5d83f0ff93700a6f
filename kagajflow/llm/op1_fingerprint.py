"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests.

A text is cut at line ends and, within long lines, behind sentences. The pieces' digests (each once) are dealt by hash into
shards of at most about SHARD, a power of two of them (most texts are one), and each shard is a sketch: cells in three tables, each
the xor of its digests, of which some bits check the others. Only filled cells are kept, so a fingerprint grows in proportion to
its text and work does too, whatever the tables' width.

Sketches of two versions subtract cell by cell, and peeling recovers the digests in which they differ: a cell with one digest gives
it away, it leaves its other cells, and so on. Where a shard is too full to be peeled it is tried again with larger tables, whose
cells are hashed afresh; behind the largest stands a plain comparison of the two shards' digests. A fingerprint is made the same way,
as a difference from nothing: each of its shards has the smallest tables from which all of its own digests can be peeled. Thus a
fingerprint by itself gives back its digests, any two of them can be brought to a common size, and what is returned as likeness
follows from the two strings alone: (|A| + |B| - d) / (|A| + |B| + d) for d recovered digests, the share of the digests that both
have; 1 for two texts without any.

The string has the number of digests, then each shard's table width and cells (place and xor in hex); a shard that no size could hold has width 0 and a cell for each digest. DataFrame functions only.

Null text is empty. Documents follow each other by id, then by text hash; a repeated row is one document and returned as often as
it occurs. Null ids come first. An empty table gives no rows; a single document is its own next. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A piece: 32 characters of a line or what it has, and on to the end of the sentence, 160 more at most.
PIECE = r"[^\n]{1,32}[^\n.!?]{0,160}[.!?]*"
TABLES, SHARD = 3, 64
#: Tables are powers of two wide, this at least, and at least ROOM times as wide as digests are likely to differ; every further attempt doubles them, up to WIDEST.
LEAST, ROOM, ATTEMPTS = 8, 1.0, 3
ROUNDS, LEVEL = 24, 64
#: A digest has HASH bits of hash and CHECK bits that check them; a cell is its place above them and the xor of its digests.
HASH, CHECK = 37, 16
BITS = HASH + CHECK
#: The widest table: the places of all tables fit above BITS.
WIDEST = 512
MASK = (1 << BITS) - 1
CELLS = "array<bigint>"


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: checked(F.xxhash64(p))))


def checked(hashed: Column) -> Column:
    """The digest of a hash."""
    high = F.shiftleft(hashed.bitwiseAND(F.lit((1 << HASH) - 1)), CHECK)
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit((1 << CHECK) - 1)))


# The arithmetic of cells is SQL text: nested lambdas built of Column objects are planned and evaluated much slower.


def cells_of(digest: str, width: str) -> str:
    """The cells of one digest, one in each table; every width hashes them afresh."""
    return f"array({', '.join(f'shiftleft(pmod(xxhash64({digest}, {width}, {t}), {width}) + {t} * {width}, {BITS}) | {digest}' for t in range(TABLES))})"


def added(cells: str) -> str:
    """Cells at the same place xored; empty ones left out."""
    place = lambda c: f"shiftrightunsigned({c}, {BITS})"
    many = f"aggregate(slice(s, i + 2, coalesce(get(t, j + 1), size(s)) - i - 1), s[i], (a, c) -> a ^ (c & {MASK}))"
    sums = f"transform(t, (i, j) -> CASE WHEN coalesce(get(t, j + 1), size(s)) - i = 1 THEN s[i] ELSE {many} END)"
    starts = f"filter(sequence(0, size(s) - 1), i -> i = 0 OR {place('s[i]')} <> {place('s[i - 1]')})"
    runs = f"transform(array({starts}), t -> filter({sums}, c -> c & {MASK} <> 0))[0]"
    return f"transform(array(sort_array({cells})), s -> CASE WHEN size(s) = 0 THEN s ELSE {runs} END)[0]"


def sketch(values: str, width: str) -> str:
    """The filled cells of digests, in order."""
    return added(f"flatten(transform({values}, d -> {cells_of('d', width)}))")


def subtract(a: str, b: str) -> str:
    """The cells of what is in one of two sketches only: xor takes away what is in both."""
    return added(f"concat({a}, {b})")


def peel(cells: str, width: str) -> str:
    """How many digests the cells hold, found by peeling; null if they are too full.

    What isn't a digest but passed for one had to be taken back, so it was found twice.
    """
    key = f"(c & {MASK})"
    high = f"shiftleft(shiftright({key}, {CHECK}), {CHECK})"
    is_digest = f"({high} | (xxhash64({high}) & {(1 << CHECK) - 1})) = {key} AND array_contains({cells_of(key, width)}, c)"
    pure = f"array_distinct(transform(filter(p.cells, c -> {is_digest}), c -> {key}))"
    rest = added(f"concat(p.cells, flatten(transform(g, e -> {cells_of('e', width)})))")
    step = f"transform(array({pure}), g -> named_struct('cells', {rest}, 'found', concat(p.found, g), 'done', size(g) = 0))[0]"
    start = f"named_struct('cells', {cells}, 'found', cast(array() AS array<bigint>), 'done', false)"
    whole = "CASE WHEN size(p.cells) = 0 AND size(array_distinct(p.found)) = size(p.found) THEN size(p.found) END"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (p, k) -> CASE WHEN p.done OR size(p.cells) = 0 THEN p ELSE {step} END, p -> {whole})"


def peeled(rows: DataFrame) -> DataFrame:
    """rows (left, right: digests of a shard in two versions; likely: how many differ) with width and cells of the first sketches whose difference can be peeled, and found, how many digests differ."""
    first = F.greatest(F.lit(LEAST), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("likely"), F.lit(1)) * ROOM))).cast("int"))
    rows = rows.withColumns({"found": F.lit(None).cast("int"), "cells": F.array().cast(CELLS), "width": F.least(first, F.lit(WIDEST))})
    for attempt in range(ATTEMPTS):
        if attempt:
            rows = rows.withColumn("width", F.when(F.col("found").isNull(), F.least(F.col("width") * 2, F.lit(WIDEST))).otherwise(F.col("width")))
        difference = f"CASE WHEN size(right) = 0 THEN {sketch('left', 'width')} ELSE {subtract(sketch('left', 'width'), sketch('right', 'width'))} END"
        rows = rows.withColumn("cells", F.expr(f"CASE WHEN found IS NULL THEN {difference} ELSE cells END"))
        rows = rows.withColumn("found", F.expr(f"CASE WHEN found IS NULL THEN {peel('cells', 'width')} ELSE found END"))
    either = F.concat(F.array_except("left", "right"), F.array_except("right", "left"))
    known = F.col("found").isNotNull()
    rows = rows.withColumn("either", F.when(known, F.array().cast(CELLS)).otherwise(either))
    return rows.withColumns({"cells": F.when(known, F.col("cells")).otherwise(F.col("either")), "width": F.when(known, F.col("width")).otherwise(0), "found": F.coalesce("found", F.size("either"))}).drop("either")


def shards_for(values: Column) -> Column:
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)) / SHARD)))).cast("int")


def split(values: str, shards: str) -> str:
    """The digests by shard, in two levels of LEVEL and more: work stays in proportion to their number."""
    shard = f"pmod(xxhash64(d, 'shard'), {shards})"
    groups = f"transform(sequence(0, greatest({shards} div {LEVEL}, 1) - 1), g -> filter({values}, d -> {shard} div {LEVEL} = g))"
    inside = f"transform(sequence(0, least({shards}, {LEVEL}) - 1), s -> filter(x, d -> pmod({shard}, {LEVEL}) = s))"
    return f"CASE WHEN {shards} = 1 THEN array({values}) ELSE flatten(transform({groups}, x -> {inside})) END"


def sharded(kind: str, left: str, right: str | None, shards: str) -> str:
    """The shards of one or two columns of digests, as (kind, shard, left, right, likely). An edit is likely to change half, a next document shares nothing as a rule."""
    other = split(right, shards) if right else f"array_repeat(cast(array() AS array<bigint>), {shards})"
    pairs = f"zip_with({split(left, shards)}, {other}, (a, b) -> named_struct('left', a, 'right', b))"
    likely = "size(p.left) + size(p.right)" if kind == "next" else "greatest(size(p.left), size(p.right))"
    return f"transform({pairs}, (p, i) -> named_struct('kind', '{kind}', 'shard', i, 'left', p.left, 'right', p.right, 'likely', {likely}))"


def encoded(n: str, kind: str) -> Column:
    cells = F.expr(f"transform(cells, c -> concat(shiftrightunsigned(c, {BITS}), '.', lower(hex(c & {MASK}))))")
    shard = F.concat(F.col("width").cast("string"), F.lit("="), F.array_join(cells, ","))
    each = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("shard", shard.alias("text")))))
    return F.concat_ws(":", F.first(n).cast("string"), F.array_join(F.transform(each, lambda s: s["text"]), ";"))


def likeness(a: str, b: str, kind: str) -> Column:
    both = F.first(a) + F.first(b)
    d = F.sum(F.when(F.col("kind") == kind, F.col("found")).otherwise(0))
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def neighbours(keys: DataFrame) -> DataFrame:
    """keys (id, h, n) with before (id, h, n), the document before in order; the last one before the first.

    Only ids move: they are range-partitioned, and of each partition its last document alone meets those of the others.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.stored(keys.repartitionByRange(partitions, "id", "h").withColumn("part", F.spark_partition_id()), "ids")
    me = F.struct("id", "h", "n")
    lasts = ranged.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull(), "id", "h", "n")).alias("m")).select("part", F.struct("m.id", "m.h", "m.n").alias("last"))
    by_part = Window.orderBy("part")  # as many rows as partitions
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("earlier"))
    inside = F.lag(me).over(Window.partitionBy("part").orderBy(F.asc_nulls_first("id"), "h"))
    return ranged.withColumn("inside", inside).join(lasts, "part").select("id", "h", F.coalesce("inside", "earlier").alias("before"))


def key_of(id_col: str, h: str) -> Column:
    """A row's id and hash as one string, never null."""
    return F.concat_ws(":", F.hex(h), F.col(id_col).cast("string"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    keys = common.stored(docs.select("id", "h", F.length("text").alias("n")), "keys")
    single = keys.distinct()
    repeats = not keys.groupBy("id", "h").count().where("count > 1").isEmpty()
    if repeats:
        docs = docs.groupBy("id", "text", "h").agg(F.count("*").cast("int").alias("copies"))
    before = neighbours(single if repeats else keys).select(key_of("id", "h").alias("key"), "before")
    # The number of partitions is given, as little data means much work here.
    docs = docs.select(key_of("id", "h").alias("key"), "text", *(["copies"] if repeats else [])).repartition(partitions, "key")  # one shuffle, used twice
    head = F.substring("text", F.lit(1), F.floor(F.col("before.n") / 2).cast("int")).alias("head")
    given = docs.join(before, "key").select(key_of("before.id", "before.h").alias("key"), F.col("before.id").alias("id"), head, digests(F.col("text")).alias("next"))
    both = docs.join(given.repartition(partitions, "key"), "key")
    n = F.length("text")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "head"))
    facts = [n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), F.col("next")]
    carried = ["key", "id", *(["copies"] if repeats else [])]
    both = both.select(*carried, F.explode(F.array(F.struct(*facts))).alias("x")).select(*carried, "x.*")
    kinds = (("own", "own", None), ("changed", "changed", None), ("edited", "own", "changed"), ("next", "own", "next"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("own", "changed", "next")]
    kept = ["key", "id", "n_chars", "sha", *(["copies"] if repeats else [])]
    both = both.withColumns({f"k_{c}": shards_for(F.col(c)) for c in ("own", "changed", "next")})
    shards = [f"greatest(k_{left}, k_{right})" if right else f"k_{left}" for _, left, right in kinds]
    jobs = ", ".join(sharded(*kind, k) for kind, k in zip(kinds, shards, strict=True))
    rows = both.select(*kept, *sizes, F.expr(f"explode(concat({jobs}))").alias("s")).select(*kept, "n_own", "n_changed", "n_next", "s.*")
    out = (
        peeled(rows).groupBy("key")  # all rows of a key come from one row in one partition
        .agg(
            *(F.first(c).alias(c) for c in kept[1:]), encoded("n_own", "own").alias("fingerprint"), encoded("n_changed", "changed").alias("edited_fingerprint"),
            likeness("n_own", "n_changed", "edited").alias("near_edited"), likeness("n_own", "n_next", "next").alias("near_next"),
        )
    )
    if repeats:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
