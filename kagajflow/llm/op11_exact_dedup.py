"""Exact dedup by two-pass Bloom filtering: only rows whose text may be repeated are shuffled.

Every text is read once for its SHA-256 digest; digests with the row's id and number are stored. The first pass sets PROBES bits of a
blocked Bloom filter for each digest and keeps the bits that more than one row sets (cells are combined before their shuffle, so a text
that a third of all rows hold is a cell for each task). The second pass looks each row's bits up: where one is missing no other row has
the text, and the row passes straight through. The others, the repeated and about one in 70 of the rest, are grouped by digest.

The filter takes ROW_BITS bits a row. What is broadcast of it never exceeds PART buckets of 4 KB; a larger corpus is taken in parts of
the hash range, one after the other, each with its own part of the filter. Groups that hold more than a share HOT of all rows are
broadcast (1 / HOT at most), the others meet their rows by a join on the digest. DataFrame functions only.

A null text counts as empty. Of equal texts the row with the largest id stays; a row without id stays only where no other has one, and
of rows that are equal in id and text one stays. An empty table gives no rows. Other columns aren't read, and `unique` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROBES, ROW_BITS = 2, 16
BUCKET_BITS = 1 << 15
#: Buckets of 4 KB that are broadcast at once: 64 MB, for 33 million rows.
PART = 1 << 14
#: Groups that hold a larger share of all rows are broadcast: at most 1 / HOT of them.
HOT = 1 / 4096


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def probes(sha: Column) -> list[Column]:
    """The bits of a digest within its bucket."""
    h = F.xxhash64(F.lit(1), sha)
    return [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BUCKET_BITS - 1)).cast("int") for k in range(PROBES)]


def buckets_for(rows: int) -> int:
    return max(1, -(-rows * ROW_BITS // BUCKET_BITS))


def bucket(sha: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(buckets)).cast("int")


def filter_bits(digests: DataFrame, buckets: int, times: int) -> DataFrame:
    """(bucket, words): the filter's bits that at least so many rows of digests (sha) set, as 64-bit words."""
    cells = digests.select(bucket(F.col("sha"), buckets).alias("bucket"), F.explode(F.array(*probes(F.col("sha")))).alias("bit"))
    cells = cells.groupBy("bucket", "bit").count().where(F.col("count") >= times)
    words = cells.groupBy("bucket", F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    by_word = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))  # BUCKET_BITS / 64 entries at most
    return by_word.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 64 - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("words"))


def marked(rows: DataFrame, bits: DataFrame, buckets: int, sha: str = "sha", name: str = "suspect") -> DataFrame:
    """rows with a column more: whether all bits of the digest are set. bits: PART buckets at most."""
    at, words = common.fresh(rows, "_bucket"), common.fresh(rows, "_words")
    joined = rows.join(F.broadcast(bits.toDF(at, words)), bucket(rows[sha], buckets) == F.col(at), "left")
    found = F.lit(True)
    for bit in probes(rows[sha]):
        found &= F.coalesce(F.getbit(F.get(words, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return joined.withColumn(name, found).drop(at, words)


def suspects(digests: DataFrame, part_buckets: int = PART) -> DataFrame:
    """Stored digests (sha, other columns) with suspect, taken in parts of the hash range."""
    buckets = buckets_for(digests.count())
    part = F.floor(bucket(F.col("sha"), buckets) / part_buckets)

    def parts():
        for k in range(-(-buckets // part_buckets)):
            own = digests.where(part == k)
            yield marked(own, common.stored(filter_bits(own, buckets, 2), "bits"), buckets)

    return common.stored_parts(parts(), "marked")


def groups_of(suspected: DataFrame) -> DataFrame:
    """(sha, group_size, last): the repeated digests among rows (sha, id, row), with the id and number of the row that stays."""
    groups = suspected.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("last"))
    return groups.where("group_size > 1")


def with_groups(rows: DataFrame, groups: DataFrame, total: int, sha: str = "sha", size: str = "group_size") -> DataFrame:
    """rows, left joined on their digest with groups (sha, size, other columns)."""
    hot = F.broadcast(groups.where(F.col(size) > HOT * total))
    cold = groups.where(F.col(size) <= HOT * total)
    return rows.join(hot, sha).unionByName(rows.join(hot.select(sha), sha, "left_anti").join(cold, sha, "left"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_buckets: int = PART) -> DataFrame:
    """For every row: id, keep_id, group_size, kept, text_sha256 (hex)."""
    digests = common.stored(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    rows = suspects(digests, part_buckets)
    one = F.struct("id", "row")
    alone = rows.where("not suspect").select("sha", "id", "row", F.lit(1).cast("long").alias("group_size"), one.alias("last"))
    suspected = rows.where("suspect").select("sha", "id", "row")
    grouped = with_groups(suspected, common.stored(groups_of(suspected), "groups"), digests.count())
    grouped = grouped.select("sha", "id", "row", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("last", one).alias("last"))
    both = alone.unionByName(grouped)
    return both.select(F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_buckets: int = PART) -> DataFrame:
    """docs, all columns, with one row of each text. A filter of the repeated digests lets all other rows pass without a move."""
    sha, suspect, size, last = (common.fresh(docs, c) for c in ("_sha", "_suspect", "group_size", "_last"))
    decided = exact_groups(docs, id_col, text_col, part_buckets).where("kept and group_size > 1")
    decided = common.stored(decided.select(F.unhex("text_sha256").alias("sha"), "group_size", F.col("keep_id").alias("last")), "kept")
    buckets = min(buckets_for(decided.count()), part_buckets)  # fuller where more are repeated: more rows are suspected, none is lost
    test = marked(docs.withColumn(sha, digest(docs[f"`{text_col}`"])), common.stored(filter_bits(decided, buckets, 1), "bits"), buckets, sha, suspect)
    total = decided.agg(F.sum("group_size")).first()[0] or 0
    rows = with_groups(test.where(F.col(suspect)), decided.toDF(sha, size, last), total, sha, size)
    alone, repeated = rows.where(F.col(size).isNull()), rows.where(F.col(size).isNotNull() & F.col(id_col).eqNullSafe(F.col(last)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return test.where(~F.col(suspect)).select(columns).union(alone.select(columns)).union(repeated.dropDuplicates([sha]).select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
