"""Merkle fixity audit of WARC files.

Records are hashed; a leaf stands for the records of one id, and ranges of FAN_OUT neighbouring leaves, in the order of their offsets,
are hashed into a node with their lengths, those into nodes of the next level, up to one root for the whole collection. Replicas are
compared from the root down: only children of nodes that differ are looked at on the next level, which ends at single leaves. There
the records are compared by id and digest. A leaf has its place by id and a node covers lengths, not absolute offsets, so a record
that is lost or added anywhere in a file is located alone: what stands behind it isn't touched.

A record is intact if the replica has as many equal ones under its id; damaged if the replica has others under it; lost if it has
none. What only the replica has is added where all of ours under its id are intact, else it is what ours were damaged into. Leaves are combined by sums before they are shuffled and no node has more than FAN_OUT
children, so no task depends on a large group; places in a file are sums over slices of its leaves, then within slices.

Null url and html are empty. Records without id (returned as -1) are dealt by their digest to leaves of their own below zero. Equal rows are
equal records one after the other. Tables without rows give no records. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PER_FILE, FAN_OUT = 256, 16
#: Digits of a digest that name a slice of a leaf, and equal records that one row stands for before they are dealt out.
SLICE_DIGITS, COPIES = 3, 1 << 16
#: Leaves for records without id: so many hexadecimal digits of the digest name one.
NULL_DIGITS = 7


def record_head(url: Column, size: Column) -> Column:
    """The header block of a resource record."""
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row per record: id (null ids -1), leaf, length, digest (sha256 of the record)."""
    body, url = F.coalesce(F.col(body_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    record = F.concat(record_head(url, F.octet_length(body)), body, F.lit("\r\n\r\n"))
    hashed = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    own = -1 - F.conv(F.substring("digest", 1, NULL_DIGITS), 16, 10).cast("long")
    return hashed.select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("id", own).alias("leaf"), "length", "digest")


def placed(found: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """records (id, leaf, digest, length) with file, position and offset: files hold the records of `per_file` leaves in order.

    Equal records are one row until they are placed. Places are summed over the slices of a file's leaves (by the first digits of the
    digest: per_file * 4096 at most), then within each slice, so a leaf of any number of records is no task's alone.
    """
    before = lambda order, x: F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(x)
    kinds = found.groupBy("leaf", "digest").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("length").alias("length"))
    kinds = kinds.withColumns({"file": F.floor(F.col("leaf") / per_file).cast("long"), "slice": F.substring("digest", 1, SLICE_DIGITS), "bytes": F.col("n") * F.col("length")})
    slices = kinds.groupBy("file", "leaf", "slice").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    in_file, in_slice = Window.partitionBy("file").orderBy("leaf", "slice"), Window.partitionBy("leaf", "slice").orderBy("digest")
    slices = slices.select("leaf", "slice", before(in_file, "n").alias("n_before"), before(in_file, "bytes").alias("bytes_before"))
    rows = kinds.withColumns({"own_n": before(in_slice, "n"), "own_bytes": before(in_slice, "bytes")}).join(slices, ["leaf", "slice"])
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).hint("rebalance")
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("n")) - 1)))
    return rows.select(
        "id", "leaf", "length", "digest", "file", (F.col("n_before") + F.col("own_n") + F.col("k")).alias("position"), (F.col("bytes_before") + F.col("own_bytes") + F.col("k") * F.col("length")).alias("offset")
    )


def leaves(found: DataFrame, first: int) -> DataFrame:
    """(node, length, hash) of each leaf. The hash covers the number of records and the sums of their digests' quarters, which don't depend on order."""
    quarters = [F.sum(F.conv(F.substring("digest", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    content = F.concat_ws(":", F.count("*").cast("string"), *(q.cast("string") for q in quarters))
    return found.groupBy((F.col("leaf") - first).alias("node")).agg(F.sum("length").alias("length"), F.sha2(content, 256).alias("hash"))


def tree(found: DataFrame, first: int, last: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The (node, length, hash) of each level, the leaves first and the root last."""
    out = [common.stored(leaves(found, first), "leaves")]
    top = last - first
    while top > 0:
        child = F.struct(F.pmod("node", F.lit(fan_out)).alias("child"), "length", "hash")
        up = out[-1].groupBy(F.floor(F.col("node") / fan_out).cast("long").alias("node")).agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(child)).alias("c"))  # fan_out at most
        content = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["child"].cast("string"), c["length"].cast("string"), c["hash"])), ";")
        out.append(common.stored(up.select("node", "length", F.sha2(content, 256).alias("hash")), "nodes"))
        top //= fan_out
    return out


def mismatches(ours: DataFrame, theirs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The leaves in which two replicas differ, found from the root down."""
    extents = [x.agg(F.min("leaf").alias("a"), F.max("leaf").alias("b")).first() for x in (ours, theirs)]
    first = min((e["a"] for e in extents if e["a"] is not None), default=0)
    last = max((e["b"] for e in extents if e["b"] is not None), default=0)
    levels = [reversed(tree(x, first, last, fan_out)) for x in (ours, theirs)]
    suspects: DataFrame | None = None
    for mine, other in zip(*levels, strict=True):
        if suspects is not None:
            parents = suspects.withColumnRenamed("node", "parent")
            mine, other = (x.join(parents, F.floor(x["node"] / fan_out).cast("long") == parents["parent"], "left_semi") for x in (mine, other))
        sides = [x.select("node", F.struct("length", "hash").alias(side)) for x, side in ((mine, "ours"), (other, "theirs"))]
        pair = reduce(lambda a, b: a.join(b, "node", "full"), sides)
        suspects = common.stored(pair.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node"), "suspects")
    return suspects.select((F.col("node") + first).alias("leaf"))


def audit(ours: DataFrame, theirs: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The records of both replicas: id, file, position, offset, length, digest, status.

    Ours are intact, damaged or lost; those that only the other replica has are added, placed by id alone (no position or offset).
    """
    ours, theirs = common.stored(ours, "records"), common.stored(theirs, "records")
    bad = mismatches(ours, theirs)
    mine = ours.join(bad, "leaf", "left_semi").groupBy("leaf", "id", "digest").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    other = theirs.join(bad, "leaf", "left_semi").groupBy("leaf", "id", "digest").agg(F.count("*").alias("m"), F.first("length").alias("length"))
    held = other.select("leaf").distinct().withColumn("held", F.lit(True))
    both = mine.join(other.select("leaf", "digest", "m"), ["leaf", "digest"], "left").where("n > coalesce(m, 0)").join(held, "leaf", "left")
    found = both.select("leaf", "digest", F.when(F.col("held"), "damaged").otherwise("lost").alias("fault"))
    status = placed(ours, per_file).join(found, ["leaf", "digest"], "left").withColumn("status", F.coalesce("fault", F.lit("intact")))
    added = other.join(both.select("leaf").distinct(), "leaf", "left_anti").join(mine.select("leaf", "digest", "n"), ["leaf", "digest"], "left").where("m > coalesce(n, 0)").withColumn("file", F.floor(F.col("leaf") / per_file).cast("long"))
    place = [F.lit(None).cast("long").alias(c) for c in ("position", "offset")]
    more = added.select("id", "file", *place, "length", "digest", F.lit("added").alias("status"), F.explode(F.sequence(F.lit(1), (F.col("m") - F.coalesce("n", F.lit(0))).cast("int"))).alias("_k")).drop("_k")
    return status.select("id", "file", "position", "offset", "length", "digest", "status").unionByName(more)


def worn(pages: DataFrame) -> DataFrame:
    """A second replica as age may leave it: by the first digits of the url's checksum a record's body begins with a blank (0), it is lost (1f), or another one stands under its id (2f)."""
    sign = F.md5(F.coalesce("url", F.lit("")))
    aged = pages.withColumn("html", F.when((F.substring(sign, 1, 1) == "0") & (F.length("html") > 0), F.concat(F.lit(" "), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    added = pages.where(F.substring(sign, 1, 2) == "2f").withColumn("html", F.lit("added"))
    return aged.where(F.substring(sign, 1, 2) != "1f").unionByName(added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the table's archive, audited against a replica that wear has changed in places."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(records(pages), records(worn(pages))).withColumnRenamed("id", "page_id")


ORACLE_SQL = f"""
WITH framed AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substring(md5(coalesce(url, '')), 1, 2) AS sign FROM pages
), versions AS (
  SELECT page_id, url, html, sign, false AS only_there FROM framed
  UNION ALL SELECT page_id, url, 'added', sign, true FROM framed WHERE sign = '2f'
), hashed AS (
  SELECT page_id, html, sign, only_there, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM versions
), leaved AS (
  SELECT coalesce(page_id, -1) AS page_id, coalesce(page_id, -1 - ('0x' || substring(sha256(record), 1, {NULL_DIGITS}))::BIGINT) AS leaf, strlen(record) AS length, sha256(record) AS digest, only_there,
    CASE WHEN sign = '1f' THEN 'lost' WHEN substring(sign, 1, 1) = '0' AND html != '' THEN 'damaged' ELSE 'intact' END AS fate FROM hashed
)
SELECT page_id, floor(leaf / {PER_FILE})::BIGINT AS file, row_number() OVER w - 1 AS position, (sum(length) OVER w - length)::BIGINT AS "offset", length, digest, fate AS status
FROM leaved WHERE NOT only_there WINDOW w AS (PARTITION BY floor(leaf / {PER_FILE}) ORDER BY leaf, digest ROWS UNBOUNDED PRECEDING)
UNION ALL
SELECT page_id, floor(leaf / {PER_FILE})::BIGINT, NULL, NULL, length, digest, 'added' FROM leaved WHERE only_there
"""
