"""A stored inverted index: which rows have a term, and where.

Postings (term, id, positions) are made of each row by itself, without a shuffle of its words, and written in BUCKETS folders by the
term's hash, sorted by term, so a search reads the folders and row groups of its terms alone. A term of many rows is spread over several
files of its folder. An update writes the postings of a batch of rows under the batch's number; of a row only the postings of its
last batch are read, and none if that removed it. Writing a batch again leaves the index as it is. `compact` rewrites it as one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

BUCKETS = 64


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def of(corpus: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(term, id, positions) of corpus: each different word of a row once, with its places (from 0) in order."""
    placed = F.array_sort(F.transform(tokens(F.col(text_col)), lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))
    firsts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i)["term"] != F.get("w", i - 1)["term"]))

    def posting(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("firsts", n + 1), F.size("w"))
        return F.struct(F.get("w", start)["term"].alias("term"), F.transform(F.slice("w", start + 1, end - start), lambda x: x["pos"]).alias("positions"))

    rows = corpus.select(F.col(id_col).alias("id"), placed.alias("w")).where(F.size("w") > 0).select("id", "w", firsts.alias("firsts"))
    return rows.select("id", F.explode(F.transform("firsts", posting)).alias("p")).select("p.term", "id", "p.positions")


def write_batch(path: str, batch: int, corpus: DataFrame, removed: DataFrame | None = None) -> None:
    """Writes the postings of a batch of rows (id, content) and of what it removes (id). Batches are numbered upwards."""
    spark = corpus.sparkSession
    ids = corpus.select("id", F.lit(False).alias("removed"))
    if removed is not None:
        ids = ids.unionByName(removed.select("id", F.lit(True).alias("removed")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, partitions // BUCKETS)))
    rows = of(corpus).withColumn("bucket", bucket_of(F.col("term"))).repartition(partitions, "bucket", spread).sortWithinPartitions("bucket", "term", "id")
    options = {"partitionOverwriteMode": "dynamic"}  # a batch that is written again replaces itself
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").options(**options).partitionBy("batch", "bucket").parquet(f"{path}/postings")
    ids.withColumn("batch", F.lit(batch)).write.mode("overwrite").options(**options).partitionBy("batch").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(term, id, positions, bucket) of the rows as they are after the last batch."""
    postings = spark.read.schema("term string, id long, positions array<int>, batch int, bucket int").parquet(f"{path}/postings")
    rows = spark.read.schema("id long, removed boolean, batch int").parquet(f"{path}/rows")
    batches = [r["batch"] for r in rows.select("batch").distinct().collect()]
    if len(batches) < 2:  # nothing has been updated since it was built
        return postings.drop("batch")
    live = rows.groupBy("id").agg(F.max_by("removed", "batch").alias("removed"), F.max("batch").alias("batch")).where("not removed")
    return postings.join(live.select("id", "batch"), ["id", "batch"], "left_semi").select("term", "id", "positions", "bucket")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The index as one batch in another folder."""
    live = read(spark, path)
    live.repartition("bucket").sortWithinPartitions("bucket", "term", "id").withColumn("batch", F.lit(0)).write.partitionBy("batch", "bucket").parquet(f"{target}/postings")
    live.select("id", F.lit(False).alias("removed"), F.lit(0).alias("batch")).distinct().write.partitionBy("batch").parquet(f"{target}/rows")


#: Terms that a search names in its filter; more of them meet the postings by a join on bucket and term.
NAMED = 1000


def of_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """postings (with their bucket, if stored) of the given terms (term, ...) alone: only their folders and row groups are read."""
    found = terms.select("term", bucket_of(F.col("term")).alias("b")).distinct().limit(NAMED + 1).collect()
    if len(found) > NAMED:
        return postings
    some = postings.where(F.col("term").isin([r["term"] for r in found]))
    if "bucket" in postings.columns and found:
        some = some.where(F.col("bucket").isin(sorted({r["b"] for r in found})))
    return some
