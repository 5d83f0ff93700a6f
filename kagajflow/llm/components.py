"""Connected components of links between integers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links (a, b), the smallest node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour; the links end as stars around
    the roots after some log(n) rounds. A round is two joins with a pre-aggregated minimum, so a node with many links loads no
    single task, and its result is written to the shared folder.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links, before = common.stored(links, "links"), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a")).distinct()
        before = state
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("s")).select("s.a", "s.b")
        last, links = links, common.stored(small.where("a < b").distinct(), "links")
        common.remove(links.sparkSession, last.inputFiles()[0].rpartition("/")[0])  # nothing reads the round before any more
