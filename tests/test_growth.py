"""What must not grow faster than the tables: plans and how rows are dealt."""

from compare import duck, same
from pyspark.sql import functions as F

from kagajflow.operators import chapters, matching, search
from kagajflow.plans import composites, sections

DATA = "/root/testdata/sf0.01"


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_topics_queries_and_clashes_do_not_meet_in_pairs(spark, data):
    rows = spark.createDataFrame([(1, 1, "en", 1), (1, 2, "en", 2), (2, 3, "en", 1), (3, 4, "de", 1), (4, 5, None, 1), (5, 6, "en", 1)], "query_id int, id int, book_id string, root int")
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "query_id int, topic string")
    clashes = spark.createDataFrame([("a", "en", 1), ("b", "en", 1), ("b", "de", 1), ("a", None, 1), (None, "en", 1)], "topic string, book_id string, root int")
    found = chapters.collisions_dropped(rows, queries, clashes)
    assert sorted(r["id"] for r in found.collect()) == [2, 3, 4, 5, 6]  # queries 2 and 3 would have none
    met = [line for line in logical(found).splitlines() if "Join" in line and "topic#" in line]
    assert met and all("root#" in line for line in met)
    same(composites.collisions(spark, DATA).toPandas(), duck(DATA).sql(composites.COLLISIONS).df())


def test_sections_are_put_together_once_before_they_meet_queries(spark, data):
    found = sections.collapsed(spark, DATA)
    lines = logical(found).splitlines()
    joins = [i for i, line in enumerate(lines) if "Join Inner" in line]
    assert joins and all(i > joins[0] for i, line in enumerate(lines) if "md5(" in line) and any("Join LeftSemi" in line for line in lines)
    same(found.toPandas(), duck(DATA).sql(sections.COLLAPSED).df())


def test_vectors_of_one_partition_are_scored_by_all_cores(spark, data, monkeypatch):
    rows = spark.range(4000).select("id", F.array(F.lit(1.0), F.col("id").cast("double"), F.lit(0.0)).alias("embedding"), F.lit("text").alias("content")).coalesce(1)
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    scored, whole = [], matching.nearest
    monkeypatch.setattr(matching, "nearest", lambda queries, corpus, *a, **b: scored.append(corpus) or whole(queries, corpus, *a, **b))
    assert [r["id"] for r in search.nearest(queries, rows, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    sizes = [r["count"] for r in scored[0].groupBy(F.spark_partition_id()).count().collect()]
    assert scored[0].columns == ["id", "embedding"] and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2000


def test_a_querys_chapters_are_not_put_together_with_all_their_chunks(spark, data):
    found = composites.leg(spark, DATA)
    lines = [line for line in logical(found).splitlines() if "Join" in line]
    met = [i for i, line in enumerate(lines) if "book_id#" in line and "chapter#" in line]
    assert len(met) == 1 and "Join LeftSemi" in lines[met[0]] and "query_id#" in lines[met[0]]  # of the targets only, by query
    same(found.toPandas(), duck(DATA).sql(composites.LEG).df())
