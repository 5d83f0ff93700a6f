"""The stored index: the same results as without it, updates by batch, and plans that read no more than the queries' terms."""

import re

import pytest
from pyspark.sql import functions as F

from kagajflow.operators import postings, search
from kagajflow.plans import catalog, retrieval
from kagajflow.sources.tables import fixture_chunks, table


def rows(df):
    return sorted(map(tuple, df.collect()))


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, content string")


@pytest.fixture()
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.write_batch(path, 0, corpus(spark, {1: "the cat and the hat", 2: "A hat", 3: None, 4: "cat, cat; cat"}))
    return path


def found(spark, path, *terms):
    queries = spark.createDataFrame([(0, list(terms))], "query_id long, terms array<string>")
    return {r["id"] for r in search.full_text(queries, postings.read(spark, path), 10).collect()}


def test_positions(spark, index):
    told = {(r["term"], r["id"]): r["positions"] for r in postings.read(spark, index).collect()}
    assert told[("the", 1)] == [0, 3] and told[("cat", 4)] == [0, 1, 2] and told[("hat", 2)] == [1] and len(told) == 7


def test_updates(spark, index):
    assert found(spark, index, "cat") == {1, 4} and found(spark, index, "cat", "hat") == {1}
    for _ in range(2):  # a batch written twice counts once
        postings.write_batch(index, 1, corpus(spark, {1: "a dog", 5: "cat hat"}), spark.createDataFrame([(4,)], "id long"))
        assert found(spark, index, "cat") == {5} and found(spark, index, "dog") == {1} and found(spark, index, "hat") == {2, 5}
    postings.write_batch(index, 2, corpus(spark, {4: "cat again"}))
    assert found(spark, index, "cat") == {4, 5}
    postings.compact(spark, index, f"{index}-2")
    assert rows(postings.read(spark, f"{index}-2").drop("bucket")) == rows(postings.read(spark, index).drop("bucket"))
    assert found(spark, f"{index}-2", "cat") == {4, 5}


def test_same_as_without_an_index(spark, data):
    queries = retrieval.term_queries(spark, data)
    stored = retrieval.chunk_words(spark, data)
    for mode in ("and", "or"):
        assert rows(search.full_text(queries, stored, 24, mode)) == rows(search.full_text(queries, fixture_chunks(spark, data), 24, mode))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_queries_postings_are_read(spark, data):
    plan = plan_of(retrieval.full_text_and(spark, data))
    scans = [line for line in plan.splitlines() if "FileScan parquet [term" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", s) and re.search(r"PushedFilters: \[[^\]]*term", s) for s in scans)
    lines = plan.splitlines()
    above = [lines[i - 1] for i, line in enumerate(lines) if "FileScan" in line and ",text#" in line]
    assert above and all("% 100) = 0" in line for line in above)  # texts are read of the queries alone


def test_cross_book_shuffles_no_pairs(spark, data):
    """The pairs are filtered by the join that makes them."""
    joins = [line for line in plan_of(catalog.queries()["cross_book_v2"](spark, data)).splitlines() if "NestedLoopJoin" in line or "Cartesian" in line]
    assert len(joins) == 1 and re.search(r"Cross, \(\(parichhed_no#\d+ = 1\) OR ", joins[0])


def test_blocks_are_written_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH", 3)
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    rows_ = spark.range(30).select("id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("embedding"))
    some = search.nearest(queries, rows_, 2)
    assert some.count() == 40 and plan_of(some).count("FileScan") == 1


def test_terms_beyond_those_named(spark, data, monkeypatch):
    want = rows(search.full_text(retrieval.term_queries(spark, data), retrieval.chunk_words(spark, data), 24))
    monkeypatch.setattr(postings, "NAMED", 1)
    assert rows(search.full_text(retrieval.term_queries(spark, data), retrieval.chunk_words(spark, data), 24)) == want
    assert table(spark, data, "documents").count() == 200


def test_an_index_that_is_gone_is_built_again(spark, data, tmp_path, monkeypatch):
    from kagajflow.sources import tables

    want = tables.chunk_words(spark, data).count()
    monkeypatch.setattr(tables, "INDEXES", {key: str(tmp_path / "gone") for key in tables.INDEXES})
    assert tables.chunk_words(spark, data).count() == want and not any(p.endswith("gone") for p in tables.INDEXES.values())
