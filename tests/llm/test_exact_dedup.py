"""Exact dedup: against SQL, in several parts of the hash range, and keeping whole rows."""

import hashlib

import pytest
from compare import duck, same

from kagajflow.llm import common, op11_exact_dedup as exact


def test_against_duckdb(spark, data):
    same(exact.query(spark, data).toPandas(), duck(data).sql(exact.ORACLE_SQL).df())


@pytest.fixture(scope="module")
def rows(spark):
    """9000 texts, a third of them one text, others held by two or three rows, ids in no order."""
    texts = [(i * 7919 % 9000, "hot" if i % 3 == 0 else f"text {i % 4000}" if i % 5 else None) for i in range(9000)]
    return texts, spark.createDataFrame(texts, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("parts", [1, 2, exact.PART])
def test_parts_of_the_filter(spark, rows, parts):
    texts, df = rows
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts}
    assert {r[0]: tuple(r[1:]) for r in exact.exact_groups(df, part_buckets=parts).collect()} == want


@pytest.mark.parametrize("parts", [1, exact.PART])
def test_unique_keeps_whole_rows(spark, rows, parts):
    texts, df = rows
    last = {}
    for i, t in texts:
        last[t or ""] = max(i, last.get(t or "", -1))
    found = exact.unique(df.withColumn("_sha", df["doc_id"] * 2), part_buckets=parts).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(last.values()) and all(r["_sha"] == 2 * r["doc_id"] for r in found)


def test_few_single_rows_are_suspected(spark):
    df = spark.range(20_000).selectExpr("unhex(sha2(cast(id as string), 256)) sha", "id", "id as row")
    assert exact.suspects(common.stored(df, "digests")).where("suspect").count() < 600
