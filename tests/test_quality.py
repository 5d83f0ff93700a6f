"""Quality of chunks and pages, references and search policy: each rule decides something."""

import pytest
from pyspark.sql import functions as F

from kagajflow.operators import analysis, assembly, chapters
from kagajflow.sources.tables import statute_chunks


def test_every_sign_decides_a_row(spark, data):
    rows = statute_chunks(spark, data)
    signs = assembly.PROVISION_SIGNS
    score = lambda some: assembly.provision_quality(F.col("content"), F.col("root"), F.col("page"), F.col("section_label"), some)
    changed = rows.select(*(F.count_if(score(signs) != score(signs[:i] + signs[i + 1 :])).alias(str(i)) for i in range(len(signs)))).first()
    assert all(changed) and not all(n == 200 for n in changed)


@pytest.mark.parametrize(
    ("body", "form"),
    [
        ("name .... age", True), ("नाम .... उमेर", True), ("नाम ... उमेर", False), ("[PAGE:12345] कुरा", False), ("पाउने  पाउने", True), ("जवाफ ...", True), ("तपाईं को उमेर", False), ("तपाईँको उमेर", True), ("abcd कुरा", False), ("abcde कुरा", True), ("[{}'\"", True),
        ("प्रकार: abcdefg\nकुरा", False), ("कुरा\nपृष्ठ : abcdefg", False), ("फिराद पत्र ...", True), ("गर्दछु / गर्दिन", True),
    ],
)
def test_forms(spark, body, form):
    assert spark.createDataFrame([(body,)], "t string").select(assembly.is_form(F.col("t"))).first()[0] is form


def test_extraction_quality(spark):
    good = "परिच्छेद १, " + "१. सङ्क्षिप्तनाम, र, विस्तार, " * 20
    cases = {"good": (good, 1.0), "short": ("परिच्छेद १. छोटो", 0.0), "unnamed": (good.replace("परिच्छेद", "खण्ड"), 0.65), "unnumbered": (good.replace("१.", "एक,"), 0.75), "broken": ("भाग १. " + "क ख ग घ " * 60, 0.6), "bad": ("क ख ग घ " * 60, 0.0)}
    pages = spark.createDataFrame([(k, 1, t) for k, (t, _) in cases.items()] + [("short", 31, good)], "file string, page int, text string")
    assert {r["file"]: r["score"] for r in assembly.extraction_quality(pages, "file").collect()} == {k: pytest.approx(v) for k, (_, v) in cases.items()}


def test_a_subsection_is_its_own_part(spark):
    corpus = spark.createDataFrame([(1, "c1", 5, None, None), (2, "c2", 5, 1, None), (3, "c3", 5, 1, "क"), (4, "c4", 5, 2, "क"), (5, "c5", 6, 1, "ख")], "id int, chunk_id string, root int, subsection int, clause string")
    asked = [(0, None, 5, 1, None), (1, None, 5, 1, "क"), (2, None, 5, None, "ख"), (3, None, 6, 1, None), (4, "c4", 5, 1, None), (5, None, 5, None, None), (6, None, 7, None, "क"), (7, None, 5, 9, None)]
    found = {}
    for r in chapters.by_reference(spark.createDataFrame(asked, "query_id int, chunk_id string, root int, subsection int, clause string"), corpus).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    assert found == {0: {2}, 1: {3}, 2: {1, 2, 3, 4}, 4: {4}, 5: {1, 2, 3, 4}}


def test_retrieval_policy(spark):
    hint = "array<struct<act:string,section:string>>"
    rows = [
        ("civil", [("civil", "१२"), ("civil", "12")], [], False), ("auto", [("civil", "3")], [], False), (None, [], [("civil", None)], False), (None, [], [], True), ("civil", [("civil", "3"), ("penal", "4")], [], False), ("civil", [], [], False), (None, [], [], False), ("civil", [(None, "3")], [], False),
    ]
    df = spark.createDataFrame(rows, f"scope string, sections {hint}, chapters {hint}, pinned boolean").coalesce(1)
    found = [tuple(r["p"]) for r in df.select(analysis.retrieval_policy(F.col("scope"), F.col("sections"), F.col("chapters"), F.col("pinned")).alias("p")).collect()]
    assert found == [
        ("civil", True, True, ["civil|12"]), (None, True, False, None), (None, True, False, None), (None, False, True, None), ("civil", True, False, ["civil|3", "penal|4"]), ("civil", True, False, None), (None, False, False, None), ("civil", True, False, []),
    ]
