"""The continuation automaton: exact blocks for every rule, and what each rule must leave alone."""

import random

import pytest
from pyspark.sql import functions as F

from kagajflow.operators import chunking, continuation


def told(*lines):
    return [(b.depth, b.text) for b in continuation.blocks_of(list(lines))]


@pytest.mark.parametrize(
    ("rule", "lines", "want"),
    [
        ("bare clause", ["(२) काम गर्ने", "(क) ,", "(ख) वा", "(ग) र"], [(1, "(२) काम गर्ने (क) , (ख) वा (ग) र")]),
        ("clauses referred to", ["(२) दफा २ को खण्ड", "(क) को काम"], [(1, "(२) दफा २ को खण्ड (क) को काम")]),
        ("clauses referred to", ["(२) उपदफा (1) खण्ड", "(ख) को काम"], [(1, "(२) उपदफा (1) खण्ड (ख) को काम")]),
        ("clause in a listing", ["(२) खण्ड क वा", "(ख) बमोजिम हुने"], [(1, "(२) खण्ड क वा (ख) बमोजिम हुने")]),
        ("clause in a listing", ["(२) खण्ड क,", "(ख) मा लेखिए"], [(1, "(२) खण्ड क, (ख) मा लेखिए")]),
        ("filled stub", ["(5) उपदफा", "(४) भएमा"], [(1, "(५) उपदफा (४) भएमा")]),
        ("filled stub", ["(क) उपदफा", "(४) भएमा"], [(2, "(क) उपदफा (४) भएमा")]),
        ("either", ["(२) उपदफा (६) वा", "(८) भएको"], [(1, "(२) उपदफा (६) वा (८) भएको")]),
        ("tail of a reference", ["(६) काम गर्ने", "(६) बमोजिम हुन्छ"], [(1, "(६) काम गर्ने (६) बमोजिम हुन्छ")]),
        ("listing", ["(१) उपदफा (२),", "(३) ,", "(४) र", "(५) मा लेखिए ।"], [(1, "(१) उपदफा (२), (३) , (४) र (५) मा लेखिए ।")]),
        ("listing", ["(१) उपदफा (२)", "(३)"], [(1, "(१) उपदफा (२) (३)")]),
        ("item of a list", ["(क) देहायकोः–", "(१) एक", "(२) दुई", "(ख) अर्को"], [(2, "(क) देहायकोः– (१) एक (२) दुई"), (2, "(ख) अर्को")]),
        ("item of a list", ["स्पष्टीकरणः", "(१) एक", "१२. अर्को"], [(1, "स्पष्टीकरणः (१) एक"), (0, "१२. अर्को")]),
        ("exception in a clause", ["(क) पहिलो ।", "तर देहायको,", "(१) एक"], [(2, "(क) पहिलो । तर देहायको, (१) एक")]),
    ],
)
def test_joined(rule, lines, want):
    assert told(*lines) == want
    assert rule in {r for b in continuation.blocks_of(lines) for _, r in b.joined}


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["(१) एक ।", "(२) बमोजिम दुई"], [(1, "(१) एक ।"), (1, "(२) बमोजिम दुई")]),  # the sentence has ended
        (["(क) एक", "(२) बमोजिम दुई"], [(2, "(क) एक"), (1, "(२) बमोजिम दुई")]),  # a tail goes on with subsections
        (["(क) एक वा", "(२) दुई"], [(2, "(क) एक वा"), (1, "(२) दुई")]),
        (["(१) एक,", "(२) दुई छ"], [(1, "(१) एक,"), (1, "(२) दुई छ")]),  # no fragment
        (["(१) एक", "(क) मा दुई"], [(1, "(१) एक"), (2, "(क) मा दुई")]),  # no listing
        (["(१) एक ।", "तर यो होइन ।"], [(1, "(१) एक ।"), (1, "तर यो होइन ।")]),
        (["(१) एक ।", "तर देहायको,", "(१) क"], [(1, "(१) एक ।"), (2, "तर देहायको, (१) क")]),
        (["भाग–१ सुरु", "परिच्छेद–२ नाम", "परिच्छेद–२ नाम", "१. दफा"], [(0, "भाग–१ सुरु"), (1, "परिच्छेद–२ नाम"), (0, "१. दफा")]),  # a heading repeated
        (["परिच्छेद–२ नाम", "१. संहिताको", "भाग–२ को कुरा", "परिच्छेद–१, र अन्य"], [(0, "परिच्छेद–२ नाम"), (0, "१. संहिताको भाग–२ को कुरा परिच्छेद–१, र अन्य")]),  # only referred to
        (["१. एक", "  फेरि   दुई "], [(0, "१. एक फेरि दुई")]),
        ([], []), (["केही"], [(1, "केही")]),
    ],
)
def test_kept_apart(lines, want):
    assert told(*lines) == want


def test_every_rule_has_a_case():
    cases = {m.args[1][i][0] for m in test_joined.pytestmark for i in range(len(m.args[1]))}
    assert cases >= {j.name for j in continuation.JOINS}


def test_from_texts(spark):
    rows = spark.createDataFrame([(1, "१. शीर्षक । (१) उपदफा\n(२) बमोजिम । (क) कुरा"), (2, None), (None, "")], "doc_id long, text string")
    assert [tuple(r) for r in continuation.unclear(rows).collect()] == [(1, 2, 2, "filled stub")]
    assert continuation.indented(rows).collect() == [(1, "१. शीर्षक ।\n  (१) उपदफा (२) बमोजिम ।\n    (क) कुरा")]


def test_places_of_repeated_chapters(spark):
    text = "परिच्छेद–१ क\nपाठ\n परिच्छेद–१ क\nपरिच्छेद २ ख"
    rows = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "id long, text string")
    assert sorted((r["at"], r["chapter"]) for r in chunking.chapters_in(rows, "id", "text").collect()) == [(0, "परिच्छेद–१ क"), (text.index(" परिच्छेद"), "परिच्छेद–१ क"), (text.rindex("परिच्छेद"), "परिच्छेद २ ख")]


def test_lines_in_python_are_those_of_spark(spark):
    pick = random.Random(5)
    bits = [*"२१12कखabc()–-:ः,.।\"“ \n\r\t\f\u0085  \x1c", "भाग", "परिच्छेद", "स्पष्टीकरणः", "तर", "। ", "\r\n", "....", "…", "[PAGE:7]", "[PAGE:", "१२३४५", "--", ". ", "१. ", "34\n", "\n12\n", "(२) ", "(क)", " दफा"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert all(chunking.lines_of(texts[r["id"]]) == r["lines"] for r in rows.select("id", chunking.logical_lines(F.col("text")).alias("lines")).collect())


def test_blocks_are_counted_where_texts_are(spark):
    rows = spark.createDataFrame([(1, "१. शीर्षक । (१) उपदफा\n(२) बमोजिम । (क) कुरा"), (2, None), (None, "(१) एक")], "doc_id long, text string")
    found = continuation.tally(rows)
    assert {tuple(r) for r in found.collect()} == {(1, "dafa", 0, 1), (1, "upadafa", 1, 1), (1, "khanda", 2, 1), (1, "filled stub", None, 1), (None, "upadafa", 1, 1)}
    for df in (found, continuation.indented(rows)):
        assert not any(word in df._jdf.queryExecution().executedPlan().toString() for word in ("Exchange", "Aggregate", "Generate"))


def test_statutes_are_parsed_where_their_texts_are(spark):
    text = "परिच्छेद–२ नाम १. हदम्याद कुराः बाँकी । (१) पहिलो । (क) दफा २ बमोजिम । तर यो । तर त्यो । २. अर्को ।"
    rows = spark.createDataFrame([(1, text), (1, "३. एक ।\n    (क) खण्ड\n  १२ पाठ ।"), (2, None)], "doc_id long, text string")
    found = chunking.parse_statutes(rows)
    want = [("dafa_1", "१"), ("dafa_1_upadafa_1", "१"), ("dafa_1_upadafa_1_ka", "१"), ("dafa_1_tar_1", "१"), ("dafa_1_tar_2", "१"), ("dafa_2", "१")]
    assert [(r["chunk_id"], r["chapter_hadamyad_dafa"]) for r in found.orderBy("chunk_index").collect() if r["parichhed"]] == want
    assert [(r["section"], r["subsection"]) for r in found.where("chunk_id = 'dafa_1_upadafa_1_ka'").first()["references"]] == [("२", None)]
    shaped = chunking.parse_indented(rows.where("text like '३%'"))
    assert [(r["chunk_id"], r["content"]) for r in shaped.orderBy("chunk_index").collect()] == [("dafa_3", "[दफा ३]: एक ।: एक ।"), ("dafa_3_upadafa_1_ka", "[दफा ३]: एक । -> (१) -> (क) खण्ड १२ पाठ ।")]
    for df in (found, shaped):
        assert not any(word in df._jdf.queryExecution().executedPlan().toString() for word in ("Exchange", "Window", "Aggregate"))
