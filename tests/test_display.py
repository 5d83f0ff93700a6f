"""Clause trees, shown sections, excerpts, answers and spelling: cases of every rule, and plain versions of the linear ones."""

import random

import pytest
from pyspark.sql import functions as F

from kagajflow.functions import spelling
from kagajflow.operators import answers, clause_tree
from kagajflow.plans import display

PART = "query_id int, filename string, root int, id int, path array<string>, text string"


def moved(spark, *parts):
    df = spark.createDataFrame([(0, "f", 1, i, path, text) for i, (path, text) in enumerate(parts)], PART)
    return [("/".join(r["path"]), r["text"]) for r in clause_tree.tree(clause_tree.restructured(df)).orderBy("place").collect()]


def test_punishments_are_clauses_of_their_list(spark):
    found = moved(spark, ([], "परिचय"), (["१"], "पहिलो काम गर्न हुँदैन"), (["1"], "बमोजिम दश वर्ष कैद,"), (["2"], "बमोजिम पाँच वर्ष"), (["2"], "बमोजिम छ वर्ष"), (["5"], "बमोजिम एक वर्ष"), (["3"], "उपदफा"), (["1", "क"], "उपदफा (२)"), (["4"], "देहाय बमोजिम सजाय हुनेछ"))
    assert found == [("", "परिचय"), ("1", "पहिलो काम गर्न हुँदैन"), ("4", "देहाय बमोजिम सजाय हुनेछ"), ("4/क", "उपदफा (१) बमोजिम दश वर्ष कैद"), ("4/ख", "उपदफा (२) बमोजिम छ वर्ष")]


def test_tails_go_on_with_their_subsections(spark):
    found = moved(spark, (["1"], "पहिलो"), (["1"], "बमोजिम निवेदन"), (["1"], "(२) बमोजिम   हानि"), (["2"], "दोस्रो"), (["3"], "उपदफा"))
    assert found == [("1", "पहिलो"), ("2", "दोस्रो उपदफा (१) बमोजिम निवेदन"), ("3", "उपदफा (२) बमोजिम   हानि")]
    assert moved(spark, (["1"], "पहिलो"), (["2"], "दोस्रो"), (["2"], "उपदफा")) == [("1", "पहिलो"), ("2", "दोस्रो उपदफा")]
    assert moved(spark, (["1"], "बमोजिम क"), (["1"], "बमोजिम ख")) == [("2", "उपदफा (१) बमोजिम क"), ("2", "उपदफा (१) बमोजिम ख")]


def test_trees_are_read_depth_first(spark):
    parts = [(["2", "ख"], "d"), (["2"], "b"), (["१०"], "e"), (["2", "क"], "c"), ([], "intro"), (["1"], "a"), ([], "तर होइन"), (["7", "क"], "f"), (["2", "क", "1"], "c1")]
    df = spark.createDataFrame([(0, "f", 1, i, path, text) for i, (path, text) in enumerate(parts)], PART)
    rows = clause_tree.tree(df).orderBy("place").collect()
    assert [r["text"] for r in rows] == ["intro", "a", "b", "c", "c1", "d", "f", "तर होइन", "e"]
    assert {r["text"]: (r["parent"], r["depth"]) for r in rows} == {"intro": (None, 0), "a": (4, 1), "b": (4, 1), "c": (1, 2), "c1": (3, 3), "d": (1, 2), "f": (4, 1), "तर होइन": (4, 1), "e": (4, 1)}
    shown = clause_tree.displayed(clause_tree.tree(df)).first()["text"].split("\n")
    assert shown[3:6] == ["    (क) c", "        (१) c1", "    (ख) d"]


def test_a_proviso_stands_before_the_sixth_subsection(spark):
    assert [t for _, t in moved(spark, *(([str(k)], str(k)) for k in range(1, 9)), ([], "तर होइन"))] == ["1", "2", "3", "4", "5", "तर होइन", "6", "7", "8"]


@pytest.mark.parametrize(
    ("sections", "precise", "hinted", "asks", "punishes", "want"),
    [
        ([1, 1], [1, 1], [0, 0], 1, [1, 1], ([1], "single")), ([1, 2, 3, 4], [1, 1, 1, 1], [0, 1, 1, 1], 1, [1, 1, 1, 1], ([2, 3], "hints")), ([1, 2, 3], [1, 1, 0], [0, 1, 0], 1, [1, 0, 0], ([1], "punishment")),
        ([1, 2, 3], [1, 1, 0], [0, 0, 0], 1, [0, 1, 0], ([1, 2], "two")), ([1, 2, 1, 3, 4], [1, 0, 1, 1, 1], [0] * 5, 0, [1] * 5, ([1, 2, 3], "all")), ([1, 2], [0, 1], [0, 0], 1, [1, 1], ([1, 2], "all")),
    ],
)
def test_shown_sections(spark, sections, precise, hinted, asks, punishes, want):
    rows = spark.createDataFrame([(0, i, i + 1, "f", s, bool(p), bool(h), bool(x)) for i, (s, p, h, x) in enumerate(zip(sections, precise, hinted, punishes, strict=True))], "query_id int, id int, rank int, filename string, root int, precise boolean, hinted boolean, punishes boolean")
    found = answers.shown_sections(rows, F.col("precise"), F.col("punishes"), F.lit(bool(asks)), F.col("hinted"), F.lit(True)).orderBy("place").collect()
    assert ([sections[r["id"]] for r in found], {r["exit"] for r in found}) == (want[0], {want[1]})


def test_every_exit_is_reached(spark):
    assert {r["exit"] for r in display.section_cap(spark, "/root/testdata/sf0.01").select("exit").distinct().collect()} >= {"hints", "punishment", "two", "all"}


def plain_excerpt(content, words):
    best, at = -1, 0
    for word in words:
        here = content.find(word)
        while here >= 0:
            around = content[max(0, here - 200) : here + 200]
            score = sum(w in around for w in words)
            if score > best:
                best, at = score, here
            here = content.find(word, here + 1)
    start = max(0, at - 250)
    return ("…" if start else "") + content[start : start + 500].strip(" ") + ("…" if start + 500 < len(content) else "")


def test_excerpts_like_the_plain_search(spark):
    pick = random.Random(4)
    rows = []
    for i in range(60):
        content = "".join(pick.choice(["aa", "a", "b", " ", "xyz ", "कख", ". ", r"\E.Q "]) for _ in range(pick.choice([0, 5, 300, 1200])))
        rows.append((i, content, [pick.choice(["aa", "aaa", "zz", "xyz", "कख", r"\E.", "b a"]) for _ in range(pick.randint(0, 5))]))
    found = answers.best_excerpts(spark.createDataFrame(rows, "id int, content string, words array<string>"), ["id"]).collect()
    assert {r["id"]: r["excerpt"] for r in found} == {i: plain_excerpt(content, words) for i, content, words in rows}


def test_answer_sections(spark):
    text = "before\n**मुद्दा**\n\n one \n two\n**लागू प्रावधानहरू**  \n**अन्य**\nthree\n **सारांश**\n"
    rows = spark.createDataFrame([(text,), ("no heading",), ("a **मुद्दा** b",), (None,)], "t string").coalesce(1)
    found = [r["s"] and [tuple(x) for x in r["s"]] for r in rows.select(answers.answer_sections(F.col("t"), display.HEADINGS, "मुद्दा").alias("s")).collect()]
    assert found == [[("मुद्दा", "one \n two"), ("लागू प्रावधानहरू", "**अन्य**\nthree"), ("सारांश", "")], None, None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("kanuni  Patra ma darta", "कानुनी पत्रमा दर्ता"), ("kanuni xyz patra", "कानुनी xyz पत्र"), ("patradarta", "patradarta"), ("PATRA le? din bhitra", "पत्रले? दिनभित्र"), ("patra lekha", "पत्र lekha"), ("civil code", "देवानी संहिता"), ("", ""), (" \n civil\tcode  patra", "देवानी संहिता पत्र"),
    ],
)
def test_transliteration(spark, text, want):
    table = {"kanuni": "कानुनी", "patra": "पत्र", "darta": "दर्ता", "ma": "मा", "le": "ले", "din": "दिन", "bhitra": "भित्र", "civil code": "देवानी संहिता", "civil code patra": "देवानी संहिता पत्र", "code": "कोड"}
    assert spark.createDataFrame([(text,)], "t string").select(spelling.transliterated(F.col("t"), table)).first()[0] == want


def plain_repair(text):
    import re

    def fix(m):
        near = text[max(0, m.start() - 40) : m.start() + 40]
        if not re.search("[ऀ-ॿ]", near):
            return m[0]
        if m[0].lower() in display.SCANNED:
            return display.SCANNED[m[0].lower()]
        return "पर्नेछ" if len(m[0]) <= 4 and re.match(r"[ \t\n]*[|।,]", text[m.end() :]) else m[0]

    out = re.sub("(?<![A-Za-z])[A-Za-z]{2,}(?![A-Za-z])", fix, text)
    return re.sub(r"[ \t\n]+([|।])", r" \1", re.sub(r"[ \t]{2,}", " ", out))


def test_repair_like_the_plain_version(spark):
    pick = random.Random(9)
    rows = [(i, "".join(pick.choice(["the ", "On", "wxyz", " ", "कख ", ", ", "|", "।", "long latin words here ", "1. ", "\n", "a"]) for _ in range(pick.choice([0, 1, 8, 60, 200])))) for i in range(80)]
    found = {r["id"]: r["text"] for r in spelling.repaired(spark.createDataFrame(rows, "id int, text string"), display.SCANNED).collect()}
    assert found == {i: plain_repair(t) for i, t in rows}
