"""Joins by keys lose no pair that scores, and sections are found on their pages."""

import random
import re

from pyspark.sql import functions as F

from kagajflow.functions import scores
from kagajflow.operators import analysis, chapters, outline, routing


def test_title_keys_meet_wherever_titles_score(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abक") for _ in range(pick.choice([1, 2, 2, 3, 4, 6])))
    titles = [" ".join(word() for _ in range(pick.randint(0, 4))) for _ in range(150)] + ["lawful", "unlawful acts", "र", "को र", "वा", "गरेको काम", "abcdefgh ijk", "abcdefgh xyz"]
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    a, b = rows.toDF("i", "q"), rows.toDF("j", "t")
    scored = a.crossJoin(b).where(scores.title_match(F.col("q"), F.col("t")) > 0.0501).select("i", "j")
    keyed = a.select("i", F.explode(routing.title_keys(F.col("q"), True)).alias("k")).join(b.select("j", F.explode(routing.title_keys(F.col("t"), False)).alias("k")), "k").select("i", "j").distinct()
    assert scored.count() > 3000 and scored.exceptAll(keyed).isEmpty()


def test_names_within_words(spark):
    taxonomy = spark.createDataFrame([("b", 1, "unlawful acts"), ("b", 2, "other"), ("b", 30, "xyz")], "book_id string, root int, title string")
    names = spark.createDataFrame([(0, "lawful", "b"), (1, "section 30", "b")], "query_id int, name string, book_id string")
    assert [tuple(r)[:5] for r in routing.reconcile(names, taxonomy).select("query_id", "root", "title", "book_id", "score").collect()] == [(0, 1, "unlawful acts", "b", 0.92)]
    assert sorted((r["query_id"], r["root"]) for r in routing.reconcile(names, taxonomy, least=0.3).collect()) == [(0, 1), (1, 30)]


def test_vocabulary_within_words(spark):
    queries = spark.createDataFrame([(0, ["law", "unlawfulness"])], "query_id int, tokens array<string>")
    terms = spark.createDataFrame([("unlawful acts",), ("lawful",), ("acts",), ("flaw",)], "term string")
    assert analysis.vocabulary_hints(queries, terms).first()["hints"] == ["lawful", "flaw", "unlawful acts"]


def test_short_phrases_and_chapters_within_words(spark):
    corpus = spark.createDataFrame([(1, "b", "Chapter 1 — of homicides", "abc def")], "id int, book_id string, chapter string, section_title string")
    assert chapters.by_phrases(spark.createDataFrame([(0, "ABC"), (0, "ab")], "query_id int, phrase string"), corpus).count() == 1
    assert chapters.chapters_by_name(spark.createDataFrame([(0, "homicide")], "query_id int, text string"), corpus).count() == 1
    assert routing.by_title(spark.createDataFrame([(0, "abc")], "query_id int, text string"), corpus).count() == 1


def test_pages(spark):
    pages = [("b", 1, "विषयसूची १२ र १४"), ("b", 2, "७. छोटो कुरा"), ("b", 3, "दफा 125 बमोजिम करारको परिभाषा गर्ने"), ("b", 4, "१२. करार सम्बन्धी व्यवस्था गरिएको"), ("b", 5, "नम्बर बिनाको शीर्षक सम्बन्धी सम्पूर्ण व्यवस्था"), ("c", 6, "७. अर्को")]
    sections = [("b", 7, "छोटो"), ("b", 12, "करार सम्बन्धी व्यवस्था गरिएको"), ("b", 99, "शीर्षक सम्बन्धी सम्पूर्ण व्यवस्था"), ("b", 98, "कतै नभएको शीर्षक यहाँ छैन"), ("b", 97, "शीर्षक"), ("b", 1, "हदम्याद")]
    found = outline.first_pages(spark.createDataFrame(sections, "book_id string, root int, title string"), spark.createDataFrame(pages, "book_id string, page int, text string"))
    assert {r["root"]: r["page"] for r in found.collect()} == {7: 2, 12: 4, 99: 5, 98: None, 97: None, 1: 3}  # behind the word for section 125 begins with 1


def test_pages_are_read_where_they_are_in_blocks_of_sections(spark, monkeypatch):
    """Of many pages no text is shuffled and no place of a text is a row; blocks of sections and small pieces change nothing."""
    monkeypatch.setattr(outline, "SECTIONS", 3)
    monkeypatch.setattr(outline, "CHARS", 7)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(5))
    pages = [(rng.choice("bc"), i, " ".join([word() for _ in range(rng.randint(0, 90))] + rng.choices(["7.", "12 ", "दफा 34", ""], k=1))) for i in range(300)] + [("b", 301, None)]
    flat = lambda t: re.sub(r"[\s।|,.:ः]+|[mनयखलउ]", "", t).lower()
    sections = [(book, root, " ".join(word() for _ in range(rng.choice([1, 3, 3, 6])))) for book in "bc" for root in (3, 7, 12, 34, 56)]
    sections += [("b", 90 + k, t[3 * k : 3 * k + 14 + 6 * k] + "zz") for k, (b, _, t) in enumerate(p for p in pages[:250] if p[0] == "b" and len(p[2]) > 60) if k < 6]
    sections += [("c", 80, next(t for b, i, t in pages if b == "c" and len(t) > 100 and i > 100)[50:80])]
    met = outline.first_pages(spark.createDataFrame(sections, "book_id string, root int, title string"), spark.createDataFrame(pages, "book_id string, page int, text string"))
    want = {}
    for book, root, title in sections:
        t = flat(title)
        own = [(i, flat(x), re.search(rf"(?:^|[ ।|]){root}(?:\s*\.|[.\sः])|दफा\s*{root}", re.sub(r"\s+", " ", x))) for b, i, x in pages if b == book and x is not None]
        tests = [lambda x, n: n and (len(t) < 14 or t[:16] in x), lambda x, n: n, *(lambda x, n, k=k: len(t) >= 14 and t[:k] in x for k in (24, 18, 12))]  # noqa: B023
        want[book, root] = next((min(hits) for test in tests if (hits := [i for i, x, n in own if test(x, n)])), None)
    assert {(r["book_id"], r["root"]): r["page"] for r in met.collect()} == want and len({p for p in want.values() if p is not None}) > 6
    monkeypatch.setattr(outline, "SECTIONS", 50_000)
    one = outline.first_pages(spark.createDataFrame(sections, "book_id string, root int, title string"), spark.createDataFrame(pages, "book_id string, page int, text string"))
    assert not any("text" in line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line or "Generate" in line)
