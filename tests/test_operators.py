"""Labels, JSON, analysis, assembly, chapters and evaluation against expected rows."""

import pytest
from pyspark.sql import functions as F

from kagajflow.functions import labels, model_json
from kagajflow.operators import analysis, assembly, calendar, chapters, chunking, continuation, evaluation, ingest, pipelines
from kagajflow.sources import tables


@pytest.fixture
def value(spark):
    def of(column, **fields):
        row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in fields.items()))
        return row.select(column.alias("v")).first()["v"]

    return of


def test_labels(value):
    c = F.col
    assert value(labels.citation_block(c("b"), c("n"), c("m"), c("s"), c("t"), c("u"), c("k")), b="संहिता", n="2", m="", s="12", t="करार", u=None, k="क") == "पुस्तक : संहिता\nपरिच्छेद नं : २\nदफा : १२ — करार\nखण्ड : क"
    assert value(labels.source_label(c("b"), c("ch"), c("t"), c("s")), b="B", ch="C", t="C", s="3") == "B · C · दफा ३"
    paths = {(): 0, ("३",): 503, ("ख",): 102, ("१", "क"): 101, ("२", "क"): 511, ("२", "ख"): 527, ("३", "क"): 951, ("२", "क", "१"): 517, ("क", "ख"): 9002}
    for path, key in paths.items():
        assert value(labels.breadcrumb_key(c("p")), p=list(path)) == key, path
    assert value(labels.section_slug(c("s"), c("u"), c("k")), s="१२", u="3", k="ख") == "sec_12_sub_3_kha"
    assert value(labels.part_key(c("f"), c("r"), c("u"), c("k"), c("t"), c("l")), f="f", r="7", u="", k="", t="", l="(२)") == "f|7|२"
    assert value(labels.part_key(c("f"), c("r"), c("u"), c("k"), c("t"), c("l")), f="f", r="7", u="२", k="क", t="", l=None) == "f|7|u2|kक"
    assert value(labels.embed_text(F.array(c("a"), c("b")), c("t")), a="x", b=" ", t="body") == "[x]: body"
    assert value(labels.embed_query(c("q"), c("a"), c("i"), c("l")), q=" why ", a="act", i="", l=["1", "2", "3", "4"]) == "[act] why 1 2 3"
    assert value(labels.display_content({"दफा": c("s"), "खण्ड": c("k")}, c("t")), s="1", k=None, t="body") == "दफा : 1\n\nbody"
    assert value(labels.numbers_in(c("l"), 2), l=["१२", "x", "12", "3 of", "0", "9"]) == [12, 3]
    assert value(labels.cited_sections(c("l"), c("t")), l=["4.1", "9"], t="दफा ९ र दफा १०") == [4, 9, 10]
    assert value(labels.split_query(c("t")), t="के हो? विवाह, दर्ता") == ("के हो?", ["विवाह", "दर्ता"])
    assert value(labels.split_query(c("t")), t="के हो? अरू") == ("के हो? अरू", [])
    assert value(labels.subsection_text(c("t"), F.lit(2)), t="(१) एक (क) ख (२) दुई । (३) तीन") == "(२) दुई ।"
    assert value(labels.without_next_section(c("t")), t="यो हो . १३. अर्को शीर्षक") == "यो हो"
    assert value(labels.scripts_of(c("t")), t="विवाह kahile") == ("mixed", True)
    assert value(labels.first_rule(c("t"), [("theft|चोरी", "criminal"), ("marriage", "civil")]), t="marriage and theft") == "criminal"
    assert value(labels.all_rules(c("t"), [("theft", ["a", "b"]), ("x", ["c"]), ("mar", ["b", "d"])]), t="marriage theft") == ["a", "b", "d"]
    assert value(labels.classified(c("t"), {"theft": "theft", "court": "court"}), t="a theft") == (True, False)
    assert value(labels.short_number(F.lit(2_500_000))) == "2.5M" and value(labels.short_number(F.lit(1234))) == "1.2k" and value(labels.short_number(F.lit(12))) == "12"


def test_model_json(value):
    c = F.col
    raw = 'Sure:\n```json\n{"intent": " know ", "retrievalQueries": ["a", " ", "b", "c", "d", "e"], "sectionHints": [{"section": "s. 12", "act": "civil"}, {"section": "x", "act": "y"}], "chapterHints": [{"chapter": "परिच्छेद ३", "act": "civil", "name": " n "}]}\n```'
    found = value(model_json.analysis(c("r"), F.lit("q?")), r=raw)
    assert (found["intent"], found["queries"], found["issues"], found["act"]) == ("know", ["a", "b", "c", "d"], [], None)
    assert [(h["section"], h["act"]) for h in found["section_hints"]] == [(".12", "civil")] and [(h["chapter"], h["name"]) for h in found["chapter_hints"]] == [("३", "n")]
    broken = value(model_json.analysis(c("r"), F.lit("q?")), r="no json")
    assert (broken["intent"], broken["queries"]) == ("q?", ["q?"])
    said = value(model_json.normalised_query(c("r")), r='{"optimized_query": "के हो? क, ख", "act": "devani", "exactDafaGuess": ["१२", 12, "४"], "excluded_dafa_guess": 9, "matching_dafa_names": ["n"]}')
    assert tuple(said) == ("के हो?", ["क", "ख"], "devani", ["n"], [12, 4], [9], None)
    assert tuple(value(model_json.normalised_query(c("r")), r='"plain text"'))[:3] == ("plain text", [], None)
    refs = value(model_json.metadata_references(c("m")), m='{"references": [{"section_dafa": "१२", "clause_khanda": "क"}, {"raw": "x"}]}')
    assert [tuple(r) for r in refs] == [("12", None, "क")]


def test_title_phrases(value):
    c = F.col
    phrases = value(analysis.title_phrases(c("q"), ["सम्पत्ति"], "कार्यविधि", [("बिगो", "बिगो भराउने कार्यविधि")]), q="'बिगो भराउने' कार्यविधि के हो")
    assert phrases[0] == "बिगो भराउने कार्यविधि के हो" and "बिगो भराउने" in phrases and len(phrases) == len(set(phrases))
    assert value(analysis.search_anchors(c("p")), p=["एक दुई तीन चार"]) == ["एक दुई तीन चार", "एक दुई तीन", "एक दुई"]
    assert value(analysis.is_title_query(c("q")), q="सम्पत्ति जायजात") and not value(analysis.is_title_query(c("q")), q="दफा १२ के हो भन्नुहोस्") and not value(analysis.is_title_query(c("q")), q="law")
    assert value(analysis.first_phrases(c("a"), c("b"), 2), a=["एक"], b=["एक", "दुई", "तीन"]) == ["एक", "दुई"]
    assert value(analysis.term_score(c("t"), c("l")), t="Big House", l=["big", "House"]) == 7
    assert value(analysis.vocabulary_tokens(c("q"), F.create_map(F.lit("bibaha"), F.lit("विवाह"))), q="Bibaha र दर्ता x") == ["bibaha", "दर्ता", "विवाह"]
    assert value(analysis.line_parts(c("l")), l="दफा १२. करारको परिभाषा") == (12, "करारको परिभाषा")
    assert value(analysis.is_precise(c("q"), c("t"), F.lit(0.5), F.lit(False), F.lit(False)), q="करार", t="करार") and not value(analysis.is_precise(c("q"), c("t"), F.lit(0.5), F.lit(True), F.lit(False)), q="करार", t="अर्को")
    assert value(analysis.hint_boost(F.lit(0.2), 0.5)) == 0.65 and value(analysis.related_enough(F.lit(0.695))) and not value(analysis.related_enough(F.lit(0.69)))
    assert value(analysis.focus_scope(F.lit("auto"), F.lit(None).cast("string"), F.lit("civil"))) == "civil"
    assert value(analysis.contains_any(c("w"), c("a"), c("b")), w=["X"], a="no", b="xy")


def test_sections_by_name(spark):
    taxonomy = spark.createDataFrame([("b", 5, "करार"), ("b", 9, "विवाह"), ("c", 9, "अर्को")], "book_id string, root int, title string")
    names = spark.createDataFrame([(1, 0, "विवाह"), (1, 1, "दफा ५. करार"), (1, 2, "३. नभएको"), (2, 0, "केही")], "query_id int, place int, name string")
    assert [tuple(r) for r in analysis.sections_by_name(names, taxonomy).collect()] == [(1, [9, 5, 3])]
    lines = spark.createDataFrame([(1, "दफा ९. अर्को"), (2, "x")], "query_id int, line string")
    assert sorted((r["query_id"], r["book_id"]) for r in analysis.owning_book(lines, taxonomy).collect()) == [(1, "c"), (2, None)]
    guesses = spark.createDataFrame([(1, 0, "b", 5), (1, 1, "b", 6), (1, 2, "c", 9)], "query_id int, place int, book_id string, root int")
    assert [r["root"] for r in analysis.owned_sections(guesses, taxonomy).orderBy("place").collect()] == [5, 9]
    text = spark.createDataFrame([("b", "१. पहिलो शीर्षकः बाँकी"), ("b", "  भित्री")], "book_id string, line string")
    assert [tuple(r) for r in analysis.taxonomy_lines(text).collect()] == [("b", 1, "पहिलो शीर्षकः")]


def test_formatted_sections(spark):
    rows = [(1, "f", 3, 1, "दफा : ३", [], "परिचय"), (1, "f", 3, 4, "दफा : ३", ["२"], "दोस्रो"), (1, "f", 3, 2, "दफा : ३", ["१"], "पहिलो"), (1, "f", 3, 5, "दफा : ३", [], "तर यो होइन"), (1, "f", 3, 6, "दफा : ३", ["२", "क"], "खण्ड"), (1, "f", 3, 7, "दफा : ३", [], " ")]
    df = spark.createDataFrame(rows, "query_id int, filename string, root int, id int, citation string, path array<string>, text string")
    found = assembly.formatted_sections(df).first()["text"].split("\n")
    assert found == ["दफा : ३", "", "परिचय", "(१) पहिलो", "(२) दोस्रो", "तर यो होइन", "  (क) खण्ड"]
    chapter = assembly.formatted_chapters(spark.createDataFrame([(1, "f", "ch", 9, "b"), (1, "f", "ch", 3, "a")], "query_id int, filename string, chapter string, root int, text string"))
    assert chapter.first()["text"] == "ch\n\na\n\n---\n\nb"


def test_section_predicates(value, spark):
    c = F.col
    assert value(assembly.is_form(c("t")), t="फिराददाबी पूर्ण") and value(assembly.is_form(c("t")), t="name ..........") and not value(assembly.is_form(c("t")), t="यो हो ।")
    assert value(assembly.is_preamble(c("l"), c("t")), l="०१", t="") and value(assembly.is_preamble(c("l"), c("t")), l="6", t="संशोधन") and not value(assembly.is_preamble(c("l"), c("t")), l="10", t="")
    assert [value(assembly.part_place(c("l"), F.lit("2")), l=x) for x in ("2", "2.8.1", "2.3", "2.9")] == [0, 1, 3, 2]
    assert not value(assembly.is_continuation(c("l"), F.lit("2"), F.lit(True)), l="2.3") and value(assembly.is_continuation(c("l"), F.lit("2"), F.lit(True)), l="2.8")
    content = "परिच्छेद : १\nदफा : १२ — करार\n\nयो (ङ) हो ।"
    assert value(assembly.provision_quality(c("t"), F.lit("12"), F.lit(3), F.lit(None).cast("string")), t=content) == 4 + 2 + 5 + 1 + 3 + 3
    assert value(assembly.part_score(c("s"), c("p"), c("t")), s="(१)", p=["१", "क"], t="उपदफा (२) बमोजिम") == 7
    rows = assembly.enriched(spark.createDataFrame([(1, content + "[PAGE:7]", None)], "id int, content string, section_label string")).first()
    assert (rows["page"], rows["section_label"], rows["section_title"], rows["chapter"]) == (7, "12", "करार", "१")
    usable = assembly.usable_chunks(spark.createDataFrame([(1, "1", "head\nलामो पाठ छ यहाँ राम्रो ।"), (2, "2", "head\nछोटो"), (3, "03", "head\nलामो पाठ छ यहाँ राम्रो ।")], "id int, section_label string, content string"))
    assert [r["id"] for r in usable.collect()] == [1]


CORPUS = [(1, "b", 1, "परिच्छेद १ — सुरु", 1, "पहिलो शीर्षक"), (2, "b", 2, "परिच्छेद २ — करार", 5, "करारको शीर्षक"), (3, "b", 2, "परिच्छेद २ — अन्य", 6, "अन्य शीर्षक"), (4, "c", 2, "परिच्छेद २ — करार", 5, "करारको शीर्षक")]


def test_chapters(spark):
    corpus = spark.createDataFrame(CORPUS, "id long, book_id string, parichhed_no int, chapter string, root int, section_title string")
    hints = spark.createDataFrame([(1, "b", 2, "अन्य"), (2, "b", 2, "छैन"), (3, "c", 2, None)], "query_id long, book_id string, chapter_no int, name string")
    stored = lambda fallback: sorted((r["query_id"], r["chapter"]) for r in chapters.stored_chapters(hints, corpus, fallback).collect())
    assert stored(False) == [(1, CORPUS[2][3]), (3, CORPUS[1][3])] and stored(True) == [(1, CORPUS[2][3]), (2, CORPUS[1][3]), (3, CORPUS[1][3])]
    targets = spark.createDataFrame([(1, "b", CORPUS[1][3])], "query_id long, book_id string, chapter string")
    assert [tuple(r) for r in chapters.opening_sections(targets, corpus).collect()] == [(1, 1, 0.36)]
    queries = spark.createDataFrame([(1, "करारको शीर्षक")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, id long, similarity double")
    assert [tuple(r) for r in chapters.expanded_by_title(none, queries, corpus, targets).collect()] == [(1, 2, 0.86)]
    phrases = spark.createDataFrame([(1, "करारको शी"), (1, "छ")], "query_id long, phrase string")
    assert sorted(r["id"] for r in chapters.by_phrases(phrases, corpus).collect()) == [2, 4]
    sections = spark.createDataFrame([(1, "b", 6)], "query_id long, book_id string, root int")
    assert sorted((r["id"], r["similarity"]) for r in chapters.by_hints(sections, phrases, hints.where("query_id = 1"), corpus).collect()) == [(2, 0.9), (3, 0.92), (4, 0.9)]
    titled = spark.createDataFrame([(1, "c", 5, 0.95), (2, "c", 5, 0.5)], "query_id long, book_id string, root int, score double")
    both = spark.createDataFrame([(1, "b", 6), (2, "b", 6)], "query_id long, book_id string, root int")
    assert sorted(tuple(r) for r in chapters.title_override(both, titled).collect()) == [(1, "c", 5), (2, "b", 6)]


def test_chapter_first(spark):
    corpus = spark.createDataFrame([(*r, f"{r[5]} को पाठ") for r in CORPUS], "id long, book_id string, parichhed_no int, chapter string, root int, section_title string, content string")
    empty = spark.createDataFrame([], "query_id long, book_id string, chapter_no int, name string")
    sections = spark.createDataFrame([(1, "b", 5)], "query_id long, book_id string, root int")
    queries = spark.createDataFrame([(1, "करारको शीर्षक"), (2, "zz")], "query_id long, text string")
    nearest = spark.createDataFrame([(1, 4, 0.9, 1), (1, 2, 0.8, 2), (2, 3, 0.7, 1)], "query_id long, id long, similarity double, rank int")
    terms = spark.createDataFrame([(1, ["करारको"]), (2, ["none"])], "query_id long, terms array<string>")
    found = chapters.chapter_first(sections, empty, queries, queries, terms, corpus, nearest)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, 2), (2, 3)]


def test_evaluation(spark, value):
    runs = spark.createDataFrame([(1, "civil", ["12"], None, "दफा १२ बमोजिम", "advocate", [("c.pdf", "9")]), (2, "civil", ["3"], "2", "यो हो", "advocate", [("x.pdf", "3")]), (3, "civil", ["3"], None, "", None, [])], "num int, book string, sections array<string>, subsection string, answer string, mode string, sources array<struct<filename:string,label:string>>")
    found = {r["num"]: r for r in evaluation.judged(runs, [("civil", "^c", None)], ["civil"]).collect()}
    assert found[1]["passed"] and found[2]["failures"] == ["subsection", "wrong book"] and found[3]["failures"] == ["mode", "section", "no sources"]
    c = F.col
    kind = evaluation.failure_kind(F.lit(True), F.lit(True), c("f"), c("a"), c("s"), F.array(F.struct(F.lit("f").alias("filename"), F.lit("3").alias("label"))))
    assert value(kind, f=["section"], a=[], s=["3"]) == "sources_ok_answer_missing_citation" and value(kind, f=["section"], a=[], s=[]) == "intro_or_early_section_trap"
    keys = spark.createDataFrame([(1, "b", ["1", "2"]), (2, "b", ["9"])], "num int, book string, sections array<string>")
    text = spark.createDataFrame([("b", 1), ("b", 2)], "book string, root int")
    assert sorted((r["num"], r["verified"]) for r in evaluation.verified_keys(keys, text).collect()) == [(1, True), (2, False)]
    periods = spark.range(1).select(evaluation.period_totals(F.array(F.struct(F.lit(100.0).alias("salary"), F.lit(3).alias("months")), F.struct(F.lit(50.0).alias("salary"), F.lit(0).alias("months")))).alias("t")).first()["t"]
    assert tuple(periods) == (350.0, 4)
    stats = spark.createDataFrame([("all", None, 4, 3), ("book", "b", 4, 3)], "by string, value string, n long, passed long")
    assert [r["line"] for r in evaluation.report_lines(stats, "Run").orderBy("n").collect()] == ["# Run", " | by | value | passed | of | ", " |-|-|-|-| ", " | all | all | 3 | 4 | ", " | book | b | 3 | 4 | "]


LAW = "परिच्छेद–१ सुरु\n१२. करारः (१) यो करार हो । (२) दफा ५ को उपदफा\n(३) बमोजिम हुन्छ । (क) पहिलो (ख) दोस्रो"


def test_statute_shapes(spark):
    df = spark.createDataFrame([(1, LAW)], "doc_id long, text string")
    found = [(r["kind"], r["depth"], r["text"]) for r in continuation.blocks(df).orderBy("block").collect()]
    assert [f[:2] for f in found] == [("parichhed", 0), ("dafa", 0), ("upadafa", 1), ("upadafa", 1), ("khanda", 2), ("khanda", 2)]
    assert found[3][2] == "(२) दफा ५ को उपदफा (३) बमोजिम हुन्छ ।"
    text = continuation.indented(df).first()
    assert [tuple(r)[2:] for r in continuation.unclear(df).collect()] == [(3 + 1, "filled stub")] and text["text"].split("\n")[2:5] == ["  (१) यो करार हो ।", "  (२) दफा ५ को उपदफा (३) बमोजिम हुन्छ ।", "    (क) पहिलो"]
    laws = df.select(F.lit('f').alias('file'), 'text', F.lit('markers').alias('format')).union(continuation.indented(df).select(F.lit('g'), 'text', F.lit('indented')))
    parsed = chunking.parse_laws(laws)
    assert parsed.where("file = 'g'").count() == chunking.parse_indented(continuation.indented(df)).count() and parsed.where("file = 'f'").count() == chunking.parse_statutes(df).count()
    ids = [r["chunk_id"] for r in chunking.parse_indented(continuation.indented(df).select("doc_id", "text")).orderBy("chunk_index").collect()]
    assert ids[:2] == ["dafa_12", "dafa_12_upadafa_1"] and ids[-1].endswith("_kha")


def test_splitters(spark):
    whole = "शीर्षक " + "(१) " + "क" * 30 + " (२) " + "ख" * 30 + " (क) " + "ग" * 30
    sections = spark.createDataFrame([(1, 7, whole)], "id long, root int, content string")
    found = [(r["level"], r["label"]) for r in chunking.structured_pieces(sections, "id", 60).orderBy("place").collect()]
    assert found == [("head", ""), ("subsection", "१"), ("head", "२"), ("clause", "२.क")]
    assert [r["level"] for r in chunking.structured_pieces(sections, "id").collect()] == ["section"]
    law = spark.createDataFrame([(1, "preamble\n1. first section (1) one (2) two\n2. second"), (2, "plain text")], "id long, text string")
    assert [(r["section"], r["piece"]) for r in chunking.section_splits(law.where("id = 1"), "id", "text", 20, 5).where("section < 3").orderBy("section", "piece").collect()][:2] == [(0, 0), (1, 0)]
    assert sorted((r["id"], r["chunk_index"]) for r in chunking.by_strategy(law, "id", "text", F.col("id") == 1).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    long_text = spark.createDataFrame([(1, "One is here. Two is here. " + "x" * 50 + ". End.")], "id long, text string")
    assert [r["content"] for r in chunking.by_sentences(long_text, "id", "text", 30).orderBy("chunk_index").collect()] == ["One is here. Two is here.", "x" * 50 + ".", "End."]
    chapters_at = chunking.chapters_in(spark.createDataFrame([(1, "x\nपरिच्छेद–१ सुरु\ny")], "id long, text string"), "id", "text").first()
    assert (chapters_at["at"], chapters_at["chapter"]) == (2, "परिच्छेद–१ सुरु")


def test_calendar_days(spark, value):
    months = calendar.month_starts(calendar.fixed_months(spark))
    df = spark.createDataFrame([(2051, 1), (2051, 13)], "y int, m int")
    assert sorted((r["m"], r["days"]) for r in calendar.with_days(df, "y", "m", months).collect()) == [(1, 31), (13, 30)]
    with pytest.raises(Exception, match="no such year"):
        calendar.with_days(spark.createDataFrame([(1900, 1)], "y int, m int"), "y", "m", months).collect()
    day = lambda *d: [F.lit(x) for x in d]
    assert value(calendar.compared(day(2051, 1, 31), day(2051, 2, 1))) == -1 and value(calendar.compared(day(2051, 2, 1), day(2051, 2, 1))) == 0
    assert value(calendar.is_date(*day(2051, 1, 31, 31))) and not value(calendar.is_date(*day(2051, 1, 32, 31)))
    assert tuple(value(calendar.clamped(*day(2051, 14, 40, 30)))) == (2051, 12, 30)


def test_loads(spark, tmp_path):
    documents = spark.createDataFrame([("a",), ("b",)], "filename string")
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "filename string, id int")
    kept, left = ingest.without_documents(documents, chunks, spark.createDataFrame([("a",)], "filename string"))
    assert [r[0] for r in kept.collect()] == ["b"] and [r["id"] for r in left.collect()] == [3]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise ValueError("not yet")
        return spark.createDataFrame([("one", 1)], "book_id string, id int")

    def broken():
        raise ValueError("never")

    path = str(tmp_path / "chunks")
    assert ingest.load_all({"flaky": flaky, "broken": broken}, path) == {"broken": "never"}
    assert spark.read.parquet(path).count() == 1
    rows = ingest.ingest_rows(chunking.parse_statutes(spark.createDataFrame([(1, LAW)], "doc_id long, text string")), F.lit("f.txt"), F.lit("b")).orderBy("chunk_index")
    assert [r["section_label"] for r in rows.collect()][:2] == ["12", "12"]


def test_law_files(spark, tmp_path):
    for folder, name, text in (("raw", "a.txt", "A"), ("raw", "b.txt", "B"), ("structured", "a.structured.txt", "  A")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    found = tables.law_texts(spark, str(tmp_path / "raw"), str(tmp_path / "structured"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "  A", "indented"), ("b", "B", "markers")]
    (tmp_path / "t.json").write_text('{"bookId": "x", "items": [{"label": "1", "title": "T", "sectionRoot": 1}]}')
    assert [tuple(r) for r in tables.taxonomy_file(spark, str(tmp_path / "t.json")).collect()] == [("x", 1, "T")]


def test_whole_searches(spark):
    corpus = spark.createDataFrame(
        [(1, "f", "b", 1, "ch", "12.1", 12, "the title of twelve", "head\nfirst part", [1.0, 0.0]), (2, "f", "b", 1, "ch", "12.2", 12, "more", "head\nsecond part", [0.0, 1.0]), (3, "g", "c", 1, "ch", "12.1", 12, "same number", "head\nother book", [0.9, 0.1]), (4, "f", "b", 2, "ch", "20", 20, "later", "head\nwords to find", [0.1, 0.9])],
        "id long, filename string, book_id string, parichhed_no int, chapter string, section_label string, root int, section_title string, content string, embedding array<double>",
    )
    queries = spark.createDataFrame([(1, "the title of twelve", [1.0, 0.0], ["none"]), (2, "find", [0.0, 1.0], ["find"])], "query_id long, text string, embedding array<double>, terms array<string>")
    found = {r["query_id"]: r["context"] for r in pipelines.quoted(queries, corpus, 2, 1).collect()}
    assert found[1] == "[1] b · ch · दफा १२.१\nhead\nfirst part\n\nsecond part" and "words to find" in found[2]
    asked = queries.select("query_id", "embedding", "terms", F.array().cast("array<string>").alias("books"), F.lit("b").alias("act"), F.lit(None).cast("int").alias("chapter_no"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.array(F.lit(20)).alias("sections"))
    hints = spark.createDataFrame([(1, "b", 20)], "query_id long, book_id string, root int")
    excluded = spark.createDataFrame([(2, 12)], "query_id long, root int")
    rows = sorted((r["query_id"], r["filename"], r["root"], r["n_parts"]) for r in pipelines.advised(asked, corpus, hints, excluded).collect())
    assert rows == [(1, "f", 12, 2), (1, "f", 20, 1), (2, "f", 20, 1)]
