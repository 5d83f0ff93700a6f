"""Golden cases: fusion, chunks, statutes, calendar, money, glossary, loading and streams."""

import datetime
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from kagajflow.functions import cleaning, finance, scores, text
from kagajflow.operators import calendar, chunking, glossary, ingest, outline, routing, search, usage
from kagajflow.sources import tables
from kagajflow.streaming import usage as stream_usage


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ranked_lists(spark):
    vector = spark.createDataFrame([(1, "A", 0.92, 1), (1, "B", 0.88, 2), (1, "C", 0.85, 3)], "query_id int, id string, similarity double, rank int")
    keyword = spark.createDataFrame([(1, "B", 0.95, 1), (1, "D", 1.0, 2), (1, "A", 0.5, 3)], "query_id int, id string, similarity double, rank int")
    return vector, keyword


def test_fusion_puts_what_both_lists_have_first(spark):
    vector, keyword = ranked_lists(spark)
    fused = search.fuse_ranks({"vector": (vector, 1), "keyword": (keyword, 1)}).orderBy("rank").collect()
    assert [r["id"] for r in fused][0] == "B" and (fused[0]["vector_rank"], fused[0]["keyword_rank"]) == (2, 1)
    assert abs(fused[0]["score"] - (1 / 62 + 1 / 61)) < 1e-8
    assert search.best_of([vector, keyword]).orderBy("rank").first()["id"] == "D"
    assert search.fuse_ranks({"vector": (vector, 1)}).orderBy("rank").first()["id"] == "A"
    assert search.fuse_ranks({"vector": (vector.limit(0), 1)}).count() == 0


def test_cosine_of_null_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["id"], r["similarity"]) for r in search.nearest(queries, corpus, 5).orderBy("rank").collect()] == [(1, 1.0), (3, None)]


def test_or_search_only_where_and_finds_nothing(spark):
    corpus = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "blue")], "id long, content string")
    queries = spark.createDataFrame([(1, ["red", "fox"]), (2, ["hen", "blue"])], "query_id long, terms array<string>")
    assert rows(search.full_text_or_fallback(queries, corpus, 9).select("query_id", "id"), "query_id", "id") == [(1, 1), (2, 2), (2, 3)]


def test_sized_pieces_end_at_sentences_and_overlap():
    body = ("word " * 120 + "end. ") * 4
    found = list(chunking.sized_pieces(body))
    assert all(len(p) <= 800 for p in found) and found[0].endswith("end.")
    assert list(chunking.sized_pieces("")) == [] and list(chunking.sized_pieces("  a\n b ")) == ["a b"]
    assert [len(p) for p in chunking.sized_pieces("x" * 1500)] == [800, 800, 300]


STATUTE = (
    "भाग–१ परिच्छेद–२ करार सम्बन्धी १३. करारको परिभाषाः (१) यो करार हो । (२) दफा ९५ को खण्ड(ख),(ग) बमोजिम हुनेछ । (क) पहिलो (ख) दोस्रो "
    "तरः यो लागू हुने छैन । स्पष्टीकरणः यहाँ अर्थ ।\n12\n १४. हदम्यादः दफा १३ बमोजिम छ महिना"
)


def test_statutes(spark):
    found = chunking.parse_statutes(spark.createDataFrame([(1, STATUTE), (2, None), (3, "no law")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_id"] for r in found] == [
        "dafa_13", "dafa_13_upadafa_1", "dafa_13_upadafa_2", "dafa_13_upadafa_2_ka", "dafa_13_upadafa_2_kha", "dafa_13_tar_1", "dafa_13_spastikaran_1", "dafa_14",
    ]
    assert found[1]["content"] == "[भाग-१, परिच्छेद–२, दफा १३]: करारको परिभाषाः -> (१) यो करार हो ।"
    assert {(r["section"], r["clause"]) for r in found[2]["references"]} == {("९५", "ख"), ("९५", "ग")}
    assert {r["chapter_hadamyad_dafa"] for r in found} == {"१४"} and found[-1]["provision_role"] == "hadamyad"
    assert [(r["section"], r["subsection"]) for r in found[-1]["references"]] == [("१३", None)]
    assert found[0]["parichhed"] == "परिच्छेद २ — करार सम्बन्धी" and found[3]["upadafa"] == "२" and found[3]["khanda"] == "क"


def test_text_functions(spark):
    assert one(spark, text.to_ascii_digits(F.lit("दफा १२३"))) == "दफा 123"
    assert one(spark, text.section_number(F.lit("१७५.८"))) == 175 and one(spark, text.section_number(F.lit(""))) is None
    assert one(spark, text.chapter_number(F.lit("परिच्छेद–१२ नाम"))) == 12
    assert one(spark, text.slug(F.lit(" Land & Tax (2) "))) == "land-and-tax-2"
    assert one(spark, text.header_field(F.lit("पुस्तक: क\nदफा: १\n\nदफा: २"), "दफा")) == "१"
    assert one(spark, text.body_of(F.lit("h: 1\n\nbody"))) == "body"
    assert one(spark, scores.title_match(F.lit("बाल विवाह"), F.lit("बाल विवाह गर्न नहुने"))) > 0.75
    assert one(spark, scores.title_match(F.lit("abc"), F.lit("xyz"))) == 0.0


def test_money(spark):
    assert one(spark, finance.emi(F.lit(1200.0), F.lit(0.0), F.lit(12))) == 100.0
    assert one(spark, finance.emi(F.lit(-1.0), F.lit(5.0), F.lit(12))) is None
    assert abs(one(spark, finance.emi(F.lit(100000.0), F.lit(12.0), F.lit(12))) - 8884.8788) < 1e-3
    assert one(spark, finance.slab_tax(F.lit(1_200_000.0), finance.SALARY_SLABS["2083-84"], F.lit(False))) == 30_000.0
    assert one(spark, finance.of_slab(F.lit("car"), F.lit(1000), 1)) == 22_000.0 and one(spark, finance.of_slab(F.lit("car"), F.lit(0), 1)) is None
    assert tuple(one(spark, finance.hill_units(F.lit(508.7374778 + 31.7960924)))) == (1, 1, 0, 0)
    assert one(spark, finance.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, usage.billable(F.lit(10), F.lit(5), F.lit(3))) == 14


def test_calendar_round_trip_and_fiscal_year(spark):
    starts = calendar.month_starts(calendar.fixed_months(spark))
    days = spark.createDataFrame([(datetime.date(1994, 4, 14),), (datetime.date(1994, 4, 13),), (datetime.date(2001, 8, 1),)], "day date")
    found = calendar.to_bs(days, "day", starts)
    assert rows(found.select("bs_year", "bs_month", "bs_day"), F.asc_nulls_first("bs_year")) == [(None, None, None), (2051, 1, 1), (2058, 4, 17)]
    back = calendar.to_ad(spark.createDataFrame([(2058, 4, 17), (2058, 4, 33)], "y int, m int, d int"), "y", "m", "d", starts)
    assert [r["ad_date"] for r in back.orderBy("d").collect()] == [datetime.date(2001, 8, 1), None]


def test_calendar_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({str(y): list(d) for y, d in calendar.MONTH_DAYS.items()}))
    assert rows(calendar.calendar_file(spark, str(tmp_path / "c.json")), "year", "month") == rows(calendar.fixed_months(spark), "year", "month")


def test_glossary_ladder(spark):
    def score(field, query):
        return one(spark, glossary.field_score(F.lit(field), F.lit(query)))

    assert [score(f, "act") for f in ("act", "action", "an act", "an action act", "fact", "a cat", "x")] == [100, 90, 95, 85, 70, 45, 0]
    assert score("a big cot", "abc") == 45 and score("", "a") == 0
    assert one(spark, glossary.entry_key(F.lit("term"), F.lit("A.Na.Mi."))) == "anami"
    assert one(spark, glossary.index_letter(F.lit("क्षमा"))) == "क्ष"


def test_glossary_and_page_map_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entries": [{"term": "t", "Roman Transliteration": "r", "meaning": "m"}]}))
    assert rows(tables.glossary_file(spark, str(tmp_path / "g.json")).select("term", "roman", "meaning"), "term") == [("t", "r", "m")]
    (tmp_path / "p.json").write_text(json.dumps({"bookId": "b", "map": {"1": 4, "2": 6}}))
    (tmp_path / "o.json").write_text(json.dumps({"bookId": "b", "map": {"2": 7}}))
    assert rows(tables.page_map(spark, str(tmp_path / "p.json"), str(tmp_path / "o.json")), "root") == [("b", "1", 4), ("b", "2", 7)]
    (tmp_path / "q.txt").write_text("1. first? -> (civil, दफा १)\nnoise\n2. second? -> (civil, दफा २)\n1. third? -> (penal, दफा ३)\n")
    assert rows(tables.question_bank(spark, str(tmp_path / "q.txt")).select("batch", "num", "book"), "seq") == [(1, 1, "civil"), (1, 2, "civil"), (2, 1, "penal")]


def test_loading_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    one_book = spark.createDataFrame([Row(id=1, book_id="a"), Row(id=2, book_id="b")])
    ingest.load(one_book, path)
    ingest.load(one_book.where("book_id = 'a'").withColumn("id", F.col("id") + 10), path)
    assert rows(spark.read.parquet(path).select("id", "book_id"), "id") == [(2, "b"), (11, "a")]


def test_stream_gives_the_windows_of_a_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_usage.event_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double")
    stream_usage.write_windows(stream_usage.windowed(stream, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = set(rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "event_type"))
    want = rows(stream_usage.windowed(events), "window_start", "event_type")
    last = max(w[0] for w in want)
    assert got <= set(want) and {w for w in want if w[0] < last} <= got  # the last window stays open


def test_answers_are_checked(spark):
    cases = spark.createDataFrame([("दफा १", ["दफा"], ["x"], 2, 1), ("y", ["दफा"], ["y"], 0, 1)], "answer string, must array<string>, must_not array<string>, sources int, min_sources int")
    found = usage.check_answers(cases).orderBy("answer").collect()
    assert [r["passed"] for r in found] == [False, True] and found[0]["failures"] == ["missing दफा", "has y", "too few sources"]


def test_cleaning(spark):
    assert one(spark, cleaning.cleaned(F.lit("कानू न र  म ा छ "), [(r"छ\s*$", "छन्")])) == "कानून र मा छन्"
    assert one(spark, cleaning.to_devanagari(F.lit("Nepal Ko kanun xyz"), [("nepal ko", "नेपालको")], {"kanun": "कानून"})) == "नेपालको कानून xyz"
    assert one(spark, cleaning.quality_ok(F.lit("क (१) ख ।"), F.lit("का (१) ख ।"))) and not one(spark, cleaning.quality_ok(F.lit("क ।"), F.lit("क")))
    assert one(spark, cleaning.legal_numerals(F.lit("see dafa 12 and 7"))) == "see दफा १२ and 7"
    assert one(spark, cleaning.less_latin(F.lit("a क"), F.lit("क"))) == "क"


def test_references_and_paths(spark):
    assert tuple(one(spark, routing.reference_in(F.lit("दफा १७५ को उपदफा (२)")))) == (175, 2, None, None)
    assert one(spark, routing.reference_in(F.lit("show dafa_12_upadafa_3")))["chunk_id"] == "dafa_12_upadafa_3"
    content = F.lit("[भाग-१, दफा १३]: परिभाषाः -> (२) -> (ख) पाठ (३)")
    assert one(spark, outline.path_of(content)) == ["(२)", "(ख)"] and one(spark, outline.part_order(outline.path_of(content))) == 20_002
    assert one(spark, outline.part_order(outline.path_of(F.lit("[दफा १]: शीर्षक")))) == 999_999


def test_reconciling_prefers_the_numbered_section(spark):
    taxonomy = spark.createDataFrame([("civil", 13, "करारको परिभाषा"), ("civil", 14, "करारको परिणाम"), ("penal", 13, "कसूर")], "book_id string, root int, title string")
    names = spark.createDataFrame([(1, "दफा १४ करारको परि", "civil"), (1, "कसूर", "penal"), (2, "zzz", "civil")], "query_id int, name string, book_id string")
    found = {r["name"]: r["root"] for r in routing.reconcile(names, taxonomy).collect()}
    assert found == {"दफा १४ करारको परि": 14, "कसूर": 13}


def test_cascade_takes_the_first_stage_with_rows(spark):
    first = spark.createDataFrame([(1, 10, 1.0)], "query_id int, id int, similarity double")
    second = spark.createDataFrame([(1, 11, 0.5), (2, 12, 0.4)], "query_id int, id int, similarity double")
    assert rows(routing.cascade(first, second).select("query_id", "id"), "query_id") == [(1, 10), (2, 12)]
