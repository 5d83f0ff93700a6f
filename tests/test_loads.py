"""Loads that adapt to the table, the order of Nepali terms, hints on one answer, staged searches and small normalisers."""

import pytest
from pyspark.sql import functions as F

from kagajflow.functions import spelling
from kagajflow.operators import glossary, ingest, pipelines, routing
from kagajflow.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_batches_adapt_to_the_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = spark.createDataFrame([(1, "a", 5)], "id long, content string, page int")
    assert ingest.load_batch(first, path, "one") == ingest.Loaded(1)
    narrow = spark.createDataFrame([(2, "b")], "id int, content string")
    assert ingest.load_batch(narrow, path, "two") == ingest.Loaded(1, added=("page",))
    wide = spark.createDataFrame([(3, "c", "6", "x")], "id long, content string, page string, extra string")
    for _ in range(2):  # a repeat replaces itself
        assert ingest.load_batch(wide, path, "three") == ingest.Loaded(1, dropped=("extra",))
        assert rows(ingest.loaded(spark, path), "id", "content", "page") == [(1, "a", 5), (2, "b", None), (3, "c", 6)]
    assert ingest.load_batch(wide.withColumn("id", F.lit(4)), path, "four", widen=True) == ingest.Loaded(1, widened=("extra",))
    assert rows(ingest.loaded(spark, path).where("extra is not null"), "id", "page", "extra") == [(4, 6, "x")] and ingest.loaded(spark, path).count() == 4
    assert [f.dataType.simpleString() for f in ingest.loaded(spark, path).schema if f.name == "page"] == ["int"]


def test_failed_loads_are_repeated_after_longer_pauses(spark, tmp_path):
    pauses, tries = [], []

    def write(df, path):
        tries.append(df.columns)
        if len(tries) < 6:
            raise OSError("not yet")

    df = spark.range(1)
    with pytest.raises(OSError):
        ingest.load_batch(df, str(tmp_path / "none"), "b", write=write, pause=pauses.append)
    assert pauses == [2.0, 4.0, 8.0, 16.0] and len(tries) == 5
    assert ingest.load_batch(df, str(tmp_path / "none"), "b", write=write, pause=pauses.append).tries == 1 and tries[-1] == ["id", "load_batch"]
    del pauses[:], tries[:-1]
    with pytest.raises(OSError):
        ingest.load_batch(df, str(tmp_path / "none"), "b", tries=4, most=5.0, pause=pauses.append, write=lambda *_: (_ for _ in ()).throw(OSError()))
    assert pauses == [2.0, 4.0, 5.0]


def test_nepali_order(spark):
    """Conjuncts stand with their first letter, the anusvara behind what it sounds like; characters alone would order otherwise."""
    terms = ["ज्ञान", "क्षमा", "काम", "कर्म", "त्रास", "तल", "जुन", "अंश", "अन्न", "हक"]
    entries = spark.createDataFrame([(t, "", "", "m") for t in terms], "term string, roman string, english string, meaning string")
    found = [r["term"] for r in glossary.browse(entries, None, 1, 20).collect()]
    assert found == ["अन्न", "अंश", "कर्म", "काम", "क्षमा", "जुन", "ज्ञान", "तल", "त्रास", "हक"] and found != sorted(terms)


def test_reconciled_hints(spark):
    known = spark.createDataFrame([("civil", 1, "contract of sale"), ("civil", 2, "lease of land"), ("penal", 1, "theft of goods"), ("penal", 7, "contract of sale")], "book_id string, root int, title string")
    names = [(0, 1, "contract of sale"), (0, 2, "lease of land"), (1, 1, "contract of sale"), (2, 1, "nothing alike"), (4, 1, "contract of sale"), (4, 2, "theft of goods"), (0, 4, "theft of goods")]
    guesses = [(0, 1, 9), (1, 1, 7), (2, 1, 2), (2, 2, 5), (3, 1, 1), (3, 2, 7), (3, 3, 1), (5, 1, 1)]
    claims = [(0, "penal"), (1, "penal"), (2, "civil"), (3, "penal"), (4, None), (5, None)]
    make = lambda data, schema: spark.createDataFrame(data, schema)
    found = routing.reconciled_hints(make(names, "query_id int, place int, name string"), make(guesses, "query_id int, place int, root int"), make(claims, "query_id int, book_id string"), known)
    got = {r["query_id"]: (r["book_id"], r["roots"], round(r["confidence"], 3), r["dropped"]) for r in found.collect()}
    assert got == {
        0: ("penal", [7], 1.0, [9]),  # two names, one in the claimed book and one in another: the book named first
        1: ("penal", [7], 1.0, []), 2: ("civil", [2], 0.0, [5]), 3: ("penal", [1, 7], 0.0, []), 4: ("civil", [1], 1.0, []), 5: (None, [], 0.0, [1]),
    }


def test_stages_ask_what_is_left(spark):
    asked = []
    queries = spark.createDataFrame([(i,) for i in range(4)], "query_id int")

    def stage(finds):
        def run(left):
            asked.append(sorted(r["query_id"] for r in left.collect()))
            return spark.createDataFrame([(q, i, 1.0) for q, ids in finds.items() for i in ids], "query_id int, id int, similarity double").join(left, "query_id", "left_semi")

        return run

    found = pipelines.staged(queries, stage({0: [1, 2], 1: [1]}), stage({1: [1, 5], 2: [3, 4]}), stage({3: [6]}), stage({3: [7]}), least=2)
    assert asked == [[0, 1, 2, 3], [1, 2, 3], [3], [3]]
    assert rows(found, "query_id", "id", "stage") == [(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 5, 2), (2, 3, 2), (2, 4, 2), (3, 6, 3), (3, 7, 4)]
    asked.clear()
    pipelines.staged(queries.limit(1), stage({0: [1]}), stage({}), stage({}))
    assert len(asked) == 1


@pytest.mark.parametrize(("said", "want"), [("Dafa 12 KO upadafa", "दफा 12 को उपदफा"), ("section sec sections kha_ga", "दफा दफा sections kha_ga"), ("", ""), ("मा ma?", "मा मा?")])
def test_reference_words(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(spelling.reference_words(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("content", "want"),
    [("परिच्छेद12 दफा 3.4 p.5 दफा7\n12.3. पाठ 4", "परिच्छेद १२ दफा ३.४ p.५ दफा7\n१२.३. पाठ 4"), ("दफा  9", "दफा ९"), ("head\nbody 1.", "head\nbody 1."), ("h\n", "h\n")],
)
def test_chunk_numerals(spark, content, want):
    assert spark.createDataFrame([(content,)], "t string").select(spelling.with_devanagari_numbers(F.col("t"))).first()[0] == want


def test_filter_of_the_joined_side_reaches_its_scan(spark, tmp_path):
    spark.createDataFrame([("f", "r1", 1), ("g", "r2", 2)], "filename string, rule string, pages int").write.parquet(str(tmp_path / "documents"))
    documents = spark.read.parquet(str(tmp_path / "documents"))
    chunks = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h")], "id int, filename string")
    found = tables.chunks_of(chunks, documents, ["r1", "none"])
    assert rows(found, "id", "rule", "pages") == [(1, "r1", 1)] and "In(rule" in found._jdf.queryExecution().executedPlan().toString()
