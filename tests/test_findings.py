"""What larger tables showed."""

import random

import duckdb
from compare import duck, same
from pyspark.sql import functions as F

from kagajflow.functions import scores, spelling
from kagajflow.operators import analysis, assembly, chapters, glossary, routing, titles
from kagajflow.plans import portal, searches


def test_an_answer_keeps_the_blank_that_its_last_excerpt_ends_with(spark):
    rows = spark.createDataFrame([(1, 1, "a "), (2, 1, " ")], "query_id long, rank int, text string")
    found = assembly.extractive_answers(rows, F.lit("L"), F.col("text"))
    assert {r["query_id"]: r["answer"] for r in found.collect()} == {1: "[1] L\na ", 2: "[1] L\n "}


def test_a_chapter_is_not_searched_for_single_letters(spark):
    corpus = spark.createDataFrame([(1, "b", "c", "a a"), (2, "b", "c", "word")], "id long, book_id string, chapter string, content string")
    targets = spark.createDataFrame([(7, "b", "c")], "query_id long, book_id string, chapter string")
    terms = spark.createDataFrame([(7, ["a", "word"])], "query_id long, terms array<string>")
    assert [r["id"] for r in chapters.keyword_leg(targets, terms, corpus).collect()] == [2]


def test_texts_are_repaired_where_they_are(spark):
    text = "क the ab। " + "x" * 50 + " the  |"
    found = spelling.repaired(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), {"the": "पूर्जी"})
    assert {r["id"]: r["text"] for r in found.collect()} == {1: "क पूर्जी पर्नेछ। " + "x" * 50 + " the |", 2: ""}
    assert not any(word in found._jdf.queryExecution().toString() for word in ("Window", "Exchange", "Aggregate"))


def random_titles(seed, n):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abक") for _ in range(pick.choice([1, 2, 2, 3, 4, 6])))
    return [pick.choice([" ", ", ", "  "]).join(word() for _ in range(pick.randint(0, 5))) for _ in range(n)] + ["lawful", "unlawful acts", "र", "को र", "गरेको काम", "abcdefgh ijk", "abcdefgh xyz", "abcdefgh ijk lm", "lawful", None]


def test_titles_are_scored_where_they_are_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(titles, "SOME", 7)
    monkeypatch.setattr(titles, "CELLS", 500)
    rows = spark.createDataFrame(list(enumerate(random_titles(6, 120))), "id int, title string")
    names = rows.toDF("name_id", "name")
    score = F.round(scores.title_match(F.col("name"), F.col("title")) + 1e-9, 6).alias("score")
    every = {tuple(r) for r in names.crossJoin(rows).select("name_id", "id", score).where("score > 0.05").collect()}
    met = titles.pairs(names, rows, 0.05)
    assert len(every) > 3000 and {tuple(r) for r in met.collect()} == every
    assert not any(word in met._jdf.queryExecution().executedPlan().toString() for word in ("Join", "Exchange"))


def test_each_task_sends_a_names_best_titles(spark):
    texts = [t for t in random_titles(7, 150) if t is not None]
    rows = spark.createDataFrame([("bc"[i % 2], i // 3, t) for i, t in enumerate(texts)], "book_id string, root int, title string")
    names = spark.createDataFrame([(t,) for t in set(texts)], "name string")
    score = F.round(scores.title_match(F.col("name"), F.col("title")) + 1e-9, 6).alias("score")
    every = names.crossJoin(rows).withColumn("score", score).where("score >= 0.45").groupBy("name", "book_id").agg(F.max_by(F.struct("root", "title", "score"), F.struct("score", -F.col("root"), "title")).alias("m"))
    best = titles.best_of_books(names, rows.coalesce(1), 0.45)
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in every.select("name", "book_id", "m.root", "m.title", "m.score").collect()}
    chapters_ = spark.createDataFrame([(1, "ab ba", ["x"]), (2, "ab ba", ["x", "y"])], "name_id int, name string, groups array<string>")
    same = spark.range(4000).selectExpr("id", "'ab cc' as title", "if(id % 2 = 0, 'x', 'y') as group").coalesce(1)
    assert sorted((r["name_id"], r["id"]) for r in titles.best_rows(chapters_, same, 3, 0.12).collect()) == [(1, 0), (1, 2), (1, 4), (2, 0), (2, 1), (2, 2)]


def test_what_is_there_already_takes_no_place_among_the_best_titles(spark):
    corpus = spark.createDataFrame([(i, "b", "c", "one two") for i in range(9)], "id long, book_id string, chapter string, section_title string")
    rows = spark.createDataFrame([(7, 0, 1.0), (7, 2, 0.9)], "query_id long, id long, similarity double")
    found = chapters.expanded_by_title(rows, spark.createDataFrame([(7, "two")], "query_id long, text string"), corpus, spark.createDataFrame([(7, "b", "c")], "query_id long, book_id string, chapter string"), most=3)
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2, 3, 4]


def glossary_tables(spark, folder, suppliers, parts):
    spark.range(parts).selectExpr("id as p_partkey", "concat('name ', id % 7) as p_name", "concat('Brand#', id % 3) as p_brand", "if(id % 2 = 0, 'SMALL', 'LARGE') as p_type").write.parquet(f"{folder}/part.parquet")
    spark.range(suppliers).selectExpr("cast(id as int) as s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) as s_name").write.parquet(f"{folder}/supplier.parquet")
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_the_last_page_of_more_than_a_thousand(spark, tmp_path):
    con = glossary_tables(spark, str(tmp_path), 30_050, 20)
    run, sql = portal.QUERIES["glossary_browse"]
    same(run(spark, str(tmp_path)).toPandas(), con.sql(sql).df())


def test_pages_from_either_end_are_the_same(spark):
    entries = spark.range(100).selectExpr("concat('क', id div 3) as term", "if(id % 5 = 0, null, 'r') as roman", "cast(id as string) as english", "'m' as meaning").repartition(3)
    pages = [[r["english"] for r in glossary.browse(entries, None, page, 30).collect()] for page in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [30, 30, 30, 10] and len({e for p in pages for e in p}) == 100
    assert sum(pages, []) == [r["english"] for r in entries.orderBy(F.collate("term", "ne"), "term", "roman", "english").collect()]


def test_copies_of_queries_and_entries_are_looked_for_once(spark, tmp_path, monkeypatch):
    con = glossary_tables(spark, str(tmp_path), 700, 900)
    blocks = []
    whole = glossary.in_blocks
    monkeypatch.setattr(glossary, "in_blocks", lambda queries, block: blocks.append(queries.count()) or whole(queries, block))
    run, sql = portal.QUERIES["glossary_search"]
    same(run(spark, str(tmp_path)).toPandas(), con.sql(sql).df())
    assert blocks == [10, 10]  # of 34


def test_lines_are_shortened_to_their_greatest_length(spark):
    lines = spark.createDataFrame([("b", f"{n}. " + "x" * n) for n in (116, 117, 118, 130)], "book_id string, line string")
    found = {r["root"]: r["title"] for r in analysis.taxonomy_lines(lines).collect()}
    assert found == {116: "x" * 116, 117: "x" * 117, 118: "x" * 116 + "…", 130: "x" * 116 + "…"}


def test_queries_without_a_vector_are_advised_by_words(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 450").toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 150").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    run, sql = searches.QUERIES["advised_sections"]
    found = run(spark, str(tmp_path)).toPandas()
    assert set(found["query_id"]) == {0, 100, 300}
    same(found, duck(tmp_path).sql(sql).df())


def test_hints_with_a_number_too_large_for_a_section(spark):
    known = spark.createDataFrame([("b", 4, "sale of land 4"), ("b", 5, "lease")], "book_id string, root int, title string")
    names = spark.createDataFrame([(1, 1, "4305024215708615"), (1, 2, "99999999999 lease"), (2, 1, "sale 4")], "query_id int, place int, name string")
    none = spark.createDataFrame([], "query_id int, place int, root int")
    found = routing.reconciled_hints(names, none, spark.createDataFrame([], "query_id int, book_id string"), known)
    assert {r["query_id"]: (r["book_id"], r["roots"]) for r in found.collect()} == {1: ("b", [5]), 2: ("b", [4])}


def test_a_name_with_a_number_too_large_for_a_section_is_matched_by_its_words(spark):
    taxonomy = spark.createDataFrame([("b", 4, "sale of land"), ("b", 5, "lease")], "book_id string, root int, title string")
    names = spark.createDataFrame([(1, "4305024215708615", "b"), (1, "99999999999 lease", "b"), (2, "sale ४", "b")], "query_id int, name string, book_id string")
    found = routing.reconcile(names, taxonomy)
    assert {(r["query_id"], r["name"], r["root"]) for r in found.collect()} == {(1, "99999999999 lease", 5), (2, "sale ४", 4)}


def test_pairs_of_several_blocks_of_names_are_not_written(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(random_titles(8, 60))), "id int, title string")
    names = rows.toDF("name_id", "name")
    whole = {tuple(r) for r in titles.pairs(names, rows, 0.05).collect()}
    written = []
    stored = titles.stored
    monkeypatch.setattr(titles, "BLOCK", 20)
    monkeypatch.setattr(titles, "stored", lambda frames, name: written.append(name) or stored(frames, name))
    met = titles.pairs(names, rows, 0.05)
    assert {tuple(r) for r in met.collect()} == whole and written == ["titles", "names"]
    assert "Union" in met._jdf.queryExecution().executedPlan().toString()


def overlap(name, title):
    short, long_ = sorted((len(name), len(title)))
    if name in title or title in name:
        return 0.75 + short / long_ * 0.25 if short else 0.0
    shared = next(i for i in range(short) if name[i] != title[i])
    return 0.55 + shared / short * 0.35 if shared >= 8 else 0.0


def test_runs_find_the_words_that_hold_a_title_or_its_words():
    pick = random.Random(9)
    texts = [" ".join("".join(pick.choice("abक") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(1, 4))) for _ in range(300)]
    names = titles.Names(texts, [t.split() for t in texts])
    assert names.n == 300 and max(map(len, names.runs)) == titles.RUN
    for text in texts + ["abcdefghi", "", "ab"]:
        for word in text.split():
            assert {names.words[k] for k in names.related(word)} == {w for w in names.words if w in word or word in w}
        assert names.overlaps(text) == {q: score for q, t in enumerate(texts) if (score := overlap(t, text))}
