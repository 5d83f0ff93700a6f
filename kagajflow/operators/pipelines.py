"""Whole searches as compositions: what a quoted and an advised answer are made from, for a batch of queries.

A search goes in stages. Each stage is asked by the queries alone that no stage before has answered well enough; its rows and the queries
that are left are written, so a later, costlier stage neither repeats the ones before nor runs for queries that don't need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import source_label
from ..sources.shared import stored
from . import assembly, chapters, routing, search, sections

Stage = Callable[[DataFrame], DataFrame]


def with_fields(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    return rows.join(corpus.drop("embedding"), "id")  # a corpus without embeddings does as well


def staged(queries: DataFrame, *stages: Stage, least: int = 1) -> DataFrame:
    """(query_id, id, similarity, stage): what the stages (rows of query_id, id, similarity for some queries) find, each asked by the queries (query_id, ...) that have fewer than `least` rows so far. A row that an earlier stage has found isn't added."""
    left, found = queries, None
    for n, stage in enumerate(stages, 1):
        rows = stage(left).select("query_id", "id", "similarity").withColumn("stage", F.lit(n))
        if found is not None:
            rows = rows.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        rows = stored([rows], "stage")
        found = rows if found is None else found.unionByName(rows)
        enough = found.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("query_id")
        if n < len(stages):
            left = stored([left.join(enough, "query_id", "left_anti")], "queries")
            if left.isEmpty():
                break
    return found


def quoted(queries: DataFrame, corpus: DataFrame, k: int = 8, most: int = 3, words: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, context): the provisions that a query (query_id, text, embedding, terms) names, by section, else by title, else by fused search.

    Of fused results introductions go where later sections of the same file are found; the first `most` sections are given whole. A query
    without an embedding is searched by its terms alone. words: the corpus' postings, if they are stored; texts: the corpus without embeddings.
    """
    vectors, corpus = corpus, corpus if texts is None else texts

    def fused(left: DataFrame) -> DataFrame:
        return search.hybrid(left.where("embedding is not null"), left, vectors, k, words=words).select("query_id", "id", F.col("score").alias("similarity"))

    found = staged(queries, lambda left: routing.by_section(left, corpus), lambda left: routing.by_title(left, corpus), fused)
    rows = search.ranked(with_fields(found, corpus), "similarity")
    searched = sections.introductions_dropped(rows.where("stage = 3")).select(rows.columns)
    first = sections.first_sections(rows.where("stage < 3").unionByName(searched), most)
    whole = sections.all_parts(first, corpus).select("query_id", "id").distinct()
    best = first.groupBy("query_id", "filename", "root").agg(F.max("similarity").alias("similarity"))
    parts = with_fields(whole, corpus).join(best, ["query_id", "filename", "root"]).withColumn("page", F.lit(0))
    ready = search.ranked(assembly.stitched(parts), "similarity").join(corpus.select("id", "book_id", "chapter", "section_label"), "id")
    return assembly.context_blocks(ready, source_label(F.col("book_id"), F.col("chapter"), F.lit(None).cast("string"), F.col("section_label")), F.col("content"), most)


def by_words(queries: DataFrame, corpus: DataFrame, k: int, words: DataFrame | None = None, version: int = 3) -> DataFrame:
    """What boosted search gives without vectors: rows that have all terms, and exact sections, in the query's books, by the same boosts."""
    _, act, chapter, in_range, exact, keyword = search.BOOSTS[version]
    hits = search.covers(queries, corpus if words is None else words).withColumnRenamed("similarity", "keyword")
    named = queries.select("query_id", F.explode("sections").alias("root")).join(corpus.select("id", "root"), "root").select("query_id", "id")
    every = hits.select("query_id", "id").unionByName(named).distinct().join(hits, ["query_id", "id"], "left").join(queries.drop("embedding", "terms"), "query_id").join(corpus.select("id", "book_id", "parichhed_no", "root"), "id")
    every = every.where((F.size("books") == 0) | F.array_contains("books", F.col("book_id")))
    boost = lambda test, by: F.when(test, F.lit(float(by))).otherwise(0.0)
    total = (
        boost(F.col("book_id") == F.col("act"), act) + boost(F.col("parichhed_no") == F.col("chapter_no"), chapter) + boost(F.col("root").between(F.col("low"), F.col("high")), in_range)
        + boost(F.array_contains("sections", F.col("root")), exact) + keyword * F.coalesce("keyword", F.lit(0.0))
    )
    return search.ranked(every.select("query_id", "id", F.round(total + search.NUDGE, search.DIGITS).alias("similarity")), "similarity", most=k)


def advised(queries: DataFrame, corpus: DataFrame, hints: DataFrame, excluded: DataFrame, k: int = 24, most: int = 16, topics: DataFrame | None = None, words: DataFrame | None = None, floor: float = 0.9, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, filename, root, similarity, n_parts, content): the sections that an answer is written from, by similarity.

    queries: as search.boosted takes them, with the preferred act. Boosted search; for queries that it finds nothing for (without an
    embedding, or without a row in their books) the same boosts by words; for those that have nothing still their topics' sections
    (topics: query_id, book_id, root) at the floor. Then fused with hinted sections (query_id, book_id, root), without excluded ones
    (query_id, root) and homonyms of the act's sections in other books, within the budget, each section whole. texts: the corpus without embeddings.
    """
    vectors, corpus = corpus, corpus if texts is None else texts
    stages: list[Stage] = [lambda left: search.boosted(left.where("embedding is not null"), vectors, k, texts=texts), lambda left: by_words(left, corpus, k, words)]
    if topics is not None:
        stages.append(lambda left: chapters.hinted_sections(topics.join(left.select("query_id"), "query_id", "left_semi"), corpus, similarity=floor))
    pool = search.ranked(staged(queries, *stages), "similarity", most=k)
    hinted = search.ranked(chapters.hinted_sections(hints, corpus, excluded), "similarity")
    fused = chapters.fused_with_hints(pool.select("query_id", "id", "rank", "similarity"), hinted).drop("place")
    rows = routing.without_sections(with_fields(fused, corpus), excluded).join(queries.select("query_id", F.col("act").alias("_act")), "query_id")
    own = rows.where(F.col("book_id") == F.col("_act")).select("query_id", "root").distinct().withColumn("_own", F.lit(True))
    rows = rows.join(own, ["query_id", "root"], "left").where((F.col("book_id") == F.col("_act")) | F.col("_own").isNull() | F.col("_act").isNull()).drop("_own", "_act")
    kept = search.ranked(sections.budget(rows, most), "similarity")
    parts = sections.hydrate_sections(kept, corpus, floor=0.0)
    return sections.collapse(with_fields(parts.select("query_id", "id", "similarity"), corpus))
