"""Chapters and hints: which chapter a query is about, what of it and of hinted sections is added, and searches by several texts at once.

Rows are (query_id, id, similarity). Lookups are equi-joins on book, chapter and section; where a name must match in part, it does so
among the rows that an equi-join on book and number has found. Cascades are unions of stages, of which a query takes the first that
has anything, so a batch of queries stays one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chapter_name
from .analysis import chapter_title_score, hint_boost
from .routing import cascade, title_keys
from . import titles
from .search import NUDGE, best_of, full_text, fuse_ranks, ranked
from .sections import budget, collapse


def floored(rows: DataFrame, floor: float) -> DataFrame:
    return rows.withColumn("similarity", F.greatest("similarity", F.lit(floor)))


def stored_chapters(hints: DataFrame, corpus: DataFrame, fallback: bool = False) -> DataFrame:
    """hints (query_id, book_id, chapter_no, name; name may be null) with the chapter as stored: of the book's chapters with that number the first whose name has the hint's.

    With fallback the number alone will do where no name fits.
    """
    chapters = corpus.groupBy("book_id", F.col("parichhed_no").alias("chapter_no"), "chapter").agg(F.min("id").alias("first"))
    pairs = hints.join(chapters, ["book_id", "chapter_no"])
    fits = F.coalesce(F.contains("chapter", F.col("name")), F.lit(True))
    kept = pairs if fallback else pairs.where(fits)
    best = F.min_by("chapter", F.struct((~fits).alias("other"), "first"))
    return kept.groupBy("query_id", "book_id", "chapter_no").agg(best.alias("chapter"))


def chapters_of_sections(sections: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, book_id, chapter): the chapters of sections (query_id, book_id, root), each section's by its first row; each chapter once."""
    first = corpus.groupBy("book_id", "root").agg(F.min_by("chapter", "id").alias("chapter"))
    return sections.select("query_id", "book_id", "root").distinct().join(first, ["book_id", "root"]).select("query_id", "book_id", "chapter").distinct()


def chapters_by_name(queries: DataFrame, corpus: DataFrame, least: float = 0.12, most: int = 6) -> DataFrame:
    """(query_id, book_id, chapter, score): the chapters whose names fit a query's text (query_id, text) best.

    There are far fewer chapters than chunks; they meet the queries by keys that every two of any score share.
    """
    chapters = corpus.select("book_id", "chapter").distinct().withColumn("name", chapter_name(F.col("chapter")))
    known = chapters.select("*", F.explode(F.array_distinct(F.concat(title_keys(F.col("chapter"), False), title_keys(F.col("name"), False)))).alias("key"))
    met = queries.select("query_id", "text", F.explode(title_keys(F.col("text"), True)).alias("key")).join(known, "key").drop("key").distinct()
    scored = met.withColumn("score", F.round(chapter_title_score(F.col("text"), F.col("chapter"), F.col("name")) + NUDGE, 6)).where(F.col("score") >= least)
    return ranked(scored, "score", ties=("book_id", "chapter"), most=most).select("query_id", "book_id", "chapter", "score", "rank")


def target_chapters(sections: DataFrame, hints: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, book_id, chapter): the chapters of a query's sections, else of its hints, else the one whose name fits best."""
    stages = [
        chapters_of_sections(sections, corpus),
        stored_chapters(hints, corpus, fallback=True).select("query_id", "book_id", "chapter"),
        chapters_by_name(queries, corpus, most=1).select("query_id", "book_id", "chapter"),
    ]
    every = reduce(DataFrame.unionByName, (s.withColumn("stage", F.lit(n)) for n, s in enumerate(stages)))
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return every.withColumn("_first", first).where("stage = _first").drop("stage", "_first").distinct()


def in_target(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """The chunks of each query's chapters."""
    return targets.join(corpus, ["book_id", "chapter"])


def opening_sections(targets: DataFrame, corpus: DataFrame, most: int = 3, floor: float = 0.36) -> DataFrame:
    """The first sections of a target book's first chapter, as context."""
    books = targets.select("query_id", "book_id").distinct()
    return books.join(corpus.where((F.col("parichhed_no") == 1) & F.col("root").between(1, most)), "book_id").select("query_id", "id", F.lit(floor).alias("similarity"))


def keyword_leg(targets: DataFrame, terms: DataFrame, corpus: DataFrame, k: int = 24, keep: int = 12, floor: float = 0.738) -> DataFrame:
    """Full-text matches of terms of two or more letters within a query's chapters: the best k, of them `keep`, at least at the floor.

    The rows found meet their chapters, then the query's: chapters and their chunks aren't put together by query.
    """
    terms = terms.select("query_id", F.filter("terms", lambda t: F.length(t) > 1).alias("terms"))
    placed = full_text(terms, corpus, k, mode="or").drop("rank").join(corpus.select("id", "book_id", "chapter"), "id")
    inside = placed.join(targets, ["query_id", "book_id", "chapter"], "left_semi").select("query_id", "id", "similarity").dropDuplicates(["query_id", "id"])
    found = ranked(inside, "similarity", most=min(k, keep))
    return floored(found.select("query_id", "id", "similarity"), floor)


def expanded_by_title(rows: DataFrame, queries: DataFrame, corpus: DataFrame, targets: DataFrame, least: float = 0.12, most: int = 6, floor: float = 0.86) -> DataFrame:
    """rows and, of their target chapters, the sections whose titles fit the query's text (query_id, text), best ones first, at the floor; what is there already isn't added."""
    chapter = F.to_json(F.array("book_id", "chapter"))
    asked = targets.where("book_id is not null and chapter is not null").groupBy("query_id").agg(F.collect_set(chapter).alias("groups")).join(queries.select("query_id", "text"), "query_id")
    there = rows.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0  # so many of a query's best may be there already
    names = asked.select(F.col("query_id").alias("name_id"), F.col("text").alias("name"), "groups")
    scored = titles.best_rows(names, corpus.select("id", F.col("section_title").alias("title"), chapter.alias("group")), most + there, least).withColumnRenamed("name_id", "query_id")
    new = scored.join(rows.select("query_id", "id"), ["query_id", "id"], "left_anti")
    best = ranked(new, "score", most=most).select("query_id", "id", F.lit(floor).alias("similarity"))
    return rows.select("query_id", "id", "similarity").unionByName(best)


def chapter_first(sections: DataFrame, hints: DataFrame, queries: DataFrame, vectors: DataFrame, terms: DataFrame, corpus: DataFrame, nearest: DataFrame, k: int = 12) -> DataFrame:
    """Search by chapter first: the target chapters' rows among the nearest (query_id, id, rank) and by keywords and titles, fused; queries without a chapter keep the nearest."""
    targets = target_chapters(sections, hints, queries, corpus)
    inside = in_target(targets, corpus).select("query_id", "id")
    vector = ranked(nearest.select("query_id", "id", "similarity").join(inside, ["query_id", "id"], "left_semi"), "similarity")
    keyword = ranked(keyword_leg(targets, terms, corpus), "similarity")
    titled = ranked(expanded_by_title(nearest.limit(0), queries, corpus, targets, most=8), "similarity")
    fused = fuse_ranks({"vector": (vector, 0.4), "keyword": (keyword, 0.6), "title": (titled, 0.5)}).where(F.col("rank") <= k)
    return cascade(fused.withColumnRenamed("score", "similarity"), nearest.select("query_id", "id", "similarity"))


def hinted_sections(hints: DataFrame, corpus: DataFrame, excluded: DataFrame | None = None, similarity: float = 1.0) -> DataFrame:
    """The chunks of hinted sections (query_id, book_id, root), without excluded ones (query_id, root)."""
    wanted = hints.select("query_id", "book_id", "root").distinct()
    if excluded is not None:
        wanted = wanted.join(excluded.select("query_id", "root"), ["query_id", "root"], "left_anti")
    return wanted.join(corpus.select("id", "book_id", "root"), ["book_id", "root"]).select("query_id", "id", F.lit(similarity).alias("similarity"))


def by_phrases(phrases: DataFrame, corpus: DataFrame, floor: float = 0.90, head: int = 3) -> DataFrame:
    """The chunks whose titles begin with a phrase of three characters and more (query_id, phrase), at least at the floor: joined by their first characters."""
    asked = phrases.where(F.length("phrase") >= head).select("query_id", F.lower("phrase").alias("p"), F.lower(F.substring("phrase", 1, head)).alias("head"))
    known = corpus.select("id", F.lower("section_title").alias("t"), F.lower(F.substring("section_title", 1, head)).alias("head"))
    found = asked.join(known, "head").where(F.col("t").startswith(F.col("p")))
    return found.groupBy("query_id", "id").agg(F.lit(floor).alias("similarity"))


def by_hints(sections: DataFrame, phrases: DataFrame, chapters: DataFrame, corpus: DataFrame) -> DataFrame:
    """All that hints name: sections at 0.92, titles at 0.90, chapters' chunks at 0.80, each row at its best."""
    of_chapters = in_target(stored_chapters(chapters, corpus).select("query_id", "book_id", "chapter"), corpus).select("query_id", "id", F.lit(0.80).alias("similarity"))
    return best_of([hinted_sections(sections, corpus, similarity=0.92), by_phrases(phrases, corpus), of_chapters])


def prepared_hints(hinted: DataFrame, vector: DataFrame) -> DataFrame:
    """Hinted rows (query_id, id, filename, root, section_label, content, similarity) collapsed by section, at least at the best similarity of the vector rows."""
    top = vector.groupBy("query_id").agg(F.max("similarity").alias("_top"))
    return collapse(hinted).join(top, "query_id", "left").withColumn("similarity", F.greatest("similarity", F.coalesce("_top", F.lit(0.0)))).drop("_top")


def fused_with_hints(rows: DataFrame, hinted: DataFrame, floor: float = 0.85) -> DataFrame:
    """Ranked rows and hinted ones (query_id, id, rank, similarity) fused 0.6 to 0.4; hinted rows get the hint's boost on top of their similarity."""
    fused = fuse_ranks({"hybrid": (rows, 0.6), "hint": (hinted, 0.4)}).withColumnRenamed("rank", "place")
    scored = fused.join(rows.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    own = F.coalesce("similarity", F.lit(0.0))
    return scored.withColumn("similarity", F.when(F.col("hint_rank").isNotNull(), hint_boost(own, floor)).otherwise(own)).select("query_id", "id", "place", "similarity")


def many_queries(texts: DataFrame, search: DataFrame, act_of: DataFrame | None = None, seeds: DataFrame | None = None, seed_floor: float = 0.88, boost: float = 0.12, most: int = 16, pinned: float = 0.84) -> DataFrame:
    """One list for each query from the results of its several texts: every row at its best, seeds at their floor, the preferred book's rows boosted, all pinned rows and the best others within the budget.

    texts: query_id, text_id; search: text_id, id, book_id, similarity; act_of: query_id, book_id; seeds: query_id, id, book_id, similarity.
    """
    found = texts.join(search, "text_id").select("query_id", "id", "book_id", "similarity")
    if seeds is not None:
        found = found.unionByName(floored(seeds.select("query_id", "id", "book_id", "similarity"), seed_floor))
    best = found.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.first("book_id").alias("book_id"))
    if act_of is not None:
        best = best.join(act_of.select("query_id", F.col("book_id").alias("_act")), "query_id", "left")
        best = best.withColumn("similarity", F.round(F.col("similarity") + F.when(F.col("book_id") == F.col("_act"), boost).otherwise(0.0), 6)).drop("_act")
    return ranked(budget(best, most, pinned), "similarity")


def seeds_of(sections: DataFrame, phrases: DataFrame, corpus: DataFrame, floor: float = 0.88) -> DataFrame:
    """What is looked up whatever the vectors say: a query's pinned sections and the titles of its phrases, at the floor."""
    every = hinted_sections(sections, corpus).unionByName(by_phrases(phrases, corpus)).select("query_id", "id").distinct()
    return every.join(corpus.select("id", "book_id"), "id").select("query_id", "id", "book_id", F.lit(floor).alias("similarity"))


def by_reference(references: DataFrame, corpus: DataFrame) -> DataFrame:
    """The chunks that a reference (query_id, chunk_id, root, subsection, clause) names, by the first stage that finds any.

    A clause without a subsection: its whole section (1), else the section's clauses of that letter (2). By the chunk's id (3). Clause
    and subsection (4). A subsection alone: the part without a clause, not the clauses below it (5). A section alone: all its parts (6).
    corpus: id, chunk_id, root, subsection, clause.
    """
    keys = corpus.select("id", "chunk_id", "root", "subsection", "clause")

    def stage(asked: str, *on: str, among: DataFrame = keys) -> DataFrame:
        named = references.where(asked).select("query_id", *on).where(" and ".join(f"{c} is not null" for c in on))
        return named.join(among.select("id", *on), list(on)).select("query_id", "id", F.lit(1.0).alias("similarity"))

    only_clause, only_section = "clause is not null and subsection is null", "clause is null and subsection is null"
    return cascade(
        stage(only_clause, "root"), stage(only_clause, "root", "clause"), stage("true", "chunk_id"), stage("true", "root", "subsection", "clause"),
        stage("clause is null", "root", "subsection", among=keys.where("clause is null")), stage(only_section, "root"),
    )


def thin_filled(primary: DataFrame, *pools: DataFrame, least: int = 3) -> DataFrame:
    """primary rows and, for queries with fewer than `least`, those of the next pools in turn, each id once."""
    out = primary.select("query_id", "id", "similarity")
    for pool in pools:
        counts = out.groupBy("query_id").agg(F.count_distinct("id").alias("_n")).where(F.col("_n") >= least)
        more = pool.select("query_id", "id", "similarity").join(counts, "query_id", "left_anti").join(out, ["query_id", "id"], "left_anti")
        out = out.unionByName(more)
    return out


def title_override(hints: DataFrame, titled: DataFrame, floor: float = 0.91) -> DataFrame:
    """A query's sections: those whose titles its text holds (query_id, book_id, root, score), if there are any at the floor, else its hints (query_id, book_id, root)."""
    strong = titled.where(F.col("score") >= floor).select("query_id", "book_id", "root")
    return strong.unionByName(hints.select("query_id", "book_id", "root").join(strong.select("query_id").distinct(), "query_id", "left_anti")).distinct()


def collisions_dropped(rows: DataFrame, queries: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows without those of sections that clash with a query's topic (query_id, topic; topic, book_id, root); a query keeps its rows if none would be left."""
    asked = rows.select("query_id", "book_id", "root").distinct().join(queries.select("query_id", "topic"), "query_id")  # a topic's queries and clashes don't meet in pairs
    bad = asked.join(clashes, ["topic", "book_id", "root"], "left_semi").select("query_id", "book_id", "root").distinct().withColumn("_bad", F.lit(True))
    marked = rows.join(bad, ["query_id", "book_id", "root"], "left").withColumn("_good", F.max(F.col("_bad").isNull()).over(Window.partitionBy("query_id")))
    return marked.where(F.col("_bad").isNull() | ~F.col("_good")).drop("_bad", "_good")


def is_limitation(metadata_role: Column, title: Column, content: Column, word: str = "हदम्याद") -> Column:
    """Whether a chunk is a limitation provision: by its role, its title, or its first line."""
    return F.coalesce(metadata_role == "hadamyad", F.lit(False)) | F.coalesce(F.contains(title, F.lit(word)), F.lit(False)) | F.contains(F.substring_index(content, "\n", 1), F.lit(word))
