"""Ranked rows and their sections: expansion, hydration, deduplication, collapsing and budgets.

Rows are (query_id, id, similarity, ...); ranks order by similarity, then id. Sections are keyed by (filename, root) or
(book_id, root), so every expansion is an equi-join; the caps that the operators have are stated per query and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import ranked


def per(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def expand_siblings(rows: DataFrame, corpus: DataFrame, seeds: int = 3, per_seed: int = 12, most: int = 8, by: tuple[str, ...] = ("root",)) -> DataFrame:
    """The first seeds' sections: up to per_seed parts each, in label order, with the seed's similarity; then the best `most` rows.

    By default a section is looked up by its number alone, in whatever file; give by=("filename", "root") to stay in the seed's.
    """
    first = rows.where(F.col("rank") <= seeds).select("query_id", "rank", "similarity", *by)
    parts = first.join(corpus.select("id", "section_label", *([] if "filename" in by else ["filename"]), *by), list(by))
    kept = parts.withColumn("n", F.row_number().over(per("query_id", "rank").orderBy("section_label", "id"))).where(F.col("n") <= per_seed)
    every = rows.select("query_id", "id", "similarity").unionByName(kept.select("query_id", "id", "similarity"))
    return ranked(every.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), "similarity", most=most)


def all_parts(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """All parts of the rows' sections, in the rows' own files."""
    keys = rows.select("query_id", "filename", "root").distinct()
    return keys.join(corpus, ["filename", "root"]).select("query_id", "filename", "root", "id", "section_label")


def hydrate_references(rows: DataFrame, references: DataFrame, corpus: DataFrame, floor: float = 0.82) -> DataFrame:
    """Rows and what they refer to (references: id, ref_book, ref_root), new ones with similarity floor."""
    targets = rows.join(references, "id").select("query_id", F.col("ref_book").alias("book_id"), F.col("ref_root").alias("root")).distinct()
    found = targets.join(corpus.select("id", "book_id", "root"), ["book_id", "root"]).select("query_id", "id").distinct()
    new = found.join(rows.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("similarity", F.lit(floor))
    return rows.select("query_id", "id", "similarity").unionByName(new)


def hydrate_chapters(rows: DataFrame, corpus: DataFrame, is_limit: Column, floor: float = 0.80) -> DataFrame:
    """Rows and, for chapters without one among them, the chapter's limitation section (its first row by id)."""
    limits = corpus.where(is_limit).groupBy("filename", "parichhed_no").agg(F.min("id").alias("limit_id"))
    chapters = rows.groupBy("query_id", "filename", "parichhed_no").agg(F.max(is_limit.cast("int")).alias("has"))
    new = chapters.where("has = 0").join(limits, ["filename", "parichhed_no"]).select("query_id", F.col("limit_id").alias("id"), F.lit(floor).alias("similarity")).distinct()
    new = new.join(rows.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return rows.select("query_id", "id", "similarity").unionByName(new)


def hydrate_sections(rows: DataFrame, corpus: DataFrame, floor: float = 0.85) -> DataFrame:
    """Each row's section in place of the row: all parts, each at the greatest of floor and the section's best similarity."""
    best = rows.groupBy("query_id", "book_id", "root").agg(F.max("similarity").alias("best"))
    return best.join(corpus.select("id", "book_id", "root"), ["book_id", "root"]).select("query_id", "id", F.greatest("best", F.lit(floor)).alias("similarity"))


def keep_longest(rows: DataFrame) -> DataFrame:
    """Of rows with one file and label the one with the longest content (of equal ones the smallest id)."""
    order = F.struct(-F.length("content"), "id")
    return rows.groupBy("filename", "section_label").agg(F.min_by(F.struct("id", "content"), order).alias("r")).select("filename", "section_label", "r.id", F.length("r.content").cast("long").alias("n_chars"))


def keep_first(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(key, names, strict=True)))
    return keyed.withColumn("_n", F.row_number().over(per(*names).orderBy(*order))).where("_n = 1").drop("_n", *names)


def homonyms_dropped(rows: DataFrame, act: str) -> DataFrame:
    """Without rows of other acts whose section number occurs in the act."""
    own = rows.where(F.col("book_id") == act).select("query_id", "root").distinct()
    other = rows.where(F.col("book_id") != act).join(own, ["query_id", "root"], "left_anti")
    return rows.where(F.col("book_id") == act).unionByName(other.select(rows.columns))


def act_aware(rows: DataFrame, act: str, boost: float = 0.12) -> DataFrame:
    """Homonyms dropped; only the act's rows where a query has two or more of them; the act's rows boosted and ranked anew."""
    kept = homonyms_dropped(rows, act).withColumn("own", F.sum((F.col("book_id") == act).cast("int")).over(per("query_id")))
    kept = kept.where((F.col("own") < 2) | (F.col("book_id") == act))
    score = F.round(F.col("similarity") + F.when(F.col("book_id") == act, boost).otherwise(0.0), 6)
    return ranked(kept.select("query_id", "id", "book_id", "root", score.alias("similarity")), "similarity")


def introductions_dropped(rows: DataFrame, low: int = 10) -> DataFrame:
    """Without sections below `low` in files that also have later ones; the query's rows as they are if none would be left."""
    late = F.max((F.col("root") >= low).cast("int")).over(per("query_id", "filename"))
    marked = rows.withColumn("_keep", ((F.col("root") >= low) | (late == 0)).cast("int"))
    return marked.withColumn("_any", F.max("_keep").over(per("query_id"))).where("_keep = 1 or _any = 0").drop("_keep", "_any")


def collapse(rows: DataFrame, by: tuple[str, ...] = ("query_id", "filename", "root")) -> DataFrame:
    """One row per section: its parts in label order joined by blank lines, the best similarity, the best row's fields. by: without the query, what all queries see of a section is put together once."""
    parts = F.array_sort(F.collect_list(F.struct("section_label", "id", "content")))
    best = F.max_by("id", F.struct("similarity", -F.col("id")))
    out = rows.groupBy(*by).agg(parts.alias("parts"), F.max("similarity").alias("similarity"), best.alias("id"))
    return out.select(*by, "id", "similarity", F.size("parts").cast("long").alias("n_parts"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"))


def budget(rows: DataFrame, most: int = 16, pinned: float = 0.84) -> DataFrame:
    """All rows at or above the pin, and the best others up to `most` in all."""
    marked = rows.withColumn("pin", (F.col("similarity") >= pinned).cast("int")).withColumn("pins", F.sum("pin").over(per("query_id")))
    marked = marked.withColumn("n", F.row_number().over(per("query_id", "pin").orderBy(F.desc("similarity"), "id")))
    return marked.where((F.col("pin") == 1) | (F.col("n") <= most - F.col("pins"))).drop("pin", "pins", "n")


def first_sections(rows: DataFrame, most: int = 3) -> DataFrame:
    """The rows of the first `most` different sections, in rank order."""
    first = F.min("rank").over(per("query_id", "root"))
    marked = rows.withColumn("_first", first).withColumn("section", F.dense_rank().over(per("query_id").orderBy("_first")))
    return marked.where(F.col("section") <= most).drop("_first")


def hints_first(rows: DataFrame, hinted: Column) -> DataFrame:
    """The same rows with hinted ones moved to the front, else in order."""
    return rows.withColumn("place", F.row_number().over(per("query_id").orderBy(F.desc(hinted.cast("int")), "rank")))


def panel(primary: DataFrame, related: DataFrame, most: int = 5) -> DataFrame:
    """Primary rows, then related ones of other sections, each section once, up to `most`."""
    every = primary.select("query_id", "id", "root", "similarity", F.lit(0).alias("tier")).unionByName(related.select("query_id", "id", "root", "similarity", F.lit(1).alias("tier")))
    order = [F.col("tier"), F.desc("similarity"), F.col("id")]
    once = every.withColumn("n", F.row_number().over(per("query_id", "root").orderBy(*order))).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(per("query_id").orderBy(*order))).where(F.col("place") <= most)


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both lists, each id once, the first list's before the second's."""
    every = first.select("query_id", "id", "rank", F.lit(0).alias("list")).unionByName(second.select("query_id", "id", "rank", F.lit(1).alias("list")))
    best = every.groupBy("query_id", "id").agg(F.min(F.struct("list", "rank")).alias("at"))
    return best.select("query_id", "id", F.row_number().over(per("query_id").orderBy("at.list", "at.rank", "id")).alias("place"))


def injected(rows: DataFrame, exact: DataFrame, similarity: float = 0.35) -> DataFrame:
    """Rows and the exact ones that they lack, at a fixed similarity."""
    new = exact.join(rows, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(similarity).alias("similarity"))
    return rows.select("query_id", "id", "similarity").unionByName(new)


def chapter_scores(rows: DataFrame, second: float = 0.26, share: float = 0.72) -> DataFrame:
    """Each query's best chapter, and the second if it scores `second` and `share` of the best."""
    best = rows.groupBy("query_id", "book_id", "parichhed_no").agg(F.max("similarity").alias("score"))
    order = per("query_id").orderBy(F.desc("score"), "book_id", "parichhed_no")
    best = best.withColumn("n", F.row_number().over(order)).withColumn("top", F.max("score").over(per("query_id")))
    return best.where((F.col("n") == 1) | (F.col("n") == 2) & (F.col("score") >= second) & (F.col("score") >= share * F.col("top"))).drop("top")


def common_chapter(rows: DataFrame) -> DataFrame:
    """The chapter that most of a query's rows are in; of equal ones the one seen first."""
    counts = rows.groupBy("query_id", "chapter").agg(F.count("*").alias("n"), F.min("rank").alias("seen"))
    return counts.groupBy("query_id").agg(F.max_by("chapter", F.struct("n", -F.col("seen"))).alias("chapter"), F.max("n").alias("n"))


def chapter_index(corpus: DataFrame) -> DataFrame:
    """Each chapter with its sections' number, first section and that section's title."""
    first = F.min_by("section_title", F.struct("root", "id"))
    return corpus.groupBy("book_id", "parichhed_no", "filename").agg(F.count_distinct("root").alias("sections"), F.min("root").alias("first_root"), first.alias("first_title"))
