"""Which rows answer a query: references in its text, cascades of stages, scopes, hints, topics and conflicts.

Rules are tables (pattern, priority, what it means), broadcast: rule tables are written by people and have some dozens of rows.
Conditions such as "unless none would be left" are windows over a query's rows, so a batch of queries stays one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import title_match
from ..functions.text import CLAUSES, normal_title, title_tokens, to_ascii_digits
from . import titles
from .search import batch_side, ranked

NUMBER = "([0-9०-९]+)"


def reference_in(query: Column) -> Column:
    """A struct of the section, subsection, clause and chunk id that a query's text names; null fields for what it doesn't."""
    ascii_ = to_ascii_digits(query)
    number = lambda pattern: F.nullif(F.regexp_extract(ascii_, pattern, 1), F.lit("")).cast("int")
    section = number(r"(?i)(?:दफा|\bdafa|\bdaafa|\bsection|\bsec\.?)\s*([0-9]+)")
    sub = number(r"(?i)(?:उपदफा|\bupadafa|\bsubsection)\s*\(?\s*([0-9]+)")
    letter = F.nullif(F.regexp_extract(query, rf"\(\s*([{''.join(CLAUSES)}])\s*\)|(?:खण्ड|\bclause)\s*\(?\s*([{''.join(CLAUSES)}])", 1), F.lit(""))
    chunk = F.nullif(F.regexp_extract(query, r"\b(dafa_[0-9a-z_]+)\b", 1), F.lit(""))
    return F.struct(section.alias("section"), sub.alias("subsection"), letter.alias("clause"), chunk.alias("chunk_id"))


def cascade(*stages: DataFrame) -> DataFrame:
    """Each query's rows (query_id, id, similarity) of the first stage that has any."""
    every = stages[0].select("query_id", "id", "similarity", F.lit(1).alias("stage"))
    for n, stage in enumerate(stages[1:], 2):
        every = every.unionByName(stage.select("query_id", "id", "similarity", F.lit(n).alias("stage")))
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return every.withColumn("_first", first).where("stage = _first").drop("_first")


def by_section(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The chunks of the section that a query (query_id, text) names."""
    named = queries.select("query_id", reference_in(F.col("text"))["section"].alias("root")).where("root is not null")
    return named.join(corpus.select("id", "root"), "root").select("query_id", "id", F.lit(1.0).alias("similarity"))


def by_title(queries: DataFrame, corpus: DataFrame, least: int = 3, telling: int = 16) -> DataFrame:
    """The chunks whose normalised title is the query's text, or begins with it (from `least` characters on): joined by their first characters, `telling` of them where the query has so many."""
    head = lambda c, n: F.substring(c, 1, n)
    asked = queries.select("query_id", F.lower(normal_title(F.col("text"))).alias("q")).where(F.length("q") >= least).withColumn("head", F.when(F.length("q") >= telling, head("q", telling)).otherwise(head("q", least)))
    known = corpus.select("id", F.lower(normal_title(F.col("section_title"))).alias("t")).withColumn("head", F.explode(F.array_distinct(F.array(head("t", least), head("t", telling)))))
    return asked.join(known, "head").where(F.col("t").startswith(F.col("q"))).select("query_id", "id", F.round(0.9 + 0.1 * F.length("q") / F.length("t"), 6).alias("similarity"))


def without_sections(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """rows without the excluded sections (query_id, root); rows without a section stay."""
    return rows.join(excluded.select("query_id", "root").distinct(), ["query_id", "root"], "left_anti")


def only_hinted(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """Each query's rows of its hinted sections (query_id, book_id, root); all its rows if there are none."""
    marked = rows.join(hints.select("query_id", "book_id", "root").distinct().withColumn("_hit", F.lit(1)), ["query_id", "book_id", "root"], "left")
    marked = marked.withColumn("_any", F.max("_hit").over(Window.partitionBy("query_id")))
    return marked.where("_hit = 1 or _any is null").drop("_hit", "_any")


def in_chapters(rows: DataFrame, chapters: DataFrame, pinned: DataFrame) -> DataFrame:
    """Rows of a query's chapters (query_id, filename, parichhed_no) and its pinned sections (query_id, root); a query without chapters keeps all."""
    inside = rows.join(chapters.select("query_id", "filename", "parichhed_no").distinct(), ["query_id", "filename", "parichhed_no"], "left_semi")
    pins = rows.join(pinned.select("query_id", "root").distinct(), ["query_id", "root"], "left_semi")
    free = rows.join(chapters.select("query_id").distinct(), "query_id", "left_anti")
    return inside.unionByName(pins.select(inside.columns)).unionByName(free.select(inside.columns)).dropDuplicates(["query_id", "id"])


def needs_title_search(queries: DataFrame, rows: DataFrame, low: int = 10, weak: float = 0.45) -> DataFrame:
    """Whether a query has no rows, only early sections, or nothing of similarity `weak`."""
    seen = rows.groupBy("query_id").agg(F.max("similarity").alias("_best"), F.max("root").alias("_last"))
    why = F.col("_best").isNull() | (F.col("_best") < weak) | (F.col("_last") < low)
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.coalesce(why, F.lit(True)).alias("needed"))


def topics(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule (pattern, priority, book_id, root) that each query's text matches."""
    met = queries.join(batch_side(rules), F.expr("regexp_like(text, pattern)"))
    return met.groupBy("query_id").agg(F.min_by(F.struct("priority", "book_id", "root"), "priority").alias("r")).select("query_id", "r.*")


def settle_conflicts(rows: DataFrame, queries: DataFrame, rules: DataFrame) -> DataFrame:
    """rows after the first rule (priority, pattern, keep_root, drop_root, strong) whose pattern the query matches and whose sections are both there.

    A strong rule drops the other section's rows; a weak one only moves them behind: place tells the new order.
    """
    met = queries.select("query_id", "text").join(batch_side(rules), F.expr("regexp_like(text, pattern)")).drop("text", "pattern")
    has = rows.select("query_id", "root").distinct()
    both = met.join(has.withColumnRenamed("root", "keep_root"), ["query_id", "keep_root"], "left_semi").join(has.withColumnRenamed("root", "drop_root"), ["query_id", "drop_root"], "left_semi")
    first = both.groupBy("query_id").agg(F.min_by(F.struct("drop_root", "strong"), "priority").alias("rule"))
    marked = rows.join(first, "query_id", "left").withColumn("_other", F.coalesce(F.col("root") == F.col("rule.drop_root"), F.lit(False)))
    kept = marked.where(~(F.col("_other") & F.coalesce("rule.strong", F.lit(False))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_other", F.desc("similarity"), "id"))
    return kept.withColumn("place", place).drop("rule", "_other")


def pin_first_section(rows: DataFrame, queries: DataFrame, corpus: DataFrame, score: float = 0.96) -> DataFrame:
    """For queries that ask what something is: the first section of the chapter most of their rows are in comes first, at `score`."""
    asks = queries.where(F.regexp_like("text", F.lit(r"(?i)परिभाषा|भनेको के|\bwhat is\b|\bdefin"))).select("query_id")
    usual = rows.join(asks, "query_id", "left_semi").groupBy("query_id", "book_id", "parichhed_no").agg(F.count("*").alias("n"), F.min("rank").alias("seen"))
    chapter = usual.groupBy("query_id").agg(F.max_by(F.struct("book_id", "parichhed_no"), F.struct("n", -F.col("seen"))).alias("c")).select("query_id", "c.*")
    first = corpus.groupBy("book_id", "parichhed_no").agg(F.min_by("id", F.struct("root", "id")).alias("id"))
    pinned = chapter.join(first, ["book_id", "parichhed_no"]).select("query_id", "id", F.lit(score).alias("similarity"))
    every = rows.select("query_id", "id", "similarity").unionByName(pinned)
    return ranked(every.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), "similarity")


GRAM = 3


def gram_keys(words: Column, asked: bool, every: Column | None = None) -> Column:
    """Keys that two lists of words share wherever a word of one holds a word of the other: the first GRAM characters of the one within, all runs of up to GRAM characters of the other. asked tells the two sides apart.

    every: all words that may hold one, if words are only those that may be held.
    """
    own, other = ("<", ">") if asked else (">", "<")
    heads = F.transform(words, lambda w: F.concat(F.lit(own), F.substring(w, 1, GRAM)))
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(w) - i + 1)), lambda n: F.concat(F.lit(other), F.substring(w, i, n)))))
    return F.array_distinct(F.concat(heads, F.flatten(F.transform(F.filter(words if every is None else every, lambda w: w != ""), runs))))


def title_keys(s: Column, asked: bool) -> Column:
    """What titles are joined by: wherever one scores in another by its words, its beginning or as a whole (not for its own length alone), the two share a key."""
    every = F.filter(F.split(normal_title(s), r"[\s,]+"), lambda w: w != "")
    words = F.when(F.size(title_tokens(s)) > 0, title_tokens(s)).otherwise(every)
    return F.array_append(gram_keys(words, asked, every), F.concat(F.lit("^"), F.substring(normal_title(s), 1, 8)))


def number_in(name: Column) -> Column:
    """The first number in a name; one too large for a section's is none."""
    return F.nullif(F.regexp_extract(to_ascii_digits(name), "([0-9]+)", 1), F.lit("")).try_cast("int")


def numbered(names: DataFrame, taxonomy: DataFrame, by: list[str], number: Column) -> DataFrame:
    """Names with the titles whose section's number they have, and the score that it adds to."""
    met = names.withColumn("root", number).join(taxonomy, [*by, "root"])
    return met.withColumn("score", F.round(title_match(F.col("name"), F.col("title")) + 0.3 + 1e-9, 6)).where("score is not null")


def reconcile(names: DataFrame, taxonomy: DataFrame, least: float = 0.45) -> DataFrame:
    """Each name (query_id, name, book_id, and place where their order counts) with the title (book_id, root, title) of its book that it matches best, if well enough.

    A number in the name that is the section's adds 0.3: such pairs are joined by book and number; for the others titles are scored
    where they are (`titles`).
    """
    names = names if "place" in names.columns else names.withColumn("place", F.lit(0))
    own = ["query_id", "place", "name", "book_id", "root", "title", "score"]
    pairs = names.join(titles.best_of_books(names.select("name").distinct(), taxonomy, least), ["name", "book_id"]).select(own)
    pairs = pairs.unionByName(numbered(names, taxonomy, ["book_id"], number_in(F.col("name"))).select(own))
    best = pairs.where(F.col("score") >= least).groupBy("query_id", "name").agg(F.min("place").alias("place"), F.max_by(F.struct("book_id", "root", "title", "score"), F.struct("score", -F.col("root"), "title")).alias("m"))
    return best.select("query_id", "place", "name", "m.*")


def agreed(reconciled: DataFrame) -> DataFrame:
    """By query: the sections found, the confidence (the least score), and the book most names are in, of equal ones the one named first."""
    books = reconciled.groupBy("query_id", "book_id").agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    usual = books.groupBy("query_id").agg(F.min_by("book_id", F.struct(-F.col("n"), "seen")).alias("inferred_book"))
    found = reconciled.groupBy("query_id").agg(F.min("score").alias("confidence"), F.array_sort(F.collect_set("root")).alias("roots"))
    return found.join(usual, "query_id")


def reconciled_hints(names: DataFrame, guesses: DataFrame, claims: DataFrame, taxonomy: DataFrame, least: float = 0.45, most: int = 3) -> DataFrame:
    """(query_id, book_id, roots, confidence, dropped): what a query's names, guessed numbers and claimed book agree on.

    names: query_id, place, name (the first `most` count); guesses: query_id, place, root; claims: query_id, book_id (null: none); taxonomy:
    book_id, root, title. A name is the title of the claimed book that it matches best, if well enough, else of any book. The book is
    the one most names are found in, of equally many the one named first; without any the claimed one. The sections are those of the
    names found in that book, else the guessed ones that the book has, at most so many, each once. confidence is the least match of the
    names found, 0 without any; dropped are the guessed sections that didn't stay.
    """
    asked = names.where(F.col("place") <= most).join(claims.select("query_id", F.col("book_id").alias("claimed")), "query_id", "left")
    own = ["query_id", "place", "claimed", "book_id", "root", "score"]
    met = asked.join(titles.best_of_books(asked.select("name").distinct(), taxonomy, least), "name").select(own)  # each book's best: the first of them is the first of all
    met = met.unionByName(numbered(asked, taxonomy, [], number_in(F.col("name"))).select(own)).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc(F.coalesce((F.col("book_id") == F.col("claimed")).cast("int"), F.lit(0))), F.desc("score"), "book_id", "root"))
    found = met.withColumn("_n", best).where("_n = 1").select("query_id", "place", "book_id", "root", "score")
    books = found.groupBy("query_id", "book_id").agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    inferred = books.groupBy("query_id").agg(F.min_by("book_id", F.struct(-F.col("n"), "seen")).alias("inferred"))
    queries = names.select("query_id").unionByName(guesses.select("query_id")).unionByName(claims.select("query_id")).distinct()
    book = queries.join(inferred, "query_id", "left").join(claims.select("query_id", F.col("book_id").alias("claimed")), "query_id", "left").select("query_id", F.coalesce("inferred", "claimed").alias("book_id"))

    def first(rows: DataFrame, name: str) -> DataFrame:
        ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: x["root"]))
        return rows.groupBy("query_id").agg(F.slice(ordered, 1, most).alias(name))

    named = first(found.join(book, ["query_id", "book_id"], "left_semi"), "named")
    owned = guesses.join(book, "query_id").join(taxonomy.select("book_id", "root").distinct(), ["book_id", "root"], "left_semi")
    every = guesses.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: x["root"])).alias("every"))
    sure = found.groupBy("query_id").agg(F.min("score").alias("confidence"))
    none = F.array().cast("array<int>")
    out = book.join(named, "query_id", "left").join(first(owned, "owned"), "query_id", "left").join(every, "query_id", "left").join(sure, "query_id", "left")
    out = out.withColumn("roots", F.coalesce("named", "owned", none))
    return out.select("query_id", "book_id", "roots", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array_except(F.coalesce("every", none), "roots").alias("dropped"))
