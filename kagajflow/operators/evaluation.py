"""Answers judged against a key, failures by kind, and reports; catalogues and small tables of a portal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import BookRules, in_books, numbers_in
from ..functions.text import to_ascii_digits


def named_sections(answer: Column) -> Column:
    """The sections that an answer names, in ASCII digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"दफा\s*:?\s*([0-9०-९]+)"), F.lit(1)), to_ascii_digits))


def verified_keys(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """questions (num, book, sections: array) with verified: whether the book's text (book, root) has all sections of the key."""
    each = questions.select("num", "book", F.explode("sections").alias("root"))
    missing = each.join(sections.select("book", F.col("root").cast("string").alias("root")).distinct(), ["book", "root"], "left_anti").select("num").distinct()
    return questions.join(missing.withColumn("_missing", F.lit(True)), "num", "left").withColumn("verified", F.col("_missing").isNull()).drop("_missing")


def judged(runs: DataFrame, rules: BookRules = (), books: Sequence[str] = ()) -> DataFrame:
    """runs (num, book, sections, subsection, answer, mode, sources: array of (filename, label)) with failures and passed.

    A section counts as cited in the answer or in a source; the subsection, where one is expected, too. All sources of other books, no
    sources, and an unexpected mode are failures.
    """
    in_answer = named_sections(F.col("answer"))
    in_sources = F.transform("sources", lambda s: to_ascii_digits(F.substring_index(s["label"], ".", 1)))
    missing = F.filter("sections", lambda n: ~F.array_contains(F.concat(in_answer, in_sources), n))
    marks = F.transform(F.regexp_extract_all("answer", F.lit(r"\(\s*([0-9०-९]+)\s*\)"), F.lit(1)), to_ascii_digits)
    of_sources = F.transform("sources", lambda s: F.coalesce(F.get(F.split(to_ascii_digits(s["label"]), r"\."), F.lit(1)), F.lit("")))
    fits = lambda book: F.exists("sources", lambda s: in_books(s["filename"], [book], rules))
    own_book = F.lit(True)
    for book in books:
        own_book = F.when(F.col("book") == book, fits(book)).otherwise(own_book)
    tests = (
        ("mode", F.coalesce(F.col("mode") != "advocate", F.lit(True))), ("section", F.size(missing) > 0),
        ("subsection", F.col("subsection").isNotNull() & (F.size("sections") == 1) & ~F.array_contains(F.concat(marks, of_sources), F.col("subsection"))),
        ("wrong book", (F.size("sources") > 0) & ~own_book), ("no sources", F.size("sources") == 0),
    )
    failures = F.filter(F.array(*(F.when(test, name) for name, test in tests)), lambda f: f.isNotNull())
    out = runs.withColumns({"in_answer": F.array_intersect("sections", in_answer), "in_sources": F.array_intersect("sections", in_sources), "failures": failures})
    return out.withColumn("passed", F.size("failures") == 0)


def failure_kind(verified: Column, reached: Column, failures: Column, in_answer: Column, in_sources: Column, sources: Column) -> Column:
    """The first thing that explains a failed run."""
    early = F.exists(sources, lambda s: F.regexp_like(to_ascii_digits(s["label"]), F.lit(r"^(?:[1-9]|1[0-9]?)$")))
    return (
        F.when(~verified, "book_key_error").when(~reached, "normalize_blocked_chat").when(F.array_contains(failures, "wrong book"), "wrong_book")
        .when(F.array_contains(failures, "no sources"), "empty_retrieval").when((F.size(in_sources) > 0) & (F.size(in_answer) == 0), "sources_ok_answer_missing_citation")
        .when(early, "intro_or_early_section_trap").otherwise("wrong_section_retrieval")
    )


def question_stats(results: DataFrame) -> DataFrame:
    """(by, value, n, passed): results (book, batch, kind, passed) counted by book, by batch, by kind of failure and in all, in one pass."""
    counted = results.groupingSets([["book"], ["batch"], ["kind"], []], "book", "batch", "kind").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.grouping("book").alias("_b"), F.grouping("batch").alias("_t"), F.grouping("kind").alias("_k")
    )
    by = F.when(F.col("_b") == 0, "book").when(F.col("_t") == 0, "batch").when(F.col("_k") == 0, "kind").otherwise("all")
    value = F.coalesce("book", F.col("batch").cast("string"), "kind")
    return counted.select(by.alias("by"), value.alias("value"), "n", "passed").where("by <> 'kind' or value is not null")


def report_lines(stats: DataFrame, title: str) -> DataFrame:
    """A Markdown report of question_stats as lines in order (n, line), to be written as text."""
    rows = stats.select(F.col("by"), F.concat_ws(" | ", F.lit(""), "by", F.coalesce("value", F.lit("all")), F.col("passed").cast("string"), F.col("n").cast("string"), F.lit("")).alias("line"))
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("by", "line")) + 3)  # a few dozen rows
    head = stats.sparkSession.createDataFrame([(1, f"# {title}"), (2, " | by | value | passed | of | "), (3, " |-|-|-|-| ")], "n int, line string")
    return head.unionByName(numbered.select("n", "line"))


def change_counts(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Aggregates of a cleaning run: rows, rows changed, characters taken away."""
    return F.count("*").alias("rows"), F.count_if(~before.eqNullSafe(after)).alias("changed"), F.coalesce(F.sum(F.length(before) - F.length(after)), F.lit(0)).alias("removed")


def catalogue(df: DataFrame, filters: Mapping[str, str | None], search: str | None = None, search_in: Sequence[str] = ()) -> DataFrame:
    """Rows with the given values; a filter of None and an empty search leave all. A column of arrays must hold the value."""
    for name, value in filters.items():
        if value is not None:
            is_list = df.schema[name].dataType.typeName() == "array"
            df = df.where(F.array_contains(name, value) if is_list else F.col(name) == value)
    if search and search_in:
        hit = F.lit(False)
        for name in search_in:
            hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(search.lower())), F.lit(False))
        df = df.where(hit)
    return df


def has_vectors(chunks: DataFrame) -> bool:
    """Whether any chunk has an embedding: without one the vector search is left out."""
    return not chunks.where("embedding is not null").isEmpty()


def meant_entries(entries: DataFrame) -> DataFrame:
    """How many glossary entries have a meaning in any language."""
    return entries.agg(F.count_if(F.coalesce(F.trim("meaning"), F.lit("")) != "").alias("entries"))


def category_entries(entries: DataFrame, slug_of: Column, slug: str) -> DataFrame:
    """A category's entries by their number, then term."""
    return entries.where(slug_of == slug).orderBy(F.col("number").asc_nulls_last(), "term")


def unit_rows(quantities: Mapping[str, Column], key: Column) -> Column:
    """An array of (unit, quantity) of the quantities above zero, in order."""
    return F.filter(F.array(*(F.struct(key.alias("key"), F.lit(unit).alias("unit"), q.cast("double").alias("quantity")) for unit, q in quantities.items())), lambda u: u["quantity"] > 0)


def slab_bounds(slabs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """slabs (most, ...) with least: one more than the slab before ends at, zero for the first."""
    before = F.lag("most").over(Window.partitionBy(*by).orderBy(F.col("most").asc_nulls_last()))
    return slabs.withColumn("least", F.coalesce(before + 1, F.lit(0)))


def period_totals(periods: Column) -> Column:
    """(income, months) of an array of salary periods (salary, months): sums, a period counts for one month at least."""
    months = lambda p: F.greatest(p["months"].cast("int"), F.lit(1))
    start = F.struct(F.lit(0.0).alias("income"), F.lit(0).alias("months"))
    return F.aggregate(periods, start, lambda t, p: F.struct((t["income"] + p["salary"].cast("double") * months(p)).alias("income"), (t["months"] + months(p)).alias("months")))


def number_lists(values: Column, most: int = 3) -> Column:
    """The first different positive numbers of a list in either script."""
    return numbers_in(values, most)
