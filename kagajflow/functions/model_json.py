"""JSON as language models and metadata columns give it: found in other text, read leniently into typed structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import filled, numbers_in, split_query
from .text import to_ascii_digits


def json_object(text: Column) -> Column:
    """The JSON in a text: what a code fence holds, else from the first brace to the last, else the text."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", F.trim(fenced)).when(braces != "", braces).otherwise(F.trim(text))


def texts_of(values: Column, most: int | None = None) -> Column:
    """Trimmed texts that aren't blank; none for a missing array."""
    some = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    return some if most is None else F.slice(some, 1, most)


HINT = "array<struct<section:string,chapter:string,act:string,name:string>>"
ANALYSIS = f"struct<intent:string,legalIssues:array<string>,factsFromQuestion:array<string>,retrievalQueries:array<string>,sectionHints:{HINT},chapterHints:{HINT},titleSearchHints:array<string>,preferredAct:string>"


def hints_of(raw: Column, number: str, keep: str, most: int) -> Column:
    """Hints that have a number and an act, the number without other characters; the first `most`."""
    clean = F.transform(F.coalesce(raw, F.array().cast(HINT)), lambda h: F.struct(F.regexp_replace(h[number], keep, "").alias(number), F.trim(h["act"]).alias("act"), F.trim(h["name"]).alias("name")))
    return F.slice(F.filter(clean, lambda h: (F.coalesce(h[number], F.lit("")) != "") & (F.coalesce(h["act"], F.lit("")) != "")), 1, most)


def analysis(raw: Column, question: Column) -> Column:
    """A model's analysis of a question as a struct; what is missing or broken falls back to the question or to nothing.

    At most 4 queries, 6 section hints, 3 chapter hints and 3 titles are taken.
    """
    p = F.from_json(json_object(raw), ANALYSIS)
    queries = texts_of(p["retrievalQueries"], 4)
    return F.struct(
        question.alias("question"), F.coalesce(F.trim(p["intent"]), question).alias("intent"), texts_of(p["legalIssues"]).alias("issues"), texts_of(p["factsFromQuestion"]).alias("facts"),
        F.when(F.size(queries) > 0, queries).otherwise(F.array(question)).alias("queries"), hints_of(p["sectionHints"], "section", r"[^0-9.]", 6).alias("section_hints"),
        hints_of(p["chapterHints"], "chapter", r"[^0-9०-९]", 3).alias("chapter_hints"), texts_of(p["titleSearchHints"], 3).alias("titles"), F.trim(p["preferredAct"]).alias("act"),
    )


def aliased(json: Column, *names: str) -> Column:
    """The first of several spellings of a field that is there, as text."""
    return F.coalesce(*(F.get_json_object(json, f"$.{name}") for name in names))


def listed(value: Column) -> Column:
    """A JSON list, or a single value as a list of one, as texts."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def normalised_query(raw: Column, most: int = 3) -> Column:
    """A model's rewriting of a query as a struct (query, keywords, act, names, sections, excluded, workspace).

    Fields may be spelled in snake or camel case and numbers may be single or in lists, of either script. Keywords behind the
    question in the query itself count where none are given apart. Text that isn't JSON is the query.
    """
    json = json_object(raw)
    is_json = F.try_parse_json(json).isNotNull() & json.startswith("{")
    plain = F.regexp_replace(json, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    queries = listed(aliased(json, "queries"))
    said = F.when(is_json, F.coalesce(filled(aliased(json, "optimized_query", "optimizedQuery")), F.trim(F.get(queries, F.lit(0))), F.lit(""))).otherwise(plain)
    cut = split_query(said)
    given = texts_of(F.when(is_json, listed(aliased(json, "search_keywords", "searchKeywords"))))
    when = lambda value: F.when(is_json, value)
    numbers = lambda *names: numbers_in(listed(when(aliased(json, *names))), most)
    return F.struct(
        cut["question"].alias("query"), F.when(F.size(given) > 0, given).otherwise(cut["keywords"]).alias("keywords"), when(aliased(json, "act")).alias("act"),
        texts_of(when(listed(aliased(json, "matching_dafa_names", "matchingDafaNames"))), most).alias("names"), numbers("exact_dafa_guess", "exactDafaGuess").alias("sections"),
        numbers("excluded_dafa_guess", "excludedDafaGuess").alias("excluded"), when(filled(aliased(json, "legal_analysis_workspace", "legal_analysis"))).alias("workspace"),
    )


def metadata_references(metadata: Column) -> Column:
    """The references (section, subsection, clause) that a chunk's metadata lists; those without a section are left out."""
    kind = "array<struct<section_dafa:string,subsection_upadafa:string,clause_khanda:string,raw:string>>"
    found = F.from_json(F.get_json_object(metadata, "$.references"), kind)
    some = F.filter(F.coalesce(found, F.array().cast(kind)), lambda r: F.coalesce(r["section_dafa"], F.lit("")) != "")
    return F.transform(some, lambda r: F.struct(to_ascii_digits(r["section_dafa"]).alias("section"), r["subsection_upadafa"].alias("subsection"), r["clause_khanda"].alias("clause")))
