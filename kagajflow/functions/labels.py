"""Labels, citations, links and keys of sections; books by rules on file names; numbers as people give them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clause_map, clause_order, to_ascii_digits, to_devanagari_digits

#: (id, include, exclude) of books by their files' names, the first that fits; exclude may be None.
BookRules = Sequence[tuple[str, str, str | None]]


def filled(s: Column) -> Column:
    """A text, or null where it is blank."""
    return F.nullif(F.trim(s), F.lit(""))


def prefixed(prefix: str, value: Column) -> Column:
    """Prefix and value; null without a value, so that concat_ws leaves it out."""
    return F.concat(F.lit(prefix), filled(value))


def citation_block(book: Column, chapter_number: Column, chapter_name: Column, section: Column, title: Column, subsection: Column, clause: Column) -> Column:
    """A citation in lines, one for each thing that is known."""
    number = to_devanagari_digits(filled(section.cast("string")))
    named = F.concat(number, F.coalesce(prefixed(" — ", title), F.lit("")))
    return F.concat_ws(
        "\n", prefixed("पुस्तक : ", book), prefixed("परिच्छेद नं : ", to_devanagari_digits(chapter_number.cast("string"))), prefixed("परिच्छेद नाम : ", chapter_name),
        prefixed("दफा : ", named), prefixed("उपदफा : ", subsection), prefixed("खण्ड : ", clause),
    )


def citation_inline(book: Column, section: Column, subsection: Column, clause: Column) -> Column:
    """A citation in one line."""
    return F.concat_ws(", ", filled(book), prefixed("दफा ", to_devanagari_digits(section.cast("string"))), prefixed("उपदफा ", subsection), prefixed("खण्ड ", clause))


def source_label(book: Column, chapter: Column, title: Column, label: Column) -> Column:
    """Book, chapter, title (unless it is the chapter's) and section, in one line."""
    own = F.when(~title.eqNullSafe(chapter), filled(title))
    return F.concat_ws(" · ", filled(book), filled(chapter), own, prefixed("दफा ", to_devanagari_digits(label)))


def breadcrumb_key(path: Column) -> Column:
    """The order in which marks (१), (क), (१)(क) ... of a section are shown.

    A clause without or within the first subsection comes at 100 and its place, a subsection at 500 and its number, clauses of the
    second around 511 to 560, those of later ones behind their subsection's fifties; what fits nowhere comes last.
    """
    mark = lambda i: F.get(path, F.lit(i))
    number = lambda m: to_ascii_digits(m).try_cast("int")
    place = lambda m: F.coalesce(F.nullif(clause_order(m), F.lit(0)), F.lit(99)).cast("int")
    first, second, third = number(mark(0)), place(mark(1)), number(mark(2))
    one = F.when(first.isNotNull(), 500 + first).otherwise(100 + place(mark(0)))
    of_second = F.when(second == 1, 511).otherwise(525 + second)
    two = F.when(first == 1, 100 + second).when(first == 2, of_second).otherwise(800 + first * 50 + second)
    depth = F.size(path)
    last = 9000 + depth
    return (
        F.when(depth == 0, 0).when(depth == 1, one).when((depth == 2) & first.isNotNull() & number(mark(1)).isNull(), two)
        .when((depth == 3) & (first == 2) & (mark(1) == "क") & third.isNotNull(), 516 + third).otherwise(last)
    )


def section_slug(section: Column, subsection: Column, clause: Column) -> Column:
    """sec_<n>, with _sub_<m> and the clause's letter in Latin."""
    letter = F.coalesce(clause_map()[filled(clause)], filled(clause))
    return F.concat_ws("_", F.lit("sec"), to_ascii_digits(section.cast("string")), prefixed("sub_", to_ascii_digits(subsection.cast("string"))), letter)


def chapter_key(filename: Column, chapter_number: Column) -> Column:
    """What a chapter is scoped by: file and number; null without a number."""
    return F.concat(filename, F.lit("|"), chapter_number.cast("string"))


def part_key(filename: Column, root: Column, subsection: Column, clause: Column, kind: Column, label: Column) -> Column:
    """What makes two chunks the same part of a section: clause within subsection, else subsection and kind, else the written label."""
    sub = filled(to_ascii_digits(subsection.cast("string")))
    of_clause = F.concat(F.lit("u"), F.coalesce(sub, F.lit("?")), prefixed("|k", clause))
    of_sub = F.concat(F.lit("u"), sub, F.lit("|"), F.coalesce(filled(kind), F.lit("upadafa")))
    return F.concat_ws("|", filename, root.cast("string"), F.coalesce(of_clause, of_sub, filled(F.regexp_replace(label, "[()]", "")), F.lit("_root")))


def embed_text(context: Column, body: Column) -> Column:
    """What a chunk is embedded by: its context (an array, blanks left out) in brackets, then the body."""
    known = F.filter(context, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    return F.when(F.size(known) > 0, F.concat(F.lit("["), F.array_join(known, " - "), F.lit("]: "), body)).otherwise(body)


def embed_query(query: Column, act: Column, intent: Column, issues: Column, most: int = 6000) -> Column:
    """What a query is embedded by: its act in brackets, the intent, the query and three issues, cut at `most` characters."""
    return F.left(F.concat_ws(" ", F.concat(F.lit("["), filled(act), F.lit("]")), filled(intent), F.trim(query), filled(F.array_join(F.slice(issues, 1, 3), " "))), F.lit(most))


def display_content(fields: Mapping[str, Column], body: Column) -> Column:
    """Labelled lines of the fields that are known, a blank line, the body."""
    head = F.concat_ws("\n", *(prefixed(f"{name} : ", value) for name, value in fields.items()))
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), body)


def pdf_link(base: str, file: Column, page: Column) -> Column:
    """The address of a page of a file; of the whole file without a page."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(file), F.lit("+"), F.lit("%20")), F.coalesce(F.concat(F.lit("#page="), page.cast("string")), F.lit("")))


def book_of(filename: Column, rules: BookRules) -> Column:
    """The first book whose rule fits the file's name; null if none does."""
    out = F.lit(None).cast("string")
    for book, include, exclude in reversed(rules):
        fits = F.regexp_like(filename, F.lit(include)) & (~F.regexp_like(filename, F.lit(exclude)) if exclude else F.lit(True))
        out = F.when(fits, book).otherwise(out)
    return out


def in_books(filename: Column, books: Sequence[str], rules: BookRules) -> Column:
    """Whether a file is of one of the books; no books, 'auto' or an unknown one: every file is."""
    wanted = [(include, exclude) for book, include, exclude in rules if book in books]
    if not books or "auto" in books or len(wanted) < len(set(books)):
        return F.lit(True)
    fits = F.lit(False)
    for include, exclude in wanted:
        fits = fits | (F.regexp_like(filename, F.lit(include)) & (~F.regexp_like(filename, F.lit(exclude)) if exclude else F.lit(True)))
    return fits


def first_rule(text: Column, rules: Sequence[tuple[str, object]], otherwise: object = None) -> Column:
    """The value of the first (pattern, value) whose pattern the text has: an act by its name, sections by topic, and the like."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(value)).otherwise(out)
    return out


def all_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The values of all (pattern, values) whose pattern the text has, in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *(F.when(F.regexp_like(text, F.lit(pattern)), F.array(*map(F.lit, values))).otherwise(none) for pattern, values in rules)))


def classified(text: Column, classes: Mapping[str, str]) -> Column:
    """A struct of whether the text has each class' pattern."""
    return F.struct(*(F.regexp_like(text, F.lit(pattern)).alias(name) for name, pattern in classes.items()))


def numbers_in(values: Column, most: int | None = None) -> Column:
    """Section numbers from texts in either script: the different positive ones, in order, at most so many."""
    found = F.transform(values, lambda v: F.nullif(F.regexp_extract(to_ascii_digits(v), r"^\s*([0-9]+)", 1), F.lit("")).try_cast("int"))
    once = F.array_distinct(F.filter(found, lambda n: n > 0))
    return once if most is None else F.slice(once, 1, most)


def cited_sections(labels: Column, answer: Column) -> Column:
    """The section numbers of sources' labels and of what an answer names, each once: not to be shown again."""
    named = F.regexp_extract_all(answer, F.lit(r"दफा\s*([0-9०-९]+)"), F.lit(1))
    return F.array_union(numbers_in(labels), numbers_in(named))


def compact_key(s: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]", ""))


def short_number(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M."""
    tenth = lambda by: F.regexp_replace(F.round(n / by, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.when(n >= 1_000_000, F.concat(tenth(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenth(1000), F.lit("k"))).otherwise(n.cast("string"))


def split_query(text: Column) -> Column:
    """(question, keywords): what follows the first question mark or danda, if it is a list with commas; else no keywords."""
    whole = F.trim(text)
    tail = F.regexp_extract(whole, r"^.+?[?।]\s+(.+)$", 1)
    words = F.filter(F.transform(F.split(tail, "[,，]"), lambda w: F.trim(w)), lambda w: w != "")
    listed = F.regexp_like(tail, F.lit("[,]")) & (F.size(words) > 0)
    question = F.when(listed, F.regexp_extract(whole, r"^(.+?[?।])\s+.+$", 1)).otherwise(whole)
    return F.struct(question.alias("question"), F.when(listed, words).otherwise(F.array().cast("array<string>")).alias("keywords"))


def subsection_text(body: Column, number: Column) -> Column:
    """The part of a section from its subsection's mark to the next one; null without it."""
    marks = F.regexp_extract_all(body, F.lit(r"\(\s*[0-9०-९]{1,2}\s*\)(?:(?!\(\s*[0-9०-९]{1,2}\s*\))[\s\S])*"), F.lit(0))
    own = F.filter(marks, lambda m: to_ascii_digits(F.regexp_extract(m, r"\(\s*([0-9०-९]{1,2})", 1)).try_cast("int") == number)
    return F.trim(F.get(own, F.lit(0)))


def without_next_section(body: Column) -> Column:
    """A body up to where the next section's number and title run into it."""
    return F.trim(F.regexp_replace(body, r"\.\s*[0-9०-९]+\.\s+[^\n(][\s\S]*$", ""))


def scripts_of(text: Column, least: int = 4) -> Column:
    """What a query is written in: devanagari (at least so many of its letters), latin, or mixed; needs_spelling where Latin words want conversion."""
    deva, latin = F.regexp_count(text, F.lit(r"\p{IsDevanagari}")), F.regexp_count(text, F.lit("[A-Za-z]"))
    kind = F.when((deva >= least) & (latin == 0), "devanagari").when((deva >= least) & (latin > 0), "mixed").when(latin > 0, "latin").otherwise("none")
    return F.struct(kind.alias("script"), (F.regexp_count(text, F.lit("[A-Za-z]{3,}")) > 0).alias("needs_spelling"))
