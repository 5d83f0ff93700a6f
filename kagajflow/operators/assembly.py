"""Sections put together for reading: filters for what isn't a provision, the best of repeated parts, order, stitching and formats.

Rows are chunks (query_id, id, filename, root, section_label, content, similarity, ...). All of a section's parts are one group;
a section has as many parts as its law gives it, and each is deduplicated before texts are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import breadcrumb_key, filled, part_key
from ..functions.text import body_of, header_field, header_of, section_number, to_ascii_digits
from .search import ranked

#: What a form to fill in, or what scanning has made of one, looks like.
FORM_SIGNS = (
    r"\.{4,}", r"पाउने\s+पाउने", r"जवाफ\s*\.{3,}", r"तपाईँ?\s*को\s*उमेर", r"[a-zA-Z\[\]{}'\"\\/]{5,}", r"फिराद.*\.{3,}", r"बमोिजम\s*यो\s*मुद्दा", r"फिराददाबी\s*पूर्ण", r"फैसलाको\s*संक्षिप्त\s*विवरण",
    r"सरकारी\s*जग्गा\s*दपोट", r"गर्दछु\s*/\s*गर्द",
)
#: The fields that a chunk's head has, each on a line of its own.
FIELDS = "पुस्तक|भाग|परिच्छेद|दफा|उपदफा|खण्ड|प्रकार|पृष्ठ"
NUMBERED = r"दफा\s*[:：]?\s*{0}\s*—"


@dataclass(frozen=True)
class Sign:
    """Points for what a chunk shows in its head, body or prose (the body without page marks and kinds), or for how its label or page suits the section that is asked for."""

    points: int
    where: str
    pattern: str = ""


#: The signs of a section's provision.
PROVISION_SIGNS = (
    Sign(4, "head", NUMBERED.format(r"[0-9०-९]+(?:\.[0-9०-९]+)?")), Sign(1, "head", "परिच्छेद"), Sign(2, "named"), Sign(5, "label is section"), Sign(-1, "label in section"),
    Sign(2, "body", r"[“\"][ऀ-ॿ]+[”\"]\s*भन्नाले"), Sign(3, "body", r"\([ङचछजझञटठडढणतथ]\)"), Sign(-4, "body", r"म्झनु|छर्न|धार्र|नामनि\s*धार"), Sign(-10, "form"), Sign(-5, "prose", r"[a-zA-Z\[\]{}]{3,}"),
    Sign(3, "early section, early page"), Sign(-8, "early section, late page"),
)


def has(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def without_lines(s: Column, pattern: str) -> Column:
    """A text without the lines that begin so."""
    return F.array_join(F.filter(F.split(s, "\n"), lambda line: ~has(F.trim(line), f"^(?:{pattern})")), "\n")


def without_marks(s: Column) -> Column:
    return F.regexp_replace(s, r"\[PAGE:\d+\]", " ")


def provision_body(content: Column) -> Column:
    """A chunk's body without the lines of its fields."""
    return without_lines(body_of(content), rf"(?:{FIELDS})\s*:")


def is_form(body: Column, signs: Sequence[str] = FORM_SIGNS) -> Column:
    """Whether a body, all its lines but those of fields, is a form to fill in: it shows one of the signs."""
    return has(without_marks(without_lines(body, rf"(?:{FIELDS})\s*:")), "|".join(signs))


def is_contaminated(title: Column, body: Column, titles: str, words: str) -> Column:
    """Whether a section of these titles holds words that belong to another one."""
    return has(F.coalesce(title, F.lit("")), titles) & has(body, words)


def is_preamble(label: Column, body: Column, amended: str = "शोिन|संशोधन") -> Column:
    """Whether a label is none of a section: it begins with zero, or is the sixth of a list of amendments."""
    ascii_ = to_ascii_digits(label)
    return has(ascii_, r"^0\d+(\.|$)") | (ascii_ == "6") & has(body, amended)


def provision_quality(content: Column, section: Column, page: Column, label: Column, signs: Sequence[Sign] = PROVISION_SIGNS) -> Column:
    """How much a chunk looks like the provision of a section that is asked for: the points of all signs that it shows; section, page and label may be null.

    A section is early up to number 30, a page up to 5, and late beyond 50.
    """
    head, body, asked = header_of(content), provision_body(content), section.cast("string")
    told = F.nullif(to_ascii_digits(F.regexp_extract(head, NUMBERED.format(r"([0-9०-९]+(?:\.[0-9०-९]+)?)"), 1)), F.lit(""))
    own, early = F.coalesce(label, told), section.try_cast("int") <= 30
    shown = {
        "named": F.regexp_like(to_ascii_digits(head), F.concat(F.lit(r"दफा\s*:?\s*"), asked, F.lit(r"\s*—"))),
        "label is section": own == asked,
        "label in section": own.startswith(F.concat(asked, F.lit("."))),
        "form": is_form(body),
        "early section, early page": early & (page <= 5),
        "early section, late page": early & (page > 50),
    }
    texts = {"head": head, "body": body, "prose": without_lines(without_marks(body), r"प्रकार\s*:")}
    points = (F.when(has(texts[s.where], s.pattern) if s.where in texts else shown[s.where], s.points).otherwise(0) for s in signs)
    return reduce(Column.__add__, points, F.lit(0))


def quality_ranked(rows: DataFrame, section: Column, page: Column, least: int = -3) -> DataFrame:
    """rows (query_id, id, content, section_label) by provision quality, without those of `least` and less."""
    scored = rows.withColumn("quality", provision_quality(F.col("content"), section, page, F.col("section_label")))
    return ranked(scored.where(F.col("quality") > least), "quality")


def extraction_quality(pages: DataFrame, by: str, first: int = 30, least: int = 200) -> DataFrame:
    """(by, score): how well a file's text was read, from 0 to 1, over its first pages (by, page, text), one blank between them.

    0.35 goes where no chapter or part is named, 0.25 where no number has a full stop, and 0.4 where more than one in forty characters
    is white space between two Devanagari letters; below `least` characters nothing can be said: 0.
    """
    some = pages.where(F.col("page") <= first).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))  # `first` pages
    text = F.array_join(F.transform("p", lambda p: p["text"]), " ")
    some = some.select(by, text.alias("text"))
    broken = F.regexp_count("text", F.lit(r"[\u0900-\u097F]\s+[\u0900-\u097F]")) > F.length("text") / 40
    lost = F.when(~has(F.col("text"), "परिच्छेद|परिरच्छेद|भाग"), 0.35).otherwise(0.0) + F.when(~has(F.col("text"), r"[0-9०-९]{1,3}\."), 0.25).otherwise(0.0) + F.when(broken, 0.4).otherwise(0.0)
    return some.select(by, F.when(F.length("text") < least, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - lost), 6)).alias("score"))


def enriched(rows: DataFrame) -> DataFrame:
    """rows with page, section_label, chapter, section_title and subsection taken from the content's head where they are null."""
    head = lambda *names: F.coalesce(*(header_field(F.col("content"), n) for n in names))
    section = F.regexp_extract(F.coalesce(head("दफा", "Section"), F.lit("")), r"^\s*([0-9०-९.]+)", 1)
    title = F.regexp_extract(F.coalesce(head("दफा", "Section"), F.lit("")), r"—\s*(.+)$", 1)
    page = F.nullif(F.regexp_extract("content", r"\[PAGE:(\d+)\]", 1), F.lit("")).try_cast("int")
    found = {
        "page": F.coalesce(to_ascii_digits(head("पृष्ठ", "Page")).try_cast("int"), page), "section_label": F.nullif(to_ascii_digits(section), F.lit("")), "chapter": head("परिच्छेद नाम", "परिच्छेद", "Chapter"),
        "section_title": F.nullif(title, F.lit("")), "subsection": head("उपदफा", "Subsection"),
    }
    return rows.withColumns({name: F.coalesce(F.col(name), value) if name in rows.columns else value for name, value in found.items()})


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (book_id, root, page, ...) with a missing page from the page map (book_id, root, page), else from the content's mark."""
    known = pages.select("book_id", F.col("root").cast("int").alias("root"), F.col("page").alias("_map"))
    parsed = F.nullif(F.regexp_extract("content", r"\[PAGE:(\d+)\]", 1), F.lit("")).try_cast("int")
    return rows.join(known, ["book_id", "root"], "left").withColumn("page", F.coalesce("page", "_map", parsed)).drop("_map")


def best_per_label(rows: DataFrame, label: Column) -> DataFrame:
    """Each query's best row of each label."""
    order = Window.partitionBy("query_id", "label").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("label", label).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_parts(rows: DataFrame, score: Column) -> DataFrame:
    """One row of each part of a section (query_id, part): the one that scores best, of equal ones the longest, then the first by id."""
    order = Window.partitionBy("query_id", "part").orderBy(F.desc(score), F.desc(F.length("content")), "id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: What tells that a text isn't its part by itself.
BARE, TAIL, REFERS = r"^उपदफा\s*$", "^बमोजिम", r"उपदफा\s*\("


def part_score(subsection: Column, path: Column, text: Column, wanted: Sequence[tuple[str, int]] = ()) -> Column:
    """How well a chunk's text stands for its part: what speaks for it, the points of each wanted pattern, less what speaks against it.

    For it: its first mark is the subsection's (4), it has a second (2), it names another subsection (1). Against: it is the bare word
    (10), or the tail of a reference in less than 180 characters (3).
    """
    digits_of = lambda s: to_ascii_digits(F.regexp_replace(s, "[^0-9०-९]", ""))
    own, body = digits_of(subsection), F.trim(text)
    points = lambda test, n: F.when(test, n).otherwise(0)
    good = points((own != "") & (digits_of(F.get(path, F.lit(0))) == own), 4) + points(F.size(path) > 1, 2) + points(has(body, REFERS), 1)
    bad = points(has(body, BARE), 10) + points(has(body, TAIL) & (F.length(body) < 180), 3)
    return reduce(Column.__add__, (points(has(body, pattern), n) for pattern, n in wanted), good) - bad


def is_continuation(label: Column, section: Column, excluded: Column) -> Column:
    """Whether a label is the section's own or of a part that goes on with it; parts .1 to .7 are items of their own where `excluded` holds."""
    tail = F.when(label.startswith(F.concat(section, F.lit("."))), F.substring(label, F.length(section) + 2, F.length(label)))
    return label.isNull() | (label == section) | has(tail, "^8") | ~(excluded & has(F.coalesce(tail, F.lit("")), r"^[1-7](\.|$)"))


def part_place(label: Column, section: Column) -> Column:
    """The order of a section's parts: the section itself, its continuations (.8), other parts, items .1 to .7."""
    tail = F.when(label.startswith(F.concat(section, F.lit("."))), F.substring(label, F.length(section) + 2, F.length(label)))
    return F.when(label.isNull() | (label == section), 0).when(has(tail, "^8"), 1).when(has(tail, r"^[1-7](\.|$)"), 3).otherwise(2)


def stitched(rows: DataFrame, excluded: Column | None = None) -> DataFrame:
    """One row per query, file and section (root) from its split parts: the first part's head, then all bodies in part order and by page, parted by blank lines.

    rows: query_id, id, filename, root, section_label, page, content, similarity; parts that is_continuation leaves out are dropped.
    """
    section = F.col("root").cast("string")
    kept = rows.where(is_continuation(F.col("section_label"), section, F.lit(False) if excluded is None else excluded))
    body = F.when(F.instr("content", "\n") > 0, body_of(F.col("content"))).otherwise(F.col("content"))
    part = F.struct(part_place(F.col("section_label"), section).alias("place"), F.coalesce("page", F.lit(0)).alias("page"), "id", "content", body.alias("body"))
    groups = kept.groupBy("query_id", "filename", "root").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("similarity").alias("similarity"))
    first = F.get("parts", F.lit(0))
    bodies = F.filter(F.transform("parts", lambda p: F.trim(p["body"])), lambda b: b != "")
    whole = F.concat_ws("\n", F.substring_index(first["content"], "\n", 1), F.array_join(bodies, "\n\n"))
    return groups.select("query_id", "filename", "root", first["id"].alias("id"), "similarity", F.size("parts").cast("long").alias("n_parts"), F.when(F.size("parts") == 1, first["content"]).otherwise(whole).alias("content"))


def in_section_order(rows: DataFrame, path: Column) -> DataFrame:
    """rows with place: the order in which a section's parts are read, by their marks, then id."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "filename", "root").orderBy(breadcrumb_key(path), "id")))


def hinted_order(rows: DataFrame, hinted: Column) -> DataFrame:
    """rows with place: hinted ones first, then by section number, then by similarity."""
    order = Window.partitionBy("query_id").orderBy(F.desc(hinted.cast("int")), F.coalesce(section_number(F.col("section_label")), F.lit(9999)), F.desc("similarity"), "id")
    return rows.withColumn("place", F.row_number().over(order))


def displayed_part(path: Column, text: Column) -> Column:
    """A part as a struct (kind, line): introduction, proviso, subsection or clause, the line with its last mark, indented by depth."""
    depth = F.size(path)
    last = F.element_at(path, F.greatest(depth, F.lit(1)))
    kind = F.when(has(F.trim(text), "^(तर|स्पष्टीकरण)[ः:\\s]"), "proviso").when(depth == 0, "introduction").when(has(to_ascii_digits(last), "[0-9]"), "subsection").otherwise("clause")
    mark = F.when(depth > 0, F.concat(F.repeat(F.lit("  "), depth - 1), F.lit("("), F.regexp_replace(last, "[()\\s]", ""), F.lit(") "))).otherwise("")
    return F.struct(kind.alias("kind"), F.concat(F.when(kind == "proviso", "").otherwise(mark), F.trim(text)).alias("line"))


def formatted_sections(rows: DataFrame) -> DataFrame:
    """(query_id, filename, root, text): a citation, the introduction, then subsections with their clauses below them, provisos behind what they limit.

    rows: query_id, filename, root, id, citation, path (array of marks), text. A clause before its subsection, or under none, is put
    where its marks belong; parts without text are left out.
    """
    some = rows.where(filled(F.col("text")).isNotNull() & ~has(F.trim("text"), r"^उपदफा\s*$"))
    part = displayed_part(F.col("path"), F.col("text"))
    key = F.when(part["kind"] == "proviso", F.lit(None)).otherwise(breadcrumb_key(F.col("path")))
    seen = Window.partitionBy("query_id", "filename", "root").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("part", part).withColumn("key", F.coalesce(key, F.last(key, ignorenulls=True).over(seen), F.lit(0)))  # a proviso follows what stands before it
    parts = F.array_sort(F.collect_list(F.struct("key", (F.col("part.kind") == "proviso").alias("behind"), "id", F.col("part.line").alias("line"))))
    groups = some.groupBy("query_id", "filename", "root").agg(parts.alias("parts"), F.min_by("citation", "id").alias("citation"))
    return groups.select("query_id", "filename", "root", F.concat_ws("\n\n", "citation", F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("text"))


def formatted_chapters(sections: DataFrame) -> DataFrame:
    """(query_id, filename, chapter, text): a chapter's name, then its formatted sections (query_id, filename, chapter, root, text) by number."""
    parts = F.array_sort(F.collect_list(F.struct("root", "text")))
    out = sections.groupBy("query_id", "filename", "chapter").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n---\n\n").alias("text"))
    return out.withColumn("text", F.concat_ws("\n\n", "chapter", "text"))


def context_blocks(rows: DataFrame, label: Column, body: Column, most: int = 12) -> DataFrame:
    """(query_id, context): the best rows numbered, label and body, as a model is given them."""
    block = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), label, F.lit("\n"), body).alias("text"))
    best = rows.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return best.select("query_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("context"))


def extractive_answers(rows: DataFrame, label: Column, excerpt: Column, most: int = 3, nothing: str = "") -> DataFrame:
    """(query_id, answer): excerpts of the best rows under their labels, without a model; `nothing` for a query whose rows say nothing."""
    return context_blocks(rows, label, excerpt, most).select("query_id", F.when(filled(F.col("context")).isNotNull(), F.col("context")).otherwise(F.lit(nothing)).alias("answer"))


def part_keys(rows: DataFrame) -> DataFrame:
    """rows (filename, root, subsection_no, clause, kind, subsection) with part."""
    return rows.withColumn("part", part_key(F.col("filename"), F.col("root"), F.col("subsection_no"), F.col("clause"), F.col("kind"), F.col("subsection")))


def usable_chunks(chunks: DataFrame, least: int = 15) -> DataFrame:
    """Chunks with a body of at least `least` characters that is neither a form nor a preamble."""
    body = body_of(F.col("content"))
    return chunks.where((F.length(body) >= least) & ~is_form(body) & ~F.coalesce(is_preamble(F.col("section_label"), body), F.lit(False)))


def chunk_summary(chunks: DataFrame, markers: str = r"\([0-9०-९क-ह]{1,2}\)") -> DataFrame:
    """One row: chunks, those with a label, different sections, and marks in all contents."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.count("section_label").alias("labelled"), F.count_distinct("filename", "root").alias("sections"), F.coalesce(F.sum(F.regexp_count("content", F.lit(markers))), F.lit(0)).alias("marks")
    )
