"""Places in texts: enclosing markers, page maps, excerpts and trimmed bodies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_order, to_ascii_digits
from .matching import in_blocks


def enclosing(rows: DataFrame, markers: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """rows (by, at, ...) with the value of the last marker (by, at, value) at or before them: an as-of join in one shuffle."""
    tagged = rows.withColumn("_row", F.lit(1)).withColumn(value, F.lit(None).cast(markers.schema[value].dataType))
    every = tagged.unionByName(markers.select(by, at, value).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_row = 1").drop("_row")


def extents(markers: DataFrame, by: str, at: str, end: str) -> DataFrame:
    """markers with until: where the next one begins, the last one at the text's end."""
    return markers.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(by).orderBy(at)), F.col(end)))


#: Titles that say nothing of their section, and how long a title must be to say something.
GENERIC, TELLING = r"^हदम्याद\s*[:ः]?$|^हदम्याद\s*[:ः]?\s*यस परिच्छेद", 14
#: How a page mentions a section: its number behind a blank or the end of a sentence and before a full stop, blank or visarga, or behind the word for section.
MENTIONED, NAMED = r"(?:^|[\s।|])([0-9०-९]+)(?=\s*\.|[.\sः])", r"दफा\s*([0-9०-९]+)"


#: What doesn't count in a title: white space, marks, and letters that scanning confuses.
UNCOUNTED = r"[\s।|,.:ः]+|[mनयखलउ]"


def compact(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, UNCOUNTED, ""))


def is_generic(title: Column) -> Column:
    return F.regexp_like(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(GENERIC)) | (F.length(compact(title)) < TELLING)


def mentioned(text: Column) -> Column:
    """The numbers that a page mentions, each once. Behind the word for section a number's first digits count as well."""
    flat = F.regexp_replace(text, r"\s+", " ")
    named = F.regexp_extract_all(flat, F.lit(NAMED), F.lit(1))
    begun = F.flatten(F.transform(named, lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda k: F.substring(n, F.lit(1), k))))
    every = F.transform(F.concat(F.regexp_extract_all(flat, F.lit(MENTIONED), F.lit(1)), begun), lambda n: to_ascii_digits(n).try_cast("int"))
    return F.array_distinct(F.filter(every, lambda n: n.isNotNull()))


#: Sections that are sent to the pages at once, characters that are hashed at once, and bits of a hash.
SECTIONS, CHARS, BITS = 50_000, 1 << 18, 20


def windows(chars: np.ndarray, n: int) -> np.ndarray:
    """BITS of a hash of every n characters in a row."""
    h = np.zeros(max(0, len(chars) - n + 1), np.uint32)
    for j in range(n):
        h *= np.uint32(0x9E3779B1)
        h += chars[j : j + len(h)]
    return h >> np.uint32(32 - BITS)


def chars_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Sought:
    """A block's sections, and the least page so far of each (book, root) by how it is found: number and title, number, a beginning of the title each."""

    def __init__(self, sections: pa.Table, head: int, needles: tuple[int, ...], least: int):
        self.least, self.needles = least, needles
        self.slots: dict[tuple[str, int], int] = {}
        self.by_number: dict[tuple[str, int], list[tuple[bool, str | None]]] = {}
        self.by_key: dict[tuple[str, str], list[tuple[int, str]]] = {}
        self.seen = np.zeros(1 << BITS, bool)
        for s in sections.to_pylist():
            book, root, title, generic = s["book_id"], s["root"], s["title"], s["generic"]
            slot = self.slots.setdefault((book, root), len(self.slots))
            self.by_number.setdefault((book, root), []).append((bool(generic), None if title is None else title[:head]))
            if generic is False and len(title) >= least:
                self.by_key.setdefault((book, title[:least]), []).append((slot, title))
                self.seen[windows(chars_of(title[:least]), least)] = True
        self.pages: list[list[int | None]] = [[None] * len(self.slots) for _ in range(2 + len(needles))]

    def found(self, how: int, slot: int, page: int) -> None:
        known = self.pages[how][slot]
        if known is None or page < known:
            self.pages[how][slot] = page

    def look(self, books: list[str], pages: list[int], texts: list[str], numbers: list[list[int]]) -> None:
        for book, page, text, own in zip(books, pages, texts, numbers, strict=True):
            for n in own or ():
                for generic, title in self.by_number.get((book, n), ()):
                    slot = self.slots[book, n]
                    self.found(1, slot, page)
                    known = self.pages[0][slot]
                    if (known is None or page < known) and (generic or title is not None and title in text):
                        self.found(0, slot, page)
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            begin = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + CHARS, "right")))
            places = np.flatnonzero(self.seen[windows(chars_of("".join(texts[at:to])), self.least)]) + begin
            for row, place in zip(np.searchsorted(ends, places, "right").tolist(), places.tolist(), strict=True):
                here = place - (int(ends[row - 1]) if row else 0)
                for slot, title in self.by_key.get((books[row], texts[row][here : here + self.least]), ()):
                    for how, n in enumerate(self.needles, 2):
                        if texts[row].startswith(title[:n], here):
                            self.found(how, slot, pages[row])
            at = to

    def rows(self) -> list[tuple]:
        return [(*key, *(own[slot] for own in self.pages)) for key, slot in self.slots.items() if any(own[slot] is not None for own in self.pages)]


def first_pages(sections: DataFrame, pages: DataFrame, head: int = 16, needles: tuple[int, ...] = (24, 18, 12), least: int = 10) -> DataFrame:
    """(book_id, root, page): the first page of the section's book that mentions the section's number and has its title's first `head` characters, else mentions the number, else has the title's first characters, as many as one finds.

    sections: book_id, root, title; pages: book_id, page, text. White space and marks don't count in titles. A generic title, or a short one,
    isn't asked for. Sections go to the pages in blocks; pages are read where they are, and a task sends the least pages of a section alone.
    """
    wanted = sections.select("book_id", F.col("root").cast("int").alias("root"), compact(F.col("title")).alias("title"), is_generic(F.col("title")).alias("generic"))
    short = wanted.where("book_id is not null and root is not null").withColumn("title", F.substring("title", 1, max(head, *needles))).withColumn("key", F.struct("book_id", "root"))
    read = pages.where("book_id is not null and page is not null and text is not null").select("book_id", "page", mentioned(F.col("text")).alias("numbers"), compact(F.col("text")).alias("text"))
    kind = pages.schema["page"].dataType.simpleString()
    ways = [f"p{i}" for i in range(2 + len(needles))]
    out = f"book_id string, root int, {', '.join(f'{w} {kind}' for w in ways)}"

    def block(some: DataFrame) -> DataFrame:
        asked = some.select("book_id", "root", "title", "generic").toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sought, page = Sought(asked, head, needles, least), None
            for batch in batches:
                page = batch["page"].type
                sought.look(*(batch[c].to_pylist() for c in ("book_id", "page", "text", "numbers")))
            if rows := sought.rows():
                kinds = [pa.string(), pa.int32(), *[page] * len(ways)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["book_id", "root", *ways])

        return read.mapInArrow(run, out)

    found = in_blocks(short, block, "key", SECTIONS).groupBy("book_id", "root").agg(F.coalesce(*(F.min(w) for w in ways)).alias("page"))
    return wanted.select("book_id", "root").distinct().join(found, ["book_id", "root"], "left")


def marker_kind(path_end: Column) -> Column:
    """What the last mark of a path is: a subsection number, a clause letter, or none."""
    return F.when(F.regexp_like(path_end, F.lit(r"^\([0-9०-९]+\)$")), "upadafa").when(F.regexp_like(path_end, F.lit(r"^\([क-ह]\)$")), "khanda").otherwise("dafa")


def path_of(content: Column) -> Column:
    """The marks of a chunk's context, `[...]: title -> (१) -> (क) body`, in order."""
    return F.regexp_extract_all(F.regexp_extract(content, r"^\[[^\]]*\]:(?:(?!->).)*((?:\s*->\s*\([^)]+\))+)", 1), F.lit(r"->\s*(\([^)]+\))"), F.lit(1))


def part_order(path: Column) -> Column:
    """The sort key of a part: ten thousand times its subsection plus the place of its clause's letter; 999999 without either."""
    number = F.try_element_at(F.filter(path, lambda m: F.regexp_like(m, F.lit("[0-9०-९]"))), F.lit(1))
    letter = F.try_element_at(F.filter(path, lambda m: F.regexp_like(m, F.lit("[क-ह]"))), F.lit(1))
    n = to_ascii_digits(F.regexp_replace(number, "[()\\s]", "")).try_cast("int")
    k = clause_order(F.regexp_replace(letter, "[()\\s]", ""))
    return F.when(n.isNull() & k.isNull(), F.lit(999_999)).otherwise(F.coalesce(n, F.lit(0)) * 10_000 + F.coalesce(k, F.lit(0)))


def trimmed(bodies: DataFrame, id_col: str, parts: Column, terms: Column, anchors: int = 2, best: int = 3) -> DataFrame:
    """Each body's first parts and of the others the ones that the terms weigh most in, in their order."""
    cut = bodies.select(id_col, F.posexplode(parts).alias("i", "part"), terms.alias("_terms"))
    weight = F.aggregate("_terms", F.lit(0), lambda n, t: n + F.when(F.contains(F.lower("part"), t), F.length(t)).otherwise(0))
    cut = cut.withColumn("weight", F.when(F.col("i") < anchors, F.lit(1_000_000)).otherwise(weight)).drop("_terms")
    cut = cut.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "i"))).where((F.col("n") <= anchors + best) & (F.col("weight") > 0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "\n")
    return cut.groupBy(id_col).agg(joined.alias("body"), F.count("*").alias("parts"))
