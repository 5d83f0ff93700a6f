"""Documents to chunks: by size, by sentences, by markers, and statutes by their structure."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, title_of_body, to_devanagari_digits

SIZE, OVERLAP = 800, 200
#: Where a chunk may end, the best first.
BREAKS = ("।", ". ", "? ", "! ")


def sized_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces of at most `size` characters of the text with single blanks.

    A piece that isn't the last ends behind the last break in its second half, of the best kind that has one; the next piece
    begins `overlap` characters before that end. The places of all breaks are found once, each piece looks them up.
    """
    flat = " ".join(text.split())
    places = [[m.end() for m in re.finditer(re.escape(mark), flat)] for mark in BREAKS]
    start, whole = 0, len(flat)
    while start < whole:
        end = min(whole, start + size)
        if end < whole:
            latest = (ends[k - 1] for ends, mark in zip(places, BREAKS, strict=True) if (k := bisect_right(ends, end)) and ends[k - 1] - len(mark) > start + size // 2)
            end = next(latest, end)
        if piece := flat[start:end].strip():
            yield piece
        start = max(end - overlap, start + 1) if end < whole else whole


def by_size(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content): a chunk's start depends on the end of the one before, so each text is cut in one Python call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pieces_batch(batch, [list(sized_pieces(text or "", size, overlap)) for text in batch.column(1).to_pylist()], id_col)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, content string")


def pieces_batch(batch: pa.RecordBatch, pieces: list[list[str]], id_col: str) -> pa.RecordBatch:
    """(id, chunk_index, content) of each row's pieces."""
    rows = pa.array([k for k, own in enumerate(pieces) for _ in own], pa.int64())
    index = pa.array([i for own in pieces for i in range(len(own))], pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), index, pa.array([p for own in pieces for p in own], pa.string())], names=[id_col, "chunk_index", "content"])


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?।])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def packed(parts: list[str], most: int) -> Iterator[str]:
    """Parts joined by blanks, as many as fit in `most` characters."""
    open_: list[str] = []
    size = -1
    for part in parts:
        if open_ and size + 1 + len(part) > most:
            yield " ".join(open_)
            open_, size = [], -1
        open_.append(part)
        size += 1 + len(part)
    if open_:
        yield " ".join(open_)


def by_sentences(df: DataFrame, id_col: str, text_col: str, most: int = 1200) -> DataFrame:
    """(id, chunk_index, content): sentences packed in order, as many in a chunk as fit in `most` characters; a longer one is a chunk alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pieces_batch(batch, [list(packed(parts, most)) for parts in batch.column(1).to_pylist()], id_col)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("parts")).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, content string")


def by_markers(df: DataFrame, id_col: str, text_col: str, marker: str, least: int = 20) -> DataFrame:
    """(id, part, content): the text split before each match of a marker; a preamble of `least` characters or fewer goes."""
    parts = df.select(id_col, F.posexplode(F.split(text_col, f"(?={marker})")).alias("part", "content")).withColumn("content", F.trim("content"))
    return parts.where((F.length("content") > least) | F.regexp_like("content", F.lit(f"^(?:{marker})")))


# --- Statutes -------------------------------------------------------------------------------------------------------------

D, L = "[0-9०-९]", "[क-ह]"
#: The marks of a statute's parts, as (before the label, the label, behind it); the kinds, words and numbers are fixed values.
GRAMMAR = {
    "bhag": (r"भाग\s*[–-]\s*", f"{D}+", ""),
    "parichhed": (r"परिच्छेद\s*[–-]\s*", f"{D}+", ""),
    "dafa": ("", f"{D}{{1,4}}{L}?", r"\.?\s"),
    "spastikaran": ("", "स्पष्टीकरण[ः:]", ""),
    "tar": ("", "तर[ः:]?", r"\s"),
    "upadafa": (r"\(\s*", f"{D}{{1,2}}", r"\s*\)"),
    "khanda": (r"\(\s*", L, r"\s*\)"),
}
OPENERS = {kind: rf"^{before}({label}){behind}\s*({'.+' if kind in ('dafa', 'tar') else '.*'})$" for kind, (before, label, behind) in GRAMMAR.items()}
ANYWHERE = "|".join("".join(GRAMMAR[kind]) for kind in GRAMMAR if kind != "dafa")
#: What a section's number may stand behind, and what ends a sentence for good.
ENDED, STOP = r"[\u0900-\u097f।…\"“”]|\.{4}", "।"


def line_begin(ended: str = ENDED, stop: str = STOP) -> str:
    """The white space before a line: any mark begins one, and a section's number where something has ended; without its full stop only behind a stop and before a Devanagari word."""
    number = f"{D}{{1,4}}{L}?"
    behind = {ended: rf"{number}\.\s", stop: rf"{number}\s+[\u0900-\u097f]"}
    return "|".join([rf"\s+(?={ANYWHERE})", *(rf"(?<={end})\s+(?={begin})" for end, begin in behind.items())])


#: What stands between pages: a number or a rule alone on its line, and page marks.
NOISE = rf"(?m)^\s*(?:{D}{{1,4}}|[-–—]{{2,}})\s*$|\[PAGE:\d+\]"


def logical_lines(text: Column) -> Column:
    """The text as lines, one for each thing that a mark opens."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, " "), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, line_begin()), lambda s: F.trim(s)), lambda s: s != "")


#: Line ends in Java's expressions, as Spark has them.
ENDS = "\n\r\u0085\u2028\u2029"
#: The same in Python, where white space is ASCII's as in Java: noise at a text's beginning, on a later line, page marks, and the blank before a line of a text with single blanks.
_ALONE = rf"\s*(?:{D}{{1,4}}|[-–—]{{2,}})\s*(?=[{ENDS}]|\Z)"
FIRST_NOISE, LATER_NOISE, PAGE_MARK = re.compile(_ALONE, re.A), re.compile(rf"([{ENDS}]){_ALONE}", re.A), re.compile(r"\[PAGE:\d+\]", re.A)
_NUMBER = f"{D}{{1,4}}{L}?"
CUT = re.compile(
    rf" (?=[भपसत({D[1:-1]}])(?:(?={ANYWHERE})|(?:(?<=[\u0900-\u097f।…\"“”] )|(?<=\.\.\.\. ))(?={_NUMBER}\.\s)|(?<={STOP} )(?={_NUMBER}\s+[\u0900-\u097f]))", re.A
)
#: Texts that a task works on at once.
TEXTS = 256


def lines_of(text: str) -> list[str]:
    """logical_lines of a text, in Python."""
    if begun := FIRST_NOISE.match(text):
        text = " " + text[begun.end() :]
    text = PAGE_MARK.sub(" ", LATER_NOISE.sub(r"\1 ", text))
    flat = b" ".join(text.encode().split()).decode()  # bytes are split at ASCII's white space
    return CUT.split(flat) if flat else []


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TEXTS rows of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


#: A mention: a section's number, subsections or clauses of one, or both, and the word that makes it a reference.
MARK = rf"\(\s*(?:{D}+|{L})\s*\)"
MENTION = rf"(?:दफा\s*({D}+{L}?))?(?:\s*को\s*)?\s*((?:उपदफा|खण्ड)\s*{MARK}(?:[^।()]{{0,15}}{MARK})*)?\s*(?:बमोजिम|को\s*प्रयोजन|मा\s|।|(?<=\)))"


def references(body: Column, dafa: Column) -> Column:
    """The sections, subsections and clauses that a text names, each once: (section, subsection, clause) with Devanagari digits.

    A mention without a section means the section that the text stands in.
    """
    none = F.lit(None).cast("string")

    def parsed(mention: Column) -> Column:
        own = F.nullif(F.regexp_extract(mention, rf"^दफा\s*({D}+{L}?)", 1), F.lit(""))
        section = to_devanagari_digits(F.coalesce(own, dafa))
        labels = F.transform(F.regexp_extract_all(mention, F.lit(MARK), F.lit(0)), lambda m: to_devanagari_digits(F.regexp_replace(m, r"[()\s]", "")))

        def ref(label: Column) -> Column:
            is_number = F.regexp_like(label, F.lit("^[०-९]"))
            return F.struct(section.alias("section"), F.when(is_number, label).alias("subsection"), F.when(~is_number, label).alias("clause"))

        return F.when(F.size(labels) > 0, F.transform(labels, ref)).when(own.isNotNull(), F.array(F.struct(section.alias("section"), none.alias("subsection"), none.alias("clause"))))

    mentions = F.filter(F.transform(F.regexp_extract_all(body, F.lit(MENTION), F.lit(0)), lambda m: F.trim(m)), lambda m: F.regexp_like(m, F.lit("^(?:दफा|उपदफा|खण्ड)")))
    found = F.flatten(F.filter(F.transform(mentions, parsed), lambda refs: refs.isNotNull()))
    none_named = ~F.contains(body, F.lit("दफा")) & ~F.contains(body, F.lit("खण्ड"))  # every mention has one of these words
    return F.when(none_named, F.array().cast("array<struct<section:string,subsection:string,clause:string>>")).otherwise(F.array_distinct(F.filter(found, lambda r: r["section"].isNotNull())))


#: OPENERS in Python, by the characters that a line of the kind begins with.
KINDS = {kind: re.compile(f"{pattern[:-4]}[^{ENDS}]{pattern[-3]})(?=[{ENDS}]?\\Z)", re.A) for kind, pattern in OPENERS.items()}
BEGINS = {"भ": ("bhag",), "प": ("parichhed",), "स": ("spastikaran",), "त": ("tar",), "(": ("upadafa", "khanda")} | dict.fromkeys("0123456789०१२३४५६७८९", ("dafa",))
OPENING, DEVANAGARI = ("dafa", "upadafa", "khanda", "spastikaran", "tar"), str.maketrans("0123456789", "०१२३४५६७८९")


def opened(line: str) -> tuple[str, str | None, str]:
    """(kind, label, body) of a line."""
    for kind in BEGINS.get(line[:1], ()):
        if m := KINDS[kind].match(line):
            return kind, m[1], m[2].strip(" ")
    return "rest", None, line


#: How many short lines a task remembers, and what is short.
KEPT, SHORT = 16_384, 200
opened_short = lru_cache(KEPT)(opened)


def repeated(values: list[str | None]) -> pa.Array:
    """Strings of which many are the same, each made once."""
    known: dict[str | None, int] = {}
    codes = [known.setdefault(v, len(known)) for v in values]
    return pa.array(list(known), pa.string()).take(pa.array(codes, pa.int32()))


#: What a statute's text tells of each chunk (`parsed`); the rest follows from that by expressions.
PARSED = {"kind": "string", "label": "string", "bhag": "string", "parichhed": "string", "dafa": "string", "dafa_title": "string", "upadafa": "string", "index": "int", "body": "string", "chapter_limit": "string"}


def title_in(body: str, before: int = 120, most: int = 80) -> str:
    """functions.text.title_of_body, in Python."""
    at = body.find("ः") + 1
    return (body[:at] if 1 < at <= before else body[:most]).strip(" ")


def parsed(text: str) -> list[list]:
    """A statute's chunks (PARSED): a state machine over its lines. What a line opens holds until the next of its kind or a larger one; a line that opens nothing goes on with the chunk before it."""
    out: list[list] = []
    bhag = parichhed = dafa = title = upadafa = None
    count = {"spastikaran": 0, "tar": 0}
    parts: list[str] | None = None
    limits: dict[str | None, str] = {}
    for line in lines_of(text):
        kind, label, body = opened_short(line) if len(line) <= SHORT else opened(line)
        if kind == "bhag":
            bhag = f"भाग {label.translate(DEVANAGARI)}"
        elif kind == "parichhed":
            parichhed = f"परिच्छेद {label.translate(DEVANAGARI)}{' — ' if body else ''}{body}"
        elif kind == "dafa":
            dafa, title, upadafa = label, title_in(body), None
            count = {"spastikaran": 0, "tar": 0}
        if dafa is None:
            continue
        if kind == "upadafa":
            upadafa = label
        elif kind in count:
            count[kind] += 1
        if kind in OPENING and body:
            parts = []
            out.append([kind, label, bhag, parichhed, dafa, title, upadafa, count.get(kind, 0), parts, None])
            if "हदम्याद" in title:
                limits[parichhed] = dafa
        said = line if kind in count else "" if kind == "parichhed" else body
        if parts is not None and said:
            parts.append(said)
    for chunk in out:
        chunk[8], chunk[9] = " ".join(chunk[8]), limits.get(chunk[3])
    return out


def unindented(text: str) -> str:
    """An indented statute as plain lines: a block's depth says what it is where its beginning doesn't."""
    out: list[list[str]] = []
    for raw in text.split("\n"):
        if not (line := raw.strip(" ")):
            continue
        depth = (len(raw) - len(raw.lstrip(" "))) // 2
        kind = (opened_short(line) if len(line) <= SHORT else opened(line))[0]
        # what a deeper block opens must not be taken for a shallower kind: a number in depth 2 is text
        if out and (depth == 2 and kind != "khanda" or depth == 1 and kind in ("dafa", "khanda", "rest")):
            out[-1].append(line)
        else:
            out.append([line])
    return "\n".join(" ".join(block) for block in out)


def parse_statutes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: Callable[[str], str] | None = None) -> DataFrame:
    """Chunks of statutes: sections, subsections, clauses, explanations and provisos with their place, references and the chapter's limitation section.

    Each text is gone through once, where it is. plain: what makes plain lines of a text of another shape.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            found = [parsed(plain(text or "") if plain else text or "") for text in some.column(1).to_pylist()]
            every = list(zip(*(chunk for own in found for chunk in own), strict=True)) or [()] * len(PARSED)
            columns = [pa.array(c, pa.int32()) if kind == "int" else pa.array(c, pa.string()) if name == "body" else repeated(c) for c, (name, kind) in zip(every, PARSED.items(), strict=True)]
            doc = some.column(0).take(pa.array([t for t, own in enumerate(found) for _ in own], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([n for own in found for n in range(1, len(own) + 1)], pa.int32()), *columns], names=["doc", "chunk", *PARSED])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in ({"doc": df.schema[id_col].dataType.simpleString(), "chunk": "int"} | PARSED).items())
    chunks = df.select(id_col, text_col).mapInArrow(run, fields)
    khanda = F.when(F.col("kind") == "khanda", F.col("label"))
    upadafa = F.when(F.col("kind").isin("upadafa", "khanda"), F.coalesce("upadafa", F.lit("1")))
    chunks = chunks.withColumns({"khanda": khanda, "upadafa": upadafa}).withColumn("references", references(F.col("body"), F.col("dafa")))
    place = F.concat_ws(", ", F.regexp_replace("bhag", "^भाग ", "भाग-"), F.regexp_replace(F.substring_index("parichhed", " — ", 1), "^परिच्छेद ", "परिच्छेद–"), F.concat(F.lit("दफा "), to_devanagari_digits(F.col("dafa"))))
    mark = lambda s: F.concat(F.lit("("), s, F.lit(")"))
    path = F.concat_ws(" -> ", F.nullif(F.col("dafa_title"), F.lit("")), mark(to_devanagari_digits(F.col("upadafa"))), mark(F.col("khanda")))
    text = F.concat(F.lit("["), place, F.lit("]: "), path, F.when(F.contains(path, F.lit(" -> ")), " ").otherwise(": "), F.col("body"))
    limit = F.when(F.contains("dafa_title", F.lit("हदम्याद")), F.col("dafa"))
    return chunks.select(
        F.col("doc").alias(id_col), F.col("chunk").cast("int").alias("chunk_index"), chunk_id(F.col("dafa"), F.col("kind"), F.col("upadafa"), F.col("khanda"), F.col("index")).alias("chunk_id"), F.col("kind").alias("chunk_type"),
        "bhag", "parichhed", to_devanagari_digits(F.col("dafa")).alias("dafa"), "dafa_title", "upadafa", "khanda", text.alias("content"), "references",
        F.when(F.col("parichhed").isNotNull(), to_devanagari_digits(F.col("chapter_limit"))).alias("chapter_hadamyad_dafa"), F.when((F.col("kind") == "dafa") & limit.isNotNull(), "hadamyad").alias("provision_role"),
    )


# --- Other shapes of statutes ---------------------------------------------------------------------------------------------

def parse_indented(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of indented statutes, as parse_statutes gives them.

    A block of depth 2 without a letter goes on with the clause before it, one of depth 1 with the subsection; blank lines don't count.
    """
    return parse_statutes(df, id_col, text_col, unindented)


def structured_pieces(chunks: DataFrame, id_col: str, most: int = 1400) -> DataFrame:
    """(id, root, level, label, content): a section whole; split into its subsections if longer than `most`, a subsection likewise into clauses.

    chunks: id, root, content (a section's text). What stands before the first mark stays with the section's number.
    """
    piece = r"{0}(?:(?!{0})[\s\S])*"
    sub, clause = rf"\(\s*{D}{{1,2}}\s*\)", rf"\(\s*{L}\s*\)"

    def parts(text: Column, mark: str, level: str) -> Column:
        head = F.trim(F.regexp_extract(text, rf"^((?:(?!{mark})[\s\S])*)", 1))
        found = F.regexp_extract_all(text, F.lit(piece.format(mark)), F.lit(0))
        named = F.transform(found, lambda p: F.struct(F.lit(level).alias("level"), F.regexp_replace(F.regexp_extract(p, f"^({mark})", 1), r"[()\s]", "").alias("label"), F.trim(p).alias("content")))
        lead = F.array(F.struct(F.lit("head").alias("level"), F.lit("").alias("label"), head.alias("content")))
        return F.when(F.size(found) > 0, F.filter(F.concat(lead, named), lambda p: p["content"] != ""))

    whole = F.array(F.struct(F.lit("section").alias("level"), F.lit("").alias("label"), F.trim("content").alias("content")))
    first = F.when(F.length("content") > most, F.coalesce(parts(F.col("content"), sub, "subsection"), whole)).otherwise(whole)
    cut = chunks.select(id_col, "root", F.posexplode(first).alias("i", "p"))
    again = F.when((F.col("p.level") == "subsection") & (F.length("p.content") > most), parts(F.col("p.content"), clause, "clause"))
    again = F.transform(again, lambda c: F.struct(c["level"].alias("level"), F.concat_ws(".", F.col("p.label"), F.nullif(c["label"], F.lit(""))).alias("label"), c["content"].alias("content")))
    pieces = cut.select(id_col, "root", "i", F.posexplode(F.coalesce(again, F.array("p"))).alias("j", "q"))
    order = Window.partitionBy(id_col, "root").orderBy("i", "j")
    return pieces.select(id_col, "root", (F.row_number().over(order) - 1).alias("place"), "q.level", "q.label", "q.content")


def section_splits(df: DataFrame, id_col: str, text_col: str, most: int = 1200, overlap: int = 150) -> DataFrame:
    """(id, section, piece, content): the older way for any legal text: at section marks, then at subsections, and what is still longer than `most` by size."""
    mark = rf"(?m)^\s*{D}{{1,4}}{L}?\.\s+"
    parts = df.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), f"(?={mark})")).alias("section", "content")).where(F.trim("content") != "")
    subs = F.when(F.length("content") > most, F.split("content", rf"(?=\(\s*{D}{{1,2}}\s*\))")).otherwise(F.array("content"))
    parts = parts.select(F.struct(id_col, "section").alias("key"), F.posexplode(subs).alias("sub", "content")).where(F.trim("content") != "")
    sized = by_size(parts.select(F.struct("key", "sub").alias("at"), "content"), "at", "content", most, overlap)
    order = Window.partitionBy("at.key").orderBy("at.sub", "chunk_index")
    return sized.select(f"at.key.{id_col}", "at.key.section", (F.row_number().over(order) - 1).alias("piece"), "content")


def chapters_in(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, chapter): where chapters begin in texts, from 0, and what they are called; a heading that repeats has each of its places."""
    heading = rf"[ \t]*परिच्छेद\s*[–-]?\s*{D}+"
    rows = df.select(F.struct(id_col).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.select("key", "row", F.posexplode(F.split("text", rf"(?m)^(?={heading})")).alias("n", "piece"))
    before = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("at", (F.sum(F.length("piece")).over(before) - F.length("piece")).cast("int")).where(F.regexp_like("piece", F.lit(f"^{heading}")))
    return placed.select(f"key.{id_col}", "at", F.trim(F.substring_index("piece", "\n", 1)).alias("chapter"))


def parse_laws(laws: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """Chunks of law texts (file, text, format), indented ones by their depth, others by their marks."""
    indented = F.col("format") == "indented"
    return parse_indented(laws.where(indented), id_col, text_col).unionByName(parse_statutes(laws.where(~F.coalesce(indented, F.lit(False))), id_col, text_col))


def by_strategy(df: DataFrame, id_col: str, text_col: str, legal: Column, most: int = 1200) -> DataFrame:
    """(id, chunk_index, content): legal texts by their sections, all others by size."""
    order = Window.partitionBy(id_col).orderBy("section", "piece")
    law = section_splits(df.where(legal), id_col, text_col, most).withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).select(id_col, "chunk_index", "content")
    return law.unionByName(by_size(df.where(~F.coalesce(legal, F.lit(False))), id_col, text_col))
