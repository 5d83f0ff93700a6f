"""A statute's lines as blocks: which lines go on with the block that is open, and how deep a block stands.

A finite automaton over a text's logical lines. Its state is the open block, as it has grown: kind, depth, the end of its text, and
whether it has begun a list of numbered items. A line is known by what it opens (`chunking.OPENERS`) and how its body begins. JOINS
says which lines go on with which blocks; every line that looks like a part but was joined is reported with the rule's name. A text is
one row, cut into lines and gone through once in the task that has it: neither lines nor blocks are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking

N, L = chunking.D, chunking.L
#: Parts and chapters that are only referred to.
REFERRED = {"bhag": re.compile(rf"भाग\s*[–-]?\s*{N}+\s+को"), "parichhed": re.compile(rf"परिच्छेद\s*[–-]\s*{N}+\s*(?:[,.{N[1:-1]}]|र\s+{N}|को\s)")}
#: How a block ends that goes on with marks, and how the body of a mark begins that is none.
STUB, EITHER, CLAUSES = re.compile(r"उपदफा$"), re.compile(r"\sवा$"), re.compile(rf"(?:को|\(\s*{N}+\s*\))\s*खण्ड$")
LISTING = re.compile(rf"(?:,|\sर|\sवा|को खण्ड|\(\s*(?:{L}|{N}+)\s*\)\s*खण्ड|उपदफा\s*\(\s*{N}+\s*\)\s*,?)$")
FRAGMENT, CLAUSE_FRAGMENT = re.compile(r"[र,\s]*$|वा|खण्ड(?:\s|$)|बमोजिम|मा\s"), re.compile(r"खण्ड(?:\s|$)|बमोजिम|मा\s")
BARE, TAIL, NOT_ENDED, ANY = re.compile(r"[,रवा\s]*$"), re.compile("बमोजिम"), re.compile(r"[^।]$"), re.compile("")
#: How a block ends that begins a list of numbered items, and a proviso that does.
LIST_BEGINS, PROVISO_BEGINS = re.compile(r"(?:ः\s*[–-]|छैनः.*[–-]|तर[ः:]?\s*,|स्पष्टीकरण[ः:]?)$"), re.compile(r"(?:ः\s*[–-]|,)$|छैनः")
DEPTH = {"bhag": 0, "parichhed": 0, "dafa": 0, "spastikaran": 1, "tar": 1, "upadafa": 1, "khanda": 2, "rest": 1}
KINDS = {kind: re.compile(pattern) for kind, pattern in chunking.OPENERS.items()}
SPACE = re.compile(r"\s+")
#: How many characters of a block's end decide.
END = 80


@dataclass(frozen=True)
class Join:
    """A line of a kind goes on with a block of a depth (None: any) whose text ends so, if its body begins so."""

    name: str
    kind: str
    depth: int | None
    ends: re.Pattern[str]
    begins: re.Pattern[str]


JOINS = (
    Join("bare clause", "khanda", None, ANY, BARE), Join("clauses referred to", "khanda", None, CLAUSES, ANY), Join("clause in a listing", "khanda", None, LISTING, CLAUSE_FRAGMENT),
    Join("filled stub", "upadafa", None, STUB, ANY), Join("either", "upadafa", 1, EITHER, ANY), Join("tail of a reference", "upadafa", 1, NOT_ENDED, TAIL), Join("listing", "upadafa", 1, LISTING, FRAGMENT),
)


@dataclass(slots=True)
class Block:
    kind: str
    depth: int
    parts: list[str]
    end: str
    joined: list[tuple[int, str]] = field(default_factory=list)

    def take(self, line: str, n: int, rule: str | None) -> None:
        self.parts.append(line)
        self.end = f"{self.end} {line}"[-END:]
        if rule:
            self.joined.append((n, rule))

    @property
    def text(self) -> str:
        return " ".join(self.parts)


def opened(line: str) -> tuple[str, str, str]:
    """(kind, body, line with the mark in Devanagari digits) of a line."""
    for kind, pattern in KINDS.items():
        m = pattern.match(line)
        if not m or kind in REFERRED and REFERRED[kind].match(line):
            continue
        body = m[2].strip()
        if kind in ("upadafa", "khanda"):
            line = f"({m[1].translate(DEVANAGARI)}) {body}".strip()
        return kind, body, line
    return "rest", line, line


DEVANAGARI = str.maketrans("0123456789", "०१२३४५६७८९")


def read(raw: str) -> tuple[str, str, str]:
    return opened(SPACE.sub(" ", raw).strip())


def joins(kind: str, depth: int, end: str, body: str) -> str | None:
    """The rule by which a line goes on with a block."""
    return next((j.name for j in JOINS if j.kind == kind and j.depth in (None, depth) and j.ends.search(end) and j.begins.match(body)), None)


def begins_list(end: str) -> bool:
    return bool(LIST_BEGINS.search(end))


read_short, joins_short, begins_list_short = (lru_cache(chunking.KEPT)(f) for f in (read, joins, begins_list))
JOINING = {j.kind for j in JOINS}


def blocks_of(lines: list[str]) -> list[Block]:
    """The blocks of a text's logical lines."""
    out: list[Block] = []
    in_part = in_list = False
    for n, raw in enumerate(lines):
        kind, body, line = read_short(raw) if len(raw) <= chunking.SHORT else read(raw)
        block = out[-1] if out else None
        if in_list and block:
            if kind == "upadafa":
                block.take(line, n, "item of a list")
                continue
            in_list = False
        if block and (len(line) <= len(block.end) and block.end.endswith(line)) and (kind == "parichhed" or block.text == line):
            continue  # a heading that stands there twice
        if block:
            rule = None
            if kind in JOINING:
                rule = joins_short(kind, block.depth, block.end, body) if len(body) <= chunking.SHORT else joins(kind, block.depth, block.end, body)
            exception = kind == "tar" and block.depth == 2 and PROVISO_BEGINS.search(line) is not None
            if rule or kind == "rest" or exception:
                block.take(line, n, rule or ("exception in a clause" if exception else None))
                in_list = begins_list_short(block.end) or exception
                continue
        depth = 2 if kind == "tar" and PROVISO_BEGINS.search(line) else 1 if kind == "parichhed" and in_part else DEPTH[kind]
        in_part = in_part or kind == "bhag"
        out.append(Block(kind, depth, [line], line[-END:]))
        in_list = kind not in ("bhag", "parichhed") and begins_list_short(line[-END:]) or kind == "tar" and depth == 2
    return out


def of_texts(df: DataFrame, id_col: str, text_col: str, rows: Callable[[list[list[Block]]], tuple[list[int], list[pa.Array]]], fields: str) -> DataFrame:
    """What rows makes of the blocks of some texts: which of the texts each row is of, and the columns (fields) behind its id."""
    names = [id_col, *(f.split(" ")[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunking.slices(batches):
            of, columns = rows([blocks_of(chunking.lines_of(text or "")) for text in some.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of, pa.int64())), *columns], names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}")


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, kind, depth, text, joined): a statute's blocks in order, with the lines that look like parts but go on with it."""

    def rows(found: list[list[Block]]) -> tuple[list[int], list[pa.Array]]:
        every = [b for own in found for b in own]
        joined = pa.array([[{"line": n, "rule": r} for n, r in b.joined] for b in every], pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())])))
        place = pa.array([k for own in found for k in range(1, len(own) + 1)], pa.int32())
        return [t for t, own in enumerate(found) for _ in own], [place, pa.array([b.kind for b in every], pa.string()), pa.array([b.depth for b in every], pa.int32()), pa.array([b.text for b in every], pa.string()), joined]

    return of_texts(df, id_col, text_col, rows, "block int, kind string, depth int, text string, joined array<struct<line:int,rule:string>>")


def tally(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, depth, n): how many blocks of each kind and depth a text has, and how many lines each rule has joined (the rule as kind, no depth)."""

    def rows(found: list[list[Block]]) -> tuple[list[int], list[pa.Array]]:
        counts = [Counter([(b.kind, b.depth) for b in own] + [(rule, None) for b in own for _, rule in b.joined]) for own in found]
        every = [(t, kind, depth, n) for t, own in enumerate(counts) for (kind, depth), n in own.items()]
        of, kind, depth, n = zip(*every, strict=True) if every else ((), (), (), ())
        return list(of), [pa.array(kind, pa.string()), pa.array(depth, pa.int32()), pa.array(n, pa.int64())]

    return of_texts(df, id_col, text_col, rows, "kind string, depth int, n bigint")


def indented(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the statute as blocks indented by two blanks a level; texts without any block go."""

    def rows(found: list[list[Block]]) -> tuple[list[int], list[pa.Array]]:
        texts = {t: "\n".join(f"{'  ' * b.depth}{b.text}" for b in own) for t, own in enumerate(found) if own}
        return list(texts), [pa.array(list(texts.values()), pa.string())]

    return of_texts(df, id_col, text_col, rows, "text string")


def unclear(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, line, rule): a report of the lines that look like parts but were joined to the block before them."""
    return blocks(df, id_col, text_col).select(id_col, "block", F.explode("joined").alias("j")).select(id_col, "block", "j.line", "j.rule")
