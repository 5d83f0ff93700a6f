"""Spelling: words of one script in another, by phrases and words; Latin letters that scanning left in Devanagari text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Postpositions that are written with the word before them, and words that are one.
POSTPOSITIONS = ("ले", "मा", "को", "बाट")
JOINED = ("दिन भित्र",)
#: Fixed value: what a short unknown word before the end of a clause stands for.
ENDING = "पर्नेछ"


#: Latin words of a reference, and what they are called.
REFERENCE_WORDS = {"dafa": "दफा", "section": "दफा", "sec": "दफा", "upadafa": "उपदफा", "parichhed": "परिच्छेद", "bhag": "भाग", "ko": "को", "ma": "मा", "khanda": "खण्ड", "ka": "क", "kha": "ख", "ga": "ग"}


def reference_words(text: Column, words: Mapping[str, str] = REFERENCE_WORDS) -> Column:
    """A query with the Latin words of references, whatever their case, in Devanagari; all else as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+"), F.lit(0))
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(known[F.lower(p)], p)), "")


def with_devanagari_numbers(content: Column) -> Column:
    """A chunk whose head (its first line) has the numbers of chapters, sections and pages in Devanagari digits, and its body the number that it begins with."""
    head, rest = F.substring_index(content, "\n", 1), F.when(F.contains(content, F.lit("\n")), F.substring(content, F.instr(content, "\n") + 1, F.length(content)))
    number = r"[0-9०-९]+"
    pieces = F.regexp_extract_all(head, F.lit(rf"परिच्छेद\s*{number}|दफा\s+{number}(?:\.{number})?|p\.{number}|[\s\S]"), F.lit(0))
    marked = lambda p: F.regexp_like(p, F.lit(r"^(?:परिच्छेद|दफा|p\.)"))
    told = lambda p: F.translate(F.regexp_replace(p, r"^(परिच्छेद|दफा)\s*", "$1 "), "0123456789", "०१२३४५६७८९")
    first = F.array_join(F.transform(pieces, lambda p: F.when(marked(p), told(p)).otherwise(p)), "")
    begun = F.regexp_extract(rest, rf"^({number}(?:\.{number})?)\.", 1)
    body = F.concat(F.translate(begun, "0123456789", "०१२३४५६७८९"), F.substring(rest, F.length(begun) + 1, F.length(rest)))
    return F.when(rest.isNull(), first).otherwise(F.concat_ws("\n", first, F.when(begun != "", body).otherwise(rest)))


def longest_first(table: Mapping[str, str]) -> str:
    """A pattern that matches the longest entry which begins at a word, its blanks any white space."""
    entries = sorted(table, key=lambda k: (-len(k), k))
    return "|".join(r"\s+".join(map(re.escape, k.split())) for k in entries)


def transliterated(text: Column, table: Mapping[str, str], postpositions: Sequence[str] = POSTPOSITIONS, joined: Sequence[str] = JOINED) -> Column:
    """A text with the phrases and words of a table (lower case, in Latin letters) in the other script; at each word the longest entry is taken, what has none stays.

    White space becomes one blank, and postpositions are attached to the word before them.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{longest_first(table)})\b|[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    spelled = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    other = F.transform(pieces, lambda p: F.coalesce(spelled[F.regexp_replace(F.lower(p), r"\s+", " ")], p))
    out = F.trim(F.regexp_replace(F.array_join(other, ""), r"\s+", " "))
    out = F.regexp_replace(out, rf"([ऀ-ॿ])\s+({'|'.join(postpositions)})(?=\s|$|[?.!])", "$1$2") if postpositions else out
    for whole in joined:
        out = F.regexp_replace(out, r"\s+".join(whole.split()), whole.replace(" ", ""))
    return out


def repaired(texts: DataFrame, table: Mapping[str, str], id_col: str = "id", text_col: str = "text", reach: int = 40, short: int = 4, ending: str = ENDING) -> DataFrame:
    """(id, text): texts without the Latin words that scanning made of Devanagari ones.

    A word of two letters and more with a Devanagari character within `reach` characters is what the table (lower case) says; if that
    has no entry, it has at most `short` letters and a clause ends behind it (| । or a comma), the ending. Each text is read by itself
    where it is, a slice of twice `reach` for a word, so work is in proportion to the text.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    word, deva = re.compile("[a-zA-Z]{2,}"), re.compile("[ऀ-ॿ]")
    end, blanks, mark = re.compile(r"\s*[|।,]", re.ASCII), re.compile(r"[ \t]{2,}"), re.compile(r"\s+([|।])", re.ASCII)

    def one(text: str) -> str:
        def said(m: re.Match) -> str:
            if not deva.search(text, max(0, m.start() - reach), min(len(text), m.start() + reach)):
                return m[0]
            other = table.get(m[0].lower())
            return other if other is not None else ending if len(m[0]) <= short and end.match(text, m.end()) else m[0]

        return mark.sub(r" \1", blanks.sub(" ", word.sub(said, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array((one(t.as_py() or "") for t in batch[1]), pa.string())], [id_col, "text"])

    return texts.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, text string")
