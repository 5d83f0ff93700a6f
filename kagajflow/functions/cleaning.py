"""Repair of Devanagari text from PDF extraction, and Latin spelling to Devanagari. Word tables are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of one or two characters that stand alone and never are the tail of a broken word.
SHORT_WORDS = ("क", "ज", "त", "र", "व", "ह", "छ", "उन", "का", "को", "तर", "नै", "भए", "मा", "यो", "ले", "वा", "हो")
LETTER = r"\p{IsDevanagari}"


def replaced(s: Column, pattern: str, by: str, passes: int = 1) -> Column:
    for _ in range(passes):
        s = F.regexp_replace(s, pattern, by)
    return s


def joined_signs(s: Column) -> Column:
    """Without the blanks between a letter and the combining signs that belong to it."""
    return F.regexp_replace(s, rf"(?<={LETTER})\s+(?=\p{{M}})", "")


def joined_tails(s: Column, words: Sequence[str] = SHORT_WORDS) -> Column:
    """Without the blank before one or two letters that a line break parted from their word, unless they are one of the words."""
    end = rf"(?!{LETTER})"
    return F.regexp_replace(s, rf"(?<={LETTER}{{2}})\s+(?!(?:{'|'.join(words)}){end})(?={LETTER}{{1,2}}{end})", "")


def cleaned(s: Column, fixes: Sequence[tuple[str, str]] = ()) -> Column:
    """The whole repair: private-use characters out, signs and tails joined, the given (pattern, replacement) fixes in order, blanks made one."""
    s = replaced(s, "[--￿]", " ")
    s = joined_tails(joined_signs(s))
    for pattern, by in fixes:
        s = replaced(s, pattern, by)
    s = replaced(replaced(s, r"।\s*।", "।"), r"([.।])\s*(\d+\.)", "$1 $2")
    return F.trim(replaced(s, r"\s+", " "))


def quality_ok(before: Column, after: Column, low: float = 0.88, high: float = 1.12) -> Column:
    """Whether a repair changed words only: as many full stops, marks and numbers, about the same length, no more Latin letters."""
    same = lambda pattern: F.regexp_count(before, F.lit(pattern)) == F.regexp_count(after, F.lit(pattern))
    ratio = F.length(after) / F.greatest(F.length(before), F.lit(1))
    latin = F.regexp_count(after, F.lit("[A-Za-z]")) <= F.regexp_count(before, F.lit("[A-Za-z]"))
    return same("।") & same(r"\([^)]{1,3}\)") & same("[0-9०-९]+") & ratio.between(low, high) & latin


def to_devanagari(s: Column, phrases: Sequence[tuple[str, str]], words: Mapping[str, str]) -> Column:
    """Latin spelling to Devanagari: phrases first, whatever their case, then single words; unknown words stay."""
    for phrase, by in phrases:
        s = F.regexp_replace(s, rf"(?i)\b{phrase}\b", by)
    if not words:
        return s
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: F.coalesce(table[F.lower(w)], w)), " ")


def less_latin(a: Column, b: Column) -> Column:
    """Of two versions the one with fewer Latin letters, the first if they have as many."""
    count = lambda x: F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when(count(b) < count(a), b).otherwise(a)


def legal_numerals(s: Column) -> Column:
    """`dafa 12`, in either script, as the Devanagari word and digits, ten digits at a time."""
    s = F.regexp_replace(s, r"(?i)\b(?:dafa|daafa|dapha|section)\s*(?=[0-9०-९])", "दफा ")
    for ascii_, deva in zip("0123456789", "०१२३४५६७८९", strict=True):
        s = replaced(s, rf"(?<=दफा\s)([०-९]*){ascii_}", f"$1{deva}", passes=4)
    return s
