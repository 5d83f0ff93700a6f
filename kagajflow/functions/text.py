"""Text: digits of two scripts, cleaning for search, titles, headers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten digits in Devanagari, and the clause letters in order with their Latin forms.
DIGITS = "०१२३४५६७८९"
CLAUSES = {
    "क": "ka", "ख": "kha", "ग": "ga", "घ": "gha", "ङ": "nga", "च": "cha", "छ": "chha", "ज": "ja", "झ": "jha", "ञ": "nya", "ट": "ta", "ठ": "tha", "ड": "da", "ढ": "dha", "ण": "na",
    "त": "ta2", "थ": "tha2", "द": "da2", "ध": "dha2", "न": "na2", "प": "pa", "फ": "pha", "ब": "ba", "भ": "bha", "म": "ma", "य": "ya", "र": "ra", "ल": "la", "व": "va", "श": "sha", "ष": "sha2", "स": "sa", "ह": "ha",
}
#: Words that say nothing in a title.
TITLE_STOP_WORDS = ("गरेको", "गर्न", "हुने", "हुन", "काम", "कसूर", "लागि", "पाउने", "वा", "र", "को", "का", "ले", "मा", "छ", "हो")


def to_ascii_digits(s: Column) -> Column:
    return F.translate(s, DIGITS, "0123456789")


def to_devanagari_digits(s: Column) -> Column:
    return F.translate(s, "0123456789", DIGITS)


def clause_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in CLAUSES.items() for x in pair))


def clause_order(letter: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLAUSES)), letter)


def search_text(s: Column) -> Column:
    """A query with all but letters, digits and marks blanked, as full-text search takes it."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}\p{N}\p{M}]+", " "))


def tokens(s: Column) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_words(s: Column, stop: tuple[str, ...] = (), least: int = 2) -> Column:
    """The distinct words that a query is searched by; the whole query if none are left."""
    words = F.array_distinct(F.filter(tokens(s), lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(F.trim(s))))


def devanagari_ratio(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[ऀ-ॿ]")) / F.greatest(F.length(s), F.lit(1))


def section_root(label: Column) -> Column:
    """A section label up to its first dot."""
    return F.nullif(F.substring_index(label, ".", 1), F.lit(""))


def section_number(label: Column) -> Column:
    """The number of a section label: what digits it has before the first dot, of either script; null without any."""
    return F.nullif(F.regexp_replace(to_ascii_digits(section_root(label)), r"[^0-9]", ""), F.lit("")).cast("int")


def chapter_number(chapter: Column) -> Column:
    """The first number in a chapter's name."""
    return F.nullif(F.regexp_extract(to_ascii_digits(chapter), r"([0-9]+)", 1), F.lit("")).cast("int")


def chapter_name(chapter: Column) -> Column:
    """A chapter's name behind the first dash; without a dash, behind its number."""
    parts = F.split(chapter, r"[—–-]\s*")
    after = F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(F.size(parts) > 1, after).otherwise(F.trim(F.regexp_replace(chapter, r"^(?:परिच्छेद|Chapter)\s*[0-9०-९]+\s*", "")))


def normal_title(s: Column) -> Column:
    """A title without marks that end it, blanks made one, spellings unified."""
    bare = F.regexp_replace(F.regexp_replace(s, "[ः:।]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "वहुविवाह", "बहुविवाह"), r"बहु\s*विवाह", "बहुविवाह"))


def title_tokens(s: Column) -> Column:
    return F.filter(F.split(normal_title(s), r"[\s,]+"), lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOP_WORDS))


def slug(s: Column) -> Column:
    """Lower case, & spelled out, all else but ASCII letters and digits as single hyphens inside."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "&", "and"), "[^a-z0-9]+", "-"), "^-|-$", "")


def shortened(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def title_of_body(body: Column, before: int = 120, most: int = 80) -> Column:
    """A section's title: its body up to the visarga, or its first characters."""
    at = F.instr(body, "ः")
    return F.trim(F.when((at > 1) & (at <= before), F.substring(body, F.lit(1), at)).otherwise(F.substring(body, 1, most)))


def header_of(content: Column) -> Column:
    return F.substring_index(content, "\n\n", 1)


def body_of(content: Column) -> Column:
    """What follows the header block; without a block, all but the first line."""
    whole = F.instr(content, "\n\n")
    return F.trim(F.when(whole > 0, F.substring(content, whole + 2, F.length(content))).otherwise(F.regexp_replace(content, r"^[^\n]*\n?", "")))


def header_field(content: Column, name: str) -> Column:
    """The value of `name: value` in the header block."""
    return F.nullif(F.trim(F.regexp_extract(header_of(content), rf"(?m)^\s*{name}\s*:\s*(.+)$", 1)), F.lit(""))


def chunk_id(dafa: Column, kind: Column, upadafa: Column, khanda: Column, index: Column) -> Column:
    """dafa_<n>, with _upadafa_<m>, then the clause's letter in Latin, or _<kind>_<index>."""
    letter = F.coalesce(clause_map()[F.regexp_extract(dafa, "([क-ह])$", 1)], F.lit(""))
    base = F.concat(F.lit("dafa_"), F.regexp_extract(to_ascii_digits(dafa), "([0-9]+)", 1), letter)
    sub = F.concat(base, F.lit("_upadafa_"), to_ascii_digits(upadafa))
    clause = F.concat(sub, F.lit("_"), F.coalesce(clause_map()[khanda], khanda))
    return F.when(kind == "dafa", base).when((kind == "upadafa") & upadafa.isNotNull(), sub).when((kind == "khanda") & upadafa.isNotNull() & khanda.isNotNull(), clause).otherwise(
        F.concat(base, F.lit("_"), kind, F.lit("_"), index.cast("string"))
    )
