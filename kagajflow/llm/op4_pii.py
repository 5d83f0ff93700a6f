"""PII: patterns propose spans, checksums and ranges confirm them, words nearby adjust the score.

Kinds: email, ip (four parts to 255), card (13 to 19 digits, Luhn), phone (+, 9 to 15 digits), and as an extra iban (mod 97).
Matches of a kind are leftmost and don't overlap; one that fails its check is dropped and the search goes on behind it. Each
search is linear in the text, also on long runs of digits or letters. Offsets are code points, the end excluded.

Null and empty texts give a row without spans. Repeated rows are kept, an empty table gives none, only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
CONTEXT = {
    kind: re.compile(rf"\b(?:{words})\b", re.I)
    for kind, words in {
        "email": r"e?-?mails?|contact\w*|write|kontakt\w*|correo|courriel",
        "ip": r"ip|address\w*|server|host|login",
        "card": r"cards?|visa|mastercard|credit|debit|\w*karte|tarjeta|carte",
        "phone": r"(?:tele)?phone|tel|call|fax|mobile|anruf\w*|llam\w*|appel\w*",
        "iban": r"iban|bank|account|konto|cuenta|compte",
    }.items()
}
#: Code points on each side in which a context word counts, and what it and a confirming checksum add to the score.
NEAR, PRIOR, BY_CONTEXT, BY_CHECKSUM = 40, 0.5, 0.2, 0.3

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if (d := 2 * int(x)) > 9 else d for x in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # behind the last match
    for m in DOMAIN.finditer(text):
        at, width = m.start(), 64
        while True:  # the run of local characters before the sign
            part = text[max(free, at - width) : at]
            run = len(part) - len(part.rstrip(LOCAL))
            if run < len(part) or at - width <= free:
                break
            width *= 8
        if run:
            yield at - run, m.end()
            free = m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                end = start + sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in parts[k : k + 4]):
                    yield start, end
                start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.span()


FIND = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans}
CHECKSUM = {"card", "iban"}


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind and then start."""
    out = []
    for kind in KINDS:
        for start, end in FIND[kind](text):
            near = CONTEXT[kind].search(text, max(0, start - NEAR), start) or CONTEXT[kind].search(text, end, end + NEAR)
            out.append((kind, start, end, PRIOR + BY_CONTEXT * bool(near) + BY_CHECKSUM * (kind in CHECKSUM)))
    return out


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end, score)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(text: str, spans: list[tuple[str, int, int, float]], least: float = 0.0) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first counts."""
    out, at = [], 0
    for kind, start, end, score in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at and score >= least:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(base_only: bool) -> Column:
        spans = F.filter("spans", lambda s: s["kind"].isin(*BASE)) if base_only else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"), scores.alias("scores"))
