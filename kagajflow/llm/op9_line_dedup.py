"""Line dedup: which lines of each document to keep, as compressed bitmaps.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least `min_chars` code points found
in at least `min_docs` documents lose all their lines but those of the largest document id that holds them.

Keys are 128-bit hashes, each with its first position in a document. They are combined before the shuffle (by hash and a slice of the
documents: how many hold it, the last of them and the position there), then range-partitioned by hash and sorted within partitions
by document, the last first, and position. A window streams over each key's rows in that order: its first row is the occurrence that
stays, its sum of documents says whether the key is repeated. A line that a third of all documents hold is at most SLICES rows there.
Lines meet the repeated keys in two ways: the few held by more than a share HOT of all lines are broadcast (at most 1 / HOT keys,
whatever the corpus), the others are joined by hash. The bitmap of a document is the lengths of its runs of kept and dropped lines in
turn, kept first. DataFrame functions only.

A null or empty text is one empty line. Repeated rows count as documents of their own; those with the surviving id all keep the line.
A row without id survives for no key while another holds it. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
SLICES = 64
#: Keys that hold a larger share of all lines are broadcast: at most 1 / HOT of them.
HOT = 1 / 4096


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Only A-Z are lower-cased; lower() does just that where all is ASCII, and faster."""
    lower = F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))
    return F.btrim(lower, F.lit(SPACE))


def line_index(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, h, lines): the text's hash, and hash (h1, h2) and position of each line whose key is long enough."""

    def hashed(line: Column, i: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), i.alias("position")))

    return df.select(F.col(id_col).alias("id"), common.text_hash(F.col(text_col)).alias("h"), F.filter(F.transform(split_lines(F.col(text_col)), hashed), lambda x: x.isNotNull()).alias("lines"))


def first_occurrences(index: DataFrame) -> DataFrame:
    """(id, h1, h2, position): each key of each document once, at its first line."""
    by_key = F.sort_array(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["position"].alias("position"))))

    def is_first(all_of: Column) -> Column:
        return F.filter(all_of, lambda x, i: (i == 0) | (x["h1"] != F.get(all_of, i - 1)["h1"]) | (x["h2"] != F.get(all_of, i - 1)["h2"]))

    return index.select("id", by_key.alias("sorted")).select("id", F.explode(is_first(F.col("sorted"))).alias("x")).select("id", "x.*")


def repeated_keys(index: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, last, position): the keys in at least min_docs documents, how many, the document that keeps them and where it first does."""
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = first_occurrences(index).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
    slices = once.groupBy("h1", "h2", "slice").agg(F.count("*").alias("n"), F.max("id").alias("last"), F.max_by("position", "id").alias("position"))
    ranged = slices.repartitionByRange(partitions, "h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("last"), "position")
    docs = F.sum("n").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranged.select("h1", "h2", F.row_number().over(stream).alias("nth"), docs.alias("n"), "last", "position").where((F.col("nth") == 1) & (F.col("n") >= min_docs)).drop("nth")


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, h, dropped): the positions of the lines to drop, for each document that has any."""
    index = common.stored(line_index(df, id_col, text_col, min_chars), "lines")
    repeated = common.stored(repeated_keys(index, min_docs), "repeated")
    total = index.agg(F.sum(F.size("lines"))).first()[0] or 0
    lines = index.select("id", "h", F.explode("lines").alias("x")).select("id", "h", "x.*")
    hot, cold = (repeated.where(F.col("n") > HOT * total).drop("n", "position"), repeated.where(F.col("n") <= HOT * total).drop("n", "position"))
    hot = F.broadcast(hot)
    found = lines.join(hot, ["h1", "h2"]).unionByName(lines.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    lost = found.where(F.coalesce(F.col("id") < F.col("last"), F.col("last").isNotNull()))
    return lost.groupBy("id", "h").agg(F.collect_set("position").alias("dropped"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Lengths of the runs of kept and dropped lines in turn, kept first (0 where the first line goes)."""
    edges = F.array_union(F.array_except(dropped, F.transform(dropped, lambda p: p + 1)), F.array_except(F.transform(dropped, lambda p: p + 1), dropped))
    edges = F.array_sort(F.filter(edges, lambda p: p < n_lines))
    starts = F.concat(F.array(F.lit(0)), edges)
    return F.zip_with(starts, F.concat(edges, F.array(n_lines)), lambda a, b: b - a)


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, n_lines, n_dropped, runs, and for who wants the text lines and dropped."""
    lost = dropped_lines(df, id_col, text_col, min_chars, min_docs)
    docs = df.select(F.col(id_col).alias("id"), common.text_hash(F.col(text_col)).alias("h"), split_lines(F.col(text_col)).alias("lines"))
    joined = docs.join(lost, docs["id"].eqNullSafe(lost["id"]) & (docs["h"] == lost["h"]), "left").select(docs["id"], "lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return joined.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), keep_runs(F.size("lines"), F.col("dropped")).alias("runs"), "lines", "dropped"
    )


def kept_text(lines: Column, dropped: Column) -> Column:
    positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.array_join(F.transform(positions, lambda p: F.get(lines, p)), "\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_bitmaps(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("lines"), F.col("dropped")), 256).alias("kept_sha256"), F.array_join(F.transform("runs", lambda n: n.cast("string")), ",").alias("keep_runs"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Runs of kept and dropped lines come from where a line's fate differs from the line before.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < last, false) AS lost FROM keyed LEFT JOIN repeated USING (k)
), turned AS (
  SELECT *, sum((lost != before)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(lost, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM marked)
), runs AS (
  SELECT doc_id, (CASE WHEN bool_or(run = 1 AND pos = 1) THEN '0,' ELSE '' END) || string_agg(n::VARCHAR, ',' ORDER BY run) AS keep_runs
  FROM (SELECT doc_id, run, count(*) AS n, min(pos) AS pos FROM turned GROUP BY doc_id, run) GROUP BY doc_id
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256, keep_runs
FROM marked JOIN runs USING (doc_id) GROUP BY doc_id, keep_runs
"""


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, all rows and columns, with only the kept lines in text, and n_chars to match where there is such a column."""
    lost = dropped_lines(docs, "doc_id", "text", min_chars, min_docs)
    others = [c for c in docs.columns if c != "text"]
    key, lines = common.fresh(docs, "text_hash"), common.fresh(docs, "lines")
    split = docs.select(*(docs[f"`{c}`"] for c in others), common.text_hash(docs["text"]).alias(key), split_lines(docs["text"]).alias(lines))
    joined = split.join(lost, split["doc_id"].eqNullSafe(lost["id"]) & (split[key] == lost["h"]), "left")
    text = F.when(lost["dropped"].isNull(), F.array_join(split[lines], "\n")).otherwise(kept_text(split[lines], lost["dropped"]))
    out = joined.select(*(split[f"`{c}`"] for c in others), text.alias("text"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
