"""Chunking, loading and windowed usage on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, continuation, ingest
from ..sources.tables import CHUNKS_SQL, fixture_chunks, table
from ..streaming import usage


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_size(table(spark, sf_dir, "documents"), "doc_id", "text")


#: A chunk's start depends on the end before it: a recursion over each text.
SIZED = """WITH RECURSIVE flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents
), steps AS (
  SELECT doc_id, t, 0 AS i, 0 AS s, 0 AS e FROM flat WHERE t != ''
  UNION ALL
  SELECT doc_id, t, i + 1, ns, CASE WHEN ns + 800 >= length(t) THEN ns + 800 ELSE ns + coalesce(
      CASE WHEN b1 > 400 THEN b1 + 1 END, CASE WHEN b2 > 400 THEN b2 + 2 END, CASE WHEN b3 > 400 THEN b3 + 2 END, CASE WHEN b4 > 400 THEN b4 + 2 END, 800) END
  FROM (SELECT *, 800 - coalesce(nullif(instr(r, '।'), 0), 801) AS b1, 799 - coalesce(nullif(instr(r, ' .'), 0), 801) AS b2, 799 - coalesce(nullif(instr(r, ' ?'), 0), 801) AS b3, 799 - coalesce(nullif(instr(r, ' !'), 0), 801) AS b4
    FROM (SELECT doc_id, t, i, CASE WHEN i = 0 THEN 0 ELSE greatest(e - 200, s + 1) END AS ns, reverse(substring(t, CASE WHEN i = 0 THEN 1 ELSE greatest(e - 200, s + 1) + 1 END, 800)) AS r FROM steps WHERE i = 0 OR e < length(t)))
) SELECT doc_id, (i - 1)::INT AS chunk_index, trim(substring(t, s + 1, e - s)) AS content FROM steps WHERE i > 0"""


def by_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", 400).withColumn("content", F.md5("content"))


#: A chunk holds what fits behind the one before: a recursion over each text's sentences.
BY_SENTENCES = """WITH RECURSIVE split AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: trim(s, ' ')), lambda s: s != '') AS s FROM documents
), steps AS (
  SELECT doc_id, s, 1 AS i, 0 AS c, s[1] AS open_ FROM split WHERE len(s) > 0
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN fits THEN c ELSE c + 1 END, CASE WHEN fits THEN open_ || ' ' || s[i + 1] ELSE s[i + 1] END FROM (SELECT *, length(open_) + 1 + length(s[i + 1]) <= 400 AS fits FROM steps WHERE i < len(s))
) SELECT doc_id, c AS chunk_index, md5(arg_max(open_, i)) AS content FROM steps GROUP BY 1, 2"""


def by_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut before lines that begin with The or In."""
    parts = chunking.by_markers(table(spark, sf_dir, "documents"), "doc_id", "text", r"\n(?:The|In) ")
    return parts.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part")).cast("long").alias("n"), F.md5("content").alias("content"))


BY_MARKERS = """WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '\\n(The|In) ', chr(1) || chr(10) || '\\1 ', 'g'), chr(1)) AS p FROM documents
), parts AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM cut), kept AS (SELECT doc_id, i, trim(raw, ' ') AS t FROM parts WHERE length(trim(raw, ' ')) > 20 OR regexp_matches(trim(raw, ' '), '^\\n(The|In) '))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, md5(t) AS content FROM kept"""


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as statutes: a chapter each, a section for each line, a subsection and a clause in it."""
    dressed = lambda line, i: F.concat(F.lit(" । "), (i + 1).cast("string"), F.lit(". "), F.when(i == 2, "हदम्यादः").otherwise("शीर्षकः"), F.lit(" (१) दफा "), (i + 3).cast("string"), F.lit(" बमोजिम "), line, F.lit(" (क) अन्य । तर यो लागू हुने छैन"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", "[0-9.()]", ""), "\n").alias("lines"))
    text = F.concat(F.lit("भाग–१ परिच्छेद–"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" प्रारम्भिक"), F.array_join(F.transform("lines", dressed), ""))
    chunks = chunking.parse_statutes(docs.select("doc_id", text.alias("text")))
    return chunks.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"), F.max("chapter_hadamyad_dafa").alias("limit_section"), F.sum(F.size("references")).alias("n_references"), F.count_distinct("chunk_id").alias("ids"), F.max(F.length("dafa_title")).cast("long").alias("title"))


#: What statutes are made of, by their making: a section, subsection, clause and proviso for each line.
STATUTES = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, t AS chunk_type, k AS n, CASE WHEN k > 2 THEN '३' END AS limit_section, CASE WHEN t = 'upadafa' THEN k ELSE 0 END::BIGINT AS n_references, k AS ids, CASE WHEN k > 2 THEN 8 ELSE 7 END::BIGINT AS title FROM n, (VALUES ('dafa'), ('upadafa'), ('khanda'), ('tar')) x(t)"""


def continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statutes with references cut by line ends: blocks by kind and depth, and how many lines each rule joined."""
    line = lambda s, i: F.concat(F.lit(" । "), (i + 1).cast("string"), F.lit(". शीर्षकः "), s, F.lit(" । (१) उपदफा (२), (३) र (४) बमोजिम काम । (२) दफा २ को खण्ड (क), (ख) वा (ग) बमोजिम । (क) खण्ड, तर देहायकोः– (१) एक (२) दुई (ख) अर्को ।"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", "[0-9.()]", ""), "\n").alias("lines"))
    found = continuation.tally(docs.select("doc_id", F.array_join(F.transform("lines", line), "").alias("text")))
    return found.groupBy("doc_id", "kind", F.col("depth").cast("long").alias("depth")).agg(F.sum("n").alias("n"))


#: What the dressed lines hold, by their making: so many blocks of each kind, and so many lines joined by each rule.
CONTINUED = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, kind, depth::BIGINT AS depth, k * times AS n FROM n, (VALUES ('dafa', 0, 1), ('upadafa', 1, 2), ('khanda', 2, 2), ('filled stub', NULL, 1), ('listing', NULL, 1), ('tail of a reference', NULL, 1), ('bare clause', NULL, 2),
  ('clause in a listing', NULL, 1), ('exception in a clause', NULL, 1), ('item of a list', NULL, 2)) x(kind, depth, times) UNION ALL SELECT doc_id, 'rest', 1, 1 FROM n"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.windowed(table(spark, sf_dir, "events"))


WINDOWS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(table(spark, sf_dir, "events"))


SESSIONS = """WITH gaps AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '30 minutes', true) AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), marked AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM gaps)
SELECT min(ts) AS session_start, user_id, count(*) AS n FROM marked GROUP BY user_id, s"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of files of which nothing is loaded (loaded are the German ones), and the rest of half-loaded ones."""
    chunks = ingest.numbered(fixture_chunks(spark, sf_dir).select("id", "filename", "book_id"), "filename", "id")
    loaded = chunks.where("book_id = 'de' and chunk_index < 10")
    new = ingest.not_yet_loaded(chunks, loaded).select("id", F.lit("new").alias("why"))
    return new.unionByName(ingest.after(chunks, loaded).select("id", F.lit("behind").alias("why")))


PENDING = f"""WITH {CHUNKS_SQL}, n AS (SELECT id, filename, book_id, row_number() OVER (PARTITION BY filename ORDER BY id) - 1 AS i FROM chunks), loaded AS (SELECT * FROM n WHERE book_id = 'de' AND i < 10
), have AS (SELECT filename, count(*) AS c FROM loaded GROUP BY 1)
SELECT id, 'new' AS why FROM n WHERE filename NOT IN (SELECT filename FROM loaded) UNION ALL SELECT id, 'behind' FROM n LEFT JOIN have USING (filename) WHERE i >= coalesce(c, 0)"""

QUERIES = {
    "fixed_size_chunks": (sized, SIZED),
    "sentence_chunks": (by_sentences, BY_SENTENCES),
    "marker_split": (by_markers, BY_MARKERS),
    "statute_parser": (statutes, STATUTES),
    "continued_lines": (continued, CONTINUED),
    "usage_windows": (windows, WINDOWS),
    "usage_sessions": (sessions, SESSIONS),
    "pending_chunks": (pending, PENDING),
}
