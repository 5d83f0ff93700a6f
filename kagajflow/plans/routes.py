"""Routing and outline queries on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import outline, routing, search
from ..sources.tables import CHUNKS_SQL, fixture_texts, table
from .retrieval import SPLIT_SQL, covers_sql
from .sections import TOP, long, near
from .texts import title_score_sql


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks: some name a section, some are the beginning of a title, the others are free text."""
    n = F.floor(F.col("id") / 100)
    chunks = fixture_texts(spark, sf_dir).where("id % 100 = 0")
    said = F.when(n % 4 == 0, F.concat(F.lit("What says section "), (n + 1).cast("string"), F.lit("?"))).when(n % 4 == 1, F.substring("section_title", 1, 20)).otherwise(F.col("content"))
    return chunks.select(F.col("id").alias("query_id"), said.alias("text"))


ASKED_SQL = """asked AS (SELECT id AS query_id, CASE id // 100 % 4 WHEN 0 THEN 'What says section ' || (id // 100 + 1) || '?' WHEN 1 THEN substring(section_title, 1, 20) ELSE content END AS text FROM chunks WHERE id % 100 = 0)"""


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named section, else title, else full text: the first that finds anything."""
    chunks, queries = fixture_texts(spark, sf_dir), asked(spark, sf_dir)
    terms = queries.select("query_id", F.slice(F.array_distinct(text.tokens(F.col("text"))), 1, 2).alias("terms"))
    return long(routing.cascade(routing.by_section(queries, chunks), routing.by_title(queries, chunks), search.full_text_or_fallback(terms, chunks, 8)), "stage")


ROUTER = f"""WITH {CHUNKS_SQL}, {ASKED_SQL}, named AS (SELECT query_id, nullif(regexp_extract(text, 'section ([0-9]+)', 1), '')::INT AS root FROM asked
), s1 AS (SELECT query_id, id, 1.0::DOUBLE AS similarity FROM named JOIN chunks USING (root)
), titles AS (SELECT id, lower(trim(regexp_replace(section_title, '\\s+', ' ', 'g'))) AS t FROM chunks), heads AS (SELECT query_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM asked
), s2 AS (SELECT query_id, id, round(0.9::DOUBLE + 0.1::DOUBLE * length(q) / length(t), 6) AS similarity FROM heads JOIN titles ON starts_with(replace(replace(t, ':', ''), '।', ''), replace(replace(q, ':', ''), '।', '')) WHERE length(q) >= 3
), split AS (SELECT query_id, {SPLIT_SQL.format("text")} AS w FROM asked
), terms AS (SELECT query_id, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:2]) AS term FROM split
), words AS (SELECT id, unnest({SPLIT_SQL.format("content")}) AS term, generate_subscripts({SPLIT_SQL.format("content")}, 1) AS pos FROM chunks
), {covers_sql("terms", "words", "whole")}, any_term AS (SELECT query_id, id, round(least(1.0::DOUBLE, 8 * (0.1::DOUBLE * count(*)) / (0.1::DOUBLE * count(*) + 1)) + 1e-9::DOUBLE, 6) AS similarity FROM words JOIN terms USING (term) WHERE length(term) > 1 GROUP BY 1, 2
), best AS (SELECT * FROM whole UNION ALL SELECT * FROM any_term WHERE query_id NOT IN (SELECT query_id FROM whole)), s3 AS (SELECT query_id, id, similarity FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 8
), every AS (SELECT *, 1::BIGINT AS stage FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3)
SELECT query_id, id, similarity, stage FROM every QUALIFY stage = min(stage) OVER (PARTITION BY query_id)"""


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    return routing.without_sections(rows, rows.where("rank % 5 = 0").select("query_id", "root")).select("query_id", "id")


EXCLUDED = f"""{TOP} SELECT query_id, id FROM rows WHERE (query_id, root) NOT IN (SELECT query_id, root FROM rows WHERE rank % 5 = 0)"""


def hinted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    return routing.only_hinted(rows, rows.where("query_id % 200 = 0 and rank in (3, 6)").select("query_id", "book_id", "root")).select("query_id", "id")


HINTED_ONLY = f"""{TOP}, hints AS (SELECT DISTINCT query_id, book_id, root FROM rows WHERE query_id % 200 = 0 AND rank IN (3, 6)), marked AS (SELECT *, (query_id, book_id, root) IN (SELECT query_id, book_id, root FROM hints) AS hit FROM rows)
SELECT query_id, id FROM marked QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY query_id)"""


def chapter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    chapters = rows.where("rank <= 2 and query_id % 300 = 0").select("query_id", "filename", "parichhed_no")
    pins = rows.where("rank = 9").select("query_id", "root")
    return routing.in_chapters(rows, chapters, pins).select("query_id", "id")


CHAPTER_SCOPE = f"""{TOP}, chapters AS (SELECT query_id, filename, parichhed_no FROM rows WHERE rank <= 2 AND query_id % 300 = 0)
SELECT query_id, id FROM rows WHERE (query_id, filename, parichhed_no) IN (SELECT * FROM chapters) OR (query_id, root) IN (SELECT query_id, root FROM rows WHERE rank = 9) OR query_id NOT IN (SELECT query_id FROM chapters)"""


def title_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return routing.needs_title_search(queries, near(spark, sf_dir, 3))


TITLE_NEED = f"""{TOP}, {ASKED_SQL}, seen AS (SELECT query_id, max(similarity) AS best, max(root) AS last FROM rows WHERE rank <= 3 GROUP BY 1)
SELECT query_id, coalesce(best < 0.45 OR last < 10, true) AS needed FROM asked LEFT JOIN seen USING (query_id)"""

RULES = [(1, "section 1[0-9]", "en", 7), (2, "(?i)section", "de", 3), (3, "the of", "en", 11), (4, "th", "fr", 2)]


def topic_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "priority int, pattern string, book_id string, root int")
    return routing.topics(asked(spark, sf_dir), rules)


TOPIC_PINS = f"""WITH {CHUNKS_SQL}, {ASKED_SQL}, rules(priority, pattern, book_id, root) AS (VALUES {", ".join(map(str, RULES))})
SELECT query_id, priority, book_id, root FROM asked JOIN rules ON regexp_matches(text, pattern) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority) = 1"""


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over pairs of sections that occur together in the results of the first queries; even ones are strong."""
    rows = near(spark, sf_dir)
    pairs = rows.where("rank = 1").select("query_id", F.col("root").alias("keep_root")).join(rows.where("rank = 4").select("query_id", F.col("root").alias("drop_root")), "query_id")
    rules = pairs.select(F.col("query_id").alias("priority"), F.lit("the").alias("pattern"), "keep_root", "drop_root", (F.col("query_id") % 200 == 0).alias("strong")).where("keep_root <> drop_root")
    queries = rows.select("query_id").distinct().withColumn("text", F.lit("the question"))
    return long(routing.settle_conflicts(rows.select("query_id", "id", "root", "similarity"), queries, rules).select("query_id", "id", "place"), "place")


CONFLICTS = f"""{TOP}, rules AS (SELECT a.query_id AS priority, a.root AS keep_root, b.root AS drop_root, a.query_id % 200 = 0 AS strong FROM rows a JOIN rows b USING (query_id) WHERE a.rank = 1 AND b.rank = 4 AND a.root != b.root
), has AS (SELECT DISTINCT query_id, root FROM rows), met AS (SELECT query_id, drop_root, strong FROM (SELECT DISTINCT query_id FROM rows), rules WHERE (query_id, keep_root) IN (SELECT * FROM has) AND (query_id, drop_root) IN (SELECT * FROM has)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority) = 1
), marked AS (SELECT r.*, coalesce(root = drop_root, false) AS other, coalesce(strong, false) AS strong FROM rows r LEFT JOIN met USING (query_id))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY other, similarity DESC, id) AS place FROM marked WHERE NOT (other AND strong)"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    queries = rows.select("query_id").distinct().withColumn("text", F.when(F.col("query_id") % 200 == 0, "What is law?").otherwise("How much?"))
    return long(routing.pin_first_section(rows, queries, fixture_texts(spark, sf_dir)), "rank")


DEFINITIONS = f"""{TOP}, counts AS (SELECT query_id, book_id, parichhed_no, count(*) AS n, min(rank) AS seen FROM rows WHERE query_id % 200 = 0 GROUP BY 1, 2, 3
), chapter AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen) = 1
), firsts AS (SELECT book_id, parichhed_no, id FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id, parichhed_no ORDER BY root, id) = 1
), every AS (SELECT query_id, id, similarity FROM rows UNION ALL SELECT query_id, id, 0.96::DOUBLE FROM chapter JOIN firsts USING (book_id, parichhed_no)), best AS (SELECT query_id, id, max(similarity) AS similarity FROM every GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM best"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of the titles of every document whose id is divisible by 100, as names, found again in the taxonomy of all titles of their book."""
    chunks = fixture_texts(spark, sf_dir)
    taxonomy = chunks.select("book_id", F.col("id").cast("int").alias("root"), F.substring("section_title", 1, 30).alias("title"))
    names = chunks.where("id % 100 = 0").select(F.floor(F.col("id") / 300).alias("query_id"), F.col("id").alias("place"), F.substring("section_title", 1, 14).alias("name"), "book_id")
    return routing.agreed(routing.reconcile(names, taxonomy)).select("query_id", "confidence", "inferred_book", F.array_join(F.transform("roots", lambda r: r.cast("string")), ",").alias("roots"))


RECONCILED = f"""WITH {CHUNKS_SQL}, titles AS (SELECT book_id, id::INT AS root, trim(regexp_replace(replace(replace(substring(section_title, 1, 30), ':', ''), '।', ''), '\\s+', ' ', 'g')) AS t FROM chunks
), names AS (SELECT id // 300 AS query_id, id AS place, substring(section_title, 1, 14) AS name, trim(regexp_replace(replace(replace(substring(section_title, 1, 14), ':', ''), '।', ''), '\\s+', ' ', 'g')) AS q, book_id FROM chunks WHERE id % 100 = 0
), pairs AS (SELECT n.*, h.root, h.t FROM names n JOIN titles h ON n.book_id = h.book_id), {title_score_sql("pairs", "matched")}, scored AS (
  SELECT * REPLACE (round(score + CASE WHEN nullif(regexp_extract(name, '([0-9]+)', 1), '')::INT = root THEN 0.3::DOUBLE ELSE 0 END + 1e-9::DOUBLE, 6) AS score) FROM matched
), best AS (SELECT * FROM scored WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC, root, t DESC) = 1
), books AS (SELECT query_id, book_id, count(*) AS n, min(place) AS seen FROM best GROUP BY 1, 2), usual AS (SELECT query_id, book_id FROM books QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen) = 1)
SELECT query_id, min(score) AS confidence, any_value(u.book_id) AS inferred_book, array_to_string(list_sort(list(DISTINCT root)), ',') AS roots FROM best JOIN usual u USING (query_id) GROUP BY 1"""


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's clicks with the value of the user's last purchase before."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("bought"))
    return outline.enclosing(clicks, bought, "user_id", "ts", "bought").select("event_id", "bought")


AS_OF = """WITH bought AS (SELECT user_id, ts, max(value) AS bought FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, bought FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN bought b ON c.user_id = b.user_id AND c.ts >= b.ts"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of an order begins and ends if lines stood one behind the other at ten times their number."""
    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("at"), F.lit(1000).cast("long").alias("whole")).distinct()
    return outline.extents(marks, "l_orderkey", "at", "whole").select("l_orderkey", "at", "until")


EXTENTS = """WITH marks AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS at_ FROM lineitem) SELECT l_orderkey, at_::BIGINT AS "at", coalesce(lead(at_) OVER (PARTITION BY l_orderkey ORDER BY at_), 1000)::BIGINT AS until FROM marks"""


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source's book, and their titles, some short, as sections to find."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), "text")
    title = F.when(F.col("page") % 5 == 0, F.substring("text", 1, 9)).otherwise(F.substring("text", 1, 40))
    sections = docs.select("book_id", (F.col("page") % 97).cast("int").alias("root"), title.alias("title")).groupBy("book_id", "root").agg(F.min("title").alias("title"))
    return outline.first_pages(sections, docs)


_FLAT = "lower(regexp_replace({0}, '[\\s।|,.:ः]+|[mनयखलउ]', '', 'g'))"
#: All sections against all pages of their books.
PAGE_MAP = f"""WITH pages AS (SELECT source AS book_id, doc_id AS page, {_FLAT.format("text")} AS flat, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents
), sections AS (SELECT source AS book_id, (doc_id % 97)::INT AS root, substring(text, 1, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 40 END) AS raw, doc_id FROM documents
), wanted AS (SELECT book_id, root, {_FLAT.format("raw")} AS t, length({_FLAT.format("raw")}) < 14 AS generic FROM (SELECT book_id, root, min(raw) AS raw FROM sections GROUP BY 1, 2)
), pairs AS (SELECT w.*, page, flat, regexp_matches(text, '(?:^|[ ।|])' || root || '(?:\\s*\\.|[.\\sः])|दफा\\s*' || root) AS named FROM wanted w JOIN pages p USING (book_id)
), found AS (SELECT book_id, root, coalesce(min(page) FILTER (named AND (generic OR contains(flat, substring(t, 1, 16)))), min(page) FILTER (named), min(page) FILTER (NOT generic AND contains(flat, substring(t, 1, 24))),
  min(page) FILTER (NOT generic AND contains(flat, substring(t, 1, 18))), min(page) FILTER (NOT generic AND contains(flat, substring(t, 1, 12)))) AS page FROM pairs GROUP BY 1, 2)
SELECT * FROM found"""

TERMS = ("estion", "thion", "erst", "que")


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first two lines and the three others that the terms weigh most in."""
    docs = table(spark, sf_dir, "documents")
    out = outline.trimmed(docs, "doc_id", F.split("text", "\n"), F.array(*map(F.lit, TERMS)))
    return out.select("doc_id", F.md5("body").alias("body"), "parts")


TRIMMED = f"""WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), weighed AS (SELECT *, CASE WHEN i < 2 THEN 1000000 ELSE list_sum(list_transform({list(TERMS)}, lambda t: CASE WHEN contains(lower(part), t) THEN length(t) ELSE 0 END)) END AS weight FROM cut
), kept AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, i) <= 5 AND weight > 0)
SELECT doc_id, md5(string_agg(part, chr(10) ORDER BY i)) AS body, count(*) AS parts FROM kept GROUP BY 1"""

QUERIES = {
    "query_router": (router, ROUTER),
    "excluded_sections": (excluded, EXCLUDED),
    "hinted_only": (hinted_only, HINTED_ONLY),
    "chapter_scope": (chapter_scope, CHAPTER_SCOPE),
    "title_search_need": (title_need, TITLE_NEED),
    "topic_pins": (topic_pins, TOPIC_PINS),
    "conflict_rules": (conflicts, CONFLICTS),
    "definition_pin": (definitions, DEFINITIONS),
    "taxonomy_reconcile": (reconciled, RECONCILED),
    "enclosing_marker": (as_of, AS_OF),
    "marker_extents": (extents, EXTENTS),
    "page_map": (page_map, PAGE_MAP),
    "trimmed_body": (trimmed, TRIMMED),
}
