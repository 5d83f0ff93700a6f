"""Whole searches on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pipelines
from ..sources.tables import fixture_chunks, fixture_texts
from .retrieval import _LISTS, WITH, _boosted_sql, term_queries, vector_queries, words
from .routes import ASKED_SQL, asked
from .sections import near


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the router's queries quote; every fifth has no embedding."""
    vectors = vector_queries(spark, sf_dir).withColumn("embedding", F.when(F.col("query_id") / 100 % 5 != 4, F.col("embedding")))
    queries = asked(spark, sf_dir).join(vectors, "query_id", "left").join(term_queries(spark, sf_dir), "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    found = pipelines.quoted(queries, fixture_chunks(spark, sf_dir), words=words(spark, sf_dir), texts=fixture_texts(spark, sf_dir))
    return found.select("query_id", F.md5("context").alias("context"))


QUOTED = f"""{WITH}, {ASKED_SQL}, named AS (SELECT query_id, nullif(regexp_extract(text, 'section ([0-9]+)', 1), '')::INT AS root FROM asked
), s1 AS (SELECT query_id, id, 1.0::DOUBLE AS similarity FROM named JOIN chunks USING (root)
), titles AS (SELECT id, replace(replace(lower(trim(regexp_replace(section_title, '\\s+', ' ', 'g'))), ':', ''), '।', '') AS t FROM chunks
), heads AS (SELECT query_id, replace(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ':', ''), '।', '') AS q FROM asked WHERE query_id NOT IN (SELECT query_id FROM s1)
), s2 AS (SELECT query_id, id, round(0.9::DOUBLE + 0.1::DOUBLE * length(q) / length(t), 6) AS similarity FROM heads JOIN titles ON starts_with(t, q) WHERE length(q) >= 3
), {_LISTS}, left_over AS (SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM s1) AND query_id NOT IN (SELECT query_id FROM s2)
), lists AS (SELECT query_id, id, 0.4::DOUBLE / (60 + rank) AS s FROM vector WHERE query_id // 100 % 5 != 4 UNION ALL SELECT query_id, id, 0.6::DOUBLE / (60 + rank) FROM keyword
), s3 AS (SELECT query_id, id, round(sum(s), 9) AS similarity FROM lists SEMI JOIN left_over USING (query_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 9) DESC, id) <= 8
), every AS (SELECT *, 1 AS stage FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3
), placed AS (SELECT e.*, filename, root, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, e.id) AS rank FROM every e JOIN chunks USING (id)
), late AS (SELECT *, max((root >= 10)::INT) OVER (PARTITION BY query_id, filename) AS l FROM placed
), marked AS (SELECT *, root >= 10 OR l = 0 AS keep FROM late), kept AS (SELECT * FROM marked QUALIFY stage < 3 OR keep OR NOT bool_or(keep) OVER (PARTITION BY query_id)
), firsts AS (SELECT *, min(rank) OVER (PARTITION BY query_id, root) AS f FROM kept), top_sections AS (SELECT * FROM firsts QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY f) <= 3
), keys AS (SELECT query_id, filename, root, max(similarity) AS similarity FROM top_sections GROUP BY 1, 2, 3
), parts AS (SELECT k.query_id, k.filename, k.root, k.similarity, c.id, c.content, split_part(section_label, '.', 2)::INT AS tail,
    trim(CASE WHEN contains(content, chr(10) || chr(10)) THEN substring(content, instr(content, chr(10) || chr(10)) + 2) WHEN contains(content, chr(10)) THEN substring(content, instr(content, chr(10)) + 1) ELSE content END, ' ') AS b
  FROM keys k JOIN chunks c ON c.filename = k.filename AND c.root = k.root
), ordered AS (SELECT *, CASE WHEN tail = 8 THEN 1 WHEN tail BETWEEN 1 AND 7 THEN 3 ELSE 2 END AS place FROM parts
), joined AS (SELECT query_id, filename, root, any_value(similarity) AS similarity, first(id ORDER BY place, id) AS id, count(*) AS n, first(content ORDER BY place, id) AS head, string_agg(CASE WHEN b != '' THEN b END, chr(10) || chr(10) ORDER BY place, id) AS bodies FROM ordered GROUP BY 1, 2, 3
), ready AS (SELECT j.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, j.id) AS rank, CASE WHEN n = 1 THEN head ELSE split_part(head, chr(10), 1) || chr(10) || coalesce(bodies, '') END AS text,
    concat_ws(' · ', book_id, chapter, 'दफा ' || translate(section_label, '0123456789', '०१२३४५६७८९')) AS label FROM joined j JOIN chunks c ON c.id = j.id)
SELECT query_id, md5(string_agg('[' || rank || '] ' || label || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM ready WHERE rank <= 3 GROUP BY query_id"""


def advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted search with hints and exclusions; every fourth query has no embedding, every eighth no term and no section that there is, but a topic. Of documents without a vector the former are asked as well, but have no topic."""
    q = (F.col("query_id") / 100).cast("long")
    bare = q % 8 == 7
    both = term_queries(spark, sf_dir).where(F.size("terms") > 0).join(vector_queries(spark, sf_dir).withColumn("placed", F.lit(True)), "query_id", "left")
    queries = both.where(F.col("placed").isNotNull() | ((q % 4 == 3) & ~bare)).select(
        "query_id", F.when(q % 4 != 3, F.col("embedding")).alias("embedding"), F.when(bare, F.array(F.lit("no such word"))).otherwise(F.col("terms")).alias("terms"), F.array(F.lit("en"), F.lit("fr"), F.lit("es")).alias("books"),
        F.when(q % 2 == 0, F.lit("fr")).alias("act"), F.when(q % 3 == 0, (q + 1).cast("int")).alias("chapter_no"), (q * 2).cast("int").alias("low"), (q * 2 + 5).cast("int").alias("high"),
        F.when(bare, F.array(F.lit(-1))).otherwise(F.array(q.cast("int"), (q + 20).cast("int"))).alias("sections"), "placed",
    )
    rows = near(spark, sf_dir, 12)
    hints = rows.where("rank in (2, 5)").select("query_id", "book_id", (F.col("root") + 1).alias("root"))
    excluded = rows.where("rank in (3, 4)").select("query_id", "root")
    topics = queries.where("placed").select("query_id", F.lit("en").alias("book_id"), (q % 5).cast("int").alias("root"))
    found = pipelines.advised(queries, fixture_chunks(spark, sf_dir), hints, excluded, topics=topics, words=words(spark, sf_dir), texts=fixture_texts(spark, sf_dir))
    return found.select("query_id", "filename", "root", "id", "similarity", "n_parts", F.md5("content").alias("content"))


ADVISED = _boosted_sql(3).replace(") SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored QUALIFY rank <= 24", f""")
, top AS (SELECT query_id, id, vector AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, id) AS rank FROM near WHERE vector IS NOT NULL QUALIFY rank <= 24
), near_rows AS (SELECT top.*, book_id, root FROM top JOIN chunks USING (id) WHERE rank <= 12
), found AS (SELECT query_id, id, similarity FROM scored WHERE query_id // 100 % 4 != 3
), w AS (SELECT query_id, id, keyword FROM matched UNION ALL SELECT t.query_id, c.id, NULL FROM (SELECT DISTINCT query_id FROM terms) t JOIN chunks c ON c.root IN (t.query_id // 100, t.query_id // 100 + 20)
), by_words AS (
  SELECT query_id, id, round(CASE WHEN n % 2 = 0 AND book_id = 'fr' THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN n % 3 = 0 AND parichhed_no = n + 1 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN root BETWEEN n * 2 AND n * 2 + 5 THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN root IN (n, n + 20) THEN 1.0::DOUBLE ELSE 0 END + 1.5::DOUBLE * coalesce(keyword, 0) + 1e-9::DOUBLE, 6) AS similarity
  FROM (SELECT query_id, id, max(keyword) AS keyword, query_id // 100 AS n FROM w GROUP BY 1, 2) JOIN chunks USING (id) WHERE book_id IN ('en', 'fr', 'es') AND n % 4 = 3 AND n % 8 != 7
), by_topic AS (SELECT t.query_id, c.id, 0.9::DOUBLE AS similarity FROM (SELECT DISTINCT query_id FROM terms SEMI JOIN vectors USING (query_id)) t JOIN chunks c ON c.book_id = 'en' AND c.root = t.query_id // 100 % 5 WHERE t.query_id NOT IN (SELECT query_id FROM found) AND t.query_id NOT IN (SELECT query_id FROM by_words)
), every AS (SELECT * FROM found UNION ALL SELECT * FROM by_words UNION ALL SELECT * FROM by_topic
), ranked_pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM every QUALIFY rank <= 24
), gone AS (SELECT DISTINCT query_id, root FROM near_rows WHERE rank IN (3, 4)
), hints AS (SELECT DISTINCT query_id, book_id, root + 1 AS root FROM near_rows WHERE rank IN (2, 5)
), hinted AS (SELECT h.query_id, c.id, row_number() OVER (PARTITION BY h.query_id ORDER BY c.id) AS rank FROM hints h JOIN chunks c ON c.book_id = h.book_id AND c.root = h.root WHERE (h.query_id, h.root) NOT IN (SELECT query_id, root FROM gone)
), fused AS (SELECT query_id, id, max(h) AS h, max(s) AS own FROM (SELECT query_id, id, NULL AS h, similarity AS s FROM ranked_pool UNION ALL SELECT query_id, id, 1, NULL FROM hinted) GROUP BY 1, 2
), graded AS (SELECT query_id, f.id, book_id, root, filename, CASE WHEN h = 1 THEN round(greatest(coalesce(own, 0), 0.85::DOUBLE) + 0.15::DOUBLE, 6) ELSE own END AS similarity FROM fused f JOIN chunks USING (id) WHERE (query_id, root) NOT IN (SELECT query_id, root FROM gone) AND query_id IN (SELECT query_id FROM terms)
), own AS (SELECT DISTINCT query_id, root FROM graded WHERE book_id = 'fr' AND query_id // 100 % 2 = 0
), scoped AS (SELECT * FROM graded WHERE query_id // 100 % 2 = 1 OR book_id = 'fr' OR (query_id, root) NOT IN (SELECT query_id, root FROM own)
), pinned AS (SELECT *, (similarity >= 0.84)::INT AS pin, sum((similarity >= 0.84)::INT) OVER (PARTITION BY query_id) AS pins FROM scoped
), kept AS (SELECT * FROM pinned QUALIFY pin = 1 OR row_number() OVER (PARTITION BY query_id, pin ORDER BY similarity DESC, id) <= 16 - pins
), best AS (SELECT query_id, book_id, root, greatest(max(similarity), 0) AS similarity FROM kept GROUP BY 1, 2, 3
), parts AS (SELECT b.query_id, b.similarity, c.id, c.filename, c.root, c.section_label, c.content FROM best b JOIN chunks c ON c.book_id = b.book_id AND c.root = b.root)
SELECT query_id, filename, root, arg_max(id, (similarity, -id)) AS id, max(similarity) AS similarity, count(*) AS n_parts, md5(string_agg(content, chr(10) || chr(10) ORDER BY section_label, id)) AS content FROM parts GROUP BY 1, 2, 3""")

QUERIES = {
    "quoted_answer": (quoted, QUOTED),
    "advised_sections": (advised, ADVISED),
}
