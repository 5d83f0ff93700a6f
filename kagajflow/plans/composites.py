"""Section assembly, chapters, hints and evaluation on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import analysis, assembly, chapters, evaluation, search
from ..functions.text import body_of
from ..sources.tables import CHUNKS_SQL, STATUTES_SQL, fixture_texts, statute_chunks, table
from .retrieval import term_queries
from .sections import TOP, long, near
from .texts import BODY_SQL, PARTS_SQL, _FORM, quality_points

BOOKS = (("even", "[02468]$", "^a"), ("odd", "[13579]$", None), ("named", "[a-z]", None))


def book_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("file")).agg(F.count("*").alias("n"))
    return docs.select(
        "file", "n", labels.book_of(F.col("file"), BOOKS).alias("book"), labels.in_books(F.col("file"), ["even", "named"], BOOKS).alias("inside"), labels.in_books(F.col("file"), [], BOOKS).alias("anywhere"),
        labels.compact_key(F.col("file")).alias("key"), labels.pdf_link("https://files.example", F.col("file"), F.col("n")).alias("link"), labels.short_number(F.col("n") * 37).alias("short"),
    )


BOOK_SCOPES = """SELECT *, CASE WHEN regexp_matches(file, '[02468]$') AND NOT regexp_matches(file, '^a') THEN 'even' WHEN regexp_matches(file, '[13579]$') THEN 'odd' WHEN regexp_matches(file, '[a-z]') THEN 'named' END AS book,
  regexp_matches(file, '[02468]$') AND NOT regexp_matches(file, '^a') OR regexp_matches(file, '[a-z]') AS inside, true AS anywhere, lower(regexp_replace(file, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) AS key,
  'https://files.example/' || url_encode(file) || '#page=' || n AS link, CASE WHEN n * 37 >= 1000000 THEN regexp_replace(round(n * 37 / 1000000, 1)::DECIMAL(20,1)::VARCHAR, '\\.0$', '') || 'M'
  WHEN n * 37 >= 1000 THEN regexp_replace(round(n * 37 / 1000, 1)::DECIMAL(20,1)::VARCHAR, '\\.0$', '') || 'k' ELSE (n * 37)::VARCHAR END AS short
FROM (SELECT coalesce(source, '') AS file, count(*) AS n FROM documents GROUP BY 1)"""


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each query's nearest chunks, all their parts as one text; odd sections' items are left out."""
    chunks = fixture_texts(spark, sf_dir).withColumn("page", (F.col("id") % 4).cast("int"))
    keys = near(spark, sf_dir).groupBy("query_id", "root").agg(F.max("similarity").alias("similarity"))
    rows = keys.join(chunks, "root")
    found = assembly.stitched(rows, F.col("root") % 2 == 1)
    return found.select("query_id", "filename", "root", "id", "similarity", "n_parts", F.md5("content").alias("content"))


STITCHED = f"""{TOP}, keys AS (SELECT query_id, root, max(similarity) AS similarity FROM rows GROUP BY 1, 2), parts AS (
  SELECT query_id, c.filename, c.root, c.id, k.similarity, c.content, c.id % 4 AS page, split_part(section_label, '.', 2)::INT AS tail,
    CASE WHEN contains(content, chr(10) || chr(10)) THEN substring(content, instr(content, chr(10) || chr(10)) + 2) WHEN contains(content, chr(10)) THEN substring(content, instr(content, chr(10)) + 1) ELSE content END AS raw
  FROM keys k JOIN chunks c USING (root) WHERE NOT (root % 2 = 1 AND split_part(section_label, '.', 2)::INT BETWEEN 1 AND 7)
), placed AS (SELECT *, trim(raw, ' ') AS b0, CASE WHEN tail = 8 THEN 1 WHEN tail BETWEEN 1 AND 7 THEN 3 ELSE 2 END AS place FROM parts
), joined AS (
  SELECT query_id, filename, root, first(id ORDER BY place, page, id) AS id, any_value(similarity) AS similarity, count(*) AS n_parts, first(content ORDER BY place, page, id) AS head, string_agg(CASE WHEN b0 != '' THEN b0 END, chr(10) || chr(10) ORDER BY place, page, id) AS bodies
  FROM placed GROUP BY 1, 2, 3
) SELECT query_id, filename, root, id, similarity, n_parts, md5(CASE WHEN n_parts = 1 THEN head ELSE split_part(head, chr(10), 1) || chr(10) || coalesce(bodies, '') END) AS content FROM joined"""


def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = labels.source_label(F.col("book_id"), F.col("filename"), F.when(F.col("id") % 2 == 0, F.col("filename")).otherwise(F.col("chapter")), (F.col("root") % 3).cast("string"))
    return assembly.best_per_label(near(spark, sf_dir), label).select("query_id", "id", "label")


BEST_LABELS = f"""{TOP}, named AS (SELECT *, concat_ws(' · ', book_id, filename, CASE WHEN id % 2 = 1 THEN chapter END, 'दफा ' || translate((root % 3)::VARCHAR, '0123456789', '०१२३४५६७८९')) AS label FROM rows)
SELECT query_id, id, label FROM named QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, id) = 1"""


def best_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's nearest chunks of one file and part number the best."""
    rows = near(spark, sf_dir).withColumns({"subsection_no": F.when(F.col("id") % 3 > 0, F.col("id") % 3), "clause": F.when(F.col("id") % 3 == 1, "क"), "kind": F.lit(""), "subsection": F.when(F.col("id") % 2 == 0, "(9)")})
    keyed = assembly.part_keys(rows.withColumn("root", (F.col("root") % 2).cast("int")))
    return assembly.best_parts(keyed, F.round(F.col("similarity"), 1)).select("query_id", "id", "part")


BEST_PARTS = f"""{TOP}, keyed AS (SELECT *, filename || '|' || (root % 2) || '|' || CASE id % 3 WHEN 1 THEN 'u1|kक' WHEN 2 THEN 'u2|upadafa' ELSE CASE WHEN id % 2 = 0 THEN '9' ELSE '_root' END END AS part FROM rows)
SELECT query_id, id, part FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY round(similarity, 1) DESC, length(content) DESC, id) = 1"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statute_chunks(spark, sf_dir)
    return rows.select(
        "id", assembly.provision_quality(F.col("content"), F.col("root"), F.col("page"), F.col("section_label")).cast("long").alias("quality"), assembly.is_form(body_of(F.col("content"))).alias("is_form")
    )


QUALITY = f"WITH {CHUNKS_SQL}, {STATUTES_SQL}, {PARTS_SQL} SELECT id, ({quality_points('root', 'page')})::BIGINT AS quality, {_FORM} AS is_form FROM shown"


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are neither forms nor preambles, of every file one row: how many, labelled, sections and marks."""
    rows = statute_chunks(spark, sf_dir).withColumn("section_label", F.when(F.col("id") % 8 == 1, F.concat(F.lit("0"), "section_label")).otherwise(F.col("section_label")))
    some = assembly.usable_chunks(rows)
    kinds = some.groupBy(F.col("book_id").alias("book")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    return assembly.chunk_summary(some).withColumns({"book": F.lit(None).cast("string"), "n": F.col("chunks"), "ids": F.lit(None).cast("long")}).unionByName(kinds, allowMissingColumns=True)


USABLE = f"""WITH {CHUNKS_SQL}, {STATUTES_SQL}, {PARTS_SQL}, kept AS (SELECT * FROM shown WHERE length({BODY_SQL}) >= 15 AND NOT {_FORM} AND NOT coalesce(regexp_matches(CASE WHEN id % 8 = 1 THEN '0' ELSE '' END || section_label, '^0[0-9]+(\\.|$)'), false)
  AND NOT coalesce(section_label = '6' AND id % 8 != 1 AND regexp_matches({BODY_SQL}, 'शोिन|संशोधन'), false))
SELECT count(*) AS chunks, count(section_label) AS labelled, count(DISTINCT (filename, root)) AS sections, sum(len(regexp_extract_all(content, '\\([0-9०-९क-ह]{{1,2}}\\)')))::BIGINT AS marks, NULL AS book, count(*) AS n, NULL AS ids FROM kept
UNION ALL SELECT NULL, NULL, NULL, NULL, book_id, count(*), sum(id)::BIGINT FROM kept GROUP BY book_id"""


def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of queries as two texts of one, with seeds and a preferred book."""
    rows = near(spark, sf_dir)
    texts = rows.select(F.col("query_id").alias("text_id")).distinct().withColumn("query_id", F.floor(F.col("text_id") / 200))
    found = rows.select(F.col("query_id").alias("text_id"), "id", "book_id", "similarity")
    chunks = fixture_texts(spark, sf_dir)
    wanted = texts.select("query_id").distinct().select("query_id", F.lit("en").alias("book_id"), (F.col("query_id") + 3).cast("int").alias("root"))
    seeds = chapters.seeds_of(wanted, wanted.select("query_id", F.lit("nothing begins so").alias("phrase")), chunks)
    act = texts.select("query_id").distinct().withColumn("book_id", F.when(F.col("query_id") % 2 == 0, "fr").otherwise("en"))
    return long(chapters.many_queries(texts, found, act, seeds), "rank").select("query_id", "id", "similarity", "rank")


MULTI_QUERY = f"""{TOP}, groups AS (SELECT DISTINCT query_id // 200 AS query_id FROM rows), every AS (
  SELECT query_id // 200 AS query_id, id, book_id, similarity FROM rows UNION ALL SELECT query_id, c.id, c.book_id, 0.88::DOUBLE FROM groups JOIN chunks c ON c.book_id = 'en' AND c.root = query_id + 3
), best AS (SELECT query_id, id, round(max(similarity) + CASE WHEN any_value(book_id) = CASE WHEN query_id % 2 = 0 THEN 'fr' ELSE 'en' END THEN 0.12::DOUBLE ELSE 0 END, 6) AS similarity FROM every GROUP BY query_id, id
), pinned AS (SELECT *, (similarity >= 0.84)::INT AS pin, sum((similarity >= 0.84)::INT) OVER (PARTITION BY query_id) AS pins FROM best
), kept AS (SELECT query_id, id, similarity FROM pinned QUALIFY pin = 1 OR row_number() OVER (PARTITION BY query_id, pin ORDER BY similarity DESC, id) <= 16 - pins)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM kept"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by a query's sections, else by its hints, else by name."""
    rows, chunks = near(spark, sf_dir), fixture_texts(spark, sf_dir)
    queries = rows.select("query_id").distinct()
    sections = rows.where("rank = 1 and query_id % 300 = 0").select("query_id", "book_id", "root")
    hints = queries.where("query_id % 300 = 100").select("query_id", F.lit("en").alias("book_id"), F.lit(4).alias("chapter_no"), F.lit("no such name").alias("name"))
    return chapters.target_chapters(sections, hints, queries.withColumn("text", F.lit("src7")), chunks)


TARGETS = f"""{TOP}, firsts AS (SELECT book_id, root, first(chapter ORDER BY id) AS chapter FROM chunks GROUP BY 1, 2
), s0 AS (SELECT DISTINCT query_id, book_id, f.chapter FROM rows r JOIN firsts f USING (book_id, root) WHERE rank = 1 AND query_id % 300 = 0
), s1 AS (SELECT query_id, 'en' AS book_id, (SELECT chapter FROM chunks WHERE book_id = 'en' AND parichhed_no = 4 ORDER BY id LIMIT 1) AS chapter FROM (SELECT DISTINCT query_id FROM rows) WHERE query_id % 300 = 100
), named AS (SELECT DISTINCT book_id, chapter FROM chunks WHERE filename = 'src7')
SELECT * FROM s0 UNION ALL SELECT * FROM s1 WHERE chapter IS NOT NULL
UNION ALL SELECT query_id, book_id, chapter FROM (SELECT DISTINCT query_id FROM rows) q, named WHERE query_id % 300 = 200 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY book_id, chapter) = 1"""


def leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text matches of queries within a chapter each."""
    chunks = fixture_texts(spark, sf_dir)
    terms = term_queries(spark, sf_dir)
    inside = terms.select("query_id", (F.floor(F.col("query_id") / 100) % 10 + 1).cast("int").alias("parichhed_no")).join(chunks.select("book_id", "parichhed_no", "chapter").distinct(), "parichhed_no").drop("parichhed_no")
    return chapters.keyword_leg(inside, terms, chunks).select("query_id", "id", "similarity")


LEG = f"""{TOP}, best AS (SELECT * FROM any_term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 24
), inside AS (SELECT b.* FROM best b JOIN chunks c USING (id) WHERE parichhed_no = query_id // 100 % 10 + 1)
SELECT query_id, id, greatest(similarity, 0.738::DOUBLE) AS similarity FROM inside QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 12"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by chunk id, section, subsection, clause, or subsection and clause."""
    chunks = fixture_texts(spark, sf_dir)
    corpus = chunks.select("id", F.concat(F.lit("c"), "id").alias("chunk_id"), "root", (F.col("id") % 3).cast("int").alias("subsection"), F.when(F.col("id") % 2 == 0, "क").alias("clause"))
    asked = chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.floor(F.col("id") / 100).cast("int").alias("n"))
    none = F.lit(None)
    wanted = asked.select(
        "query_id", F.when(F.col("n") % 5 == 0, F.concat(F.lit("c"), F.col("n").cast("string"))).alias("chunk_id"), F.when(F.col("n") % 5 > 0, F.col("n")).cast("int").alias("root"),
        F.when(F.col("n") % 5 % 2 == 0, 1).otherwise(none).cast("int").alias("subsection"), F.when(F.col("n") % 5 > 2, "क").alias("clause"),
    )
    return long(chapters.by_reference(wanted, corpus).select("query_id", "id", "stage"), "stage")


REFERENCES = f"""WITH {CHUNKS_SQL}, asked AS (SELECT id AS query_id, (id // 100)::INT AS n FROM chunks WHERE id % 100 = 0)
SELECT query_id, c.id, 3::BIGINT AS stage FROM asked JOIN chunks c ON c.id = n WHERE n % 5 = 0
UNION ALL SELECT query_id, c.id, CASE n % 5 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 4 END FROM asked JOIN chunks c ON c.root = n
WHERE n % 5 = 1 OR n % 5 = 2 AND c.id % 3 = 1 AND c.id % 2 = 1 OR n % 5 = 3 OR n % 5 = 4 AND c.id % 3 = 1 AND c.id % 2 = 0"""


def hint_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir, 12)
    hints = rows.where("rank in (2, 5)").select("query_id", "book_id", (F.col("root") + 1).alias("root"))
    hinted = search.ranked(chapters.hinted_sections(hints, fixture_texts(spark, sf_dir), rows.where("rank = 5").select("query_id", (F.col("root") + 1).alias("root"))), "similarity")
    return long(chapters.fused_with_hints(rows.select("query_id", "id", "rank", "similarity"), hinted), "place")


HINT_FUSION = f"""{TOP}, r AS (SELECT * FROM rows WHERE rank <= 12), hints AS (SELECT DISTINCT query_id, book_id, root + 1 AS root FROM r WHERE rank IN (2, 5) AND (query_id, root) NOT IN (SELECT query_id, root FROM r WHERE rank = 5)
), hinted AS (SELECT query_id, c.id, row_number() OVER (PARTITION BY query_id ORDER BY c.id) AS rank FROM hints JOIN chunks c USING (book_id, root)
), fused AS (SELECT query_id, id, max(h) AS h, round(sum(s), 9) AS score FROM (SELECT query_id, id, NULL AS h, 0.6::DOUBLE / (60 + rank) AS s FROM r UNION ALL SELECT query_id, id, rank, 0.4::DOUBLE / (60 + rank) FROM hinted) GROUP BY 1, 2)
SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.id) AS place, CASE WHEN h IS NOT NULL THEN round(greatest(coalesce(similarity, 0), 0.85::DOUBLE) + 0.15::DOUBLE, 6) ELSE coalesce(similarity, 0) END AS similarity
FROM fused f LEFT JOIN r ON r.query_id = f.query_id AND r.id = f.id"""


def filled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    first = rows.where("rank = 1 or rank <= 4 and query_id % 200 = 0")
    return chapters.thin_filled(first, rows.where("rank between 8 and 10"), rows.where("rank > 20"), least=4).select("query_id", "id")


FILLED_UP = f"""{TOP} SELECT query_id, id FROM rows WHERE rank = 1 OR rank <= 4 AND query_id % 200 = 0 OR query_id % 200 != 0 AND rank BETWEEN 8 AND 10"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near(spark, sf_dir)
    queries = rows.select("query_id", F.when(F.col("query_id") % 200 == 0, "all").otherwise("some").alias("topic")).distinct()
    clashes = rows.where("query_id % 200 = 0 or rank % 2 = 0").select(F.when(F.col("query_id") % 200 == 0, "all").otherwise("some").alias("topic"), "book_id", "root").distinct()
    return chapters.collisions_dropped(rows, queries, clashes).select("query_id", "id")


COLLISIONS = f"""{TOP}, clashes AS (SELECT DISTINCT query_id % 200 AS topic, book_id, root FROM rows WHERE query_id % 200 = 0 OR rank % 2 = 0)
, marked AS (SELECT r.*, (query_id % 200, book_id, root) IN (SELECT topic, book_id, root FROM clashes) AS bad FROM rows r) SELECT query_id, id FROM marked QUALIFY NOT bad OR bool_and(bad) OVER (PARTITION BY query_id)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("book"), F.col("l_linenumber").alias("batch"), F.when(F.col("l_quantity") < 10, F.col("l_linestatus")).alias("kind"), (F.col("l_quantity") >= 10).alias("passed"))
    return evaluation.question_stats(results)


STATS = """WITH r AS (SELECT l_returnflag AS book, l_linenumber AS batch, CASE WHEN l_quantity < 10 THEN l_linestatus END AS kind, l_quantity >= 10 AS passed FROM lineitem)
SELECT 'book' AS by, book AS value, count(*) AS n, count(*) FILTER (passed) AS passed FROM r GROUP BY 2 UNION ALL SELECT 'batch', batch::VARCHAR, count(*), count(*) FILTER (passed) FROM r GROUP BY batch
UNION ALL SELECT 'kind', kind, count(*), count(*) FILTER (passed) FROM r WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'all', NULL, count(*), count(*) FILTER (passed) FROM r"""


def slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") * 100).cast("long").alias("most")).distinct()
    return evaluation.slab_bounds(sizes, ["brand"]).select("brand", "most", F.col("least").cast("long").alias("least"))


SLABS = "SELECT brand, most, coalesce(lag(most) OVER (PARTITION BY brand ORDER BY most) + 1, 0)::BIGINT AS least FROM (SELECT DISTINCT p_brand AS brand, (p_size * 100)::BIGINT AS most FROM part)"


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.catalogue(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, "customer#0000001", ["c_name"]).select("c_custkey")


DIRECTORY = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), 'customer#0000001')"


def hints_by_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    asked = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.transform(F.split("p_name", " "), lambda w: F.lower(w)).alias("tokens"))
    found = analysis.vocabulary_hints(asked, terms, 5, ["core"])
    return found.select("query_id", F.array_join("hints", "|").alias("hints"))


HINTS_BY_VOCABULARY = """WITH asked AS (SELECT p_partkey AS query_id, list_transform(string_split(p_name, ' '), lambda w: lower(w)) AS tokens FROM part WHERE p_partkey % 100 = 0
), terms AS (SELECT DISTINCT p_name AS term FROM part
), pairs AS (SELECT query_id, term, list_sum(list_transform(tokens, lambda t: CASE WHEN contains(term, t) OR contains(t, term) THEN 3 ELSE 0 END + CASE WHEN contains(lower(term), t) THEN 2 ELSE 0 END)) AS score FROM asked, terms
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(term), term) AS n FROM pairs WHERE score > 0 QUALIFY n <= 5
), picked AS (SELECT query_id, list(term ORDER BY n) AS own FROM best GROUP BY 1)
SELECT query_id, array_to_string(CASE WHEN len(own) < 5 THEN list_append(own, 'core') ELSE own END, '|') AS hints FROM picked"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs of a question bank: sections are numbers of the turn, sources come from the speaker."""
    turns = table(spark, sf_dir, "conversations")
    source = lambda file, label: F.struct(F.lit(file).alias("filename"), label.alias("label"))
    runs = turns.select(
        "conv_id", "turn", F.lit("odd").alias("book"), F.array((F.col("turn") % 3).cast("string")).alias("sections"), F.lit(None).cast("string").alias("subsection"), F.concat(F.lit("see दफा "), (F.col("turn") % 2).cast("string")).alias("answer"),
        F.when(F.col("conv_id") % 5 > 0, "advocate").alias("mode"),
        F.when(F.col("conv_id") % 4 == 0, F.array(source("file 1", F.concat((F.col("conv_id") % 3).cast("string"), F.lit(".1"))))).when(F.col("conv_id") % 4 == 1, F.array(source("file 2", F.lit("2")))).otherwise(F.array().cast("array<struct<filename:string,label:string>>")).alias("sources"),
    )
    return evaluation.judged(runs, BOOKS, ["odd"]).select("conv_id", "turn", F.array_join("failures", ", ").alias("failures"), "passed")


JUDGED = """WITH runs AS (SELECT conv_id, turn, turn % 3 AS want, turn % 2 AS said, CASE conv_id % 4 WHEN 0 THEN conv_id % 3 WHEN 1 THEN 2 END AS src FROM conversations
), tests AS (SELECT conv_id, turn, concat_ws(', ', CASE WHEN conv_id % 5 = 0 THEN 'mode' END, CASE WHEN want != said AND want IS DISTINCT FROM src THEN 'section' END, CASE WHEN conv_id % 4 = 1 THEN 'wrong book' END, CASE WHEN conv_id % 4 > 1 THEN 'no sources' END) AS failures FROM runs)
SELECT *, failures = '' AS passed FROM tests"""

QUERIES = {
    "book_scope": (book_scopes, BOOK_SCOPES),
    "section_stitch": (stitched, STITCHED),
    "label_best": (best_labels, BEST_LABELS),
    "part_best": (best_parts, BEST_PARTS),
    "provision_quality": (quality, QUALITY),
    "usable_chunks": (usable, USABLE),
    "multi_query": (multi_query, MULTI_QUERY),
    "target_chapters": (targets, TARGETS),
    "chapter_keyword_leg": (leg, LEG),
    "structured_reference": (references, REFERENCES),
    "hint_fusion": (hint_fusion, HINT_FUSION),
    "thin_fill": (filled_up, FILLED_UP),
    "topic_collisions": (collisions, COLLISIONS),
    "question_stats": (stats, STATS),
    "slab_bounds": (slabs, SLABS),
    "catalogue_filter": (directory, DIRECTORY),
    "vocabulary_hints": (hints_by_vocabulary, HINTS_BY_VOCABULARY),
    "run_judgement": (judged, JUDGED),
}
