"""Labels, query reading, section texts, order of parts, catalogues and calendar days on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, labels, spelling, text
from ..operators import analysis, assembly, calendar, chapters, chunking, continuation, evaluation, ingest, outline, routing, search
from ..sources import tables
from ..sources.tables import CHUNKS_SQL, STATUTES_SQL, fixture_chunks, fixture_texts, statute_chunks, table
from .sections import TOP, long, near
from .texts import title_score_sql

_DEV = "translate({0}, '0123456789', '०१२३४५६७८९')"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with titles, subsections and clauses that some lack: as citations, keys and what is embedded."""
    rows = fixture_chunks(spark, sf_dir)
    n = F.col("id")
    title, sub, clause = F.when(n % 3 > 0, F.substring("section_title", 1, 20)).otherwise(" "), F.when(n % 2 == 0, (n % 7).cast("string")), F.when(n % 4 == 0, "ख").when(n % 4 == 1, "")
    section, number = F.when(n % 5 > 0, F.col("root")), F.when(n % 6 > 0, F.col("parichhed_no"))
    body = F.substring("content", 1, 50)
    context = F.array(F.col("book_id"), F.lit(" "), F.when(n % 8 > 0, F.col("chapter")))
    return rows.select(
        "id", labels.citation_block(F.col("book_id"), number, F.col("filename"), section, title, sub, clause).alias("block"), labels.citation_inline(F.col("book_id"), section, sub, clause).alias("inline"),
        labels.section_slug(section, sub, clause).alias("slug"), labels.chapter_key(F.col("filename"), number).alias("chapter_key"), labels.embed_text(F.when(n % 9 > 0, context).otherwise(F.array(F.lit(" "))), body).alias("embedded"),
        labels.embed_query(title, F.when(n % 3 == 1, F.col("book_id")), F.when(n % 2 == 1, " intent "), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), 40).alias("asked"),
        labels.display_content({"पुस्तक": F.col("book_id"), "खण्ड": clause}, body).alias("shown"), F.round(text.devanagari_ratio(F.concat(F.lit("कख"), body)), 6).alias("deva"),
    )


CITATIONS = f"""WITH {CHUNKS_SQL}, r AS (SELECT *, CASE WHEN id % 3 > 0 THEN substring(section_title, 1, 20) ELSE ' ' END AS title, CASE WHEN id % 2 = 0 THEN (id % 7)::VARCHAR END AS sub, CASE id % 4 WHEN 0 THEN 'ख' WHEN 1 THEN '' END AS clause,
  CASE WHEN id % 5 > 0 THEN root END AS section, CASE WHEN id % 6 > 0 THEN parichhed_no END AS number, substring(content, 1, 50) AS body FROM chunks)
SELECT id, concat_ws(chr(10), 'पुस्तक : ' || book_id, 'परिच्छेद नं : ' || {_DEV.format("number::VARCHAR")}, 'परिच्छेद नाम : ' || filename, 'दफा : ' || trim({_DEV.format("section::VARCHAR")} || coalesce(' — ' || nullif(trim(title), ''), '')), 'उपदफा : ' || sub, 'खण्ड : ' || nullif(clause, '')) AS block,
  concat_ws(', ', book_id, 'दफा ' || {_DEV.format("section::VARCHAR")}, 'उपदफा ' || sub, 'खण्ड ' || nullif(clause, '')) AS inline, concat_ws('_', 'sec', section::VARCHAR, 'sub_' || sub, CASE WHEN clause = 'ख' THEN 'kha' END) AS slug, filename || '|' || number AS chapter_key,
  CASE WHEN id % 9 > 0 THEN '[' || book_id || CASE WHEN id % 8 > 0 THEN ' - ' || chapter ELSE '' END || ']: ' || body ELSE body END AS embedded,
  substring(concat_ws(' ', CASE WHEN id % 3 = 1 THEN '[' || book_id || ']' END, CASE WHEN id % 2 = 1 THEN 'intent' END, trim(title), 'a b c'), 1, 40) AS asked,
  concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'पुस्तक : ' || book_id, 'खण्ड : ' || nullif(clause, '')), body) AS shown, round(2 / (length(body) + 2), 6) AS deva FROM r"""

#: What is asked, by the remainder of the id.
SAID = ("Dafa 12 ko UPADAFA (3) kha", "के हो? कर, दण्ड , ", "दफा १२ र section 7 sec_7 dafa5", "सजाय कति हुन्छ? होला", "Section 5 ma bhag 2?! a, b", "कति")
TOPIC_RULES = (("सजाय|कैद", "penal"), ("[Dd]afa|दफा", "civil"), ("कति", "count"))


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of several kinds with titles behind them: scripts, words of references, keywords, numbers, topics and classes."""
    rows = fixture_chunks(spark, sf_dir)
    said = F.concat(F.get(F.array(*map(F.lit, SAID)), (F.col("id") % len(SAID)).cast("int")), F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), F.substring("section_title", 1, 15))).otherwise(""))
    q = F.col("q")
    cut, script = labels.split_query(q), labels.scripts_of(q)
    values = F.array(F.lit("१२.3"), F.col("section_label"), F.lit("x"), F.lit("0"), F.lit("12"))
    every = [("कति", ["how many"]), ("सजाय", ["penalty", "how many"]), ("[Ss]ection", ["english"])]
    classes = labels.classified(q, {"penal": "सजाय|कैद", "list": ","})
    list_ = lambda c: F.array_join(c.cast("array<string>"), "|")
    words = F.split(q, " ")
    return rows.select("id", said.alias("q"), "section_label").select(
        "id", script["script"].alias("script"), script["needs_spelling"].alias("spell"), spelling.reference_words(q).alias("words"), cut["question"].alias("question"), list_(cut["keywords"]).alias("keywords"), list_(labels.numbers_in(values, 2)).alias("numbers"),
        list_(labels.cited_sections(values, q)).alias("cited"), labels.first_rule(q, TOPIC_RULES, "none").alias("topic"), list_(labels.all_rules(q, every)).alias("extra"), classes["penal"].alias("penal"), classes["list"].alias("listed"),
        list_(analysis.phrases_within(words, 4, 8, 2)).alias("phrases"), list_(analysis.united(words, F.array(F.lit("a"), F.lit("कति")), most=3)).alias("united"), analysis.contains_any(F.array(F.lit("KO"), F.lit("x")), q, F.col("section_label")).alias("has"),
        analysis.related_enough((F.col("id") % 100) / 100).alias("related"), list_(evaluation.number_lists(values)).alias("three"), list_(analysis.vocabulary_tokens(q, F.create_map(F.lit("ko"), F.lit("को")))).alias("tokens"), cleaning.less_latin(q, F.lit("abc abc")).alias("less"),
    )


_NUMS = "list_filter([12, split_part(section_label, '.', 1)::INT, 12], lambda x: x > 0)"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in spelling.REFERENCE_WORDS.items()) + "}"
READING = f"""WITH {CHUNKS_SQL}, r AS (SELECT id, section_label, {list(SAID)}[id % {len(SAID)} + 1] || CASE WHEN id % 4 = 0 THEN ' ' || substring(section_title, 1, 15) ELSE '' END AS q FROM chunks
), counted AS (SELECT *, len(regexp_extract_all(q, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(q, '[A-Za-z]')) AS l, regexp_extract(trim(q), '^.+?[?।]\\s+(.+)$', 1) AS tail, {_NUMS} AS nums FROM r
), cut AS (SELECT *, list_filter(list_transform(regexp_split_to_array(tail, '[,，]'), lambda w: trim(w)), lambda w: w != '') AS k, list_concat(nums, list_transform(regexp_extract_all(q, 'दफा\\s*([0-9०-९]+)', 1), lambda n: translate(n, '०१२३४५६७८९', '0123456789')::INT)) AS c,
  list_concat(regexp_extract_all(lower(q), '[a-z]{{2,}}'), list_filter(regexp_extract_all(q, '[ऀ-ॿ]+'), lambda w: length(w) >= 2), list_filter(list_transform(regexp_extract_all(lower(q), '[a-z]{{2,}}'), lambda w: CASE WHEN w = 'ko' THEN 'को' END), lambda w: w IS NOT NULL)) AS t,
  list_filter(string_split(q, ' '), lambda w: length(w) BETWEEN 4 AND 8) AS p, list_concat(string_split(q, ' '), ['a', 'कति']) AS u FROM counted
), said AS (SELECT *, contains(tail, ',') AND len(k) > 0 AS listed_ FROM cut)
SELECT id, CASE WHEN d >= 4 AND l = 0 THEN 'devanagari' WHEN d >= 4 THEN 'mixed' WHEN l > 0 THEN 'latin' ELSE 'none' END AS script, regexp_matches(q, '[A-Za-z]{{3,}}') AS spell,
  array_to_string(list_transform(regexp_extract_all(q, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+'), lambda x: coalesce({_WORDS}[lower(x)], x)), '') AS words,
  CASE WHEN listed_ THEN regexp_extract(trim(q), '^(.+?[?।])\\s+.+$', 1) ELSE trim(q) END AS question, CASE WHEN listed_ THEN array_to_string(k, '|') ELSE '' END AS keywords, array_to_string({_ONCE.format("nums")}[1:2], '|') AS numbers, array_to_string({_ONCE.format("c")}, '|') AS cited,
  CASE WHEN regexp_matches(q, 'सजाय|कैद') THEN 'penal' WHEN regexp_matches(q, '[Dd]afa|दफा') THEN 'civil' WHEN contains(q, 'कति') THEN 'count' ELSE 'none' END AS topic,
  concat_ws('|', CASE WHEN contains(q, 'कति') OR contains(q, 'सजाय') THEN CASE WHEN contains(q, 'कति') THEN concat_ws('|', 'how many', CASE WHEN contains(q, 'सजाय') THEN 'penalty' END) ELSE 'penalty|how many' END END, CASE WHEN regexp_matches(q, '[Ss]ection') THEN 'english' END) AS extra,
  regexp_matches(q, 'सजाय|कैद') AS penal, contains(q, ',') AS listed, array_to_string({_ONCE.format("p")}[1:2], '|') AS phrases, array_to_string({_ONCE.format("u")}[1:3], '|') AS united, contains(lower(q), 'ko') OR contains(lower(q), 'x') AS has, id % 100 >= 70 AS related,
  array_to_string({_ONCE.format("nums")}[1:3], '|') AS three, array_to_string({_ONCE.format("t")}, '|') AS tokens, CASE WHEN l > 6 THEN 'abc abc' ELSE q END AS less FROM said"""


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes with heads and marks: their subsections, ends, numbers, paths, fields and roles."""
    rows = statute_chunks(spark, sf_dir).withColumn("role", F.when(F.col("id") % 9 == 0, "hadamyad"))
    marked = F.concat(F.lit("पहिलो (1) एक "), F.substring("content", 1, 12), F.lit(" (२) दुई\nफेरि (3) तीन. 7. अर्को दफा"))
    numbered = F.concat(F.lit("परिच्छेद 3, दफा "), F.col("root"), F.lit(" p.12 दफा7\n"), F.col("root"), F.lit(".5. पाठ 8."))
    path = outline.path_of(F.concat(F.lit("[दफा]: शीर्षक -> (१) -> (ग) "), F.col("section_title")))
    paths = F.when(F.col("id") % 3 == 0, path).when(F.col("id") % 3 == 1, F.slice(path, 2, 1)).otherwise(F.array().cast("array<string>"))
    found = assembly.enriched(rows.withColumn("page", F.when(F.col("id") % 2 == 0, F.col("page"))).withColumn("chapter", F.lit(None).cast("string")).withColumn("section_title", F.lit(None).cast("string")))
    pages = rows.select("book_id", F.col("root").cast("string").alias("root"), (F.col("root") % 50).alias("page")).where("root % 3 = 0").distinct()
    paged = assembly.with_pages(found, pages)
    return paged.select(
        "id", labels.subsection_text(marked, F.lit(2)).alias("second"), labels.subsection_text(marked, F.lit(9)).alias("ninth"), labels.without_next_section(marked).alias("cut"), spelling.with_devanagari_numbers(numbered).alias("numbers"), cleaning.legal_numerals(F.concat(F.lit("dafa 12 Section५ "), F.col("root"))).alias("numerals"),
        outline.part_order(paths).cast("long").alias("place"), outline.marker_kind(F.coalesce(F.get(paths, F.size(paths) - 1), F.lit(""))).alias("kind"), labels.breadcrumb_key(F.transform(paths, lambda p: F.regexp_replace(p, "[()]", ""))).cast("long").alias("key"),
        F.col("page").cast("long").alias("page"), "section_label", "section_title", "chapter", chapters.is_limitation(F.col("role"), F.lit("शीर्षक"), F.when(F.col("id") % 5 == 0, "हदम्याद\nपाठ").otherwise("पाठ\nहदम्याद")).alias("limits"),
        assembly.is_contaminated(F.col("section_title"), F.col("content"), "व्यवस्था", "म्झनु").alias("mixed"),
    )


SECTION_TEXTS = f"""WITH {CHUNKS_SQL}, {STATUTES_SQL}, r AS (SELECT *, split_part(content, chr(10) || chr(10), 1) AS head, id % 3 < 2 AS has_head FROM statutes
), t AS (SELECT *, CASE WHEN has_head THEN trim(regexp_extract(head, '(?m)^दफा: (.+)$', 1)) END AS dafa FROM r
), maps AS (SELECT DISTINCT book_id, root, root % 50 AS p FROM r WHERE root % 3 = 0)
SELECT id, '(२) दुई' || chr(10) || 'फेरि' AS second, NULL::VARCHAR AS ninth, 'पहिलो (1) एक ' || substring(content, 1, 12) || ' (२) दुई' || chr(10) || 'फेरि (3) तीन' AS cut,
  'परिच्छेद ३, दफा ' || {_DEV.format("r.root::VARCHAR")} || ' p.१२ दफा7' || chr(10) || {_DEV.format("r.root::VARCHAR")} || '.५. पाठ 8.' AS numbers, 'दफा १२ दफा ५ ' || r.root AS numerals,
  CASE id % 3 WHEN 0 THEN 10003 WHEN 1 THEN 3 ELSE 999999 END::BIGINT AS place, CASE WHEN id % 3 < 2 THEN 'khanda' ELSE 'dafa' END AS kind, CASE WHEN id % 3 < 2 THEN 103 ELSE 0 END::BIGINT AS key,
  coalesce(CASE WHEN id % 2 = 0 THEN page END, nullif(regexp_extract(content, '\\[PAGE:(\\d+)\\]', 1), '')::INT, m.p)::BIGINT AS page,
  coalesce(section_label, nullif(translate(regexp_extract(dafa, '^\\s*([0-9०-९.]+)', 1), '०१२३४५६७८९', '0123456789'), '')) AS section_label, nullif(regexp_extract(dafa, '—\\s*(.+)$', 1), '') AS section_title, nullif(trim(regexp_extract(CASE WHEN has_head THEN head END, '(?m)^\\s*परिच्छेद\\s*:\\s*(.+)$', 1)), '') AS chapter,
  id % 9 = 0 OR id % 5 = 0 AS limits, coalesce(contains(nullif(regexp_extract(dafa, '—\\s*(.+)$', 1), ''), 'व्यवस्था'), false) AND contains(content, 'म्झनु') AS mixed
FROM t r LEFT JOIN maps m ON m.book_id = r.book_id AND m.root = r.root"""


def order_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's nearest chunks in the order of their marks, hinted ones first, and as lines."""
    rows = near(spark, sf_dir).withColumn("root", F.col("root") % 4)
    paths = F.array(*(F.array(*map(F.lit, p)).cast("array<string>") for p in ((), ("१",), ("२", "क"), ("ख",), ("३", "ग"))))
    rows = rows.withColumns({"path": F.get(paths, (F.col("id") % 5).cast("int")), "text": F.when(F.col("id") % 7 == 0, "तर यो होइन").otherwise(" कुरा ")})
    shown = assembly.displayed_part(F.transform("path", lambda m: F.concat(F.lit("("), m, F.lit(")"))), F.col("text"))
    read = assembly.in_section_order(rows, F.col("path")).withColumnRenamed("place", "reading")
    hinted = assembly.hinted_order(read, F.col("id") % 6 == 0)
    return long(hinted.select("query_id", "id", "reading", "place", shown["kind"].alias("kind"), shown["line"].alias("line")), "reading", "place")


ORDER_OF_PARTS = f"""{TOP}, r AS (SELECT * REPLACE (root % 4 AS root), [0, 501, 511, 102, 953][id % 5 + 1] AS k FROM rows)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id, filename, root ORDER BY k, id) AS reading, row_number() OVER (PARTITION BY query_id ORDER BY (id % 6 = 0) DESC, split_part(section_label, '.', 1)::INT, similarity DESC, id) AS place,
  CASE WHEN id % 7 = 0 THEN 'proviso' ELSE ['introduction', 'subsection', 'clause', 'clause', 'clause'][id % 5 + 1] END AS kind, CASE WHEN id % 7 = 0 THEN 'तर यो होइन' ELSE ['', '(१) ', '  (क) ', '(ख) ', '  (ग) '][id % 5 + 1] || 'कुरा' END AS line FROM r"""


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a model: each query's three nearest chunks under their labels."""
    found = assembly.extractive_answers(near(spark, sf_dir, 5), labels.source_label(F.col("book_id"), F.col("chapter"), F.lit(None).cast("string"), F.col("section_label")), F.substring("content", 1, 30))
    return found.withColumn("answer", F.md5("answer"))


EXTRACTS = f"""{TOP} SELECT query_id, md5(string_agg('[' || rank || '] ' || book_id || ' · ' || chapter || ' · दफा ' || {_DEV.format("section_label")} || chr(10) || substring(content, 1, 30), chr(10) || chr(10) ORDER BY rank)) AS answer FROM rows WHERE rank <= 3 GROUP BY 1"""


def chapter_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening sections of target books, sections of target chapters whose titles fit, and titles that override hints."""
    rows, chunks = near(spark, sf_dir, 6), fixture_texts(spark, sf_dir)
    targets = rows.where("rank <= 2").select("query_id", "book_id", "chapter").distinct()
    queries = rows.where("rank = 1").select("query_id", F.substring("section_title", 1, 16).alias("text"))
    opening = chapters.opening_sections(targets, chunks)
    titled = chapters.expanded_by_title(rows.where("rank < 4"), queries, chunks, targets)
    hints = rows.where("rank in (3, 4)").select("query_id", "book_id", "root")
    scored = rows.select("query_id", "book_id", "root", F.when((F.col("query_id") % 200 == 0) & (F.col("rank") == 5), 0.95).otherwise(0.5).alias("score"))
    over = chapters.title_override(hints, scored)
    prepared = chapters.prepared_hints(rows.where("rank in (3, 4)"), rows.where("rank = 1"))
    pick = lambda df, why, root: df.select("query_id", F.col(root).cast("long").alias("what"), F.lit(why).alias("why"), F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double").alias("similarity"))
    return pick(opening, "opening", "id").unionByName(pick(titled, "titled", "id")).unionByName(pick(over, "override", "root")).unionByName(pick(prepared, "prepared", "id"))


CHAPTER_CONTEXT = f"""{TOP}, r AS (SELECT * FROM rows WHERE rank <= 6), targets AS (SELECT DISTINCT query_id, book_id, chapter FROM r WHERE rank <= 2
), pairs AS (SELECT t.query_id, c.id, trim(regexp_replace(regexp_replace(substring(r.section_title, 1, 16), '[ः:।]', '', 'g'), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(regexp_replace(c.section_title, '[ः:।]', '', 'g'), '\\s+', ' ', 'g')) AS t
  FROM targets t JOIN chunks c USING (book_id, chapter) JOIN r ON r.query_id = t.query_id AND r.rank = 1), {title_score_sql("pairs", "scored")}
, new AS (SELECT query_id, id FROM scored s WHERE round(score + 1e-9::DOUBLE, 6) >= 0.12 AND (query_id, id) NOT IN (SELECT query_id, id FROM r WHERE rank < 4) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score + 1e-9::DOUBLE, 6) DESC, id) <= 6)
SELECT query_id, c.id AS what, 'opening' AS why, 0.36::DOUBLE AS similarity FROM (SELECT DISTINCT query_id, book_id FROM targets) JOIN chunks c USING (book_id) WHERE parichhed_no = 1 AND root BETWEEN 1 AND 3
UNION ALL SELECT query_id, id, 'titled', similarity FROM r WHERE rank < 4 UNION ALL SELECT query_id, id, 'titled', 0.86 FROM new
UNION ALL SELECT DISTINCT query_id, root, 'override', NULL FROM r WHERE CASE WHEN query_id % 200 = 0 THEN rank = 5 ELSE rank IN (3, 4) END
UNION ALL SELECT a.query_id, arg_max(a.id, (a.similarity, -a.id)), 'prepared', greatest(max(a.similarity), any_value(b.similarity)) FROM r a JOIN r b ON a.query_id = b.query_id AND b.rank = 1 WHERE a.rank IN (3, 4) GROUP BY a.query_id, a.filename, a.root"""


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a law's list of sections, and the sections that names, lines and guesses mean."""
    chunks = fixture_texts(spark, sf_dir)
    lines = chunks.select("book_id", F.concat(F.when(F.col("id") % 7 > 0, F.concat(F.col("id").cast("string"), F.lit(". "))).otherwise(""), F.regexp_replace(F.substring("content", 1, 130), r"[\n0-9]", " "), F.when(F.col("id") % 3 == 0, "ः पाठ").otherwise("")).alias("line"))
    known = analysis.taxonomy_lines(lines)
    some = chunks.where("id % 20 = 1").select(F.floor(F.col("id") / 60).alias("query_id"), F.col("id").alias("place"), "book_id", F.col("id").cast("int").alias("root"))
    named = some.join(known, ["book_id", "root"]).select("query_id", "place", "book_id", "root", F.when(F.col("place") % 40 == 1, F.col("title")).otherwise(F.concat(F.lit("दफा "), F.col("root").cast("string"), F.lit(". no title"))).alias("name"))
    by_name = analysis.sections_by_name(named, known).select("query_id", F.array_join(F.col("roots").cast("array<string>"), ",").alias("found"), F.lit("names").alias("by"))
    owner = analysis.owning_book(named.select("query_id", F.col("name").alias("line")), known).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("book_id")), ",").alias("found")).withColumn("by", F.lit("books"))
    guesses = named.select("query_id", "place", "book_id", F.when(F.col("root") % 3 == 0, -1).otherwise(F.col("root")).alias("root"))
    owned = analysis.owned_sections(guesses, known).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: x["root"].cast("string")), ",").alias("found")).withColumn("by", F.lit("guesses"))
    words = analysis.vocabulary(chunks).agg(F.count("*").cast("string").alias("found")).select(F.lit(-1).cast("long").alias("query_id"), "found", F.lit("vocabulary").alias("by"))
    return by_name.unionByName(owner.select("query_id", "found", "by")).unionByName(owned.select("query_id", "found", "by")).unionByName(words)


TAXONOMY = f"""WITH {CHUNKS_SQL}, lines AS (SELECT book_id, id::INT AS root, id, trim(regexp_replace(substring(content, 1, 130), '[\\n0-9]', ' ', 'g') || CASE WHEN id % 3 = 0 THEN 'ः पाठ' ELSE '' END, ' ') AS raw FROM chunks
), known AS (SELECT book_id, root, id, trim(CASE WHEN instr(raw, 'ः') > 1 AND instr(raw, 'ः') < 160 THEN substring(raw, 1, instr(raw, 'ः')) WHEN length(raw) > 117 THEN substring(raw, 1, 116) || '…' ELSE raw END, ' ') AS title FROM lines WHERE id % 7 > 0 AND raw != ''
), keyed AS (SELECT *, lower(trim(regexp_replace(regexp_replace(title, '[ः:।]', '', 'g'), '\\s+', ' ', 'g'))) AS k FROM known
), some AS (SELECT id // 60 AS query_id, id AS place, k.book_id, k.root, CASE WHEN id % 40 = 1 THEN k ELSE 'no title' END AS k, id % 40 = 1 AS titled FROM keyed k WHERE id % 20 = 1
), first_root AS (SELECT k, min(root) AS known, min(book_id) AS book FROM keyed GROUP BY 1
), found AS (SELECT query_id, place, coalesce(f.known, CASE WHEN NOT titled THEN s.root END) AS root, book FROM some s LEFT JOIN first_root f USING (k)
), once AS (SELECT query_id, root, min(place) AS place FROM found WHERE root IS NOT NULL GROUP BY 1, 2), best AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 3
), owned AS (SELECT query_id, place, root FROM some WHERE root % 3 != 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, root) <= 3
), vocabulary AS (SELECT trim(section_title, ' ') AS term FROM chunks WHERE length(trim(section_title, ' ')) BETWEEN 4 AND 120 UNION SELECT chapter FROM chunks WHERE length(chapter) BETWEEN 4 AND 80)
SELECT query_id, string_agg(root, ',' ORDER BY place) AS found, 'names' AS by FROM best GROUP BY 1 UNION ALL SELECT query_id, coalesce(string_agg(book, ',' ORDER BY book), ''), 'books' FROM found GROUP BY 1
UNION ALL SELECT query_id, string_agg(root, ',' ORDER BY place), 'guesses' FROM owned GROUP BY 1 UNION ALL SELECT -1, count(*)::VARCHAR, 'vocabulary' FROM vocabulary""".replace("), some AS", "), chosen AS").replace("FROM some ", "FROM chosen ")


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, guessed numbers and claimed books of queries made from every twentieth document's title, on one answer."""
    chunks = fixture_texts(spark, sf_dir)
    known = chunks.select("book_id", F.col("id").cast("int").alias("root"), F.substring("section_title", 1, 30).alias("title"))
    some = chunks.where("id % 20 = 3").withColumns({"query_id": F.floor(F.col("id") / 60), "place": (F.col("id") / 20 % 3 + 1).cast("int")})
    names = some.select("query_id", "place", F.when(F.col("query_id") % 4 == 3, "zz qq").otherwise(F.substring("section_title", 1, 18)).alias("name"))
    guesses = some.select("query_id", "place", F.when(F.col("place") == 2, 999_999).otherwise(F.col("id")).cast("int").alias("root"))
    claims = some.where("place = 1").select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("book_id")).alias("book_id"))
    found = routing.reconciled_hints(names, guesses, claims, known)
    return found.select("query_id", "book_id", F.array_join(F.col("roots").cast("array<string>"), ",").alias("roots"), "confidence", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


_NORMAL = "trim(regexp_replace(regexp_replace({0}, '[ः:।]', '', 'g'), '\\s+', ' ', 'g'))"
HINTS = f"""WITH {CHUNKS_SQL}, known AS (SELECT book_id, id::INT AS root, {_NORMAL.format("substring(section_title, 1, 30)")} AS t FROM chunks
), chosen AS (SELECT *, id // 60 AS query_id, id // 20 % 3 + 1 AS place FROM chunks WHERE id % 20 = 3
), claims AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN book_id END AS claimed FROM chosen WHERE place = 1
), names AS (SELECT query_id, place, CASE WHEN query_id % 4 = 3 THEN 'zz qq' ELSE substring(section_title, 1, 18) END AS name FROM chosen
), pairs AS (SELECT n.query_id, n.place, n.name, {_NORMAL.format("n.name")} AS q, k.book_id, k.root, k.t, claimed FROM names n LEFT JOIN claims USING (query_id), known k), {title_score_sql("pairs", "graded")}
, met AS (SELECT * REPLACE (round(score + CASE WHEN nullif(regexp_extract(name, '([0-9]+)', 1), '')::INT = root THEN 0.3::DOUBLE ELSE 0 END + 1e-9::DOUBLE, 6) AS score) FROM graded
), found AS (SELECT * FROM met WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY query_id, place ORDER BY coalesce(book_id = claimed, false) DESC, score DESC, book_id, root) = 1
), inferred AS (SELECT query_id, book_id FROM (SELECT query_id, book_id, count(*) AS n, min(place) AS seen FROM found GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen) = 1
), book AS (SELECT q.query_id, coalesce(i.book_id, claimed) AS book_id FROM (SELECT DISTINCT query_id FROM chosen) q LEFT JOIN inferred i USING (query_id) LEFT JOIN claims USING (query_id)
), guesses AS (SELECT query_id, place, CASE WHEN place = 2 THEN 999999 ELSE id END::INT AS root FROM chosen
), named AS (SELECT query_id, list(root ORDER BY place) AS roots FROM (SELECT f.query_id, f.root, min(place) AS place FROM found f JOIN book b ON b.query_id = f.query_id AND b.book_id = f.book_id GROUP BY 1, 2) GROUP BY 1
), owned AS (SELECT g.query_id, list(g.root ORDER BY place) AS roots FROM guesses g JOIN book b USING (query_id) JOIN known k ON k.book_id = b.book_id AND k.root = g.root GROUP BY 1
), every AS (SELECT query_id, list(root ORDER BY place) AS roots FROM guesses GROUP BY 1), sure AS (SELECT query_id, min(score) AS confidence FROM found GROUP BY 1
), joined AS (SELECT b.query_id, b.book_id, coalesce(n.roots, o.roots, []) AS roots, coalesce(confidence, 0)::DOUBLE AS confidence, e.roots AS asked FROM book b LEFT JOIN named n USING (query_id) LEFT JOIN owned o USING (query_id) LEFT JOIN every e USING (query_id) LEFT JOIN sure USING (query_id))
SELECT query_id, book_id, array_to_string(roots, ',') AS roots, confidence, array_to_string(list_filter(asked, lambda r: NOT list_contains(roots, r)), ',') AS dropped FROM joined"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys as dates of the calendar: the month's days, whether there is such a day, and the nearest that there is."""
    dates = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9 + 2051).cast("int").alias("year"), (F.col("o_orderkey") % 14).cast("int").alias("month"), (F.col("o_orderkey") % 35).cast("int").alias("day"))
    found = calendar.with_days(dates, "year", "month", calendar.month_starts(calendar.fixed_months(spark)))
    near_ = calendar.clamped(F.col("year"), F.col("month"), F.col("day"), F.col("days"))
    return long(found.select("o_orderkey", "days", calendar.is_date(F.col("year"), F.col("month"), F.col("day"), F.col("days")).alias("is_date"), near_["month"].alias("month"), near_["day"].alias("day")), "days", "month", "day")


_DAYS = ", ".join(f"({year}, {month}, {n})" for year, all_days in calendar.MONTH_DAYS.items() for month, n in enumerate(all_days, 1))
DAYS = f"""WITH dates AS (SELECT o_orderkey, (o_orderkey % 9 + 2051)::INT AS y, (o_orderkey % 14)::INT AS m, (o_orderkey % 35)::INT AS d FROM orders), months(y, m, n) AS (VALUES {_DAYS})
SELECT o_orderkey, coalesce(n, 30)::BIGINT AS days, m BETWEEN 1 AND 12 AND d BETWEEN 1 AND coalesce(n, 30) AS is_date, greatest(1, least(12, m))::BIGINT AS month, greatest(1, least(coalesce(n, 30), d))::BIGINT AS day FROM dates LEFT JOIN months USING (y, m)"""


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as runs and periods: why they failed, whether their key is in the text, salaries, units and what cleaning changed."""
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") % 11)
    source = F.array(F.struct(F.lit("f").alias("filename"), F.when(F.col("k") % 2 == 0, "३").otherwise("44").alias("label")))
    none, one = F.array().cast("array<string>"), F.array(F.lit("1"))
    failures = F.when(F.col("k") == 2, F.array(F.lit("wrong book"))).when(F.col("k") == 3, F.array(F.lit("no sources"))).otherwise(one)
    kind = evaluation.failure_kind(F.col("k") != 0, F.col("k") != 1, failures, F.when(F.col("k") == 4, none).otherwise(one), F.when(F.col("k") < 6, one).otherwise(none), source)
    period = lambda m: F.struct(F.col("l_quantity").cast("double").alias("salary"), m.cast("int").alias("months"))
    income = evaluation.period_totals(F.array(period(F.col("l_linenumber")), period(F.lit(0))))
    units = evaluation.unit_rows({"a": F.col("l_quantity") - 25, "b": F.col("l_linenumber") - 2}, F.col("l_orderkey"))
    keyed = ["l_partkey", "l_suppkey"]
    questions = lines.select(*keyed).distinct().select(F.concat_ws("-", *keyed).alias("num"), *keyed, F.lit("b").alias("book"), F.array((F.col("l_partkey") % 40).cast("string"), (F.col("l_suppkey") % 7).cast("string")).alias("sections"))
    known = table(spark, sf_dir, "part").select(F.lit("b").alias("book"), (F.col("p_partkey") % 30).alias("root")).distinct()
    keys = evaluation.verified_keys(questions, known).select(*keyed, "verified")
    runs = lines.select("l_orderkey", "l_linenumber", *keyed, kind.alias("kind"), income["income"].alias("income"), income["months"].cast("long").alias("months"), F.array_join(F.transform(units, lambda u: u["unit"]), ",").alias("units"))
    return runs.join(keys, keyed).drop(*keyed).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


JUDGEMENTS = """WITH parts AS (SELECT DISTINCT p_partkey % 30 AS root FROM part), r AS (SELECT *, l_orderkey % 11 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE k WHEN 0 THEN 'book_key_error' WHEN 1 THEN 'normalize_blocked_chat' WHEN 2 THEN 'wrong_book' WHEN 3 THEN 'empty_retrieval' WHEN 4 THEN 'sources_ok_answer_missing_citation' ELSE CASE WHEN k % 2 = 0 THEN 'intro_or_early_section_trap' ELSE 'wrong_section_retrieval' END END AS kind,
  l_quantity::DOUBLE * (greatest(1, l_linenumber) + 1) AS income, greatest(1, l_linenumber) + 1::BIGINT AS months, concat_ws(',', CASE WHEN l_quantity > 25 THEN 'a' END, CASE WHEN l_linenumber > 2 THEN 'b' END) AS units,
  l_partkey % 40 IN (SELECT root FROM parts) AND l_suppkey % 7 IN (SELECT root FROM parts) AS verified FROM r"""


def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a category, entries with a meaning, what a cleaning changed, chunks of a rule's documents and without replaced ones, and whether there are vectors."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise(" ").alias("meaning"), F.col("p_brand").alias("category"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("number"))
    chunks = fixture_chunks(spark, sf_dir)
    ours = evaluation.category_entries(parts, text.slug(F.col("category")), "brand-11").agg(F.count("*").alias("n"), F.sum("number").cast("long").alias("m"))
    meant = evaluation.meant_entries(parts).select(F.col("entries").alias("n"), F.lit(None).cast("long").alias("m"))
    fixed = chunks.agg(*evaluation.change_counts(F.col("content"), cleaning.cleaned(F.regexp_replace("content", "[?!]", "")))).select(F.col("changed").alias("n"), F.col("removed").alias("m"))
    documents = chunks.select("filename").distinct().withColumn("rule", F.when(F.col("filename").rlike("[02468]$"), "even").otherwise("odd"))
    ruled = tables.chunks_of(chunks, documents, ["even", "none"]).agg(F.count("*").alias("n"), F.sum("id").alias("m"))
    left_docs, left_chunks = ingest.without_documents(documents, chunks, documents.where("rule = 'odd'"))
    left = left_chunks.agg(F.count("*").alias("m")).crossJoin(left_docs.agg(F.count("*").alias("n"))).select("n", "m")  # one row each
    vectors = spark.range(1).select(F.lit(evaluation.has_vectors(chunks)).cast("long").alias("n"), F.lit(evaluation.has_vectors(chunks.where("embedding is null"))).cast("long").alias("m"))
    named = {"category": ours, "meant": meant, "cleaned": fixed, "ruled": ruled, "left": left, "vectors": vectors}
    out = None
    for name, df in named.items():
        row = df.select(F.lit(name).alias("what"), "n", "m")
        out = row if out is None else out.unionByName(row)
    return out


CATALOGUES = f"""WITH {CHUNKS_SQL}, cleaned AS (SELECT content, trim(regexp_replace(regexp_replace(regexp_replace(content, '[?!]', '', 'g'), '([.।])\\s*(\\d+\\.)', '\\1 \\2', 'g'), '\\s+', ' ', 'g'), ' ') AS c FROM chunks)
SELECT 'category' AS what, count(*) AS n, sum(CASE WHEN p_size > 5 THEN p_size END)::BIGINT AS m FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 'meant', count(*), NULL FROM part WHERE p_size % 3 > 0 AND trim(p_type) != ''
UNION ALL SELECT 'cleaned', count(*) FILTER (content != c), sum(length(content) - length(c))::BIGINT FROM cleaned UNION ALL SELECT 'ruled', count(*), sum(id)::BIGINT FROM chunks WHERE regexp_matches(filename, '[02468]$')
UNION ALL SELECT 'left', count(DISTINCT filename), count(*) FROM chunks WHERE regexp_matches(filename, '[02468]$') UNION ALL SELECT 'vectors', 1, 0"""


def indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statutes, indented and parsed by depth: chunks by kind, and as rows to load."""
    line = lambda s, i: F.concat(F.lit(" । "), (i + 1).cast("string"), F.lit(". शीर्षकः "), s, F.lit(" । (१) पहिलो । (२) दोस्रो (क) खण्ड । (ख) अर्को ।"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", "[0-9.()]", ""), "\n").alias("lines")).select("doc_id", F.concat(F.lit("परिच्छेद–२ नाम"), F.array_join(F.transform("lines", line), "")).alias("text"))
    chunks = chunking.parse_indented(continuation.indented(docs))
    rows = ingest.ingest_rows(chunks, F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.lit("b"))
    return rows.groupBy("filename", F.get_json_object("metadata", "$.chunk_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("section_label").alias("sections"), F.max("chapter").alias("chapter"), F.max("subsection").alias("last"))


INDENTED = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL)
SELECT 'f' || doc_id AS filename, kind, k * times AS n, k AS sections, 'परिच्छेद २ — नाम ।' AS chapter, last FROM n, (VALUES ('dafa', 1, NULL), ('upadafa', 2, '(२)'), ('khanda', 2, '(२)')) x(kind, times, last)"""

QUERIES = {
    "citations": (citations, CITATIONS),
    "query_reading": (reading, READING),
    "section_texts": (section_texts, SECTION_TEXTS),
    "order_of_parts": (order_of_parts, ORDER_OF_PARTS),
    "extractive_answers": (extracts, EXTRACTS),
    "chapter_context": (chapter_context, CHAPTER_CONTEXT),
    "taxonomy_lines": (taxonomy, TAXONOMY),
    "reconciled_hints": (hints, HINTS),
    "calendar_days": (days, DAYS),
    "run_details": (judgements, JUDGEMENTS),
    "catalogues": (catalogues, CATALOGUES),
    "indented_statutes": (indented, INDENTED),
}
