"""Glossary, usage and evaluation queries on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import glossary, usage
from ..sources.tables import table


def entries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts and suppliers as two glossaries; Latin spellings have dots, some entries no meaning."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("term"), F.replace("p_brand", F.lit("#"), F.lit(".")).alias("roman"), F.col("p_type").alias("english"), F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_type")).alias("meaning")
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("term"), F.lit("").alias("roman"), F.lit(None).cast("string").alias("english"), F.lit("supplier").alias("meaning"))
    return {"parts": part, "suppliers": supplier}


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of fields of every part and supplier whose number is divisible by 100, as queries."""
    part = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    asked = part.select((F.col("p_partkey") * 4).alias("query_id"), F.substring("p_name", 1, 6).alias("query")).union(part.select(F.col("p_partkey") * 4 + 1, F.lower(F.substring("p_type", 3, 5))))
    return asked.union(part.select(F.col("p_partkey") * 4 + 2, F.substring("p_brand", 1, 4))).union(table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.col("s_suppkey").cast("long") * 4 + 3, F.substring("s_name", 1, 9)))


def glossary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = glossary.search(searches(spark, sf_dir), entries(spark, sf_dir), 10)
    return found.select("query_id", "term", "roman", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"), "total", "source")


ENTRIES_SQL = """entries AS (
  SELECT p_partkey AS id, 0 AS place, 'parts' AS source, p_name AS term, replace(p_brand, '#', '.') AS roman, p_type AS english, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_type END AS meaning FROM part
  UNION ALL SELECT s_suppkey, 1, 'suppliers', s_name, '', NULL, 'supplier' FROM supplier
), asked(query_id, query) AS (
  SELECT p_partkey * 4, substring(p_name, 1, 6) FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT p_partkey * 4 + 1, lower(substring(p_type, 3, 5)) FROM part WHERE p_partkey % 100 = 0
  UNION ALL SELECT p_partkey * 4 + 2, substring(p_brand, 1, 4) FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT s_suppkey * 4 + 3, substring(s_name, 1, 9) FROM supplier WHERE s_suppkey % 100 = 0
), fields AS (
  SELECT *, trim(term) AS f, trim(query) AS q, false AS sub FROM entries, asked UNION ALL SELECT *, lower(trim(replace(roman, '.', ''))), lower(trim(replace(query, '.', ''))), true FROM entries, asked
  UNION ALL SELECT *, coalesce(lower(trim(english)), ''), lower(trim(query)), true FROM entries, asked
), words AS (SELECT *, list_filter(regexp_split_to_array(f, '[/\\s,]+'), lambda w: starts_with(w, q))[1] AS w FROM fields
), graded AS (
  SELECT *, CASE WHEN f = '' OR q = '' THEN 0 WHEN f = q THEN 100 WHEN starts_with(f, q) THEN 90 WHEN w = q THEN 95 WHEN w IS NOT NULL THEN 85 WHEN contains(f, q) THEN 70
    WHEN sub AND length(q) >= 3 AND regexp_matches(f, array_to_string(list_transform(regexp_split_to_array(q, ''), lambda c: regexp_escape(c)), '.*')) THEN 45 ELSE 0 END AS g FROM words
), scored AS (SELECT query_id, place, source, id, term, roman, max(g)::BIGINT AS score FROM graded GROUP BY query_id, place, source, id, term, roman HAVING max(g) > 0)"""
GLOSSARY_SEARCH = f"""WITH {ENTRIES_SQL}, fetched AS (SELECT *, count(*) OVER (PARTITION BY query_id, source) AS total_of, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, term, roman) AS n FROM scored
), kept AS (SELECT *, CASE WHEN lower(trim(replace(roman, '.', ''))) != '' THEN lower(trim(replace(roman, '.', ''))) ELSE trim(term) END AS k FROM fetched WHERE n <= 50
), totals AS (SELECT query_id, sum(t)::BIGINT AS total FROM (SELECT DISTINCT query_id, source, total_of AS t FROM fetched) GROUP BY 1
), once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, place, term) = 1)
SELECT query_id, term, roman, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term, k) AS rank, total, source FROM once JOIN totals USING (query_id) QUALIFY rank <= 10"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.letter_counts(entries(spark, sf_dir)["parts"])


LETTERS = f"""WITH {ENTRIES_SQL} SELECT substring(trim(term), 1, 1) AS letter, count(*) AS n FROM entries WHERE source = 'parts' AND trim(meaning) != '' GROUP BY 1"""


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts and suppliers in Devanagari letters with signs and conjuncts, as one glossary: its last page but one for every letter, and a page far beyond the last."""
    every = [e.select("term", "roman", "english", "meaning") for e in entries(spark, sf_dir).values()]
    every = every[0].unionByName(every[1]).withColumn("term", F.concat(F.lit("क"), F.translate(F.lower("term"), LATIN, SIGNS))).distinct()
    columns = ["term", *(F.col(c).cast("long").alias(c) for c in ("page", "pages", "total"))]
    return glossary.browse(every, None, FAR, 30).select(columns).unionByName(glossary.browse(every, "क", 3, 30).select(columns))


#: A page beyond the last of any glossary.
FAR = 1 << 40
#: Letters, vowel signs and the sign that makes conjuncts, for Latin letters.
LATIN, SIGNS = "abcdefghijklmnopqrstuvwxyz#", "ाबचद्फगहिजकलमनंपखरसतुवथषयझट"
BROWSE = f"""WITH {{ENTRIES_SQL}}, named AS (SELECT DISTINCT 'क' || translate(lower(term), '{LATIN}', '{SIGNS}') AS term, roman, english, meaning FROM entries WHERE trim(meaning) != ''
), placed AS (SELECT term, row_number() OVER (ORDER BY term COLLATE ne, term, roman) - 1 AS i, count(*) OVER () AS total FROM named
), letters AS (SELECT term, row_number() OVER (ORDER BY term COLLATE ne, term, roman) - 1 AS i, count(*) OVER () AS total FROM named WHERE NOT starts_with(term, 'क्ष')
), paged AS (SELECT *, (total + 29) // 30 AS pages FROM placed), first_letter AS (SELECT *, (total + 29) // 30 AS pages FROM letters)
SELECT term, pages AS page, pages, total FROM paged WHERE i >= (pages - 1) * 30 UNION ALL SELECT term, least(3, pages), pages, total FROM first_letter WHERE i // 30 + 1 = least(3, pages)""".format(ENTRIES_SQL=ENTRIES_SQL)


def term_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.distinct_terms(list(entries(spark, sf_dir).values()))


TERM_COUNT = f"""WITH {ENTRIES_SQL} SELECT count(DISTINCT CASE WHEN lower(trim(replace(roman, '.', ''))) != '' THEN lower(trim(replace(roman, '.', ''))) ELSE trim(term) END) AS n_terms FROM entries WHERE trim(meaning) != ''"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entries of their regions: category, slug, count, and the entries in order."""
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",")
    return joined.groupBy(F.col("r_name").alias("category")).agg(F.count("*").alias("n"), listed.alias("entries")).withColumn("slug", text.slug(F.concat(F.col("category"), F.lit(" & Co."))))


CATEGORIES = """SELECT r_name AS category, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS entries,
  regexp_replace(regexp_replace(replace(lower(trim(r_name || ' & Co.')), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


def usage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records; purchases come from the provider that reports cached tokens apart."""
    events = table(spark, sf_dir, "events")
    prompt, cached = F.floor(F.abs("value") * 10).cast("long"), (F.get_json_object("props", "$.k").cast("long") % 50)
    provider = F.when(F.col("event_type") == "purchase", "gemini").otherwise("openai")
    entry = usage.normal_entry(prompt, F.floor(F.abs("value")).cast("long"), cached, provider)
    return events.select("event_id", "user_id", F.col("event_type").alias("operation"), F.col("ts").alias("created"), F.floor(F.col("event_id") / 3).cast("long").alias("request_id"), entry.alias("e")).select("*", "e.*").drop("e")


USAGE_SQL = """raw AS (SELECT *, floor(abs(value) * 10)::BIGINT AS p, floor(abs(value))::BIGINT AS c, (json_extract(props, '$.k')::BIGINT % 50) AS h FROM events
), used AS (SELECT event_id, user_id, event_type AS operation, ts AS created, event_id // 3 AS request_id, CASE WHEN event_type = 'purchase' THEN coalesce(p, 0) + coalesce(h, 0) ELSE coalesce(p, 0) END AS prompt,
    coalesce(c, 0) AS completion, coalesce(h, 0) AS cached, CASE WHEN event_type = 'purchase' THEN coalesce(p, 0) + coalesce(h, 0) ELSE coalesce(p, 0) END + coalesce(c, 0) AS total FROM raw)"""
_SUMS = "sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(cached)::BIGINT AS cached, sum(total)::BIGINT AS total, count(*) AS operations"
_BILL = "(prompt - least(greatest(0, cached), prompt) + floor(least(greatest(0, cached), prompt) * 0.5 + 0.5) + completion)::BIGINT AS billable"


def usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(usage_entries(spark, sf_dir), "operation")


def usage_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(usage_entries(spark, sf_dir), "user_id")


USAGE_BY_OPERATION = f"WITH {USAGE_SQL}, sums AS (SELECT operation, {_SUMS} FROM used WHERE total > 0 GROUP BY 1) SELECT *, {_BILL} FROM sums"
USAGE_BY_MEMBER = f"WITH {USAGE_SQL}, sums AS (SELECT user_id, {_SUMS} FROM used WHERE total > 0 GROUP BY 1) SELECT *, {_BILL} FROM sums"


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = usage.request_log(usage_entries(spark, sf_dir), 50, 20)
    listed = F.array_join(F.transform("processes", lambda p: p["operation"]), ",")
    return page.select("request_id", "prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens", "process_count", "billable_tokens", "has_more", listed.alias("processes"))


USAGE_LOG = f"""WITH {USAGE_SQL}, grouped AS (SELECT request_id, min(created) AS created_at, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(cached)::BIGINT AS cached, sum(total)::BIGINT AS total_tokens,
  count(*) AS process_count, string_agg(operation, ',' ORDER BY created, operation, prompt, completion, cached) AS processes FROM used GROUP BY 1), page AS (SELECT *, count(*) OVER () > 70 AS has_more FROM grouped ORDER BY created_at DESC, request_id LIMIT 50 OFFSET 20)
SELECT request_id, prompt AS prompt_tokens, completion AS completion_tokens, cached AS cached_tokens, total_tokens, process_count, {_BILL.replace("AS billable", "AS billable_tokens")}, has_more, processes FROM page"""


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answers: they must have 'the' or 'de', must not have a run of three stars, and need two sources."""
    turns = table(spark, sf_dir, "conversations").select("role", F.coalesce("text", F.lit("")).alias("answer"), (F.col("turn") % 4).alias("sources"))
    cases = turns.withColumns({"must": F.array(F.lit("(the|de)")), "must_not": F.array(F.lit("[*]{3}")), "min_sources": F.lit(1)})
    return usage.pass_rates(usage.check_answers(cases), "role")


EVALUATION = """WITH checked AS (SELECT role, regexp_matches(coalesce(text, ''), '(the|de)') AND NOT regexp_matches(coalesce(text, ''), '[*]{3}') AND turn % 4 >= 1 AS passed FROM conversations)
SELECT role, count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 4) AS rate FROM checked GROUP BY 1"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels rerun for every third document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("result"))
    return usage.merged_runs(labels, labels.where("doc_id % 3 = 0").withColumn("result", F.col("result") + 10), "doc_id")


MERGED = "SELECT doc_id, quality::BIGINT + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END AS result FROM labels"

QUERIES = {
    "glossary_search": (glossary_search, GLOSSARY_SEARCH),
    "glossary_letters": (letters, LETTERS),
    "glossary_browse": (browse, BROWSE),
    "glossary_term_count": (term_count, TERM_COUNT),
    "category_slugs": (categories, CATEGORIES),
    "usage_by_operation": (usage_by_operation, USAGE_BY_OPERATION),
    "usage_by_member": (usage_by_member, USAGE_BY_MEMBER),
    "usage_request_log": (usage_log, USAGE_LOG),
    "answer_evaluation": (evaluation, EVALUATION),
    "rerun_merge": (merged, MERGED),
}
