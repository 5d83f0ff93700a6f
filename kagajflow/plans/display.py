"""Clause trees, shown sections, excerpts, answers and spelling on the fixture tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling
from ..functions.text import normal_title
from ..operators import analysis, answers, clause_tree
from ..sources.tables import CHUNKS_SQL, STATUTES_SQL, fixture_chunks, statute_chunks, table
from .sections import TOP, long, near
from .texts import title_score_sql

#: Paths and texts by which the parts of a section differ: introduction, subsections, clauses, one without its subsection, a proviso, tails and bare words.
PATHS = ((), ("(१)",), ("(१)", "(ख)"), ("(२)",), ("(२)", "(क)"), ("(५)", "(ग)"), (), ("(४)",), ("(१)",), ("(३)",))
SAYS = ("परिचय", "पहिलो व्यवस्था", "उपदफा बमोजिम", "दोस्रो व्यवस्था", "बमोजिम कुरा", "पाँचौंको खण्ड", "तर यो लागू हुने छैन", "देहाय बमोजिम हुनेछ", "बमोजिम गर्नु पर्छ", "उपदफा")
OTHERS = {1: {7: "अन्य कुरा", 3: "बमोजिम सजाय,", 9: "बमोजिम पनि"}, 2: {7: "अन्य कुरा", 8: "(२) बमोजिम पीडितलाई", 3: "उपदफा"}, 3: {7: "अन्य कुरा", 9: "तेस्रो व्यवस्था", 8: "बमोजिम हानि भएमा"}}


def said_sql() -> str:
    cases = " ".join(f"WHEN root % 4 = {k} AND id % 10 = {i} THEN '{text}'" for k, own in OTHERS.items() for i, text in own.items())
    return f"CASE {cases} ELSE {list(SAYS)}[id % 10 + 1] END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten documents as the parts of a section."""
    rows = fixture_chunks(spark, sf_dir)
    text = F.get(F.array(*map(F.lit, SAYS)), (F.col("id") % 10).cast("int"))
    for k, own in OTHERS.items():
        for i, other in own.items():
            text = F.when((F.col("root") % 4 == k) & (F.col("id") % 10 == i), other).otherwise(text)
    paths = F.array(*(F.array(*map(F.lit, p)).cast("array<string>") for p in PATHS))
    return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit("law").alias("filename"), "root", "id", F.get(paths, (F.col("id") % 10).cast("int")).alias("path"), text.alias("text"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clause_tree.tree(clause_tree.restructured(parts(spark, sf_dir)))
    return found.select("root", "id", "parent", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"), F.array_join("path", ".").alias("path"), "text")


#: Parents by recursion from the section's roots: a part's parent is the part with the longest beginning of its path; places by the order of marks.
_MARK = "list_transform(path, lambda m: coalesce(try_cast(m AS INT), list_position(['क', 'ख', 'ग'], m)))"
_SINGLE = "len(path) = 1 AND regexp_matches(path[1], '^[0-9]+$')"
CLAUSES = rf"""WITH RECURSIVE {CHUNKS_SQL}, parts AS (
  SELECT root, id, list_transform([{', '.join(str(list(p)) if p else "[]::VARCHAR[]" for p in PATHS)}][id % 10 + 1], lambda m: translate(m, '()०१२३४५६७८९', '  0123456789').replace(' ', '')) AS path, {said_sql()} AS text FROM chunks
), marked AS (SELECT *, bool_or(coalesce(len(path) = 1 AND path[1] = '4' AND NOT starts_with(text, 'बमोजिम') AND regexp_matches(text, 'देहाय\s+बमोजिम|बमोजिम\s+सजाय|सजाय\s+हुनेछ'), false)) OVER (PARTITION BY root) AS lists FROM parts
), roles AS (
  SELECT *, CASE WHEN lists AND (text = 'उपदफा' OR len(path) = 2 AND path[1] != '4' AND starts_with(text, 'उपदफा')) THEN 'gone' WHEN lists AND {_SINGLE} AND path[1] != '4' AND starts_with(text, 'बमोजिम') THEN 'moved' WHEN lists THEN 'kept'
    WHEN {_SINGLE} AND text = 'उपदफा' THEN 'stub' WHEN len(path) = 1 AND path[1] = '1' AND regexp_matches(text, '^(\([0-9०-९]+\)\s*)?बमोजिम') THEN 'tail' ELSE 'kept' END AS role FROM marked
), tails AS (SELECT root, id, CASE WHEN regexp_matches(text, 'क्षतिपूर्ति|पीडित|हानि|नोक्सानी') THEN '3' ELSE '2' END AS mark, CASE WHEN starts_with(text, 'बमोजिम') THEN 'उपदफा (१) ' ELSE 'उपदफा ' END || text AS said FROM roles WHERE role = 'tail'
), stubs AS (SELECT root, path[1] AS mark, max(id) AS stub FROM roles WHERE role = 'stub' GROUP BY 1, 2
), targets AS (SELECT root, path[1] AS mark, min(id) AS target FROM roles WHERE role = 'kept' AND {_SINGLE} GROUP BY 1, 2
), more AS (
  SELECT coalesce(t.root, s.root) AS root, coalesce(t.mark, s.mark) AS mark, said, t.id, stub, target, row_number() OVER (PARTITION BY coalesce(t.root, s.root), coalesce(t.mark, s.mark) ORDER BY t.id) AS n
  FROM tails t FULL JOIN stubs s ON t.root = s.root AND t.mark = s.mark LEFT JOIN targets g ON g.root = coalesce(t.root, s.root) AND g.mark = coalesce(t.mark, s.mark)
), appended AS (SELECT root, target AS id, string_agg(coalesce(said, 'उपदफा'), ' ' ORDER BY n) AS extra FROM more WHERE target IS NOT NULL GROUP BY 1, 2
), moved AS (
  SELECT r.root, r.id, path, CASE WHEN extra IS NULL THEN text ELSE text || ' ' || extra END AS text FROM roles r LEFT JOIN appended a ON a.root = r.root AND a.id = r.id WHERE role = 'kept'
  UNION ALL SELECT root, CASE WHEN n = 1 THEN coalesce(stub, id) ELSE id END, [mark], coalesce(said, 'उपदफा') FROM more WHERE target IS NULL
  UNION ALL SELECT root, id, ['4', ['क', 'ख', 'ग'][path[1]::INT]], 'उपदफा (' || translate(path[1], '123', '१२३') || ') ' || regexp_replace(text, ',\s*$', '') FROM roles WHERE role = 'moved' AND path[1] IN ('1', '2', '3') QUALIFY row_number() OVER (PARTITION BY root, path[1] ORDER BY id DESC) = 1
), numbered AS (SELECT *, starts_with(text, 'तर ') AND len(path) = 0 AS proviso, list_sort(list_distinct(list(CASE WHEN {_SINGLE} THEN path[1]::INT END) OVER (PARTITION BY root))) AS numbers FROM moved
), keyed AS (SELECT *, CASE WHEN proviso THEN [CASE WHEN list_contains(numbers, 6) THEN 5 ELSE greatest(1, list_max(numbers) - 1) END, 10000] ELSE {_MARK} END AS key FROM numbered
), nodes AS (SELECT root, path, min(id) AS above FROM keyed WHERE NOT proviso GROUP BY 1, 2
), parents AS (SELECT k.root, k.id, max_by(n.above, len(n.path)) AS parent FROM keyed k JOIN nodes n ON n.root = k.root AND n.path = k.path[1:len(n.path)] AND n.above != k.id GROUP BY 1, 2
), down AS (
  SELECT k.root, k.id, NULL::BIGINT AS parent, 0 AS depth FROM keyed k LEFT JOIN parents p ON p.root = k.root AND p.id = k.id WHERE p.parent IS NULL
  UNION ALL SELECT p.root, p.id, p.parent, depth + 1 FROM parents p JOIN down d ON d.root = p.root AND d.id = p.parent
)
SELECT k.root, k.id, d.parent, d.depth::BIGINT AS depth, row_number() OVER (PARTITION BY k.root ORDER BY key, k.id) AS place, array_to_string(path, '.') AS path, text FROM keyed k JOIN down d ON d.root = k.root AND d.id = k.id"""


def section_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's nearest chunks cut to the sections that answer it; what it asks is its first row's title or something else, for every other query a punishment."""
    rows = near(spark, sf_dir, 12).withColumn("n", F.floor(F.col("query_id") / 100))
    title = normal_title(F.col("section_title"))
    first = rows.where("rank = 1").select("query_id", F.concat(F.when(F.col("n") % 2 == 0, "सजाय ").otherwise(""), F.when(F.col("n") % 5 == 2, "xyz uvw").otherwise(F.substring(title, 1, F.when(F.col("n") % 3 == 0, 60).otherwise(12).cast("int")))).alias("asked"))
    rows = rows.join(first, "query_id").withColumn("similarity", F.when((F.col("n") % 5 % 3 == 0) & (F.col("rank") < 4), 0.9).otherwise(F.round(F.col("similarity") / 2, 6)))
    punishes, hinted = F.col("id") % 4 < 2, (F.col("id") + F.col("n")) % 7 < 2
    precise = analysis.is_precise(F.col("asked"), F.col("section_title"), F.col("similarity"), hinted & (F.col("n") % 4 == 1), punishes)
    shown = answers.shown_sections(rows, precise, punishes, F.col("asked").startswith("सजाय"), hinted, F.col("n") % 4 == 1)
    return long(shown, "place")


SECTION_CAP = f"""{TOP}, r AS (SELECT *, query_id // 100 AS n FROM rows WHERE rank <= 12
), titled AS (SELECT *, trim(regexp_replace(regexp_replace(section_title, '[ः:।]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM r
), asked AS (SELECT query_id, trim(regexp_replace(CASE WHEN n % 2 = 0 THEN 'सजाय ' ELSE '' END || CASE WHEN n % 5 = 2 THEN 'xyz uvw' ELSE substring(t, 1, CASE WHEN n % 3 = 0 THEN 60 ELSE 12 END) END, '\\s+', ' ', 'g')) AS q, n % 2 = 0 AS asks FROM titled WHERE rank = 1
), pairs AS (SELECT r.* REPLACE (CASE WHEN n % 5 % 3 = 0 AND rank < 4 THEN 0.9::DOUBLE ELSE round(similarity / 2, 6) END AS similarity), q, asks, id % 4 < 2 AS punishes, (id + n) % 7 < 2 AND n % 4 = 1 AS hinted FROM titled r JOIN asked USING (query_id)
), {title_score_sql("pairs", "scored")}, judged AS (
  SELECT *, hinted AND (score >= 0.5 OR similarity >= 0.7) OR score >= 0.65 OR similarity >= 0.88 OR asks AND punishes AND score >= 0.45 AS precise FROM scored
), firsts AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY query_id, filename, root ORDER BY rank) = 1
), top_three AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM firsts QUALIFY p <= 3
), told AS (SELECT *, count(*) OVER q AS c, count(*) FILTER (hinted) OVER q AS h, bool_or(p = 1 AND precise) OVER q AS one, bool_or(p = 1 AND precise AND asks AND punishes) OVER q AS pun, bool_or(p = 2 AND precise) OVER q AS two FROM top_three WINDOW q AS (PARTITION BY query_id)
), left_by AS (SELECT *, CASE WHEN c = 1 THEN 'single' WHEN h >= 2 THEN 'hints' WHEN pun THEN 'punishment' WHEN one AND two THEN 'two' ELSE 'all' END AS exit FROM told)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place, exit FROM left_by WHERE CASE exit WHEN 'hints' THEN hinted WHEN 'punishment' THEN p = 1 WHEN 'two' THEN p <= 2 ELSE true END"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best part of each query's eight nearest chunks for words of the first of them, one of them twice."""
    rows = near(spark, sf_dir, 8)
    words = answers.excerpt_words(F.substring("content", 30, 90))
    asked = rows.where("rank = 1").select("query_id", F.concat(F.slice(words, 2, 5), F.slice(words, 3, 1), F.array(F.lit("en"), F.lit("anan"))).alias("words"))
    found = answers.best_excerpts(rows.select("query_id", "id", "content").join(asked, "query_id"), ["query_id", "id"])
    return long(found.select("query_id", "id", "at", "words", F.md5("excerpt").alias("excerpt")), "at", "words")


EXCERPTS = f"""{TOP}, r AS (SELECT query_id, id, rank, content FROM rows WHERE rank <= 8
), asked AS (SELECT query_id, list_concat(w[2:6], w[3:3], ['en', 'anan']) AS words FROM (SELECT query_id, list_filter(regexp_split_to_array(substring(content, 30, 90), '[\\s,।.?!;:]+'), lambda x: length(x) > 1) AS w FROM r WHERE rank = 1)
), each AS (SELECT r.query_id, r.id, content, unnest(words) AS w, generate_subscripts(words, 1) AS no FROM r JOIN asked USING (query_id)
), found AS (SELECT query_id, id, no, length(w) AS n, unnest(list_filter(range(0, length(content)), lambda i: substring(content, i + 1, length(w)) = w)) AS pos FROM each
), counted AS (SELECT a.query_id, a.id, a.no, a.pos, count(DISTINCT b.no) AS words FROM found a JOIN found b ON a.query_id = b.query_id AND a.id = b.id AND b.pos >= a.pos - 200 AND b.pos + b.n <= a.pos + 200 GROUP BY ALL
), best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY words DESC, no, pos) = 1
), cut AS (SELECT r.query_id, r.id, coalesce(pos, 0) AS at_, coalesce(words, 0) AS words, content, greatest(0, coalesce(pos, 0) - 250) AS s FROM r LEFT JOIN best b ON b.query_id = r.query_id AND b.id = r.id)
SELECT query_id, id, at_::BIGINT AS "at", words::BIGINT AS words, md5(CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substring(content, s::BIGINT + 1, 500), ' ') || CASE WHEN s + 500 < length(content) THEN '…' ELSE '' END) AS excerpt FROM cut"""

HEADINGS = ("मुद्दा", "लागू प्रावधानहरू", "सारांश")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers, their turns below headings in turn."""
    heads = F.array(*(F.lit(f"**{h}**") for h in (*HEADINGS, "अन्य")))
    turn = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.get(heads, ((F.col("conv_id") + F.col("turn") / 2) % 4).cast("int")), F.lit("  \n"))).otherwise(""), F.coalesce("text", F.lit("")))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    cut = whole.select("conv_id", F.posexplode(answers.answer_sections(F.col("t"), HEADINGS, HEADINGS[0])).alias("place", "s"))
    return cut.select("conv_id", F.col("place").cast("long").alias("place"), "s.heading", F.md5("s.body").alias("body"))


_HEAD = "|".join(HEADINGS)
SECTIONED = f"""WITH turns AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ['**मुद्दा**', '**लागू प्रावधानहरू**', '**सारांश**', '**अन्य**'][((conv_id + turn // 2) % 4 + 1)::INT] || '  ' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM conversations
), lines AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM turns
), marked AS (SELECT *, regexp_extract(line, '^[ \\t]*\\*\\*({_HEAD})\\*\\*[ \\t]*$', 1) AS h FROM lines
), held AS (SELECT *, count(*) FILTER (h != '') OVER (PARTITION BY conv_id ORDER BY turn, i) AS k, bool_or(contains(line, '**मुद्दा**')) OVER (PARTITION BY conv_id) AS has FROM marked)
SELECT conv_id, k - 1 AS place, first(h ORDER BY turn, i) AS heading, md5(coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY turn, i) FILTER (h = ''), '^\\s+|\\s+$', '', 'g'), '')) AS body FROM held WHERE has AND k > 0 GROUP BY conv_id, k"""

#: Words of part names in Devanagari letters, and phrases that go before their words.
SPELLED = {
    "almond": "बदाम", "antique": "पुरानो", "antique almond": "पुरानो बदाम", "blue": "नीलो", "green": "हरियो", "dark green": "गाढा हरियो", "dark": "गाढा", "red": "रातो", "black": "कालो", "white": "सेतो", "le": "ले", "ma": "मा",
    "lime": "कागती", "lemon": "निबुवा", "rose": "गुलाब", "snow": "हिउँ", "sky": "आकाश", "smoke": "धुवाँ", "steel": "इस्पात", "tan": "भित्र", "din": "दिन",
}


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, some with postpositions, phrases and capitals, in Devanagari letters."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Dark  GREEN ").otherwise("antique almond ma "), F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, " le? din tan").otherwise("ma blue le"))
    return table(spark, sf_dir, "part").select("p_partkey", spelling.transliterated(name, SPELLED).alias("name"))


_SPELLED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SPELLED.items()) + "}"
SPELLED_SQL = f"""WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Dark  GREEN ' ELSE 'antique almond ma ' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || CASE WHEN p_partkey % 2 = 0 THEN ' le? din tan' ELSE 'ma blue le' END AS name FROM part
), pieces AS (SELECT p_partkey, regexp_extract_all(name, '(?i)\\b(?:{spelling.longest_first(SPELLED)})\\b|[a-zA-Z]+|[^a-zA-Z]+') AS p FROM named
), other AS (SELECT p_partkey, trim(regexp_replace(array_to_string(list_transform(p, lambda x: coalesce({_SPELLED}[regexp_replace(lower(x), '\\s+', ' ', 'g')], x)), ''), '\\s+', ' ', 'g')) AS t FROM pieces)
SELECT p_partkey, regexp_replace(regexp_replace(t, '([ऀ-ॿ])\\s+(ले|मा|को|बाट)(\\s|$|[?.!])', '\\1\\2\\3', 'g'), 'दिन\\s+भित्र', 'दिनभित्र', 'g') AS name FROM other"""

#: Latin words that scanning makes of Devanagari ones.
SCANNED = {"the": "पूर्जी", "ab": "", "latin": "लाटिन", "on": "मा"}


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes with every fourth word in Latin letters."""
    rows = statute_chunks(spark, sf_dir)
    words = F.transform(F.split("content", " "), lambda w, i: F.when((i + F.col("id")) % 4 == 0, F.get(F.array(*map(F.lit, ("The", "ab", "wxyz", "Unknown"))), ((i + F.col("id")) / 4 % 4).cast("int"))).otherwise(w))
    mixed = F.when(F.col("id") % 6 == 0, F.concat(F.lit("only the latin words here and on and on for a long while "), F.array_join(words, " "))).otherwise(F.array_join(words, " "))
    return spelling.repaired(rows.select("id", F.concat(mixed, F.lit(" wxyz । on |  ab")).alias("text")), SCANNED).select("id", F.md5("text").alias("text"))


_MIXED = """list_transform(string_split(content, ' '), lambda w, i: CASE WHEN (i - 1 + id) % 4 = 0 THEN ['The', 'ab', 'wxyz', 'Unknown'][(i - 1 + id) // 4 % 4 + 1] ELSE w END)"""
_SCANNED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SCANNED.items()) + "}"
REPAIRED = f"""WITH {CHUNKS_SQL}, {STATUTES_SQL}, texts AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'only the latin words here and on and on for a long while ' ELSE '' END || array_to_string({_MIXED}, ' ') || ' wxyz । on |  ab' AS t FROM statutes
), pieces AS (SELECT id, t, unnest(regexp_extract_all(t, '[a-zA-Z]+|[^a-zA-Z]+')) AS x, generate_subscripts(regexp_extract_all(t, '[a-zA-Z]+|[^a-zA-Z]+'), 1) AS n FROM texts
), placed AS (SELECT *, sum(length(x)) OVER w - length(x) AS at_, lead(x) OVER (PARTITION BY id ORDER BY n) AS y FROM pieces WINDOW w AS (PARTITION BY id ORDER BY n)
), fixed AS (SELECT *, CASE WHEN regexp_matches(x, '^[a-zA-Z]{{2,}}$') AND regexp_matches(substring(t, greatest(0, at_ - 40)::BIGINT + 1, (at_ + 40 - greatest(0, at_ - 40))::BIGINT), '[ऀ-ॿ]')
  THEN coalesce({_SCANNED}[lower(x)], CASE WHEN length(x) <= 4 AND regexp_matches(coalesce(y, ''), '^\\s*[|।,]') THEN 'पर्नेछ' END, x) ELSE x END AS f FROM placed)
SELECT id, md5(regexp_replace(regexp_replace(string_agg(f, '' ORDER BY n), '[ \\t]{{2,}}', ' ', 'g'), '\\s+([|।])', ' \\1', 'g')) AS text FROM fixed GROUP BY id"""

QUERIES = {
    "script_repair": (repaired, REPAIRED),
    "clause_tree": (clauses, CLAUSES),
    "section_cap": (section_cap, SECTION_CAP),
    "excerpt": (excerpts, EXCERPTS),
    "answer_sections": (sectioned, SECTIONED),
    "transliteration": (spelled, SPELLED_SQL),
}
