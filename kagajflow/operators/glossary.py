"""Glossary search and browsing over entries (term, roman, english, meaning)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import in_blocks

#: Index letters of more than one character.
CONJUNCTS = ("क्ष", "त्र", "ज्ञ")


def plain(s: Column) -> Column:
    return F.lower(F.trim(s))


def roman(s: Column) -> Column:
    """Latin spelling without dots, lower case."""
    return plain(F.replace(s, F.lit("."), F.lit("")))


def in_order(query: Column) -> Column:
    """A pattern for fields that have the query's characters in this order; made once for each query. Each is sought from where the one before was first found, so matching is linear."""
    escaped = lambda ch: F.regexp_replace(ch, r"([^\p{L}\p{M}\p{N}])", r"\\$1")
    characters = F.filter(F.split(query, ""), lambda ch: ch != "")
    return F.array_join(F.transform(characters, lambda ch: F.concat(F.lit("[^"), escaped(ch), F.lit("]*+"), escaped(ch))), "")


def letters_of(s: Column) -> Column:
    """The characters of a text as bits of a number: what a text holds in any order has no bit that the text lacks."""
    bits = F.transform(F.split(F.coalesce(s, F.lit("")), ""), lambda ch: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(ch) + F.length(F.hex(ch)), F.lit(63))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def field_score(field: Column, query: Column, subsequence: bool = True, pattern: Column | None = None) -> Column:
    """100 equal, 90 begins with; then of the field's words, in order, 95 equal or 85 begins with; 70 within; 45 in order, from 3 characters (by in_order's pattern, if that is at hand)."""
    words = F.filter(F.split(field, r"[/\s,]+"), lambda w: w.startswith(query))
    first = F.get(words, F.lit(0))
    score = F.when(field == query, 100).when(field.startswith(query), 90).when(first == query, 95).when(first.isNotNull(), 85).when(field.contains(query), 70)
    if subsequence:
        score = score.when((F.length(query) >= 3) & F.regexp_like(field, in_order(query) if pattern is None else pattern), 45)
    return F.when((F.coalesce(field, F.lit("")) != "") & (query != ""), score.otherwise(0)).otherwise(0)


def prepared(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) in the spellings that fields are compared with."""
    forms = queries.select("query_id", F.trim("query").alias("q"), roman(F.col("query")).alias("q_roman"), plain(F.col("query")).alias("q_plain"))
    forms = forms.withColumns({"like_roman": in_order(F.col("q_roman")), "like_plain": in_order(F.col("q_plain"))})
    return forms.withColumns({f"{q}_has": letters_of(F.col(q)) for q in ("q", "q_roman", "q_plain")})


def label_score() -> Column:
    """The best of the term (case counts), the Latin spelling (dots don't) and the English label, of an entry's and a query's prepared forms."""
    return F.greatest(field_score(F.col("t"), F.col("q"), subsequence=False), field_score(F.col("t_roman"), F.col("q_roman"), pattern=F.col("like_roman")), field_score(F.col("t_plain"), F.col("q_plain"), pattern=F.col("like_plain")))


def matches() -> Column:
    """Whether the label score is above zero: what equals, begins or has the query holds it, and its characters in order.

    Pairs whose field lacks a character of the query, most of them, are told by one comparison of numbers.
    """

    def held(t: str, q: str, pattern: Column | None = None) -> Column:
        field, query, has = F.col(t), F.col(q), F.col(f"{q}_has")
        found = field.contains(query)
        if pattern is not None:
            found = F.when(F.length(query) >= 3, F.regexp_like(field, pattern)).otherwise(found)
        return F.coalesce((F.col(f"{t}_has").bitwiseAND(has) == has) & (query != "") & (field != "") & found, F.lit(False))

    return held("t", "q") | held("t_roman", "q_roman", F.col("like_roman")) | held("t_plain", "q_plain", F.col("like_plain"))


def entry_key(term: Column, latin: Column) -> Column:
    """What makes two entries the same: the Latin spelling, or the term without one."""
    return F.when(F.coalesce(roman(latin), F.lit("")) != "", roman(latin)).otherwise(F.trim(term))


def search_one(queries: DataFrame, entries: DataFrame, source: str, fetch: int) -> DataFrame:
    """Each query's best entries of one source, with its total of matches. A stated set of queries against all different entries, in blocks; a copy of an entry counts in the total and takes a place among the best."""
    entries = entries.groupBy("term", "roman", "english").agg(F.count("*").alias("copies"))
    forms = entries.select("term", "roman", "english", "copies", F.trim("term").alias("t"), roman(F.col("roman")).alias("t_roman"), plain(F.col("english")).alias("t_plain"))
    forms = forms.withColumns({f"{t}_has": letters_of(F.col(t)) for t in ("t", "t_roman", "t_plain")})
    forms = forms.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a small table, but much work for each row

    def block(some: DataFrame) -> DataFrame:
        met = forms.crossJoin(some).where(matches())
        scored = met.select("query_id", "term", "roman", "english", "copies", label_score().alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "term", "roman", "english")
        best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fetch)
        before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = best.withColumn("before", before).where(F.col("before") < fetch)
        return best.join(scored.groupBy("query_id").agg(F.sum("copies").alias("total")), "query_id").select("query_id", "term", "roman", "english", "score", "total", F.lit(source).alias("source"))

    return in_blocks(prepared(queries), block)


def search(queries: DataFrame, sources: dict[str, DataFrame], limit: int = 30) -> DataFrame:
    """Each query's best entries over all sources, one per key; total sums the sources' totals (an entry in both counts twice). Queries of one text are looked for once."""
    fetch = max(3 * limit, 50)
    asked = queries.select(F.col("query").alias("query_id"), "query").where("query is not null").distinct()
    parts = [search_one(asked, entries, name, fetch) for name, entries in sources.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    each = F.collect_set(F.struct("source", "total")).over(Window.partitionBy("query_id"))  # a few fetched rows a query
    every = every.withColumn("total", F.aggregate(each, F.lit(0).cast("long"), lambda n, s: n + s["total"]))
    places = F.create_map(*(F.lit(x) for i, name in enumerate(sources) for x in (name, i)))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), places[F.col("source")], "term")
    once = every.withColumn("key", entry_key(F.col("term"), F.col("roman"))).withColumn("n", F.row_number().over(best)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "term", "key")
    found = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("n", "key", "before", "copies").withColumnRenamed("query_id", "query")
    return queries.select("query_id", "query").join(found, "query").drop("query")


def index_letter(term: Column) -> Column:
    word = F.trim(term)
    out = F.substring(word, 1, 1)
    for letters in reversed(CONJUNCTS):
        out = F.when(word.startswith(letters), letters).otherwise(out)
    return out


def letter_counts(entries: DataFrame) -> DataFrame:
    return entries.where("trim(meaning) <> ''").groupBy(index_letter(F.col("term")).alias("letter")).agg(F.count("*").alias("n"))


#: The order of terms: ICU's for Nepali, in which conjuncts stand with their first letter.
COLLATION = "ne"


def browse(entries: DataFrame, letter: str | None, page: int, limit: int, collation: str = COLLATION) -> DataFrame:
    """One page of the entries with a meaning, in the order of a language; of equal terms in that order by their characters. A page beyond the last is the last."""
    limit = min(max(limit, 1), 100)
    kept = entries.where("trim(meaning) <> ''")
    if letter is not None:
        kept = kept.where(index_letter(F.col("term")) == letter)
    total = kept.count()
    pages = max(1, -(-total // limit))
    page = min(max(page, 1), pages)
    first = (page - 1) * limit
    size = min(limit, max(total - first, 0))
    keys = [F.collate("term", collation), F.col("term"), F.col("roman"), F.col("english"), F.col("meaning")]
    if 2 * first > total:  # from the end, if that is nearer
        kept = kept.orderBy(*(k.desc() for k in keys)).offset(total - first - size).limit(size)
    else:
        kept = kept.orderBy(*keys).offset(first).limit(size)
    return kept.orderBy(*keys).select("term", "roman", "english", "meaning", F.lit(page).alias("page"), F.lit(pages).alias("pages"), F.lit(total).alias("total"))


def distinct_terms(sources: list[DataFrame]) -> DataFrame:
    """How many different keys the sources' entries with a meaning have."""
    keys = sources[0].where("trim(meaning) <> ''").select(entry_key(F.col("term"), F.col("roman")).alias("key"))
    for more in sources[1:]:
        keys = keys.unionByName(more.where("trim(meaning) <> ''").select(entry_key(F.col("term"), F.col("roman")).alias("key")))
    return keys.agg(F.count_distinct("key").alias("n_terms"))
