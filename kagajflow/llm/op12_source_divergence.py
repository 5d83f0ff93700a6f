"""Source divergence audit: how the sources of each language differ in their words.

Pass one counts exactly in how many documents of its language each term stands; each language keeps its terms of `min_docs` documents or
more. Pass two recounts the kept terms by (language, source): an automaton (pyahocorasick) of the terms, each padded with a blank at both
ends, runs over the text with one blank or more for all that isn't a term. Automata are for the HEAD most frequent kept terms of at most
TERM_BYTES (a proven bound on what is broadcast); the terms beyond are recounted by words, combined in tasks and joined with the
vocabulary. Counts are combined within tasks before they are shuffled, so a source of a third of all rows is a row for each term and task.

From the counts come integer shares p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)), in decimals. The distance of two sources is the
sum of |p - q| over the V terms. Terms that neither has add V |a - b|, a and b being the shares of an absent term; what is posted for one
source is counted against the other's absent share by sorted sums, and only terms of both are looked at in pairs. Postings are dealt by
language, slice of its terms and pair of slices of its sources, so a task holds a matrix of SOURCES x SOURCES sums at most and sends
sums, not pairs for each term. Distances and terms are ranked by windows, terms with Spark's grouped top-k.

Null text, language and source count as empty. Repeated rows count as documents of their own. A (language, source) without terms is a
group as any other; where a language keeps no term all distances are 0. An empty table gives no rows; other columns aren't read. Ties
are ranked by the item in UTF-8 order. The id isn't read: nulls in it say nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Terms in all automata together, and the bytes of one: 12.8 MB at most.
HEAD, TERM_BYTES = 200_000, 64
#: Sources of one side of a task's matrix, and terms of one slice (at least).
SOURCES, TERMS = 1024, 256
#: Entries that a task's counts hold before they are sent on.
HELD = 400_000
CHUNK = 1 << 20


def spaced() -> bytes:
    """Bytes to what they count as: A-Z in lower case, a-z and all beyond ASCII as they are, the others blanks."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(0x61, 0x7B):
        out[c] = out[c - 0x20] = c
    return bytes(out)


SPACED = spaced()


def chunks(text: bytes) -> Iterator[bytes]:
    """Spaced text in runs of bounded size, cut at blanks only, each with a blank at both ends."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            end = text.find(b" ", end)
            end = n if end < 0 else end
        yield b" " + text[at:end] + b" "
        at = end


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def sent(counts: dict[tuple[str, ...], Counter], names: list[str]) -> pa.RecordBatch:
    """Counts by key and term as rows; the counts are emptied."""
    keys = [(*key, term, n) for key, own in counts.items() for term, n in own.items()]
    counts.clear()
    columns = list(zip(*keys, strict=True)) if keys else [[] for _ in names]
    kinds = [*(pa.string() for _ in names[:-1]), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, df) of rows (text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        names, held = ["lang", "term", "n"], 0
        for batch in batches:
            data, at = common.utf8_of(batch.column(0))
            for a, b, lang in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), strict=True):
                own = counts[(lang,)]
                before = len(own)
                own.update(set(data[a:b].tobytes().translate(SPACED).split()))
                held += len(own) - before
                if held > HELD:
                    yield sent(counts, names)
                    held = 0
        yield sent(counts, names)

    return rows.select("text", "lang").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df"))


def head_of(kept: DataFrame, head: int) -> dict[str, list[str]]:
    """By language the terms that get into the automata: the `head` most frequent of all languages at most, none beyond TERM_BYTES."""
    out: dict[str, list[str]] = defaultdict(list)
    chosen = kept.where((F.octet_length("term") <= TERM_BYTES) & (F.octet_length("lang") <= TERM_BYTES)).orderBy(F.desc("df"), "lang", "term").limit(head)
    for r in chosen.select("lang", "term").collect():  # HEAD rows at most
        out[r["lang"]].append(r["term"])
    return dict(out)


AUTOMATA: dict[int, dict[str, ahocorasick.Automaton]] = {}


def automaton_of(key: int, lang: str, terms: list[str]) -> ahocorasick.Automaton:
    """The language's automaton, built once in a worker."""
    if key not in AUTOMATA:
        AUTOMATA.clear()
        AUTOMATA[key] = {}
    own = AUTOMATA[key]
    if lang not in own:
        own[lang] = ahocorasick.Automaton()
        for term in terms:
            own[lang].add_word(f" {term} ", term)
        own[lang].make_automaton()
    return own[lang]


def occurrences(rows: DataFrame, kept: DataFrame, head: int = HEAD) -> DataFrame:
    """(lang, source, term, n): how often each kept term of the language stands in the source's texts, where it does."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(head_of(kept, head))
    key, in_head = shared._jbroadcast.id(), sum(map(len, shared.value.values()))
    tail = kept.count() > in_head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        names, held = ["lang", "source", "term", "n"], 0
        fast = {lang: set(terms) for lang, terms in shared.value.items()} if tail else {}
        for batch in batches:
            data, at = common.utf8_of(batch.column(0))
            for a, b, lang, source in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, own = data[a:b].tobytes().translate(SPACED), counts[(lang, source)]
                before = len(own)
                if lang in shared.value:
                    found = automaton_of(key, lang, shared.value[lang])
                    for part in chunks(text):
                        own.update(map(itemgetter(1), found.iter(part.decode())))
                if tail:
                    others = Counter(text.split())
                    own.update({t: n for w, n in others.items() if (t := w.decode()) not in fast.get(lang, ())})
                held += len(own) - before
                if held > HELD:
                    yield sent(counts, names)
                    held = 0
        yield sent(counts, names)

    found = rows.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi") if tail else found


def share(count: Column, total: Column, terms: Column) -> Column:
    whole = lambda c: c.cast("decimal(25,0)")
    top, under = (F.lit(SCALE).cast("decimal(10,0)") * whole(count + PRIOR)).cast("decimal(38,0)"), whole(total) + (whole(terms) * F.lit(PRIOR).cast("decimal(2,0)"))
    return F.lit(1).cast("long") + F.call_function("div", top, under.cast("decimal(38,0)"))


def groups_of(rows: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(g, lang, source, total, terms, absent): every (lang, source), numbered, with N, V and the share of a term it hasn't."""
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))
    return groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", "total", "terms", absent.alias("absent"))


def block_sums(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """(s, t, v): of one block the sums over its terms of |p - q| - |a - b|, for each source of either slice with each of the other."""
    g, side, term, p, absent = (part.column(c).to_numpy() for c in ("g", "side", "term", "p", "absent"))
    sides = []
    for k in (0, 1):
        own = side == k
        names, first, place = np.unique(g[own], return_index=True, return_inverse=True)
        posted = term[own] >= 0
        sides.append((names, absent[own][first], place[posted], term[own][posted], p[own][posted]))
    (left, a, *_), (right, b, *_) = sides
    sums = np.zeros((len(left), len(right)), np.int64)
    apart = np.abs(a[:, None] - b[None, :])
    for k, other, table, gap in ((0, b, sums, apart), (1, a, sums.T, apart.T)):
        _, _, place, _, values = sides[k]
        order = np.lexsort([values, place])
        bounds = np.searchsorted(place[order], np.arange(len(sides[k][0]) + 1))
        for s, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = values[order[x:y]]
            before = np.concatenate([[0], np.cumsum(own)])
            under = np.searchsorted(own, other)  # |p - q| summed over the source's terms, by how many of them are below q
            table[s] += other * under - before[under] + before[-1] - before[under] - other * (len(own) - under) - len(own) * gap[s]
    lists = []
    for _, _, place, terms, values in sides:
        order = np.argsort(terms, kind="stable")
        lists.append((place[order], terms[order], values[order]))
    shared = np.intersect1d(lists[0][1], lists[1][1])
    cuts = [zip(np.searchsorted(x[1], shared).tolist(), np.searchsorted(x[1], shared, "right").tolist(), strict=True) for x in lists]
    for (x0, x1), (y0, y1) in zip(*cuts, strict=True):
        i, j, p, q = lists[0][0][x0:x1], lists[1][0][y0:y1], lists[0][2][x0:x1], lists[1][2][y0:y1]
        sums[np.ix_(i, j)] += np.abs(p[:, None] - q) - np.abs(p[:, None] - b[j]) - np.abs(a[i][:, None] - q) + apart[np.ix_(i, j)]
    for x in range(0, len(left), 64):
        some = left[x : x + 64]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(right))), pa.array(np.tile(right, len(some))), pa.array(sums[x : x + 64].ravel())], names=["s", "t", "v"])


def distances(groups: DataFrame, postings: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, item, q, value) for each two different sources of a language, both ways. postings: g, lang, word, p, absent."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("slices"), F.greatest(F.lit(1), F.ceil(F.max("terms") / F.greatest(F.lit(terms), F.least(F.count("*"), F.lit(sources))))).cast("int").alias("shards"))
    sizes = common.stored(sizes, "sizes")
    word = F.xxhash64("word")
    posted = postings.join(sizes, "lang").select("lang", "g", "absent", "slices", F.pmod(word, F.col("shards")).cast("int").alias("shard"), F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), 63)).bitwiseAND(word).alias("term"), "p")
    every = groups.join(sizes, "lang").select("lang", "g", "absent", "slices", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(-1).cast("long").alias("term"), F.lit(0).cast("long").alias("p"))
    rows = posted.unionByName(every).withColumn("slice", F.pmod(F.xxhash64("g"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = F.when(F.col("slice") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("slice") > F.col("other")).cast("int")))
    rows = rows.select("lang", "shard", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "g", "absent", "term", "p", F.explode(both).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_in(batches, ["lang", "shard", "i", "j"]):
            yield from block_sums(part)

    keys = ["lang", "shard", "i", "j"]
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, "s long, t long, v long")
    near = found.groupBy("s", "t").agg(F.sum("v").alias("v"))
    ways = near.join(groups.select(F.col("g").alias("s"), "lang", F.col("source").alias("left"), F.col("absent").alias("a"), "terms"), "s").join(groups.select(F.col("g").alias("t"), F.col("source").alias("right"), F.col("absent").alias("b")), "t")
    ways = ways.where("s != t").select("lang", "s", "t", "left", "right", (F.col("v") + F.col("terms") * F.abs(F.col("a") - F.col("b"))).alias("value"))
    slice_of = lambda c: F.pmod(F.xxhash64(c), F.col("slices"))  # noqa: E731  two slices met once, a slice with itself both ways
    ways = ways.join(sizes.select("lang", "slices"), "lang").withColumn("ways", F.when(slice_of("s") == slice_of("t"), F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")))).otherwise(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))))
    return ways.select("lang", F.explode("ways").alias("w"), "value").select("lang", "w.source", "w.item", "value")


def groups_in(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, of batches in order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        start = 0
        for k, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], k, key
        if len(batch) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, head: int = HEAD, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): the distances of sources and the terms that set them apart from their language."""
    rows = rows_of(docs)
    kept = common.stored(document_frequencies(rows).where(F.col("df") >= min_docs), "kept")
    counts = common.stored(occurrences(rows, kept, head), "occurrences")
    groups = common.stored(groups_of(rows, kept, counts), "groups")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    posted = counts.join(groups, ["lang", "source"]).select("lang", "source", "g", "absent", "terms", F.col("term").alias("word"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    posted = common.stored(posted, "postings")
    order = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(groups, posted, sources, terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order()))
    q = of_lang.join(lang_total, "lang").select("lang", F.col("term").alias("word"), "lang_n", "lang_total")
    told = posted.join(q, ["lang", "word"]).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("word").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    return pairs.unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x{{00}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS found FROM documents
), words AS (
  SELECT id, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}
), sizes AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, any_value(v) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(n, 0) + {PRIOR}) // (total + {PRIOR} * v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + {SCALE}::HUGEINT * (sum(n) + {PRIOR}) // (any_value(total) + {PRIOR} * any_value(v))::HUGEINT AS q
  FROM shares JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
