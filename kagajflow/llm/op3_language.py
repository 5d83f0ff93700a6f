"""Language ID by Bayesian fusion of evidence.

The text gives a likelihood under each language's letter trigrams (a naive Bayes model, fitted on a bounded sample of labelled
texts). To that come three pieces of evidence whose weight the corpus itself tells, by grouped counts of what the texts alone
say: the language that the markup declares, the address suffix, and the host's prior, smoothed towards its domain's and that
towards the whole corpus'. A row's own vote is taken out of the counts that it is judged by.

A row is accepted if its text has letters, one language is at least as probable as MIN_CONFIDENCE, and the text is typical of that
language: its mean log likelihood per trigram, with TYPICAL_OF more trigrams of the usual likelihood, is not further below the usual one
than what labelled texts kept out of the fit have, but for the share ODD of them, and SLACK nats more. So texts in a language that
nothing is labelled with, and noise, are rejected, and short texts aren't for a rare word. In the fit each labelled text counts once for
each trigram that it has, and once in the usual likelihood (their median), so that no long or repetitive text makes itself the norm.

A label is a language if MIN_TEXTS rows have it; of more than LANGUAGES such labels the most frequent are (a worker holds 256 KB for
each: 64 MB). A row that declares any other label can't be judged by it: it is accepted if it has letters, under its label where its text
isn't typical of a language. A language with fewer than MIN_HELD texts kept out of the fit takes all texts for typical. Without letters
the language is 'und'. Without any language all rows are 'und' and those with letters are accepted.

Null and empty texts are 'und'. Null evidence says nothing. Repeated rows are judged alike, an empty table gives no rows, other
columns aren't read. Texts are scored whole. Counts are combined before they are shuffled; a host with a third of all rows is one
row of the counts, and rows meet the counts by joins that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, op5_html

GRAMS = 1 << 16
#: Labelled texts per language that the model is fitted on, at most (about).
SAMPLE = 2000
#: Trigrams overlap, so each counts as a third; a long text's evidence is that of so many trigrams.
OVERLAP, MOST = 3.0, 3000
#: Rows that a prior from above counts as.
SMOOTH = 4.0
MIN_CONFIDENCE = 0.5
#: What texts may be less likely than those kept out of the fit, in nats.
ODD, SLACK, TYPICAL_OF = 0.02, 1.25, 20
#: Labelled rows that make a language, and texts kept out of its fit by which others are judged.
MIN_TEXTS, MIN_HELD = 20, 5
LANGUAGES = 256
BLOCK = 1 << 20


def folded() -> np.ndarray:
    """Bytes to what they count as: letters in lower case, all else in ASCII a blank."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    for c in range(0x61, 0x7B):
        out[c] = out[c - 0x20] = c
    return out


FOLD = folded()


def grams(data: np.ndarray) -> np.ndarray:
    """The trigram at each byte, as a number below GRAMS."""
    x = FOLD[data].astype(np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log probability of each trigram, by language
    usual: list[float]  # the median over texts of the mean log probability of a trigram
    far: list[float]  # how far below that a text may be


def held_out(key: Column) -> Column:
    """Whether a labelled text judges the fit instead of being in it: half of them, by a hash of the id."""
    return F.shiftright(F.xxhash64(key), 40).bitwiseAND(F.lit(1)) == 1


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, min_texts: int = MIN_TEXTS) -> Model:
    """A model of the languages that label rows; of each, about `sample` rows are chosen by a hash of their id."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and octet_length(text) >= 3")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()
    sizes = sorted((r["label"], r["n"]) for r in sizes)
    model = Model([label for label, _ in sizes], np.full((len(sizes), GRAMS), -np.log(GRAMS), np.float32), [0.0] * len(sizes), [1e9] * len(sizes))
    if not sizes:
        return model
    named = rows.sparkSession.createDataFrame([(label, n, k) for k, (label, n) in enumerate(sizes)], "label string, n long, k int")
    chosen = rows.join(F.broadcast(named), "label").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.least(F.lit(1.0), sample / F.col("n")) * (1 << 20))
    chosen = chosen.select("k", "text", held_out(F.col("id")).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sizes), GRAMS), np.int32)
        for batch in batches:
            data, at = common.utf8_of(batch.column(0))
            for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), strict=True):
                sums[k, np.unique(grams(data[a:b]))] += 1
        for k in np.flatnonzero(sums.any(1)).tolist():
            gram = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int32)), pa.array(sums[k, gram].astype(np.int64))], names=["k", "gram", "n"])

    def weigh(group: pa.Table) -> pa.Table:
        sums = np.zeros(GRAMS)
        sums[group.column("gram").to_numpy()] = group.column("n").to_numpy()
        weights = np.log((sums + 0.5) / (sums.sum() + 0.5 * GRAMS)).astype(np.float32)
        return pa.table({"k": group.column("k")[:1], "weights": pa.array([weights.tobytes()], pa.binary())})

    counts = chosen.where("not held").select("text", "k").mapInArrow(count, "k int, gram int, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    for r in counts.groupBy("k").applyInArrow(weigh, "k int, weights binary").collect():  # LANGUAGES rows at most
        model.weights[r["k"]] = np.frombuffer(r["weights"], np.float32)
    own = scores(chosen.where("held").select("text", "k"), model).where("letters and grams > 0")
    own = common.stored(own.select("k", "grams", (F.get("logs", "k") * OVERLAP / F.col("grams")).alias("mean")), "held")
    usual = own.groupBy("k").agg(F.percentile("mean", 0.5).alias("usual"), F.count("*").alias("n")).where(F.col("n") >= MIN_HELD)
    behind = (F.col("usual") - F.col("mean")) * F.col("grams") / (F.col("grams") + TYPICAL_OF)
    for r in own.join(usual, "k").groupBy("k", "usual").agg(F.percentile(behind, 1 - ODD).alias("far")).collect():  # LANGUAGES rows at most
        model.usual[r["k"]], model.far[r["k"]] = r["usual"], r["far"] + SLACK
    return model


def scores(df: DataFrame, model: Model) -> DataFrame:
    """df (text, other columns) with letters, whether the text has any, logs, its tempered log likelihoods, and grams, of how many trigrams, in place of the text."""
    others = [c for c in df.columns if c != "text"]
    shared = df.sparkSession.sparkContext.broadcast(model.weights)  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            data, at = common.utf8_of(batch.column(0))
            logs, letters, counted = np.zeros((len(batch), len(weights))), np.zeros(len(batch), bool), np.zeros(len(batch))
            for a, b in common.blocks(at, BLOCK):
                part = data[at[a] : at[b]]
                low, high = at[a:b] - at[a], at[a + 1 : b + 1] - at[a]
                seen = np.concatenate([[0], np.cumsum(FOLD[part] != 0x20)])
                letters[a:b] = seen[high] > seen[low]
                if len(part) < 3:
                    continue
                code, last = grams(part), np.clip(high - 2, 0, max(0, len(part) - 2))
                first = np.minimum(low, last)
                n = last - first
                counted[a:b] = np.minimum(n, MOST)
                temper = counted[a:b] / np.maximum(n, 1) / OVERLAP
                for k, weight in enumerate(weights):
                    running = np.concatenate([[0.0], np.cumsum(weight[code], dtype=np.float64)])
                    logs[a:b, k] = (running[last] - running[first]) * temper
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(weights), pa.int32()), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(letters), lists, pa.array(counted)], names=[*others, "letters", "logs", "grams"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(F.col("text").cast("string"), *others).mapInArrow(run, f"{schema}, letters boolean, logs array<double>, grams double")


def normal(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """scored (declared, suffix, host, domain, letters, logs, grams, other columns) with lang, confidence, text_lang and accepted."""
    languages = model.languages
    if not languages:
        return scored.select("*", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.col("letters").alias("accepted")).drop("logs", "grams")
    names = F.array(*map(F.lit, languages))
    vote = F.when(F.col("letters"), F.array_position("logs", F.array_max("logs")).cast("int") - 1)
    rows = scored.withColumn("vote", vote)

    def counted(key: str) -> DataFrame:
        """Votes by key: a map of LANGUAGES entries at most."""
        by_vote = rows.where(f"vote is not null and `{key}` is not null").groupBy(key, "vote").count()
        return by_vote.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("vote", F.col("count").cast("double")))).alias(f"n_{key}"))

    for key in ("declared", "suffix", "host", "domain"):
        rows = rows.join(counted(key), key, "left")
    whole = scored.withColumn("vote", vote).where("vote is not null").groupBy("vote").count().collect()  # a row for each language
    total = sum(r["count"] for r in whole) + len(languages)
    share = {r["vote"]: r["count"] for r in whole}
    base = F.array(*(F.lit((share.get(k, 0) + 1) / total) for k in range(len(languages))))

    def given(key: str, prior: Column) -> Column:
        """The languages' shares among rows with the same key, this row left out, smoothed towards the prior."""
        own = lambda k: F.coalesce(F.col(f"n_{key}")[k], F.lit(0.0)) - F.when(F.col("vote") == k, 1.0).otherwise(0.0)
        return normal(F.transform(prior, lambda p, k: F.greatest(F.lit(0.0), own(k)) + SMOOTH * p))

    host = given("host", given("domain", base))
    tilt = [F.zip_with(given(key, base), base, lambda p, q: F.log(p / q)) for key in ("declared", "suffix")]
    logs = F.zip_with(F.col("logs"), F.transform(host, lambda p: F.log(p)), lambda a, b: a + b)
    for part in tilt:
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    rows = rows.withColumn("fused", logs).withColumn("top", F.array_max("fused"))
    confidence = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    place = (F.array_position("fused", F.col("top")) - 1).cast("int")
    best, usual, far = (F.get(F.array(*map(F.lit, x)), place) for x in (languages, model.usual, model.far))
    behind = usual * F.col("grams") - F.get("logs", place) * OVERLAP
    sure = (behind <= far * (F.col("grams") + TYPICAL_OF)) & (confidence >= MIN_CONFIDENCE)
    other = F.coalesce(~F.array_contains(names, F.col("declared")), F.lit(False))
    judged = rows.withColumns({"_sure": sure, "_best": best, "_confidence": confidence, "_other": other})
    lang = F.when(~F.col("letters"), "und").when(F.col("_other") & ~F.col("_sure"), F.col("declared")).otherwise(F.col("_best"))
    out = judged.withColumn("lang", lang)
    certain = F.when(F.col("letters") & (F.col("lang") == F.col("_best")), F.col("_confidence")).otherwise(0.0)
    out = out.withColumn("confidence", certain).withColumn("text_lang", F.coalesce(F.get(names, F.col("vote")), F.lit("und"))).withColumn("accepted", F.col("letters") & (F.col("_sure") | F.col("_other")))
    return out.drop("logs", "grams", "fused", "top", "vote", "_sure", "_best", "_confidence", "_other", *(f"n_{k}" for k in ("declared", "suffix", "host", "domain")))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column) -> Column:
    """The host's last label, with a two-letter first folder of the path where there is one."""
    folder = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1)
    return F.nullif(F.concat_ws("/", F.substring_index(host_of(url), ".", -1), F.nullif(F.lower(folder), F.lit(""))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]{0,200}?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def identify(df: DataFrame, model: Model) -> DataFrame:
    """df (text, declared, suffix, host, domain, other columns) without text, with lang, confidence, text_lang and accepted."""
    return fuse(common.stored(scores(df, model), "language"), model)


def of_documents(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Documents declare their language in a column and have their source for a host."""
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return identify(docs.select(F.col(id_col), text("text").alias("text"), text("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), text("source").alias("host"), text("source").alias("domain")), model)


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    url = F.col("url").cast("string")
    told = pages.select("page_id", markup_language(F.col("html").cast("string")).alias("declared"), suffix_of(url).alias("suffix"), host_of(url).alias("host"), "html")
    return identify(op5_html.extract(told.withColumn("domain", domain_of(F.col("host")))), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page: doc_id or page_id, with the language."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(documents)
    found = ["lang", "confidence", "text_lang", "accepted"]
    docs = of_documents(documents, model).select("doc_id", F.lit(None).cast("long").alias("page_id"), *found)
    pages = of_pages(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), model).select(F.lit(None).cast("long").alias("doc_id"), "page_id", *found)
    return docs.unionByName(pages)
