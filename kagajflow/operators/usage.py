"""Token usage: billing, totals, summaries and request logs; and evaluation of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHED_SHARE = 0.5


def billable(prompt: Column, completion: Column, cached: Column) -> Column:
    """Prompt tokens from the cache cost half, halves rounded up."""
    hit = F.least(F.greatest(F.lit(0), F.coalesce(cached, F.lit(0))), prompt)
    return prompt - hit + F.floor(hit * CACHED_SHARE + 0.5) + completion


def normal_entry(prompt: Column, completion: Column, cached: Column, provider: Column) -> Column:
    """A struct of prompt, completion, cached, total: one provider reports cached tokens besides the prompt, the other within it."""
    whole = F.when(provider == "gemini", F.coalesce(prompt, F.lit(0)) + F.coalesce(cached, F.lit(0))).otherwise(F.coalesce(prompt, F.lit(0)))
    done = F.coalesce(completion, F.lit(0))
    return F.struct(whole.alias("prompt"), done.alias("completion"), F.coalesce(cached, F.lit(0)).alias("cached"), (whole + done).alias("total"))


def totals(entries: DataFrame, *by: str) -> DataFrame:
    """Sums over entries (prompt, completion, cached, total) that used any tokens, and what the sums cost."""
    sums = [F.sum(c).alias(c) for c in ("prompt", "completion", "cached", "total")]
    out = entries.where("total > 0").groupBy(*by).agg(*sums, F.count("*").alias("operations"))
    return out.withColumn("billable", billable(F.col("prompt"), F.col("completion"), F.col("cached")))


def request_log(entries: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of requests, the latest first, with their processes in order and whether more follow."""
    process = F.struct("created", "operation", "prompt", "completion", "cached", "total")
    sums = [F.sum(c).alias(f"{c}_tokens") for c in ("prompt", "completion", "cached", "total")]
    grouped = entries.groupBy("request_id").agg(F.min("created").alias("created_at"), *sums, F.count("*").alias("process_count"), F.array_sort(F.collect_list(process)).alias("processes"))
    page = grouped.orderBy(F.desc("created_at"), "request_id").offset(offset).limit(limit + 1)
    numbered = page.withColumn("n", F.row_number().over(Window.orderBy(F.desc("created_at"), "request_id"))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("n") <= limit).drop("n").withColumn("billable_tokens", billable(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4))


def check_answers(cases: DataFrame) -> DataFrame:
    """cases (answer, must, must_not: arrays of patterns, sources, min_sources) with failures and passed."""
    missing = F.transform(F.filter("must", lambda p: ~F.regexp_like(F.col("answer"), p)), lambda p: F.concat(F.lit("missing "), p))
    banned = F.transform(F.filter("must_not", lambda p: F.regexp_like(F.col("answer"), p)), lambda p: F.concat(F.lit("has "), p))
    few = F.when(F.col("sources") < F.col("min_sources"), F.array(F.lit("too few sources"))).otherwise(F.array().cast("array<string>"))
    return cases.withColumn("failures", F.concat(missing, banned, few)).withColumn("passed", F.size("failures") == 0)


def pass_rates(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("rate"))


def merged_runs(previous: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """Results of both runs by key, the rerun's where it has one."""
    return rerun.unionByName(previous.join(rerun.select(key), key, "left_anti"))
