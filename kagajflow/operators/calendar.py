"""The Bikram Sambat calendar: conversion by joins with a table of its months."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The days of each month in the years around the fixtures' dates, and the day on which the first begins.
MONTH_DAYS = {
    2051: (31, 31, 31, 32, 31, 31, 30, 29, 30, 29, 30, 30),
    2052: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2053: (31, 32, 31, 32, 31, 30, 30, 30, 29, 29, 30, 30),
    2054: (31, 32, 31, 32, 31, 30, 30, 30, 29, 30, 29, 31),
    2055: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2056: (31, 31, 32, 31, 32, 30, 30, 29, 30, 29, 30, 30),
    2057: (31, 32, 31, 32, 31, 30, 30, 30, 29, 29, 30, 31),
    2058: (30, 32, 31, 32, 31, 30, 30, 30, 29, 30, 29, 31),
    2059: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
}
FIRST_DAY = datetime.date(1994, 4, 14)
MONTHS = ("Baisakh", "Jestha", "Ashad", "Shrawan", "Bhadra", "Ashwin", "Kartik", "Mangsir", "Poush", "Magh", "Falgun", "Chaitra")


def calendar_file(spark: SparkSession, path: str) -> DataFrame:
    """(year, month, days) of a JSON file that maps years to twelve month lengths."""
    text = spark.read.text(path, wholetext=True)
    years = text.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("year", "days"))
    return years.select(F.col("year").cast("int").alias("year"), F.posexplode("days").alias("month", "days")).select("year", (F.col("month") + 1).alias("month"), "days")


def fixed_months(spark: SparkSession) -> DataFrame:
    rows = [(year, month, days) for year, all_days in MONTH_DAYS.items() for month, days in enumerate(all_days, 1)]
    return spark.createDataFrame(rows, "year int, month int, days int")


def month_starts(months: DataFrame, first_day: datetime.date = FIRST_DAY) -> DataFrame:
    """months with the dates on which they start and end; the table has some hundred rows, whatever the data."""
    before = F.coalesce(F.sum("days").over(Window.orderBy("year", "month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    out = months.withColumn("starts", F.date_add(F.lit(first_day), before))
    return out.withColumn("ends", F.date_add("starts", F.col("days") - 1))


def to_bs(df: DataFrame, date_col: str, starts: DataFrame) -> DataFrame:
    """df with bs_year, bs_month, bs_day of a date; null outside the table. The month is found by an equi-join on the calendar month of both."""
    keyed = starts.select("starts", "ends", F.col("year").alias("bs_year"), F.col("month").alias("bs_month"))
    by_month = keyed.select("*", F.explode(F.sequence(F.trunc("starts", "month"), F.trunc("ends", "month"), F.expr("interval 1 month"))).alias("_month"))
    date = F.to_date(F.col(date_col))
    joined = df.withColumn("_month_of", F.trunc(date, "month")).join(F.broadcast(by_month), (F.col("_month_of") == F.col("_month")) & date.between(F.col("starts"), F.col("ends")), "left")
    return joined.withColumn("bs_day", F.date_diff(date, F.col("starts")) + 1).drop("_month", "_month_of", "starts", "ends")


def to_ad(df: DataFrame, year: str, month: str, day: str, starts: DataFrame) -> DataFrame:
    """df with ad_date of a BS date; null for a date that there isn't."""
    keyed = starts.select(F.col("year").alias(year), F.col("month").alias(month), "starts", "days")
    joined = df.join(F.broadcast(keyed), [year, month], "left")
    valid = F.col(day).between(1, F.col("days"))
    return joined.withColumn("ad_date", F.when(valid, F.date_add("starts", F.col(day).cast("int") - 1))).drop("starts", "days")


def fiscal_year_end(year: Column, month: Column) -> Column:
    """The year in whose third month the fiscal year ends."""
    return F.when(month <= 3, year).otherwise(year + 1)


def lateness(df: DataFrame, starts: DataFrame, as_of: datetime.date) -> DataFrame:
    """df (bs_year, bs_month of the last renewal) with tax_years, days_late and status on a day.

    Due is the end of each third month after the fiscal year that was paid, of which five at most count.
    """
    due = starts.where("month = 3").select(F.col("year").alias("_due_year"), F.col("ends").alias("_due"))
    by_end = due.select((F.col("_due_year") - 1).alias("_paid"), F.col("_due").alias("first_due"))
    passed = due.where(F.col("_due") < F.lit(as_of)).agg(F.max("_due_year").alias("_last"))
    out = df.withColumn("_paid", fiscal_year_end(F.col("bs_year"), F.col("bs_month"))).join(F.broadcast(by_end), "_paid", "left").crossJoin(F.broadcast(passed))
    missed = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("_last", F.lit(0)) - F.col("_paid")))
    out = out.withColumn("_missed", missed).withColumn("days_late", F.when(F.col("_missed") > 0, F.date_diff(F.lit(as_of), "first_due")).otherwise(0))
    status = F.when(F.col("_missed") == 0, "on_time").when(F.col("_missed") >= 3, "year_3").when(F.col("_missed") == 2, "year_2").when(F.col("days_late") <= 30, "days_1_30")
    status = status.when(F.col("days_late") <= 45, "days_31_45").otherwise("same_fy")
    return out.withColumn("status", status).withColumn("tax_years", F.greatest(F.lit(1), F.col("_missed"))).drop("_paid", "_missed", "_last", "first_due")


def formatted(year: Column, month: Column, day: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month)
    return F.concat_ws("-", year.cast("string"), name, day.cast("string"))


def with_days(df: DataFrame, year: str, month: str, starts: DataFrame) -> DataFrame:
    """df with days, how many the month has: 30 for a number that is no month's; a year that the table doesn't have is an error."""
    span = starts.agg(F.min("year").alias("_first"), F.max("year").alias("_end"))
    joined = df.join(F.broadcast(starts.select(F.col("year").alias(year), F.col("month").alias(month), "days")), [year, month], "left").crossJoin(F.broadcast(span))
    outside = ~F.col(year).between(F.col("_first"), F.col("_end"))
    return joined.withColumn("days", F.when(outside, F.raise_error(F.concat(F.lit("no such year in the calendar: "), F.col(year).cast("string")))).otherwise(F.coalesce("days", F.lit(30))).cast("int")).drop("_first", "_end")


def is_date(year: Column, month: Column, day: Column, days: Column) -> Column:
    """Whether there is such a day, given the days of the month."""
    return F.coalesce(year.isNotNull() & month.between(1, 12) & day.between(1, days), F.lit(False))


def compared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """-1, 0 or 1 as the date (year, month, day) a is before, at or after b."""
    left, right = F.struct(*(c.cast("int").alias(n) for c, n in zip(a, "ymd", strict=True))), F.struct(*(c.cast("int").alias(n) for c, n in zip(b, "ymd", strict=True)))
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def clamped(year: Column, month: Column, day: Column, days: Column) -> Column:
    """The nearest day that there is in the month: a struct of year, month and day."""
    return F.struct(year.alias("year"), F.greatest(F.lit(1), F.least(F.lit(12), month)).alias("month"), F.greatest(F.lit(1), F.least(days, day)).alias("day"))
