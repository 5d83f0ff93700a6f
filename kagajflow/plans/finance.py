"""Calculators and calendar on the fixture tables, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..operators import calendar
from ..sources.tables import table

#: Added before rounding, so that a half rounds up whatever its last binary digit.
NUDGE = 1e-7
AS_OF = datetime.date(2002, 3, 1)


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loans: the rate 0 to 15 percent, 6 to 65 months."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("principal"), (key % 16).cast("double").alias("rate"), (key % 60 + 6).cast("int").alias("months"))


LOANS = """loans AS (SELECT o_orderkey, o_totalprice AS principal, (o_orderkey % 16)::DOUBLE AS rate, (o_orderkey % 60 + 6)::INT AS months FROM orders
), paid AS (SELECT *, CASE WHEN rate = 0 THEN principal / months ELSE principal * (rate / 1200) * pow(1 + rate / 1200, months) / (pow(1 + rate / 1200, months) - 1) END AS emi FROM loans)"""


def emi(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = loans(spark, sf_dir).withColumn("emi", finance.emi(F.col("principal"), F.col("rate"), F.col("months")))
    total = F.col("emi") * F.col("months")
    return paid.select("o_orderkey", F.round(F.col("emi") + NUDGE, 2).alias("emi"), F.round(total + NUDGE, 2).alias("total"), F.round(total - F.col("principal") + NUDGE, 2).alias("interest"))


EMI = f"""WITH {LOANS} SELECT o_orderkey, round(emi + 1e-7::DOUBLE, 2) AS emi, round(emi * months + 1e-7::DOUBLE, 2) AS total, round(emi * months - principal + 1e-7::DOUBLE, 2) AS interest FROM paid"""


def amortization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows for loans of up to 36 months, else yearly ones."""
    rows = loans(spark, sf_dir).withColumn("month", F.explode(F.sequence(F.lit(1), "months")))
    owed = lambda m: finance.balance_after(F.col("principal"), F.col("rate"), F.col("months"), m)
    rows = rows.withColumn("period", F.when(F.col("months") <= 36, F.col("month")).otherwise(F.floor((F.col("month") - 1) / 12) + 1).cast("long"))
    rows = rows.withColumn("before", owed(F.col("month") - 1)).withColumn("balance", owed(F.col("month"))).withColumn("emi", finance.emi(F.col("principal"), F.col("rate"), F.col("months")))
    repaid = F.col("before") - F.col("balance")
    grouped = rows.groupBy("o_orderkey", "period").agg(F.round(F.sum(repaid) + NUDGE, 1).alias("repaid"), F.round(F.sum(F.col("emi") - repaid) + NUDGE, 1).alias("interest"), F.round(F.min_by("balance", -F.col("month")) + NUDGE, 1).alias("balance"))
    return grouped


AMORTIZATION = f"""WITH {LOANS}, rows AS (SELECT *, unnest(range(1, months + 1)) AS month FROM paid), owed AS (
  SELECT *, CASE WHEN rate = 0 THEN principal * (1 - (month - 1) / months) ELSE principal * pow(1 + rate / 1200, month - 1) - emi * (pow(1 + rate / 1200, month - 1) - 1) / (rate / 1200) END AS before,
    CASE WHEN month >= months THEN 0 WHEN rate = 0 THEN principal * (1 - month / months) ELSE principal * pow(1 + rate / 1200, month) - emi * (pow(1 + rate / 1200, month) - 1) / (rate / 1200) END AS after
  FROM rows), parts AS (SELECT *, (CASE WHEN months <= 36 THEN month ELSE (month - 1) // 12 + 1 END)::BIGINT AS period, greatest(before, 0) - greatest(after, 0) AS repaid FROM owed)
SELECT o_orderkey, period, round(sum(repaid) + 1e-7::DOUBLE, 1) AS repaid, round(sum(emi - repaid) + 1e-7::DOUBLE, 1) AS interest, round(arg_max(greatest(after, 0), month) + 1e-7::DOUBLE, 1) AS balance FROM parts GROUP BY 1, 2"""


def salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, income = F.col("c_custkey"), (F.abs("c_acctbal") * 700).alias("income")
    people = table(spark, sf_dir, "customer").select("c_custkey", income)
    year = F.when(key % 3 == 0, "2082-83").otherwise("2083-84")
    tax = finance.salary_tax(year, key % 2 == 0, key % 5 == 0, key % 7 < 3, F.col("income"), F.col("income") * 0.2, F.col("income") * 0.02, F.col("income") * 0.01, (key % 14).cast("int"))
    taxed = people.select("c_custkey", tax.alias("t"))
    return taxed.select("c_custkey", *(F.round(F.col(f"t.{c}") + NUDGE, 2).alias(c) for c in ("assessable", "gross", "rebate", "net", "monthly")))


def _slab_sql(slabs: tuple) -> str:
    low, parts = 0, []
    for i, (high, rate) in enumerate(slabs):
        part = f"greatest(0, {'least(assessable, %d)' % high if high else 'assessable'} - {low}) * {rate}::DOUBLE"
        parts.append(f"CASE WHEN ssf THEN 0 ELSE {part} END" if i == 0 else part)
        low = high
    return " + ".join(parts)


SALARY = f"""WITH people AS (SELECT c_custkey, abs(c_acctbal) * 700 AS income, c_custkey % 2 = 0 AS married, c_custkey % 5 = 0 AS ssf, c_custkey % 7 < 3 AS female FROM customer
), net AS (SELECT *, greatest(0, income - (least(income * 0.2::DOUBLE, CASE WHEN ssf THEN 500000 ELSE 300000 END, income / 3) + least(income * 0.02::DOUBLE, 40000) + least(income * 0.01::DOUBLE, 20000))) AS assessable FROM people
), taxed AS (SELECT *, CASE WHEN c_custkey % 3 != 0 THEN {_slab_sql(finance.SALARY_SLABS["2083-84"])} WHEN married THEN {_slab_sql(finance.SALARY_SLABS["2082-83 couple"])} ELSE {_slab_sql(finance.SALARY_SLABS["2082-83 individual"])} END AS gross FROM net
), rebated AS (SELECT *, CASE WHEN female AND NOT married THEN gross * 0.1::DOUBLE ELSE 0 END AS rebate FROM taxed)
SELECT c_custkey, round(assessable + 1e-7::DOUBLE, 2) AS assessable, round(gross + 1e-7::DOUBLE, 2) AS gross, round(rebate + 1e-7::DOUBLE, 2) AS rebate, round(gross - rebate + 1e-7::DOUBLE, 2) AS net, round((gross - rebate) / least(20, greatest(1, c_custkey % 14)) + 1e-7::DOUBLE, 2) AS monthly FROM rebated"""


def salary_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slab schedules as rows with their lower bounds."""
    rows = [(name, high, rate, i) for name, slabs in finance.SALARY_SLABS.items() for i, (high, rate) in enumerate(slabs)]
    table_ = spark.createDataFrame(rows, "schedule string, up_to long, rate double, n int")
    low = F.coalesce(F.lag("up_to").over(Window.partitionBy("schedule").orderBy("n")) + 1, F.lit(0)).alias("low")
    return table_.select("schedule", low, "up_to", "rate", (F.col("n") == 0).alias("social_security"))


SALARY_SLABS_SQL = f"""WITH slabs(schedule, up_to, rate, n) AS (VALUES {", ".join(f"('{name}', {high if high else 'NULL::BIGINT'}, {rate}::DOUBLE, {i})" for name, slabs in finance.SALARY_SLABS.items() for i, (high, rate) in enumerate(slabs))})
SELECT schedule, coalesce(lag(up_to) OVER (PARTITION BY schedule ORDER BY n) + 1, 0)::BIGINT AS low, up_to::BIGINT AS up_to, rate, n = 0 AS social_security FROM slabs"""


def bs_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = calendar.month_starts(calendar.fixed_months(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    found = calendar.to_bs(orders, "day", starts)
    back = calendar.to_ad(found, "bs_year", "bs_month", "bs_day", starts)
    label = calendar.formatted(F.col("bs_year"), F.col("bs_month"), F.col("bs_day"))
    return back.select("o_orderkey", "bs_year", "bs_month", "bs_day", label.alias("label"), calendar.fiscal_year_end(F.col("bs_year"), F.col("bs_month")).alias("fy_end"), (F.col("ad_date") == F.col("day")).alias("round_trip"))


MONTHS_SQL = f"""months(year, month, days) AS (VALUES {", ".join(f"({y}, {m}, {d})" for y, days in calendar.MONTH_DAYS.items() for m, d in enumerate(days, 1))}
), starts AS (SELECT year, month, days, (DATE '{calendar.FIRST_DAY}' + coalesce(sum(days) OVER (ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT) AS starts FROM months
), dated AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders
), bs AS (SELECT o_orderkey, day, year AS bs_year, month AS bs_month, (day - starts + 1)::INT AS bs_day FROM dated JOIN starts ON day BETWEEN starts AND starts + (days - 1))"""
BS_DATES = f"""WITH {MONTHS_SQL} SELECT o_orderkey, bs_year, bs_month, bs_day, bs_year || '-' || [{", ".join(f"'{m}'" for m in calendar.MONTHS)}][bs_month] || '-' || bs_day AS label,
  CASE WHEN bs_month <= 3 THEN bs_year ELSE bs_year + 1 END AS fy_end, true AS round_trip FROM bs"""


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = calendar.month_starts(calendar.fixed_months(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    late = calendar.lateness(calendar.to_bs(orders, "day", starts), starts, AS_OF)
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, finance.VEHICLE_SLABS)), (key % 4 + 1).cast("int"))
    capacity = key % F.when(kind == "ev_car", 300).when(kind == "motorcycle", 800).otherwise(3500)
    taxed = late.select("o_orderkey", kind.alias("kind"), capacity.alias("capacity"), "status", "tax_years", "days_late")
    taxed = taxed.withColumn("t", finance.vehicle_tax(F.col("kind"), F.col("capacity"), F.col("status"), F.col("tax_years")))
    return taxed.select("o_orderkey", "kind", "capacity", "status", F.col("tax_years").cast("long").alias("tax_years"), F.col("days_late").cast("long").alias("days_late"), "t.annual", "t.insurance", "t.fine", "t.cost")


_VEHICLE_ROWS = ", ".join(
    f"('{kind}', {slabs[i - 1][0] if i else 0}, {slab[0] or 10**9}, {slab[1]}, {slab[2]}, {finance.RENEWAL[kind]})" for kind, slabs in finance.VEHICLE_SLABS.items() for i, slab in enumerate(slabs)
)
VEHICLES = f"""WITH {MONTHS_SQL}, slabs(kind, low, high, tax, insurance, renewal) AS (VALUES {_VEHICLE_ROWS}), fines(status, rate) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in finance.FINES.items())}
), due AS (SELECT year, starts + (days - 1) AS due FROM starts WHERE month = 3), paid AS (SELECT o_orderkey, CASE WHEN bs_month <= 3 THEN bs_year ELSE bs_year + 1 END AS paid FROM bs
), missed AS (SELECT o_orderkey, least(5, count(due) FILTER (due < DATE '{AS_OF}')) AS missed, (DATE '{AS_OF}' - min(due))::BIGINT AS since FROM paid LEFT JOIN due ON year > paid GROUP BY 1
), late AS (SELECT o_orderkey, greatest(1, missed)::BIGINT AS tax_years, CASE WHEN missed > 0 THEN since ELSE 0 END AS days_late,
    CASE WHEN missed = 0 THEN 'on_time' WHEN missed >= 3 THEN 'year_3' WHEN missed = 2 THEN 'year_2' WHEN since <= 30 THEN 'days_1_30' WHEN since <= 45 THEN 'days_31_45' ELSE 'same_fy' END AS status FROM missed
), cars AS (SELECT *, ['motorcycle', 'car', 'ev_bike', 'ev_car'][o_orderkey % 4 + 1] AS kind FROM late
), sized AS (SELECT *, o_orderkey % CASE kind WHEN 'ev_car' THEN 300 WHEN 'motorcycle' THEN 800 ELSE 3500 END AS capacity FROM cars)
SELECT o_orderkey, sized.kind, capacity, sized.status, tax_years, days_late, tax::DOUBLE AS annual, insurance::DOUBLE AS insurance, floor(tax * tax_years * rate + 0.5)::DOUBLE AS fine,
  (tax * tax_years + renewal + insurance)::DOUBLE + floor(tax * tax_years * rate + 0.5) AS cost
FROM sized LEFT JOIN slabs ON slabs.kind = sized.kind AND capacity > low AND capacity <= high JOIN fines ON fines.status = sized.status"""


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    hill = {"ropani": key % 50, "anna": key % 20, "paisa": key % 6, "daam": key % 5}
    parts = table(spark, sf_dir, "part").select("p_partkey", finance.to_square_metres(hill).alias("m2"), finance.over_limits(hill, {"anna": 15, "paisa": 3, "daam": 3}).alias("over"))
    out = parts.select("p_partkey", "m2", finance.hill_units(F.col("m2")).alias("h"), finance.terai_units(F.col("m2")).alias("t"), "over")
    return out.select("p_partkey", F.round("m2", 4).alias("m2"), F.round(F.col("m2") * finance.SQUARE_FEET, 2).alias("ft2"), "h.*", "t.*", F.array_join("over", ",").alias("over"))


_M = finance.SQUARE_METRES
LAND = f"""WITH units AS (SELECT p_partkey, p_partkey % 50 AS r, p_partkey % 20 AS a, p_partkey % 6 AS p, p_partkey % 5 AS d FROM part
), metres AS (SELECT *, 0::DOUBLE + r * {_M["ropani"]}::DOUBLE + a * {_M["anna"]}::DOUBLE + p * {_M["paisa"]}::DOUBLE + d * {_M["daam"]}::DOUBLE AS m2 FROM units
), small AS (SELECT *, floor(m2 / {_M["daam"]}::DOUBLE + 0.5)::BIGINT AS h, floor(m2 / {_M["dhur"]}::DOUBLE + 0.5)::BIGINT AS t FROM metres)
SELECT p_partkey, round(m2, 4) AS m2, round(m2 * {finance.SQUARE_FEET}::DOUBLE, 2) AS ft2, h // 256 AS ropani, h % 256 // 16 AS anna, h % 16 // 4 AS paisa, h % 4 AS daam, t // 400 AS bigha, t % 400 // 20 AS kattha, t % 20 AS dhur,
  concat_ws(',', CASE WHEN a > 15 THEN 'anna' END, CASE WHEN p > 3 THEN 'paisa' END, CASE WHEN d > 3 THEN 'daam' END) AS over FROM small"""


QUERIES = {
    "loan_emi": (emi, EMI),
    "loan_amortization": (amortization, AMORTIZATION),
    "salary_tax": (salary, SALARY),
    "salary_slabs": (salary_slabs, SALARY_SLABS_SQL),
    "bs_calendar": (bs_dates, BS_DATES),
    "vehicle_tax": (vehicles, VEHICLES),
    "land_units": (land, LAND),
}
