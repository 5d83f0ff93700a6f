"""Loans, salary tax, vehicle tax and land units as column expressions.

Amounts are doubles. round_half_up rounds halves towards plus infinity, as the portal's calculators do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tax slabs (upper bound, rate) by year and status; the first slab is the social security tax.
SALARY_SLABS = {
    "2083-84": ((1_000_000, 0.01), (1_500_000, 0.10), (2_500_000, 0.20), (4_000_000, 0.27), (None, 0.29)),
    "2082-83 individual": ((500_000, 0.01), (700_000, 0.10), (1_000_000, 0.20), (2_000_000, 0.30), (5_000_000, 0.36), (None, 0.39)),
    "2082-83 couple": ((600_000, 0.01), (800_000, 0.10), (1_100_000, 0.20), (2_100_000, 0.30), (5_100_000, 0.36), (None, 0.39)),
}
#: Caps of deductions.
RETIREMENT_CAP, RETIREMENT_CAP_SSF, LIFE_CAP, MEDICAL_CAP = 300_000, 500_000, 40_000, 20_000
#: Fixed values: (capacity up to, tax, insurance) by vehicle type, the renewal charge, and the fine by lateness.
VEHICLE_SLABS = {
    "motorcycle": ((125, 3_000, 1_415), (150, 5_000, 1_715), (225, 6_500, 2_015), (400, 11_000, 3_500), (650, 20_000, 5_500), (None, 30_000, 7_500)),
    "car": ((1_000, 22_000, 6_500), (1_500, 25_000, 8_500), (2_000, 27_000, 10_500), (2_500, 37_000, 14_000), (2_900, 50_000, 18_000), (None, 65_000, 25_000)),
    "ev_bike": ((1_000, 1_500, 800), (1_500, 2_000, 1_200), (None, 3_000, 1_500)),
    "ev_car": ((49, 10_000, 4_000), (125, 15_000, 8_000), (225, 20_000, 10_000), (None, 30_000, 12_000)),
}
RENEWAL = {"motorcycle": 300, "ev_bike": 300, "car": 500, "ev_car": 500}
FINES = {"on_time": 0.0, "days_1_30": 0.05, "days_31_45": 0.10, "same_fy": 0.20, "year_1": 0.32, "year_2": 0.64, "year_3": 0.96}
#: Square metres of a unit, square feet of a square metre.
SQUARE_METRES = {"ropani": 508.7374778, "anna": 31.7960924, "paisa": 7.9490231, "daam": 1.9872558, "bigha": 6772.6315789, "kattha": 338.6315789, "dhur": 16.9315789}
SQUARE_FEET = 10.7639104167


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def emi(principal: Column, annual_rate: Column, months: Column) -> Column:
    """The equal monthly instalment; null for what is no loan."""
    rate = annual_rate / 1200
    factor = F.pow(1 + rate, months)
    paid = F.when(annual_rate == 0, principal / months).otherwise(principal * rate * factor / F.nullif(factor - 1, F.lit(0.0)))
    return F.when((principal > 0) & (months > 0) & (annual_rate >= 0), paid)


def balance_after(principal: Column, annual_rate: Column, months: Column, month: Column) -> Column:
    """What is owed after a month's instalment, in closed form."""
    rate = annual_rate / 1200
    grown = F.pow(1 + rate, month)
    owed = F.when(annual_rate == 0, principal * (1 - month / months)).otherwise(principal * grown - emi(principal, annual_rate, months) * (grown - 1) / F.nullif(rate, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.when(month >= months, F.lit(0.0)).otherwise(owed))


def slab_tax(income: Column, slabs: tuple, waive_first: Column) -> Column:
    """Progressive tax: each slab taxes its part of the income."""
    total, low = F.lit(0.0), 0
    for i, (high, rate) in enumerate(slabs):
        part = F.greatest(F.lit(0.0), (F.least(income, F.lit(float(high))) if high else income) - low)
        tax = part * rate
        total = total + (F.when(waive_first, F.lit(0.0)).otherwise(tax) if i == 0 else tax)
        low = high
    return total


def salary_tax(year: Column, married: Column, ssf: Column, female: Column, income: Column, retirement: Column, life: Column, medical: Column, months: Column) -> Column:
    """A struct: assessable, gross, rebate, net, monthly."""
    income = F.greatest(F.lit(0.0), income)
    cap = F.when(ssf, F.lit(float(RETIREMENT_CAP_SSF))).otherwise(float(RETIREMENT_CAP))
    at_most = lambda x, most: F.least(F.greatest(F.lit(0.0), x), most)
    deducted = at_most(retirement, F.least(cap, income / 3)) + at_most(life, F.lit(float(LIFE_CAP))) + at_most(medical, F.lit(float(MEDICAL_CAP)))
    assessable = F.greatest(F.lit(0.0), income - deducted)
    gross = F.when(year == "2083-84", slab_tax(assessable, SALARY_SLABS["2083-84"], ssf)).when(married, slab_tax(assessable, SALARY_SLABS["2082-83 couple"], ssf))
    gross = gross.otherwise(slab_tax(assessable, SALARY_SLABS["2082-83 individual"], ssf))
    rebate = F.when(female & ~married, gross * 0.1).otherwise(0.0)
    net = F.greatest(F.lit(0.0), gross - rebate)
    return F.struct(assessable.alias("assessable"), gross.alias("gross"), rebate.alias("rebate"), net.alias("net"), (net / F.least(F.lit(20), F.greatest(F.lit(1), months))).alias("monthly"))


def of_slab(kind: Column, capacity: Column, field: int) -> Column:
    """The field of the first slab that holds the capacity; null for a capacity of zero or less."""
    out = F.lit(None).cast("double")
    for name, slabs in VEHICLE_SLABS.items():
        found = F.lit(float(slabs[-1][field]))
        for slab in reversed(slabs[:-1]):
            found = F.when(capacity <= slab[0], F.lit(float(slab[field]))).otherwise(found)
        out = F.when(kind == name, found).otherwise(out)
    return F.when(capacity > 0, out)


def fine_rate(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FINES.items() for x in pair))[status]


def vehicle_tax(kind: Column, capacity: Column, status: Column, years: Column) -> Column:
    """A struct: annual, insurance, renewal, total, fine, cost."""
    annual, insurance = of_slab(kind, capacity, 1), of_slab(kind, capacity, 2)
    renewal = F.create_map(*(F.lit(x) for k, v in RENEWAL.items() for x in (k, float(v))))[kind]
    total = annual * years
    fine = round_half_up(total * fine_rate(status)).cast("double")
    return F.struct(annual.alias("annual"), insurance.alias("insurance"), renewal.alias("renewal"), total.alias("total"), fine.alias("fine"), (total + renewal + insurance + fine).alias("cost"))


def to_square_metres(units: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, value in units.items():
        total = total + F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))) * SQUARE_METRES[name]
    return total


def hill_units(square_metres: Column) -> Column:
    """A struct: ropani, anna, paisa, daam."""
    n = F.greatest(F.lit(0), round_half_up(square_metres / SQUARE_METRES["daam"]))
    return F.struct(F.floor(n / 256).alias("ropani"), F.floor(n % 256 / 16).alias("anna"), F.floor(n % 16 / 4).alias("paisa"), (n % 4).alias("daam"))


def terai_units(square_metres: Column) -> Column:
    """A struct: bigha, kattha, dhur."""
    n = F.greatest(F.lit(0), round_half_up(square_metres / SQUARE_METRES["dhur"]))
    return F.struct(F.floor(n / 400).alias("bigha"), F.floor(n % 400 / 20).alias("kattha"), (n % 20).alias("dhur"))


def over_limits(units: dict[str, Column], limits: dict[str, int]) -> Column:
    """The names of the units beyond their limits."""
    return F.filter(F.array(*(F.when(units[k] > most, F.lit(k)) for k, most in limits.items())), lambda k: k.isNotNull())
