"""The exchange's trading calendar as DataFrames, made of date expressions.

Rules: weekends; fixed holidays move from Saturday to Friday and from Sunday to Monday, but New Year's Day on a
Saturday is not observed; Juneteenth from 2022; Good Friday by the computus; single closures as listed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closures that follow no rule.
SPECIAL_CLOSURES = ("2018-12-05",)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def _last(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def _observed(day: Column, saturday: bool = True) -> Column:
    """dayofweek: Sunday 1 .. Saturday 7."""
    on_saturday = F.date_sub(day, 1) if saturday else F.lit(None).cast("date")
    return F.when(F.dayofweek(day) == 7, on_saturday).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def _good_friday(year: Column) -> Column:
    """Two days before Easter Sunday (anonymous Gregorian algorithm)."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    whole = h + m - 7 * n + 114
    return F.date_sub(F.make_date(year, div(whole, 31), whole % 31 + 1), 2)


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, holiday) by rule."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    y = F.col("y")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    named = {
        "new_year": _observed(fixed(1, 1), saturday=False),
        "mlk": _nth(y, 1, "MON", 3),
        "presidents": _nth(y, 2, "MON", 3),
        "good_friday": _good_friday(y),
        "memorial": _last(y, 5, "MON"),
        "juneteenth": F.when(y >= 2022, _observed(fixed(6, 19))),
        "independence": _observed(fixed(7, 4)),
        "labor": _nth(y, 9, "MON", 1),
        "thanksgiving": _nth(y, 11, "THU", 4),
        "christmas": _observed(fixed(12, 25)),
    }
    pairs = F.array(*(F.struct(c.alias("date"), F.lit(k).alias("holiday")) for k, c in named.items()))
    by_rule = years.select(F.explode(pairs).alias("h")).select("h.*").where("date is not null")
    special = spark.createDataFrame([(date.fromisoformat(d), "special") for d in SPECIAL_CLOSURES], "date date, holiday string")
    return by_rule.unionByName(special.where(F.year("date").between(first_year, last_year)))


def _days(spark: SparkSession, start: str, end: str) -> DataFrame:
    if date.fromisoformat(start) > date.fromisoformat(end):
        return spark.createDataFrame([], "date date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def closed_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date) of all closed days from start to end, both included: weekends and holidays."""
    days = _days(spark, start, end)
    known = holidays(spark, date.fromisoformat(start).year, date.fromisoformat(end).year).select("date").distinct()
    return days.where(F.dayofweek("date").isin(1, 7)).union(days.join(known, "date", "left_semi")).distinct()


def trading_sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date, session_idx) of the sessions from start to end; session_idx from 0. A row a day: small."""
    open_days = _days(spark, start, end).join(closed_dates(spark, start, end), "date", "left_anti")
    return open_days.withColumn("session_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def calendar_differences(spark: SparkSession, expected: DataFrame, start: str, end: str) -> DataFrame:
    """(date, side) of closed weekdays that only one of the rules and a given list have."""
    ours = closed_dates(spark, start, end).where(~F.dayofweek("date").isin(1, 7))
    theirs = expected.select("date").where(~F.dayofweek("date").isin(1, 7))
    return ours.exceptAll(theirs).withColumn("side", F.lit("rules")).unionByName(theirs.exceptAll(ours).withColumn("side", F.lit("list")))
