"""Calendar fields, cyclical encodings and holiday tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronolith.functions.columns import true_or_zero

# Encoding periods of hour-of-day, day-of-week and day-of-year.
PERIODS = {"hour": 24.0, "dow": 7.0, "doy": 365.25}

# National holidays as (month, day, name).
NATIONAL_FIXED = [
    (1, 1, "New Year"),
    (1, 6, "Epiphany"),
    (5, 1, "Labour Day"),
    (8, 15, "Assumption"),
    (10, 12, "National Day"),
    (11, 1, "All Saints"),
    (12, 6, "Constitution Day"),
    (12, 8, "Immaculate Conception"),
    (12, 25, "Christmas Day"),
]
# Holidays as (days after Easter Sunday, name).
NATIONAL_EASTER = [(-2, "Good Friday")]


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), day of year and month."""
    return {"hour": F.hour(ts), "dow": F.weekday(ts), "doy": F.dayofyear(ts), "month": F.month(ts)}


def cyclical(c: Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = c * F.lit(2.0 * math.pi * harmonic / period)
    return F.sin(angle), F.cos(angle)


def cyclical_columns(ts: Column) -> dict[str, Column]:
    parts = calendar_parts(ts)
    out: dict[str, Column] = {}
    for part, period in PERIODS.items():
        out[f"{part}_sin"], out[f"{part}_cos"] = cyclical(parts[part], period)
    return out


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def with_easter(df: DataFrame, year: str = "year", name: str = "easter") -> DataFrame:
    """Gregorian Easter Sunday by the anonymous computus, in steps that are each computed once."""
    def q(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)).cast("int")

    y, c = F.col(year), F.col
    steps = [
        {"_golden": y % 19, "_century": q(y, 100), "_rest": y % 100},
        {"_corr": q(c("_century") + 8, 25)},
        {"_moon": (c("_golden") * 19 + c("_century") - q(c("_century"), 4)
                   - q(c("_century") - c("_corr") + 1, 3) + 15) % 30},
        {"_week": (F.lit(32) + (c("_century") % 4) * 2 + q(c("_rest"), 4) * 2 - c("_moon") - c("_rest") % 4) % 7},
        {"_late": q(c("_golden") + c("_moon") * 11 + c("_week") * 22, 451)},
        {"_day0": c("_moon") + c("_week") - c("_late") * 7 + 114},
        {name: F.make_date(y, q(c("_day0"), 31), c("_day0") % 31 + 1)},
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, name)


def holiday_table(spark: SparkSession, first_year: int, last_year: int,
                  fixed=None, easter=None) -> DataFrame:
    """(date, name) for every listed holiday in a range of years.

    The row count is years x list length, whatever the size of the data.
    """
    fixed = NATIONAL_FIXED if fixed is None else fixed
    easter = NATIONAL_EASTER if easter is None else easter
    years = with_easter(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year")))
    year = F.col("year")
    rows = [F.struct(F.make_date(year, F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("name"))
            for m, d, n in fixed]
    rows += [F.struct(F.date_add("easter", off).alias("date"), F.lit(n).alias("name"))
             for off, n in easter]
    return years.select(F.inline(F.array(*rows)))


def holidays_for(df: DataFrame, ts: str = "ts", fixed=None, easter=None) -> DataFrame:
    """Holidays of all years in which the data lies, and of the neighbouring years for their bridge days.

    One aggregate row is read back, the first and the last date.
    """
    first, last = df.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
    return holiday_table(df.sparkSession, (first or 1970) - 1, (last or 1970) + 1, fixed, easter)


def day_flags(holidays: DataFrame) -> DataFrame:
    """One row per flagged date: is_holiday and is_bridge_day.

    A bridge day is the Monday before a Tuesday holiday or the Friday after a
    Thursday holiday, so it is derived from the holiday table itself and the
    data needs a single join for both flags.
    """
    day = F.col("date")
    none = F.lit(None).cast("date")
    bridge = (F.when(F.weekday(day) == 1, F.date_sub(day, 1))
              .when(F.weekday(day) == 3, F.date_add(day, 1)).otherwise(none))
    marks = F.array(
        F.struct(day.alias("date"), F.lit(1).alias("h"), F.lit(0).alias("b")),
        F.struct(bridge.alias("date"), F.lit(0).alias("h"), F.lit(1).alias("b")))
    return (holidays.select(F.inline(marks)).where("date IS NOT NULL")
            .groupBy("date")
            .agg(F.max("h").alias("is_holiday"), F.max("b").alias("is_bridge_day")))


def with_day_flags(df: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach is_holiday and is_bridge_day by date (0 where nothing matches).

    No broadcast hint: the planner sizes the flag table and broadcasts it only
    below its threshold.
    """
    flags = day_flags(holidays).withColumnRenamed("date", "_day")
    return (df.withColumn("_day", F.to_date(ts)).join(flags, "_day", "left").drop("_day")
            .withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
            .withColumn("is_bridge_day", F.coalesce("is_bridge_day", F.lit(0))))


def with_holiday(df: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach is_holiday alone."""
    days = holidays.select(F.col("date").alias("_day"), F.lit(1).alias("is_holiday")).distinct()
    return (df.withColumn("_day", F.to_date(ts)).join(days, "_day", "left").drop("_day")
            .withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0))))


def positional_bridge(frame, ts: str = "ts", flag: str = "is_holiday", day: int = 24) -> Column:
    """Bridge flag from shifted rows instead of dates.

    ``frame`` is the span frame of :func:`chronolith.operators.grid.over_spans`
    in row mode with ``day`` rows of history and of look-ahead.
    """
    tomorrow = F.coalesce(frame.at(flag, day), F.lit(0)) == 1
    yesterday = F.coalesce(frame.at(flag, -day), F.lit(0)) == 1
    dow = F.weekday(ts)
    return true_or_zero(((dow == 0) & tomorrow) | ((dow == 4) & yesterday))
