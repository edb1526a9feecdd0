"""Null-safe column expressions.

Missing values are NULL everywhere; NaN never leaves a source.  Several Spark
built-ins (``greatest``, ``least``, division under ANSI) do not follow the
"missing stays missing" rule the operators need, so the guarded forms live here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_upper(c: Column, limit: float) -> Column:
    """Cap at ``limit``; NULL stays NULL (``least`` would return the limit)."""
    return F.when(c > limit, F.lit(limit)).otherwise(c)


def clip_lower(c: Column, limit: float) -> Column:
    """Floor at ``limit``; NULL stays NULL (``greatest`` would return the limit)."""
    return F.when(c < limit, F.lit(limit)).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def kelvin_to_celsius(c: Column) -> Column:
    return c - 273.15


def heating_degrees(celsius: Column, base: float = 18.0) -> Column:
    return clip_lower(F.lit(base) - celsius, 0.0)


def cooling_degrees(celsius: Column, base: float = 18.0) -> Column:
    return clip_lower(celsius - F.lit(base), 0.0)


def pattern_flag(text: Column, pattern: str) -> Column:
    """1 where the lower-cased text matches, 0 elsewhere and for missing text.

    An alternation of plain words is a chain of substring searches, which is
    several times cheaper than the regular expression on long texts.
    """
    low = F.lower(text)
    words = pattern.split("|")
    if all(w.replace(" ", "").isalnum() for w in words):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
    else:
        hit = low.rlike(pattern)
    return F.coalesce(hit, F.lit(False)).cast("int")


def true_or_zero(condition: Column) -> Column:
    """Boolean to 0/1, with an unknown condition counting as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def share_percent(condition: Column) -> Column:
    """Percent of rows where the condition holds; unknown counts as no."""
    return F.avg(true_or_zero(condition).cast("double")) * 100.0


def log1p_filled(c: Column) -> Column:
    return F.log1p(F.coalesce(c, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero or missing denominator."""
    return F.try_divide(a, b)


def name_token(c: Column) -> Column:
    """Entity name as it may appear inside a column name."""
    return F.regexp_replace(c, " ", "_")


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.replace(c, F.lit(suffix), F.lit(""))


# --- time on a regular step -------------------------------------------------
# These never consult the session time zone: on a zone-free timestamp the date
# and the clock fields are read as written.

def epoch_seconds(ts: Column) -> Column:
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def floor_div(c: Column, n: int) -> Column:
    """Integer division rounding toward minus infinity (for |c| below 2^40)."""
    return F.floor(c / F.lit(float(n)))


def step_of(ts: Column, seconds: int) -> Column:
    return floor_div(epoch_seconds(ts), seconds)


def ts_of_step(step: Column, seconds: int) -> Column:
    span = F.make_dt_interval(secs=(step * F.lit(seconds)).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span


def shift_ts(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def floor_ts(ts: Column, seconds: int) -> Column:
    """Start of the step a timestamp falls into; hours and days need no arithmetic on epochs."""
    if seconds == 86400:
        return F.to_date(ts).cast("timestamp_ntz")
    if seconds == 3600:
        return ts - F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), ts))
    return ts_of_step(step_of(ts, seconds), seconds)
