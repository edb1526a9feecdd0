"""Error profile of a probabilistic forecast against a benchmark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from chronolith.functions.calendar import with_day_flags
from chronolith.operators.leaderboard import forecast_vs_benchmark


def compared_hours(predictions: DataFrame, benchmark: DataFrame, holidays: DataFrame, keys: Iterable[str],
                   ts: str = "ts") -> DataFrame:
    """Forecast, benchmark, errors, win flag and calendar flags per hour."""
    return with_day_flags(forecast_vs_benchmark(predictions, benchmark, keys), holidays, ts)


def error_profile(predictions: DataFrame, benchmark: DataFrame, holidays: DataFrame, keys: Iterable[str],
                  by: Iterable[str] = ("series_id",), ts: str = "ts") -> DataFrame:
    """(series, section, hour, ...): overall, holiday and hour-of-day sections in one table.

    The joined hours are aggregated once, by hour of day and flag; the sections
    are sums of these cells, at most 48 for each series.
    """
    by = list(by)
    hours = compared_hours(predictions, benchmark, holidays, keys, ts)
    flagged = (F.col("is_holiday") == 1) | (F.col("is_bridge_day") == 1)
    measures = {"model_mae": "model_error", "benchmark_mae": "benchmark_error", "win_pct": "win"}
    cells = hours.groupBy(*by, F.hour(ts).alias("_hour"), flagged.alias("_flagged")).agg(
        F.count("*").alias("_n"), *[f(c).alias(f"_{k}_{name}") for name, c in measures.items()
                                    for k, f in (("sum", F.sum), ("cnt", F.count))])
    none = F.lit(-1)
    sections = F.array(F.struct(F.lit("overall").alias("section"), none.alias("hour")),
                       F.struct(F.lit("hour").alias("section"), F.col("_hour").alias("hour")),
                       F.struct(F.when(F.col("_flagged"), F.lit("holiday")).alias("section"), none.alias("hour")))
    placed = cells.select("*", F.inline(sections)).where("section IS NOT NULL")
    means = {name: F.try_divide(F.sum(f"_sum_{name}"), F.sum(f"_cnt_{name}")) for name in measures}
    means["win_pct"] = means["win_pct"] * 100.0
    return placed.groupBy(*by, "section", "hour").agg(
        F.sum("_n").alias("n_hours"), *[c.alias(name) for name, c in means.items()])
