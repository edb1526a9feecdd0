"""Quantile bands that move with the days: exact order statistics of the latest residuals, per series and time of day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.functions.columns import epoch_seconds, floor_div
from chronolith.operators.backtest import walk_forward_retrain
from chronolith.operators.grid import DAY, Grid, over_spans
from chronolith.operators.models import TAUS


def sorted_quantile(values: Column, tau: float) -> Column:
    """Linear interpolation between the order statistics of a sorted array; NULL for an empty one."""
    at = (F.size(values) - 1) * F.lit(float(tau))
    low = F.floor(at).cast("int")
    below, above = F.get(values, low), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, below + (at - low) * (above - below))


def rolling_bands(predictions: DataFrame, grid: Grid, start: str, window_days: int = 28, min_rows: int = 5,
                  retrain_every: int = 1, y: str = "y", y_pred: str = "y_pred", taus: Iterable[float] = TAUS) -> DataFrame:
    """Adds q05, q50, q95 (named by level): the forecast plus quantiles of the residuals before its fold.

    Folds are stretches of `retrain_every` days from `start` on.  A fold's bands come from the residuals of the same series
    and time of day on the `window_days` days before the fold, so nothing that happens in it or later moves them.  With
    fewer than `min_rows` residuals the bands are NULL; levels cannot cross, since they are read from one sorted array.

    One time of day of a series is a daily grid of its own, cut into spans: no task holds a series, and a row's
    frame holds `window_days` + `retrain_every` - 1 residuals at most.
    """
    taus = sorted(taus)
    ts = F.col(grid.ts)
    day0 = F.unix_date(F.to_date(F.lit(start).cast("timestamp_ntz")))
    day = F.unix_date(F.to_date(ts))
    daily = Grid(by=(*grid.by, "_slot"), ts="_day", step=DAY)
    data = predictions.withColumns({
        "_slot": F.pmod(epoch_seconds(ts), F.lit(DAY)), "_day": F.to_date(ts).cast("timestamp_ntz"), "_date": day,
        "_first": day0 + floor_div(day - day0, retrain_every) * retrain_every,
        "_residual": F.col(y).cast("double") - F.col(y_pred).cast("double")})
    reach = window_days + retrain_every - 1

    def held(f):
        entry = F.when(F.col("_residual").isNotNull(), F.struct(F.col("_date").alias("d"), F.col("_residual").alias("r")))
        return {"_held": F.collect_list(entry).over(f.frame(-reach, -1))}

    def levels(_):
        inside = F.filter("_held", lambda e: (e["d"] < F.col("_first")) & (e["d"] >= F.col("_first") - window_days))
        return {"_sorted": F.array_sort(F.transform(inside, lambda e: e["r"]))}

    out = over_spans(data, daily, held, levels, back=reach)
    enough = F.size("_sorted") >= max(min_rows, 1)
    bands = {f"q{round(t * 100):02d}": F.when(enough, F.col(y_pred) + sorted_quantile(F.col("_sorted"), t)) for t in taus}
    return out.withColumns(bands).drop("_slot", "_day", "_date", "_first", "_residual", "_held", "_sorted")


def walk_forward_quantiles(df: DataFrame, grid: Grid, xs: Iterable[str], start: str, y: str = "y", retrain_every: int = 1,
                           ridge: float = 0.0, window_days: int = 28, min_rows: int = 5, taus: Iterable[float] = TAUS) -> DataFrame:
    """Daily (or every `retrain_every` days) refitted point forecasts with bands from the folds before; adds fold,
    y_pred and a column for each level.

    The rows from `start` on come out.  Bands need residuals of earlier folds, so the first ones are NULL.
    """
    point = walk_forward_retrain(df, grid, xs, start, y, retrain_every, ridge)
    return rolling_bands(point, grid, start, window_days, min_rows, retrain_every, y, "y_pred", taus)


def coverage(banded: DataFrame, by: Iterable[str] = (), y: str = "y", lower: str = "q05", upper: str = "q95") -> DataFrame:
    """(by, n, covered_pct, mean_width): rows with bands, how many hold the actual, and how wide they are."""
    inside = (F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper))
    return (banded.where(F.col(lower).isNotNull() & F.col(upper).isNotNull() & F.col(y).isNotNull()).groupBy(*by)
            .agg(F.count("*").alias("n"), (F.avg(inside.cast("int")) * 100.0).alias("covered_pct"),
                 F.avg(F.col(upper) - F.col(lower)).alias("mean_width")))
