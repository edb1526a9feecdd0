"""Forecasts several steps from an origin: step k uses the forecasts of the steps before it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.functions.columns import floor_div, ts_of_step
from chronolith.operators.grid import Grid, span_arrays, span_length
from chronolith.operators.models import fit_panel
from chronolith.operators.stats import join_groups
from chronolith.operators.windows import lag_features


def fit_lags(train: DataFrame, grid: Grid, lags: Iterable[int], y: str = "y", ridge: float = 0.0) -> DataFrame:
    """(series, beta): y regressed on its own lags, one fit for each series."""
    lags = list(lags)
    frame = lag_features(train, grid, y, lags=lags, prefix="_lag_")
    return fit_panel(frame, list(grid.by), [f"_lag_{k}" for k in lags], y, ridge)


def recursive_forecast(df: DataFrame, coefficients: DataFrame, grid: Grid, lags: Iterable[int], start: str, horizon: int = 24,
                       stride: int | None = None, y: str = "y") -> DataFrame:
    """(series, origin, ts, step, y_true, y_pred): forecasts of steps 1 to `horizon` from every origin.

    An origin is the last known step; the first is the step before `start`, further ones follow every `stride` steps
    (default: the horizon) while there is a row after them.  Actuals after the origin are never used: a lag that reaches
    behind it takes the forecast made there.  A missing actual among the lags, or a series without a fit, gives NULL
    forecasts.  Steps without a row in `df` are left out.

    A span of a series is one array; each of its origins folds over its own slice, so no step is a job and no join is
    made by step.  The grid must be regular (`regularize`).
    """
    lags = sorted(lags)
    stride = stride or horizon
    back = max(lags)
    first = floor_div(F.unix_date(F.to_date(F.lit(start).cast("timestamp_ntz"))).cast("long") * 86400
                      + F.hour(F.lit(start).cast("timestamp_ntz")) * 3600 + F.minute(F.lit(start).cast("timestamp_ntz")) * 60, grid.step)
    # A span must hold the lags before its origins and the horizon after them.
    arrays = span_arrays(df, grid, y, back, horizon, "time", span_length(back, horizon))
    own, n_own, begin = F.col("own"), F.col("n_own"), F.col("first")
    # Index of an origin inside the array: its step is begin + index; the next step belongs to the span.
    low = F.greatest(own, (first - begin).cast("int"))
    low = low + F.pmod(first - begin - low, F.lit(stride)).cast("int")
    high = own + n_own - 1
    ready = join_groups(arrays.withColumns({"_low": low, "_high": high}).where("_low <= _high"),
                        coefficients.select(*grid.by, "beta"), list(grid.by), "left")

    def forecast(target: Column) -> Column:
        # The last `back` values before the first target step, oldest first; too short a history is filled with NULL.
        missing = F.greatest(F.lit(back) - target, F.lit(0))
        known = F.concat(F.array_repeat(F.lit(None).cast("double"), missing),
                         F.slice(F.col("values"), (target - F.lit(back) + missing + 1).cast("int"), (F.lit(back) - missing).cast("int")))

        def step(held, _):
            value = F.col("beta")[0]
            for i, lag in enumerate(lags, start=1):
                value = value + F.col("beta")[i] * F.element_at(held, -lag)
            return F.concat(held, F.array(value))
        return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), known, step), back + 1, horizon)

    origins = F.transform(F.sequence("_low", "_high", F.lit(stride)), lambda i: F.struct(
        (begin + i - 1).alias("origin"), forecast(i).alias("path"), F.slice(F.col("values"), (i + 1).cast("int"), horizon).alias("actual")))
    rows = ready.select(*grid.by, F.inline(origins))
    steps = rows.select(*grid.by, "origin", "actual", F.posexplode("path").alias("_k", "y_pred"))
    return (steps.where(F.col("_k") < F.size("actual"))
            .select(*grid.by, ts_of_step(F.col("origin"), grid.step).alias("origin"),
                    ts_of_step(F.col("origin") + 1 + F.col("_k"), grid.step).alias(grid.ts), (F.col("_k") + 1).alias("step"),
                    F.get(F.col("actual"), F.col("_k")).alias("y_true"), "y_pred"))
