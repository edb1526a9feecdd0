"""Differences of an order that the tests choose for each series, in one plan for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronolith.operators.grid import Grid, over_spans
from chronolith.operators.signal import kpss_p_value, span_tests, verdict
from chronolith.operators.stats import join_groups

#: Stages from the weakest to the strongest: none, seasonal, seasonal and first differences.
STAGES = ("raw", "D1", "d1_D1")


def _stages(df: DataFrame, grid: Grid, value: str, season: int) -> DataFrame:
    """Adds _raw, _D1 and _d1_D1; rows without a value do not count (offsets are rows)."""
    def stage(f):
        y, s = F.col(value).cast("double"), f.at(value, -season)
        return {"_raw": y, "_D1": y - s, "_d1_D1": y - s - (f.at(value, -1) - f.at(value, -season - 1))}
    return over_spans(df.where(F.col(value).isNotNull()), grid, stage, back=season + 1, mode="row")


def differencing_orders(df: DataFrame, grid: Grid, value: str = "y", season: int = 24, max_lag: int = 48, n_lags: int = 72,
                        tests: str = "both", alpha: float = 0.05) -> DataFrame:
    """(series, stage): the first of STAGES that is stationary, the last one where none is.

    tests "both" wants ADF and KPSS to agree (as `verdict` says), "kpss" that KPSS does not reject.  Stages too short to be
    tested do not count as stationary.  The stage is one more key of the panel, so the tests run once for all.
    """
    entries = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("_order"), F.col(f"_{s}").alias("_v")) for k, s in enumerate(STAGES)])
    panel = _stages(df, grid, value, season).select(*grid.by, grid.ts, F.inline(entries)).where("_v IS NOT NULL")
    staged = Grid(by=(*grid.by, "stage", "_order"), ts=grid.ts, step=grid.step)
    if tests == "kpss":
        done = span_tests(panel, staged, "_v", kpss_lag=n_lags)
        good = kpss_p_value(F.col("kpss_stat")) > alpha
    else:
        done = span_tests(panel, staged, "_v", adf_lag=max_lag, kpss_lag=n_lags)
        good = verdict(F.col("adf.p_value"), kpss_p_value(F.col("kpss_stat")), alpha) == "stationary: d=0"
    # One row for each series and stage.
    chosen = done.withColumn("_good", F.coalesce(good, F.lit(False))).groupBy(*grid.by).agg(
        F.min(F.when(F.col("_good"), F.col("_order"))).alias("_o"))
    return chosen.select(*grid.by, F.get(F.array(*[F.lit(s) for s in STAGES]), F.coalesce("_o", F.lit(len(STAGES) - 1))).alias("stage"))


def apply_differencing(df: DataFrame, grid: Grid, orders: DataFrame, value: str = "y", season: int = 24, name: str = "z") -> DataFrame:
    """The rows with a value, with the stage of their series and its difference `name` (NULL while it warms up).

    A series without an order, in `orders` (series, stage), keeps its values.
    """
    wide = join_groups(_stages(df, grid, value, season), orders.select(*grid.by, "stage"), list(grid.by), "left")
    wide = wide.withColumn("stage", F.coalesce("stage", F.lit(STAGES[0])))
    picked = F.coalesce(*[F.when(F.col("stage") == s, F.col(f"_{s}")) for s in STAGES])
    return wide.withColumn(name, picked).drop(*[f"_{s}" for s in STAGES])


def restore_levels(df: DataFrame, grid: Grid, value: str = "y", forecast: str = "z_pred", season: int = 24, name: str = "y_pred") -> DataFrame:
    """A one-step forecast of the chosen difference back on the scale of the values: adds `name`.

    `df` has the stage and the actual values; only values before a row are used for it.
    """
    def level(f):
        last, seasonal, both = f.at(value, -1), f.at(value, -season), f.at(value, -season - 1)
        return {name: F.coalesce(F.when(F.col("stage") == "raw", F.col(forecast)), F.when(F.col("stage") == "D1", F.col(forecast) + seasonal),
                                 F.when(F.col("stage") == "d1_D1", F.col(forecast) + seasonal + last - both))}
    return over_spans(df.where(F.col(value).isNotNull()), grid, level, back=season + 1, mode="row")
