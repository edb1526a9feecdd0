"""Error metrics, rolling-origin scoring and daily-retrain backtests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from chronolith.functions.columns import epoch_seconds, floor_div, ratio
from chronolith.operators.align import asof_join
from chronolith.operators.grid import Grid
from chronolith.operators.models import collect_cells, gram_cells, linear_coefficients, linear_value
from chronolith.operators.stats import join_groups

PREDICTION_COLUMNS = ("model", "series_id", "ts", "y_true", "y_pred", "q05", "q50", "q95")


def mae_mape(df: DataFrame, by: Iterable[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """MAE and MAPE in percent over pairs with both sides present.

    A zero actual has no percentage error: it stays out of the MAPE and is counted.
    """
    y, p = F.col(y_true), F.col(y_pred)
    err = F.abs(y - p)
    return (df.where(y.isNotNull() & p.isNotNull()).groupBy(*by)
            .agg(F.count("*").alias("n"), F.avg(err).alias("mae"),
                 (F.avg(ratio(err, F.abs(y))) * 100.0).alias("mape"),
                 F.count_if(y == 0).alias("n_zero_actual")))


def rolling_origin(df: DataFrame, grid: Grid, start: str, horizon: int = 24,
                   keys: Iterable[str] = (), ragged: str = "drop") -> DataFrame:
    """Number each prediction by origin block and step within it (1..horizon).

    "drop" removes blocks that are not complete, "keep" leaves them in.  A block
    is at most ``horizon`` rows, so the completeness window is small.
    """
    first = floor_div(epoch_seconds(F.lit(start).cast("timestamp_ntz")), grid.step)
    offset = grid.step_index() - first
    out = (df.where(F.col(grid.ts) >= F.lit(start).cast("timestamp_ntz"))
           .withColumn("origin", floor_div(offset, horizon))
           .withColumn("horizon", (F.pmod(offset, F.lit(horizon)) + 1).cast("int")))
    if ragged == "drop":
        block = Window.partitionBy(*keys, *grid.by, "origin")
        out = out.repartition(*keys, *grid.by, "origin").withColumn("_n", F.count("*").over(block)).where(F.col("_n") == horizon).drop("_n")
    return out


def rolling_origin_score(df: DataFrame, grid: Grid, start: str, horizon: int = 24,
                         keys: Iterable[str] = ("model",), ragged: str = "drop") -> DataFrame:
    blocks = rolling_origin(df, grid, start, horizon, keys, ragged)
    return mae_mape(blocks, [*keys, "horizon"])


def score_model(model, df: DataFrame, name: str, grid: Grid, y: str = "y", params: DataFrame | None = None,
                scaled_as: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Predictions table of a fitted or loaded pipeline; undoes target scaling if parameters are given."""
    from chronolith.operators.models import predict
    from chronolith.operators.scale import scale_invert

    out = predict(model, df).select(*grid.by, grid.ts, F.col(f"`{y}`").alias("y_true"), "y_pred")
    if params is not None:
        src = scaled_as or y
        out = scale_invert(out, params, {"y_true": src, "y_pred": src}, by)
    return out.select(F.lit(name).alias("model"), *grid.by, grid.ts, "y_true", "y_pred")


def score_status(expected: DataFrame, predictions: DataFrame, by: Iterable[str] = ("series_id",)) -> DataFrame:
    """(model, series, ok, n_scored) for every expected pair; a missing model is a row, not a failure."""
    keys = ["model", *by]
    counts = (predictions.where(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
              .groupBy(*keys).agg(F.count("*").alias("n_scored")))
    return (expected.select(*keys).distinct().join(counts, keys, "left")
            .withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
            .withColumn("ok", F.col("n_scored") > 0).select(*keys, "ok", "n_scored"))


def fold_coefficients(df: DataFrame, grid: Grid, xs: Iterable[str], start: str, y: str = "y", retrain_every: int = 1,
                      ridge: float = 0.0, centre: list[float] | None = None) -> DataFrame:
    """(series, fold, beta): the fit of every fold on all rows before it; folds with too little history have no row.

    All folds come out of one job: small cross-product matrices per series and fold block, folded where the rows are
    read (everything before ``start`` is one block), running sums of their cells over the blocks before each fold, and one
    small solve per fold.  A cell of a series has one row per fold, so the running sum is bounded by the calendar.
    ``centre`` holds a value near the mean of each regressor and the target (a scaler's means, say): products are then
    taken around it.
    """
    xs, by = list(xs), list(grid.by)
    width = len(xs) + 2
    data = with_fold(df, grid, start, retrain_every)
    cells = gram_cells(data, [*by, "_fold"], xs, y, centre)
    # Folds without a complete row still need a model: they enter with empty matrices.
    wanted = data.where("_fold >= 0").select(*by, "_fold").distinct()
    empty = wanted.select(*by, "_fold", F.explode(F.sequence(F.lit(0), F.lit(width * (width + 1) // 2 - 1))).alias("_i"), F.lit(0.0).alias("_v"))
    blocks = cells.unionByName(empty).groupBy(*by, "_i", "_fold").agg(F.sum("_v").alias("_v"))
    before = Window.partitionBy(*by, "_i").orderBy("_fold").rowsBetween(Window.unboundedPreceding, -1)
    running = blocks.withColumn("_v", F.coalesce(F.sum("_v").over(before), F.lit(0.0))).where("_fold >= 0")
    history = collect_cells(running, [*by, "_fold"]).where(F.col("gram")[0] > len(xs) + 1)
    return linear_coefficients(history, width, ridge=ridge, shift=centre)


def with_fold(df: DataFrame, grid: Grid, start: str, retrain_every: int) -> DataFrame:
    """Adds _fold: stretches of `retrain_every` days from the day of `start` on, -1 before it."""
    day0 = F.unix_date(F.to_date(F.lit(start).cast("timestamp_ntz")))
    day = F.unix_date(F.to_date(grid.ts))
    return df.withColumn("_fold", F.when(day < day0, F.lit(-1)).otherwise(floor_div(day - day0, retrain_every)).cast("long"))


def walk_forward_retrain(df: DataFrame, grid: Grid, xs: Iterable[str], start: str, y: str = "y",
                         retrain_every: int = 1, ridge: float = 0.0, centre: list[float] | None = None) -> DataFrame:
    """Expanding-window linear forecasts, refitted every ``retrain_every`` days; adds fold and y_pred.

    The fits of fold_coefficients are joined back by fold; folds without one keep their rows with a NULL forecast.
    """
    xs, by = list(xs), list(grid.by)
    coef = fold_coefficients(df, grid, xs, start, y, retrain_every, ridge, centre)
    data = with_fold(df, grid, start, retrain_every).where("_fold >= 0")
    return (join_groups(data, coef, [*by, "_fold"], "left").withColumn("y_pred", linear_value(xs, F.col("beta")))
            .withColumnRenamed("_fold", "fold").drop("beta"))


# --- versions of a fit ------------------------------------------------------------------

def versioned_fits(df: DataFrame, grid: Grid, xs: Iterable[str], start: str, y: str = "y", retrain_every: int = 1,
                   ridge: float = 0.0, centre: list[float] | None = None) -> DataFrame:
    """(series, valid_from, beta): the coefficients that are in force from a moment on, until the next version."""
    first = F.to_date(F.lit(start).cast("timestamp_ntz"))
    coef = fold_coefficients(df, grid, xs, start, y, retrain_every, ridge, centre)
    return coef.select(*grid.by, F.date_add(first, (F.col("_fold") * retrain_every).cast("int")).cast("timestamp_ntz").alias("valid_from"), "beta")


def score_as_of(df: DataFrame, versions: DataFrame, grid: Grid, xs: Iterable[str], name: str = "y_pred") -> DataFrame:
    """Every row under the latest version that is in force at its time; NULL before the first one."""
    held = asof_join(df, versions.select(*grid.by, "valid_from", "beta"), grid)
    return held.withColumn(name, linear_value(xs, F.col("beta"))).drop("beta")
