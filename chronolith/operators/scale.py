"""Scalers fitted on the training rows only.

Parameters are a table: per column a center and a scale, one row per series (or
one row in all).  A zero scale becomes 1, so constant columns map to 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def _guard(scale: Column) -> Column:
    return F.when(scale == 0.0, F.lit(1.0)).otherwise(scale)


def _fit(df: DataFrame, columns: Iterable[str], train: Column, by: Iterable[str], center, scale) -> DataFrame:
    aggs = []
    for c in columns:
        value = F.col(f"`{c}`").cast("double")
        aggs += [center(value).alias(f"{c}__center"), _guard(scale(value)).alias(f"{c}__scale")]
    return df.where(train).groupBy(*by).agg(*aggs)


def standardize_fit(df: DataFrame, columns: Iterable[str], train: Column, by: Iterable[str] = ()) -> DataFrame:
    """Mean and population standard deviation."""
    return _fit(df, columns, train, by, F.avg, F.stddev_pop)


def minmax_fit(df: DataFrame, columns: Iterable[str], train: Column, by: Iterable[str] = ()) -> DataFrame:
    return _fit(df, columns, train, by, F.min, lambda v: F.max(v) - F.min(v))


def _with_params(df: DataFrame, params: DataFrame, by: Iterable[str]):
    """Attach the parameters: a join per series, a one-row scalar subquery otherwise."""
    by = list(by)
    names = [c for c in params.columns if c not in by]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(names)])
    slot = {c: F.col(f"_params.p{i}") for i, c in enumerate(names)}
    if by:
        return df.join(params.select(*by, packed.alias("_params")), by, "left"), slot
    return df.withColumn("_params", params.select(packed).scalar()), slot


def scale_apply(df: DataFrame, params: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    joined, slot = _with_params(df, params, by)
    return joined.withColumns({
        c: (F.col(f"`{c}`") - slot[f"{c}__center"]) / slot[f"{c}__scale"] for c in columns}).drop("_params")


def scale_invert(df: DataFrame, params: DataFrame, columns: dict[str, str], by: Iterable[str] = ()) -> DataFrame:
    """Back to original units; ``columns`` maps a column to the fitted one it was scaled as."""
    joined, slot = _with_params(df, params, by)
    return joined.withColumns({
        c: F.col(f"`{c}`") * slot[f"{src}__scale"] + slot[f"{src}__center"]
        for c, src in columns.items()}).drop("_params")


def minmax_scale(df: DataFrame, columns: Iterable[str], train: Column, by: Iterable[str] = ()) -> DataFrame:
    columns = list(columns)
    return scale_apply(df, minmax_fit(df, columns, train, by), columns, by)


# Columns that keep their units in the sequence matrices.
NOT_SCALED = ["ds", "unique_id", "y", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos",
              "is_holiday", "is_bridge_day"]
NOT_SCALED_MARK = "_is_active"


def scalable_columns(df: DataFrame) -> list[str]:
    """All but keys, target, encodings, calendar flags and activity flags."""
    return [c for c in df.columns if c not in NOT_SCALED and NOT_SCALED_MARK not in c]


def scale_columns(df: DataFrame, train: Column, columns: Iterable[str] | None = None,
                  by: Iterable[str] = ()) -> DataFrame:
    columns = list(columns) if columns is not None else scalable_columns(df)
    return scale_apply(df, standardize_fit(df, columns, train, by), columns, by)
