"""Joins on the time key, with the fan-out and missing-key checks made explicit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from chronolith.functions.columns import floor_div, step_of
from chronolith.operators.clean import dedup_first
from chronolith.operators.grid import SPAN, Grid, with_carry


def join_master(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Inner equi join; the planner picks the strategy from the sizes at run time."""
    return left.join(right, list(keys), "inner")


def unique_on(df: DataFrame, keys: Iterable[str], order: Iterable | None = None) -> DataFrame:
    """One row per key: the first under ``order``, or an error on a repeated key.

    Grouped by the join keys, so a following join reuses the partitioning.
    """
    keys = list(keys)
    if order is not None:
        return dedup_first(df, keys, order)
    rest = [c for c in df.columns if c not in keys]
    row = F.any_value(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]))
    checked = F.when(F.count("*") > 1, F.raise_error(F.lit("join key repeats on the right side"))
                     ).otherwise(F.lit(None))
    return (df.groupBy(*keys).agg(row.alias("_row"), checked.cast("string").alias("_ok"))
            .where("_ok IS NULL")
            .select(*keys, *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(rest)]))


def attach_benchmark(df: DataFrame, other: DataFrame, keys: Iterable[str], order=None) -> DataFrame:
    """Left join that cannot fan out: the other side is made unique first."""
    keys = list(keys)
    return df.join(unique_on(other, keys, order), keys, "left")


def align_to(index: DataFrame, series: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Put a series on another table's index; steps it lacks come out NULL."""
    keys = list(keys)
    return index.select(*keys).join(series, keys, "left")


def lookup_rows(wanted: DataFrame, table: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Rows of ``table`` for the wanted keys; a key that is not there fails the job."""
    keys, columns = list(keys), list(columns)
    found = wanted.select(*keys).join(table.select(*keys, *columns, F.lit(True).alias("_hit")), keys, "left")
    ok = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("lookup key not found")).cast("boolean")).otherwise(True)
    return found.where(ok).select(*keys, *columns)


def concat_columns(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Full outer alignment on the key."""
    return left.join(right, list(keys), "full")


def align_intersection(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def append_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    out = first
    for df in more:
        out = out.unionByName(df)
    return out


def asof_join(df: DataFrame, versions: DataFrame, grid: Grid, valid_from: str = "valid_from", strict: bool = False,
              span: int = SPAN) -> DataFrame:
    """Adds the columns of the latest version of the row's series with valid_from <= ts (< ts if strict), and valid_from.

    No join on a range: both sides are dealt out by series and span of time and ordered together, so the last version
    seen is a running value; what comes from earlier spans is carried over a table of one row for each series and span.
    Rows before the first version have NULLs; (series, valid_from) must be unique; rows with a NULL time match nothing.
    """
    by, ts = list(grid.by), F.col(grid.ts)
    columns = [c for c in versions.columns if c not in by]
    clash = [c for c in columns if c in df.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")

    def span_of(c):
        out = floor_div(step_of(c, grid.step), span)
        for key in by:  # a NULL series key ends the query, as in Grid.step_index
            out = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL in series key {key}")).cast("long")).otherwise(out)
        return out

    version = F.struct(*[F.col(f"`{c}`") for c in columns])
    left = df.select("*", ts.alias("_at"), F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType).alias("_version"), F.lit(1).alias("_side"))
    right = versions.where(F.col(f"`{valid_from}`").isNotNull()).select(
        *by, F.col(f"`{valid_from}`").alias("_at"), version.alias("_version"), F.lit(2 if strict else 0).alias("_side"))
    both = (left.unionByName(right, allowMissingColumns=True).withColumn("_span", span_of(F.col("_at")))
            .repartition(*by, "_span"))
    inside = Window.partitionBy(*by, "_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last("_version", ignorenulls=True).over(inside)).where("_side = 1")
    spans = both.groupBy(*by, "_span").agg(F.max_by("_version", F.when(F.col("_side") != 1, F.col("_at"))).alias("_last"))
    carried = with_carry(spans, grid, lambda before, after: {"_carry": F.last("_last", ignorenulls=True).over(before)}).drop("_last")
    found = F.when(ts.isNotNull(), F.coalesce("_here", "_carry"))
    # Both sides lie by (series, span) already.
    return (seen.join(carried, [*by, "_span"], "left").withColumn("_found", found)
            .select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_found")[c].alias(c) for c in columns]))
