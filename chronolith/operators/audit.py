"""Data audits: one aggregate pass each, small result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from chronolith.functions.columns import pattern_flag


def duplicate_audit(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows in total, distinct keys, rows whose key repeats, and their rate in percent.

    Two levels of aggregation; the rows themselves are never gathered by key.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = F.sum("_n")
    repeated = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
    return per_key.agg(
        total.cast("long").alias("n_rows"), F.count("*").alias("n_keys"),
        repeated.cast("long").alias("n_repeated"),
        (F.try_divide(repeated, total) * 100.0).alias("repeated_pct"),
        (F.try_divide(total - F.count("*"), total) * 100.0).alias("surplus_pct"))


def duplicate_sample(df: DataFrame, keys: Iterable[str], order: Iterable[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows with a repeating key, in order (a report)."""
    keys = list(keys)
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(repeated, keys, "left_semi").orderBy(*keys, *order).limit(n)


def outlier_audit(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Per measure: maximum and number of rows above a physical limit."""
    entries = [F.struct(F.lit(c).alias("measure"), F.max(c).cast("double").alias("max_value"),
                        F.count_if(F.col(c) > k).alias("n_above")) for c, k in limits.items()]
    return df.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))


def missing_census(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null count and share per column, worst first, complete columns left out."""
    names = list(columns) if columns is not None else df.columns
    entries = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(F.col(f"`{c}`").isNull()).alias("n_missing"),
                        F.count("*").alias("_n")) for c in names]
    return (df.agg(F.array(*entries).alias("_r")).select(F.inline("_r")).where("n_missing > 0")
            .select("column_name", "n_missing", (F.col("n_missing") / F.col("_n") * 100.0).alias("missing_pct"))
            .orderBy(F.desc("n_missing"), "column_name"))


def zero_share(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Percent of non-null rows that are exactly zero."""
    entries = [F.struct(F.lit(c).alias("measure"),
                        (F.avg((F.col(c) == 0).cast("double")) * 100.0).alias("zero_pct")) for c in columns]
    return df.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))


def flag_density(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Percent of rows on which each text pattern fires."""
    entries = [F.struct(F.lit(name).alias("flag"),
                        (F.avg(pattern_flag(F.col(text), p).cast("double")) * 100.0).alias("density_pct"))
               for name, p in patterns.items()]
    return df.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))


def time_bounds(df: DataFrame, by: Iterable[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"),
                               F.max(ts).alias("last_ts"))
