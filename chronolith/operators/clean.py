"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Weather text patterns of the feature pipeline ...
WEATHER_PATTERNS = {
    "is_rain": "rain|drizzle|shower",
    "is_snow": "snow|sleet",
    "is_extreme": "thunderstorm|squall|heavy|very heavy",
    "is_obscured": "fog|mist|haze|dust|smoke|sand",
}
# ... and of the density audit, which is narrower.
AUDIT_PATTERNS = {
    "is_rain": "rain|drizzle|shower",
    "is_snow": "snow|sleet",
    "is_extreme": "thunderstorm|squall|heavy",
    "is_obscured": "fog|mist|haze|dust|smoke",
}


def utc_to_local(ts: str | Column, zone: str) -> Column:
    """Zone-free UTC to the wall clock of ``zone``; the result is zone-free too."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def dedup_first(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """Keep the first row of each key under an explicit order.

    An aggregate, not a window: partial aggregation shrinks a group of copies on
    the map side, so a key that holds a third of all rows is no hot task.
    """
    keys = list(keys)
    rank = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}")
                      for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    first = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.min_by(row, rank).alias("_row"))
    values = {c: F.col(f"_row.c{i}").alias(c) for i, c in enumerate(rest)}
    return first.select(*[values.get(c, F.col(f"`{c}`")) for c in df.columns])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(f"`{target}`").isNotNull())


def drop_any_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Keep complete rows (over ``columns``, or over all of them)."""
    names = list(columns) if columns is not None else df.columns
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(True)))


def empty_columns(df: DataFrame, mask: Column | None = None) -> list[str]:
    """Names of columns without a single value (in the masked rows): one aggregate, one row read back."""
    scope = df if mask is None else df.where(mask)
    counts = scope.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if counts[str(i)] == 0]


def drop_empty_columns(df: DataFrame, mask: Column | None = None) -> DataFrame:
    return drop_listed_columns(df, empty_columns(df, mask))


def drop_listed_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    gone = set(names)
    return df.select(*[f"`{c}`" for c in df.columns if c not in gone])


def columns_matching(df: DataFrame, prefixes: Iterable[str] = (), contains: Iterable[str] = (),
                     numeric_only: bool = False) -> list[str]:
    """Column names by prefix or substring; a decision on the schema, no job."""
    prefixes, contains = tuple(prefixes), tuple(contains)
    return [f.name for f in df.schema
            if (f.name.startswith(prefixes) if prefixes else False) or any(s in f.name for s in contains)
            if not numeric_only or isinstance(f.dataType, T.NumericType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


# What marks a column as unknown at forecast time.
LEAKAGE_PREFIXES = ("generation",)
LEAKAGE_SUBSTRINGS = ("forecast", "price")


def leakage_columns(df: DataFrame) -> list[str]:
    return columns_matching(df, LEAKAGE_PREFIXES, LEAKAGE_SUBSTRINGS)


def leakage_bound(df: DataFrame) -> DataFrame:
    """Drop every column that would not be known when the forecast is made."""
    return drop_listed_columns(df, leakage_columns(df))


def rename_to_panel(df: DataFrame, ts: str, target: str, unique_id: str | Column) -> DataFrame:
    """(unique_id, ds, y, covariates...)."""
    key = F.lit(unique_id) if isinstance(unique_id, str) else unique_id
    others = [c for c in df.columns if c not in (ts, target)]
    return df.select(key.alias("unique_id"), F.col(f"`{ts}`").alias("ds"), F.col(f"`{target}`").alias("y"),
                     *[f"`{c}`" for c in others])


def fill_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns})


def sparse_activity(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Split a mostly-zero measure into an activity flag and its log size."""
    from chronolith.functions.columns import log1p_filled, true_or_zero

    out = {}
    for c in columns:
        value = F.col(f"`{c}`")
        out[f"{c}_is_active"] = true_or_zero(value > 0)
        out[c] = log1p_filled(value)
    return df.withColumns(out)


def split_label(ts: str | Column, train_end, val_end) -> Column:
    """Chronological split by inclusive end points."""
    t = F.col(ts) if isinstance(ts, str) else ts
    a, b = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (train_end, val_end))
    return F.when(t <= a, "train").when(t <= b, "val").otherwise("test")


def chrono_split(df: DataFrame, train_end: str, val_end: str, ts: str = "ts") -> DataFrame:
    return df.withColumn("split", split_label(ts, train_end, val_end))


def split_rows(df: DataFrame, train_end: str, val_end: str, part: str, ts: str = "ts") -> DataFrame:
    """The rows of one part ("train", "val" or "test") as a range of times, which reaches the scan as a filter."""
    t, a, b = F.col(ts), F.lit(train_end).cast("timestamp_ntz"), F.lit(val_end).cast("timestamp_ntz")
    where = {"train": t <= a, "val": (t > a) & (t <= b), "test": t > b}
    return df.where(where[part])


def mask_invalid(df: DataFrame, prediction: str = "y_pred") -> DataFrame:
    """Rows with a usable prediction (neither NULL nor NaN)."""
    return df.where(F.col(prediction).isNotNull() & ~F.isnan(prediction))


def time_slice(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Inclusive range; with literals it reaches the parquet scan as a filter."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
