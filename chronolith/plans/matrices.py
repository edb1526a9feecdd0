"""Model-input matrices cut from one feature frame.

All matrices take the master table: ``ts``, a target and covariates, optionally
with series keys (a grid with ``by``).  ``mode`` decides what a lag means: "row"
counts rows (and so slips across gaps), "time" counts
hours on the clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.functions.calendar import cyclical_columns, is_weekend, with_day_flags, with_holiday, positional_bridge
from chronolith.operators.clean import (
    columns_matching, drop_any_null, drop_listed_columns, leakage_bound, rename_to_panel, sparse_activity,
    fill_zero, drop_null_target)
from chronolith.operators.grid import Grid, over_spans
from chronolith.operators.scale import scale_apply, scale_columns, standardize_fit
from chronolith.operators.windows import (
    DAY_AHEAD_LAGS, INTRADAY_LAGS, forward_fill, full_only, lag_columns, lag_many, ramp, rolling_columns)
from chronolith.plans.energy import TARGET, WHOLE

DAY_AHEAD_REACH = max(*DAY_AHEAD_LAGS, 47)
LONG_LAG_COLUMNS = [f"load_t_{k}" for k in DAY_AHEAD_LAGS]
# Which covariates are continuous weather measures.
WEATHER_SUBSTRINGS = ("HDD", "CDD", "wind_speed", "humidity", "cloud_cover_pct")
# Columns that are always empty or benchmark, and the two sparse ones.
SANDBOX_DROP = [
    "generation fossil coal-derived gas", "generation fossil oil shale", "generation fossil peat",
    "generation geothermal", "generation hydro pumped storage aggregated", "generation marine",
    "generation wind offshore", "forecast wind offshore day ahead", "total load forecast",
]
SPARSE_COLUMNS = ["generation fossil brown coal / lignite", "generation hydro pumped storage consumption"]


def calendar_columns(df: DataFrame, holidays: DataFrame, ts: str = "ts", weekend: bool = True) -> DataFrame:
    out = df.withColumns(cyclical_columns(F.col(ts)))
    if weekend:
        out = out.withColumn("is_weekend", is_weekend(F.col(ts)))
    return with_day_flags(out, holidays, ts)


def calendar_regressor_matrix(master: DataFrame, holidays: DataFrame, target: str = TARGET, grid: Grid = WHOLE,
                              bridge: str = "calendar") -> DataFrame:
    """(ds, y, is_holiday, is_bridge_day); the bridge flag by date or by 24-row shifts."""
    base = master.select(*grid.by, grid.ts, F.col(f"`{target}`").alias("y"))
    if bridge == "calendar":
        flagged = with_day_flags(base, holidays, grid.ts)
    else:
        flagged = over_spans(with_holiday(base, holidays, grid.ts), grid,
                             lambda f: {"is_bridge_day": positional_bridge(f, grid.ts)},
                             back=24, ahead=24, mode="row")
    return drop_any_null(flagged.withColumnRenamed(grid.ts, "ds")
                         .select(*grid.by, "ds", "y", "is_holiday", "is_bridge_day"))


def _with_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("_y", F.col(f"`{target}`"))


def day_ahead_matrix(master: DataFrame, holidays: DataFrame, target: str = TARGET, grid: Grid = WHOLE,
                     mode: str = "row") -> DataFrame:
    """Calendar encodings, day-ahead lags and the 24-step statistics of the day before."""
    stats = ("mean", "std", "max", "min")

    def features(f):
        return {**lag_columns(f, "_y", DAY_AHEAD_LAGS, "load_t_"),
                **rolling_columns(f, "_y", 24, 24, stats, "24h")}

    base = _with_target(calendar_columns(master, holidays, grid.ts), target)
    wide = over_spans(base, grid, features, lambda f: full_only(24, stats, "24h"),
                      back=DAY_AHEAD_REACH, mode=mode)
    return drop_any_null(wide.drop("_y", "_full_24h"))


def intraday_matrix(master: DataFrame, holidays: DataFrame, target: str = TARGET, grid: Grid = WHOLE,
                    mode: str = "row") -> DataFrame:
    """Day-ahead statistics plus the latest hours; the long lags are left out.

    The short lags are taken after the warm-up rows of the day-ahead matrix are
    gone, hence the second window pass.
    """
    base = drop_listed_columns(day_ahead_matrix(master, holidays, target, grid, mode), LONG_LAG_COLUMNS)

    stats = ("mean", "max", "min")

    def features(f):
        return {**lag_columns(f, "_y", INTRADAY_LAGS, "load_t_"), **rolling_columns(f, "_y", 6, 1, stats, "6h")}

    def finish(f):
        return {"load_ramp_1h": ramp(F.col("load_t_1"), F.col("load_t_2")), **full_only(6, stats, "6h")}

    wide = over_spans(_with_target(base, target), grid, features, finish, back=6, mode=mode)
    return drop_any_null(wide.drop("_y", "_full_6h"))


def _train_mask(train_end: str, ts: str) -> Column:
    return F.col(ts) <= F.lit(train_end).cast("timestamp_ntz")


def scaled_matrix(master: DataFrame, holidays: DataFrame, train_end: str, target: str = TARGET,
                  grid: Grid = WHOLE, mode: str = "row") -> tuple[DataFrame, DataFrame]:
    """Standardised day-ahead matrix and the target's parameters, fitted on train rows only."""
    full = day_ahead_matrix(master, holidays, target, grid, mode)
    columns = [c for c in full.columns if c not in (*grid.by, grid.ts)]
    params = standardize_fit(full, columns, _train_mask(train_end, grid.ts))
    target_params = params.select(f"`{target}__center`", f"`{target}__scale`")
    return scale_apply(full, params, columns), target_params


def sequence_matrix(master: DataFrame, holidays: DataFrame, train_end: str, target: str = TARGET,
                    grid: Grid = WHOLE, unique_id: str | Column = "grid") -> DataFrame:
    """(unique_id, ds, y, ...) with encodings, flags and standardised weather measures."""
    full = calendar_columns(master, holidays, grid.ts, weekend=False)
    weather = columns_matching(full, contains=WEATHER_SUBSTRINGS)
    if weather:
        full = scale_columns(full, _train_mask(train_end, grid.ts), weather)
    return drop_any_null(rename_to_panel(full, grid.ts, target, unique_id))


def univariate_panel(master: DataFrame, target: str = TARGET, grid: Grid = WHOLE,
                     unique_id: str | Column = "grid") -> DataFrame:
    return rename_to_panel(master.select(grid.ts, *grid.by, f"`{target}`"), grid.ts, target,
                           unique_id).select("unique_id", "ds", "y")


# --- leakage studies -------------------------------------------------------------------

def sandbox_clean(master: DataFrame, grid: Grid = WHOLE, sparse: Iterable[str] = SPARSE_COLUMNS,
                  drop: Iterable[str] = SANDBOX_DROP) -> DataFrame:
    """Drop dead columns, split sparse ones, then forward-fill and zero-fill the market columns."""
    out = drop_listed_columns(master, drop)
    out = sparse_activity(out, [c for c in sparse if c in out.columns])
    market = columns_matching(out, ("generation",), ("forecast", "price"))
    return fill_zero(forward_fill(out, grid, market), market)


def sandbox_lagged(cleaned: DataFrame, grid: Grid = WHOLE, mode: str = "row",
                   price: str = "price actual") -> DataFrame:
    """Generation and price as known a day earlier."""
    columns = [c for c in cleaned.columns if c.startswith("generation") or c == price]
    return drop_any_null(lag_many(cleaned, grid, columns, 24, mode))


def sandbox_realtime(cleaned: DataFrame) -> DataFrame:
    return drop_any_null(cleaned)


def sandbox_scaled(matrix: DataFrame, train_end: str, ts: str = "ds") -> DataFrame:
    return drop_any_null(scale_columns(matrix, _train_mask(train_end, ts)))


# --- everything --------------------------------------------------------------------------

def build_all(master: DataFrame, holidays: DataFrame, train_end: str, target: str = TARGET,
              grid: Grid = WHOLE, mode: str = "row", sparse: Iterable[str] = SPARSE_COLUMNS,
              shared: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All ten matrices as lazy frames.

    ``shared`` is applied to the two frames that several matrices start from; pass
    ``sources.tables.materialize`` there when the matrices are all to be written,
    so that the cleaning and the wide window pass run once.
    """
    full = shared(drop_null_target(sandbox_clean(master, grid, sparse), target))
    clean = leakage_bound(full)
    day_ahead_full = shared(day_ahead_matrix(full, holidays, target, grid, mode))
    sequence_full = sequence_matrix(full, holidays, train_end, target, grid)
    ds = Grid(by=("unique_id",), ts="ds", step=grid.step)
    return {
        "calendar_regressors": calendar_regressor_matrix(clean, holidays, target, grid),
        "intraday_trees": intraday_matrix(clean, holidays, target, grid, mode),
        "univariate_sequence": univariate_panel(clean, target, grid),
        "scaled_day_ahead": scaled_matrix(clean, holidays, train_end, target, grid, mode)[0],
        "day_ahead_trees": day_ahead_matrix(clean, holidays, target, grid, mode),
        "sequence": sequence_matrix(clean, holidays, train_end, target, grid),
        "sandbox_lagged_trees": sandbox_lagged(day_ahead_full, grid, mode),
        "sandbox_lagged_sequence": sandbox_scaled(sandbox_lagged(sequence_full, ds, mode), train_end),
        "sandbox_realtime_trees": sandbox_realtime(day_ahead_full),
        "sandbox_realtime_sequence": sandbox_scaled(sandbox_realtime(sequence_full), train_end),
    }
