"""Lags, rolling frames, fills, differences and window diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.functions.columns import nan_to_null
from chronolith.operators.grid import (
    Grid, over_spans, spread_spans, span_arrays, span_length, with_carry, with_position)

# Lags of the day-ahead and the intraday matrices, in steps.
DAY_AHEAD_LAGS = (24, 25, 26, 168, 169, 170)
INTRADAY_LAGS = (1, 2, 3)


def lag_columns(frame, value: str, lags, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{k}": frame.at(value, -k) for k in lags}


def lag_features(df: DataFrame, grid: Grid, value: str = "y", lags=DAY_AHEAD_LAGS,
                 prefix: str = "load_t_", mode: str = "time") -> DataFrame:
    """One column per lag; "time" looks back on the clock, "row" by position."""
    back, ahead = max(0, *lags), max(0, *(-k for k in lags))
    return over_spans(df, grid, lambda f: lag_columns(f, value, lags, prefix),
                      back=back, ahead=ahead, mode=mode)


def lead_flag(df: DataFrame, grid: Grid, flag: str, k: int = 24, name: str | None = None,
              mode: str = "time") -> DataFrame:
    """Flag known in advance, read ``k`` steps ahead; 0 beyond the end."""
    name = name or f"{flag}_lead_{k}"
    return over_spans(df, grid, lambda f: {name: F.coalesce(f.at(flag, k), F.lit(0))},
                      ahead=k, mode=mode)


def lag_many(df: DataFrame, grid: Grid, columns, k: int = 24, mode: str = "time") -> DataFrame:
    """Replace each column by its lag; one shuffle and sort for all of them."""
    lagged = over_spans(df, grid, lambda f: {f"{c}_t_{k}": f.at(F.col(f"`{c}`"), -k) for c in columns},
                        back=k, mode=mode)
    return lagged.drop(*columns)


def ramp(a: Column, b: Column) -> Column:
    return a - b


ROLLING = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def rolling_columns(frame, value: str, window: int, lag: int, stats, suffix: str) -> dict[str, Column]:
    """Statistics of the ``window`` steps that end ``lag`` steps back, with their value count.

    To be followed by :func:`full_only`; counting once serves all statistics.
    """
    over = frame.frame(-(lag + window - 1), -lag)
    return {f"_full_{suffix}": F.count(value).over(over),
            **{f"rolling_{s}_{suffix}": ROLLING[s](value).over(over) for s in stats}}


def full_only(window: int, stats, suffix: str) -> dict[str, Column]:
    """Blank the statistics of frames that do not hold every value."""
    return {f"rolling_{s}_{suffix}": F.when(F.col(f"_full_{suffix}") == window, F.col(f"rolling_{s}_{suffix}"))
            for s in stats}


def rolling_lagged(df: DataFrame, grid: Grid, value: str = "y", window: int = 24, lag: int = 24,
                   stats=("mean", "std", "max", "min"), mode: str = "time") -> DataFrame:
    suffix = f"{window}h"
    return over_spans(df, grid, lambda f: rolling_columns(f, value, window, lag, stats, suffix),
                      lambda f: full_only(window, stats, suffix),
                      back=lag + window - 1, mode=mode).drop(f"_full_{suffix}")


def _running_stage(value: str):
    def stage(f):
        y = nan_to_null(F.col(value).cast("double"))
        return {"_cum": f.running(F.sum, F.coalesce(y, F.lit(0.0))), "_cnt": f.running(F.count, y)}
    return stage


def _between(f, c: str, start: int, end: int) -> Column:
    """Total over the steps start..end as a difference of running totals."""
    zero = F.lit(0)
    return F.coalesce(f.up_to(c, end), zero) - F.coalesce(f.up_to(c, start - 1), zero)


def centered_ma(df: DataFrame, grid: Grid, value: str = "y", windows=(168, 720, 8760),
                mode: str = "row") -> DataFrame:
    """Centered rolling means; an even window has one more step behind than ahead."""
    reach = {n: (n - 1 - (n - 1) // 2, (n - 1) // 2) for n in windows}

    def means(f):
        return {f"ma_{n}": F.when(_between(f, "_cnt", -b, a) == n, _between(f, "_cum", -b, a) / n)
                for n, (b, a) in reach.items()}

    out = over_spans(df, grid, _running_stage(value), means, mode=mode,
                     back=max(b for b, _ in reach.values()), ahead=max(a for _, a in reach.values()))
    return out.drop("_cum", "_cnt")


def difference(df: DataFrame, grid: Grid, value: str = "y", lags=(24, 1), mode: str = "row",
               steps: bool = False) -> DataFrame:
    """Apply differences one after another: y - y[k1], then the same on the result.

    The nested differences expand to one signed sum of lags, so a single window
    pass serves any chain.  With ``steps`` the shorter chains (k1), (k1, k2), ...
    become columns too.
    """
    chains = [lags[:n] for n in range(1 if steps else len(lags), len(lags) + 1)]
    return over_spans(df, grid, lambda f: {"diff_" + "_".join(map(str, c)): _signed_lags(f, value, c) for c in chains},
                      back=sum(lags), mode=mode)


def _signed_lags(f, value: str, lags) -> Column:
    terms = {0: 1}
    for k in lags:
        shifted: dict[int, int] = {}
        for lag, sign in terms.items():
            shifted[lag] = shifted.get(lag, 0) + sign
            shifted[lag + k] = shifted.get(lag + k, 0) - sign
        terms = shifted

    total = None
    for lag, sign in sorted(terms.items()):
        part = f.at(value, -lag) * sign
        total = part if total is None else total + part
    return total


def seasonal_naive(df: DataFrame, grid: Grid, value: str = "y", period: int = 168,
                   name: str = "y_pred", mode: str = "time") -> DataFrame:
    return over_spans(df, grid, lambda f: {name: f.at(value, -period)}, back=period, mode=mode)


def row_ordinal(df: DataFrame, grid: Grid, name: str = "t") -> DataFrame:
    return with_position(df, grid, name)


# --- filling -----------------------------------------------------------------

def forward_fill(df: DataFrame, grid: Grid, columns, suffix: str = "") -> DataFrame:
    """Last valid value per column, across gaps of any length.

    Inside a span a running ``last`` does it; a value from an earlier span comes
    from the table of span ends (one row per series and span).
    """
    columns = list(columns)
    step = F.col("_step")
    spread = spread_spans(df, grid, 0, 0)
    quoted = {c: F.col(f"`{c}`") for c in columns}
    ends = spread.groupBy(*grid.by, "_span").agg(
        *[F.max_by(quoted[c], F.when(quoted[c].isNotNull(), step)).alias(f"_end_{i}")
          for i, c in enumerate(columns)])
    carried = with_carry(ends, grid, lambda before, after: {
        f"_carry_{i}": F.last(f"_end_{i}", ignorenulls=True).over(before) for i in range(len(columns))})
    carried = carried.drop(*[f"_end_{i}" for i in range(len(columns))])
    inside = (Window.partitionBy(*grid.by, "_span").orderBy("_step")
              .rowsBetween(Window.unboundedPreceding, 0))
    out = spread.join(carried, [*grid.by, "_span"], "left")
    out = out.withColumns({
        c + suffix: F.coalesce(F.last(quoted[c], ignorenulls=True).over(inside), F.col(f"_carry_{i}"))
        for i, c in enumerate(columns)})
    keep = df.columns + ([c + suffix for c in columns] if suffix else [])
    return out.select(*[f"`{c}`" for c in keep])


def interpolate_linear(df: DataFrame, grid: Grid, value: str = "y", name: str | None = None) -> DataFrame:
    """Straight line across inner gaps; a leading gap stays NULL, a trailing one repeats."""
    name = name or value
    spread = spread_spans(df, grid, 0, 0)
    point = F.when(F.col(value).isNotNull(),
                   F.struct(F.col("_step").alias("s"), F.col(value).cast("double").alias("v")))
    ends = spread.groupBy(*grid.by, "_span").agg(F.min(point).alias("_lo"), F.max(point).alias("_hi"))
    carried = with_carry(ends, grid, lambda before, after: {
        "_left": F.last("_hi", ignorenulls=True).over(before),
        "_right": F.last("_lo", ignorenulls=True).over(after)}).drop("_lo", "_hi")
    w = Window.partitionBy(*grid.by, "_span")
    so_far = (Window.unboundedPreceding, 0)
    out = (spread.join(carried, [*grid.by, "_span"], "left")
           .withColumn("_p", F.coalesce(
               F.last(point, ignorenulls=True).over(w.orderBy("_step").rowsBetween(*so_far)), "_left"))
           .withColumn("_n", F.coalesce(
               F.last(point, ignorenulls=True).over(w.orderBy(F.desc("_step")).rowsBetween(*so_far)),
               "_right")))
    p, n = F.col("_p"), F.col("_n")
    line = (p["v"] + (n["v"] - p["v"]) * (F.col("_step") - p["s"])
            / F.nullif(n["s"] - p["s"], F.lit(0)))
    filled = F.coalesce(F.col(value).cast("double"), line, p["v"])
    filled = F.when(p.isNotNull(), filled)
    keep = [c for c in df.columns if c != name]
    return out.select(*keep, filled.alias(name))


# --- widest interval ----------------------------------------------------------

def widest_interval(df: DataFrame, grid: Grid, lower: str = "q05", upper: str = "q95",
                    window: int = 72) -> DataFrame:
    """Per series, the window with the largest mean interval width (earliest on a tie)."""
    wide = df.withColumn("_width", F.col(upper) - F.col(lower))
    rolled = over_spans(wide, grid,
                        lambda f: {"_mean": f.full(F.avg, "_width", -(window - 1), 0)},
                        back=window - 1)
    best = F.max(F.when(F.col("_mean").isNotNull(),
                        F.struct(F.col("_mean").alias("width"), (-grid.step_index()).alias("neg"),
                                 F.col(grid.ts).alias("end"))))
    return (rolled.groupBy(*grid.by).agg(best.alias("_b")).where("_b IS NOT NULL")
            .select(*grid.by, F.col("_b.end").alias("end_ts"), F.col("_b.width").alias("mean_width")))


def widest_interval_window(df: DataFrame, grid: Grid, lower: str = "q05", upper: str = "q95",
                           window: int = 72) -> DataFrame:
    """The rows [end - window, end] around the widest interval of each series."""
    from chronolith.functions.columns import shift_ts

    best = widest_interval(df, grid, lower, upper, window)
    ts = F.col(grid.ts)
    return (df.join(best, list(grid.by))
            .where((ts >= shift_ts(F.col("end_ts"), -window * grid.step)) & (ts <= F.col("end_ts"))))


# --- sequence chunks -----------------------------------------------------------

def sequence_windows(df: DataFrame, grid: Grid, value: str = "y", input_len: int = 168,
                     output_len: int = 24, stride: int = 24, mode: str = "row") -> DataFrame:
    """(input chunk, output chunk) pairs, one per origin every ``stride`` rows.

    Each span array is cut in place, so a row is shuffled once (plus the margin)
    however many chunks contain it.  Incomplete chunks are not emitted.  Mode
    "row" needs no regular spine: positions are contiguous by construction.
    """
    length = span_length(input_len, output_len)
    arrays = span_arrays(df, grid, value, input_len - 1, output_len, mode, length)
    # Indices of the last input element: aligned to the stride, owned by the span,
    # with a full chunk on either side.
    low = F.greatest(F.col("own"), F.lit(input_len - 1))
    low = low + F.pmod(F.lit(input_len - 1) - F.col("first") - low, F.lit(stride))
    high = F.least(F.col("own") + F.col("n_own"), F.size("values") - output_len) - 1
    ready = arrays.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    # Chunks are cut inside one expression, so no row beside them carries the array of its span.
    chunks = F.transform(F.sequence("_low", "_high", F.lit(stride)), lambda i: F.struct(
        (F.col("first") + i).alias("origin"),
        F.slice("values", (i - (input_len - 2)).cast("int"), input_len).alias("chunk_in"),
        F.slice("values", (i + 2).cast("int"), output_len).alias("chunk_out")))
    return ready.select(*grid.by, F.inline(chunks))
