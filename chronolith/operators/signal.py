"""Decomposition, autocorrelation and stationarity tests for many series at once.

The heavy pass over the data is always a span job; what is left per series is a
vector of at most max-lag + 1 numbers or a small square matrix, handled in a
vectorised Python function over series rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from chronolith.functions.columns import floor_div
from chronolith.operators.grid import SPAN, Grid, over_spans, span_arrays, with_carry, with_position
from chronolith.operators.windows import _between, _running_stage

VECTOR = T.ArrayType(T.DoubleType())


def seasonal_decompose(df: DataFrame, grid: Grid, value: str = "y", period: int = 168) -> DataFrame:
    """Additive decomposition by centered average and phase means; edges are NULL.

    Works by row position.  Phase means are one row per series and phase.
    """
    half = period // 2
    positioned = with_position(df, grid, "_pos")

    def trend(f):
        full = _between(f, "_cnt", -half, half) == 2 * half + 1
        if period % 2:
            total = _between(f, "_cum", -half, half) / period
        else:
            total = (_between(f, "_cum", -half, half - 1)
                     + _between(f, "_cum", -half + 1, half)) / (2 * period)
        return {"trend": F.when(full, total)}

    out = over_spans(positioned, grid, _running_stage(value), trend, back=half, ahead=half,
                     position="_pos").drop("_cum", "_cnt")
    out = out.withColumn("_phase", F.pmod("_pos", F.lit(period)))
    phases = (out.groupBy(*grid.by, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_m")))
    level = F.avg("_m").over(Window.partitionBy(*grid.by))
    seasonal = phases.select(*grid.by, "_phase", (F.col("_m") - level).alias("seasonal"))
    return (out.join(seasonal, [*grid.by, "_phase"], "left")
            .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
            .drop("_pos", "_phase"))


# --- autocovariance -------------------------------------------------------------

def centered(df: DataFrame, grid: Grid, value: str = "y") -> DataFrame:
    """Non-null rows with their position (_pos) and their distance from the series mean (_d).

    Row counts and sums per time chunk give both the offset of a chunk and the
    mean of its series, so one small table serves both.
    """
    by = list(grid.by)
    chunked = (df.where(F.col(value).isNotNull())
               .withColumn("_chunk", floor_div(grid.step_index(), SPAN))
               .repartition(*by, "_chunk"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (chunked.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
              .select(*by, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
                      (F.sum("_sum").over(whole) / F.sum("_n").over(whole)).alias("_mean")))
    inside = Window.partitionBy(*by, "_chunk").orderBy(grid.ts)
    return (chunked.withColumn("_rn", F.row_number().over(inside)).join(chunks, [*by, "_chunk"], "left")
            .withColumn("_pos", F.col("_offset") + F.col("_rn") - 1)
            .withColumn("_d", F.col(value) - F.col("_mean"))
            .drop("_chunk", "_rn", "_offset", "_mean"))


def _lagged_products(max_lag: int):
    @pandas_udf(VECTOR)
    def products(values: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(values, own):
            x = np.asarray(x, dtype=float)
            n = len(x)
            row = np.zeros(max_lag + 1)
            for k in range(min(max_lag, n - 1) + 1):
                i = max(o, k)
                row[k] = x[i:] @ x[i - k:n - k]
            out.append(row)
        return pd.Series(out)
    return products


def autocovariance(df: DataFrame, grid: Grid, value: str = "y", max_lag: int = 48) -> DataFrame:
    """(series, lag, gamma): biased autocovariance, divided by the series length.

    One shuffle of the data; each row travels to at most one extra span.
    """
    arrays = span_arrays(centered(df, grid, value), grid, "_d", max_lag, position="_pos")
    partial = arrays.select(*grid.by, "n_own", F.posexplode(
        _lagged_products(max_lag)("values", "own")).alias("lag", "_s"))
    return (partial.groupBy(*grid.by, "lag").agg(F.sum("_s").alias("_s"), F.sum("n_own").alias("n"))
            .where("lag < n")
            .select(*grid.by, "lag", (F.col("_s") / F.col("n")).alias("gamma"), "n"))


# Fixed value: two-sided 5 % point of the normal distribution.
Z_95 = 1.959963984540054


def acf(df: DataFrame, grid: Grid, value: str = "y", max_lag: int = 48) -> DataFrame:
    """Autocorrelation per lag with the half-width of Bartlett's 95 % band.

    A constant series has no autocorrelation: its values are NULL.
    """
    gamma = autocovariance(df, grid, value, max_lag)
    by_lag = Window.partitionBy(*grid.by).orderBy("lag")
    rho = F.try_divide(F.col("gamma"), F.first("gamma").over(
        by_lag.rowsBetween(Window.unboundedPreceding, 0)))
    # var(k) = (1 + 2 * sum_{0<j<k} rho_j^2) / n, and 1/n at lag 1, 0 at lag 0.
    earlier = F.sum(F.when(F.col("lag") >= 1, F.col("acf") ** 2).otherwise(0.0)).over(
        by_lag.rowsBetween(Window.unboundedPreceding, -1))
    var = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(
        (1.0 + 2.0 * F.coalesce(earlier, F.lit(0.0))) / F.col("n"))
    return (gamma.withColumn("acf", rho).withColumn("band", Z_95 * F.sqrt(var))
            .select(*grid.by, "lag", "acf", "band"))


@pandas_udf(VECTOR)
def _levinson(rho: pd.Series) -> pd.Series:
    """Partial autocorrelations from autocorrelations 0..K of each series."""
    out = []
    for r in rho:
        r = np.asarray(r, dtype=float)
        if len(r) == 0 or np.isnan(r).any():
            out.append(None)
            continue
        pacf = np.ones(len(r))
        phi = np.zeros(0)
        for k in range(1, len(r)):
            err = 1.0 - phi @ r[1:k]
            last = (r[k] - phi @ r[k - 1:0:-1]) / err if err > 1e-14 else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            pacf[k] = last
        out.append([None if np.isnan(v) else float(v) for v in pacf])
    return pd.Series(out)


def _as_vector(df: DataFrame, by, index: str, value: str, name: str) -> DataFrame:
    """Collect a bounded number of indexed values per series into an ordered array."""
    return df.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))),
        lambda e: e["v"]).alias(name))


def pacf(df: DataFrame, grid: Grid, value: str = "y", max_lag: int = 48) -> DataFrame:
    """Partial autocorrelation by the Yule-Walker recursion on the biased ACF."""
    rho = _as_vector(acf(df, grid, value, max_lag), grid.by, "lag", "acf", "_rho")
    return rho.select(*grid.by, F.posexplode(_levinson("_rho")).alias("lag", "pacf"))


# --- augmented Dickey-Fuller ------------------------------------------------------

# Response surface of the Dickey-Fuller distribution with a constant
# (MacKinnon 1994 for p-values, MacKinnon 2010 for critical values).
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def _adf_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    z = sum(c * tau ** i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _adf_rows(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows [1, level, diff lag 1..lags, diff] for every x with lags + 1 predecessors."""
    d = np.diff(x)
    n = len(d) - lags
    if n <= 0:
        return np.zeros((0, lags + 3))
    cols = [np.ones(n), x[lags:-1]] + [d[lags - j:len(d) - j] for j in range(1, lags + 1)] + [d[lags:]]
    return np.column_stack(cols)


def _adf_grams(max_lag: int):
    @pandas_udf(VECTOR)
    def grams(values: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(values, own):
            x = np.asarray(x, dtype=float)
            z = _adf_rows(x[max(o - max_lag - 1, 0):], max_lag)
            out.append((z.T @ z).ravel())
        return pd.Series(out)
    return grams


def _ols(gram: np.ndarray, k: int):
    """Coefficients, residual sum of squares and inverse for the first k columns."""
    a, b, yy = gram[:k, :k], gram[:k, -1], gram[-1, -1]
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    inv = np.linalg.pinv(a / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inv @ b
    return beta, max(yy - b @ beta, 0.0), inv


ADF_RESULT = T.StructType([
    T.StructField("adf_stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("used_lag", T.IntegerType()), T.StructField("n_obs", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in TAU_CRITICAL]])


def _adf_one(g: np.ndarray, head: np.ndarray, max_lag: int):
    """Test of one series from its summed cross products and its first values."""
    n = g[0, 0]
    if n <= max_lag + 2 or g[-1, -1] <= 0.0:
        return [None] * 7
    best = (math.inf, 0)
    for lag in range(max_lag + 1):
        _, ssr, _ = _ols(g, lag + 2)
        aic = n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * (lag + 2)
        best = min(best, (aic, lag))
    lag = best[1]
    # The refit also uses the early rows that only longer lags had to skip.
    keep = [*range(lag + 2), max_lag + 2]
    early = _adf_rows(head, lag)
    final = g[np.ix_(keep, keep)] + early.T @ early
    beta, ssr, inv = _ols(final, lag + 2)
    n_obs = final[0, 0]
    se = math.sqrt(ssr / (n_obs - lag - 2) * inv[1, 1])
    tau = beta[1] / se if se > 0 else None
    crit = [sum(c / n_obs ** i for i, c in enumerate(TAU_CRITICAL[q])) for q in TAU_CRITICAL]
    return [tau, None if tau is None else _adf_p(tau), lag, int(n_obs), *crit]


def _adf_solve(max_lag: int):
    @pandas_udf(ADF_RESULT)
    def solve(grams: pd.Series, head: pd.Series) -> pd.DataFrame:
        width = max_lag + 3
        rows = [_adf_one(np.asarray(g, dtype=float).reshape(width, width), np.asarray(h, dtype=float), max_lag)
                for g, h in zip(grams, head)]
        return pd.DataFrame(rows, columns=["adf_stat", "p_value", "used_lag", "n_obs", *TAU_CRITICAL]
                            ).astype({"used_lag": "Int32", "n_obs": "Int64"})
    return solve


# --- KPSS -----------------------------------------------------------------------

# KPSS level critical values and their p-values.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def kpss_p_value(stat: Column) -> Column:
    """Linear interpolation in the published table, clamped at both ends."""
    p = F.when(stat <= KPSS_CRITICAL[0], F.lit(KPSS_P[0]))
    for i in range(3):
        slope = (KPSS_P[i + 1] - KPSS_P[i]) / (KPSS_CRITICAL[i + 1] - KPSS_CRITICAL[i])
        p = p.when(stat <= KPSS_CRITICAL[i + 1], F.lit(KPSS_P[i]) + (stat - KPSS_CRITICAL[i]) * slope)
    return p.when(stat.isNotNull(), F.lit(KPSS_P[3]))


def _running_moments():
    @pandas_udf(VECTOR)
    def moments(values: pd.Series, own: pd.Series) -> pd.Series:
        """Total of a span and first two moments of its running sum."""
        out = []
        for x, o in zip(values, own):
            run = np.cumsum(np.asarray(x, dtype=float)[o:])
            out.append([run[-1], run.sum(), run @ run])
        return pd.Series(out)
    return moments


def span_tests(df: DataFrame, grid: Grid, value: str, adf_lag: int | None = None,
               kpss_lag: int | None = None, bandwidth: DataFrame | None = None) -> DataFrame:
    """Both tests from one pass: (series, adf struct, kpss_stat, lags).

    A span reports its regression cross products (ADF), its lagged products and
    the moments of its inner running sum (KPSS).  The running total before a span
    enters the sum of squared partial sums in closed form.  What is collected per
    series is one entry per span, bounded by the calendar.
    """
    by = list(grid.by)
    back = max((adf_lag or 0) + 1, kpss_lag or 0)
    arrays = span_arrays(centered(df, grid, value), grid, "_d", back, position="_pos")
    cells = {}
    if adf_lag is not None:
        cells["_gram"] = _adf_grams(adf_lag)("values", "own")
        # The common sample starts at position adf_lag + 1; a refit may start earlier.
        cells["_head"] = F.when(F.col("first") == 0, F.slice("values", 1, adf_lag + 1))
    if kpss_lag is not None:
        cells["_prod"] = _lagged_products(kpss_lag)("values", "own")
        cells["_run"] = _running_moments()("values", "own")
    spans = arrays.select(*by, "_span", "n_own", *[c.alias(n) for n, c in cells.items()])
    if bandwidth is not None:
        spans = spans.join(bandwidth, by)
    elif kpss_lag is not None:
        spans = spans.withColumn("lags", F.lit(kpss_lag))
    aggs = [F.sum("n_own").cast("double").alias("_n")]
    out = []
    if adf_lag is not None:
        aggs.append(F.any_value("_head", ignoreNulls=True).alias("_head"))
        out.append(_adf_solve(adf_lag)("_gram", "_head").alias("adf"))
    if kpss_lag is not None:
        spans = with_carry(spans, grid, lambda before, after: {
            "_base": F.coalesce(F.sum(F.col("_run")[0]).over(before), F.lit(0.0))})
        b, run, lags = F.col("_base"), F.col("_run"), F.col("lags")
        # Bartlett weights: 1 at lag 0, twice a falling weight up to the bandwidth.
        weight = F.transform("_prod", lambda p, k: F.when(k == 0, p).when(
            k <= lags, 2.0 * p * (1.0 - k / (lags + 1.0))).otherwise(0.0))
        aggs += [F.sum(F.col("n_own") * b * b + 2.0 * b * run[1] + run[2]).alias("_eta"),
                 F.sum(F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)).alias("_lrv"),
                 F.max("lags").alias("lags")]
        # eta = sum(S^2) / n^2 and the long-run variance is _lrv / n.
        out += [F.try_divide(F.col("_eta"), F.col("_n") * F.col("_lrv")).alias("kpss_stat"), F.col("lags")]
    tests = spans.groupBy(*by).agg(*aggs)
    if adf_lag is not None:
        total = _summed(spans, by, "_gram")
        tests = tests.join(total, by) if by else tests.withColumn("_gram", total.scalar())
    return tests.select(*by, *out)


def _summed(spans: DataFrame, by: list[str], matrix: str) -> DataFrame:
    """(by, matrix): the spans' matrices added cell by cell, with partial sums before the shuffle."""
    cells = (spans.select(*by, F.posexplode(matrix).alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("_v")))
    return cells.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda e: e["_v"]).alias(matrix))


def adf_test(df: DataFrame, grid: Grid, value: str = "y", max_lag: int = 48) -> DataFrame:
    """Unit-root test with a constant, lag order chosen by AIC up to ``max_lag``.

    Every span contributes the cross-product matrix of its regression rows; the
    nested fits of all lag orders are leading blocks of the summed matrix.
    """
    return span_tests(df, grid, value, adf_lag=max_lag).select(*grid.by, "adf.*")


def short_lags(n: int) -> int:
    """Autocovariances that the bandwidth rule needs for a series of n rows."""
    return max(1, math.floor(n ** (2.0 / 9.0) + 1e-12))


def _auto_bandwidth(df: DataFrame, grid: Grid, value: str) -> DataFrame:
    """(series, lags) by the data-driven rule of Hobijn et al., from n^(2/9) autocovariances.

    The longest series sets how many are computed (one number is read back).
    """
    n = F.col("n").cast("double")
    longest = (df.where(F.col(value).isNotNull()).groupBy(*grid.by).agg(F.count("*").alias("n"))
               .agg(F.max("n")).first()[0] or 0)
    gamma = autocovariance(df, grid, value, short_lags(longest))
    cut = F.floor(F.pow(n, F.lit(2.0 / 9.0)) + F.lit(1e-12))
    inner = F.when((F.col("lag") >= 1) & (F.col("lag") <= cut), F.col("gamma"))
    zero = F.lit(0.0)
    rule = (gamma.groupBy(*grid.by)
            .agg((F.max(F.when(F.col("lag") == 0, F.col("gamma")))
                  + 2.0 * F.coalesce(F.sum(inner), zero)).alias("_s0"),
                 (2.0 * F.coalesce(F.sum(inner * F.col("lag")), zero)).alias("_s1"), F.max("n").alias("n")))
    ratio = F.try_divide(F.col("_s1"), F.col("_s0"))
    third = F.lit(1.0 / 3.0)
    width = F.floor(1.1447 * F.pow(ratio * ratio, third) * F.pow(n, third))
    return rule.select(*grid.by, F.least(width, F.col("n") - 1).cast("int").alias("lags"))


def kpss_test(df: DataFrame, grid: Grid, value: str = "y", n_lags: int | str = 72) -> DataFrame:
    """Level-stationarity test; ``n_lags`` is a number or "auto".

    "auto" reads one number back, the widest bandwidth of all series, because it
    sets the span margin.
    """
    bandwidth = None
    if n_lags == "auto":
        bandwidth = _auto_bandwidth(df, grid, value)
        n_lags = bandwidth.agg(F.max("lags")).first()[0] or 0
    tests = span_tests(df, grid, value, kpss_lag=int(n_lags), bandwidth=bandwidth)
    return tests.select(*grid.by, "kpss_stat", kpss_p_value(F.col("kpss_stat")).alias("p_value"), "lags")


# --- verdict -----------------------------------------------------------------------

def verdict(adf_p: Column, kpss_p: Column, alpha: float = 0.05) -> Column:
    """What the two tests say together about further differencing."""
    return (F.when((adf_p < alpha) & (kpss_p > alpha), F.lit("stationary: d=0"))
            .when((adf_p < alpha) & (kpss_p <= alpha), F.lit("borderline: d=0 or d=1"))
            .when(adf_p.isNotNull() & kpss_p.isNotNull(), F.lit("non-stationary: d=1")))


def stationarity_verdict(df: DataFrame, grid: Grid, value: str = "y", season: int = 24,
                         max_lag: int = 48, n_lags: int = 72) -> DataFrame:
    """ADF and KPSS on the raw, seasonally and fully differenced series.

    The three stages form one panel with the stage as an extra key, so both
    tests run once.
    """
    def stage(f):
        y, s = F.col(value), f.at(value, -season)
        return {"_d1": y - s, "_d2": y - s - (f.at(value, -1) - f.at(value, -season - 1))}

    present = df.where(F.col(value).isNotNull())
    wide = over_spans(present, grid, stage, back=season + 1, mode="row")
    stages = F.array(F.struct(F.lit("raw").alias("stage"), F.col(value).cast("double").alias("_v")),
                     F.struct(F.lit("D1").alias("stage"), F.col("_d1").alias("_v")),
                     F.struct(F.lit("d1_D1").alias("stage"), F.col("_d2").alias("_v")))
    panel = (wide.select(*grid.by, grid.ts, F.inline(stages)).where("_v IS NOT NULL"))
    staged = Grid(by=(*grid.by, "stage"), ts=grid.ts, step=grid.step)
    keys = list(staged.by)
    both = span_tests(panel, staged, "_v", adf_lag=max_lag, kpss_lag=n_lags).select(
        *staged.by, "adf.adf_stat", F.col("adf.p_value").alias("adf_p"), "kpss_stat",
        kpss_p_value(F.col("kpss_stat")).alias("kpss_p"))
    return both.withColumn("verdict", verdict(F.col("adf_p"), F.col("kpss_p")))
