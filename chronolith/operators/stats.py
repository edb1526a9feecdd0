"""Grouped statistics: pivots, exact quantiles, box plots, correlation, trend."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from chronolith.operators.grid import Grid, with_position


# --- reshape -----------------------------------------------------------------

def pivot_wide(df: DataFrame, keys: Iterable[str], entity: str, measures: Iterable[str],
               entities: Iterable[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """measure_Entity columns, plus plain aggregates of the same group, in one pass.

    Without a list the entities are found by one small aggregate; with a list, an
    entity that is not on it ends the query with an error instead of losing its
    values.  Expects one row per (keys, entity).
    """
    if entities is None:
        found = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.lit(1)).select(entity).collect()
        entities = sorted(r[0] for r in found)
    entities, who = list(entities), F.col(entity)
    known = F.when(who.isNull() | who.isin(entities), who).otherwise(
        F.raise_error(F.concat(F.lit("unlisted entity: "), who.cast("string"))))
    cells = [F.max(F.when(known == e, F.col(m))).alias(f"{m}_{e.replace(' ', '_')}")
             for m in measures for e in entities]
    return df.groupBy(*keys).agg(*cells, *[c.alias(n) for n, c in (extra or {}).items()])


def flag_any(df: DataFrame, keys: Iterable[str], flags: Iterable[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(f).alias(f) for f in flags])


def entity_mean(df: DataFrame, keys: Iterable[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def join_groups(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join by keys of which NULL is one value among others; the keys come from the left."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


# --- exact quantiles ------------------------------------------------------------

# Relative rank error of the sketch that places the value brackets.
SKETCH_ACCURACY = 10000


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v"))
            .agg(F.count("*").alias("_c")))


def exact_quantiles(df: DataFrame, groups: Iterable[str], value: str, qs: Iterable[float],
                    counts: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group: (groups, n, q_0, q_1, ...).

    ``percentile`` keeps all values of a group in one task's memory.  Here an
    approximate sketch brackets each wanted quantile from both sides, the
    brackets cut a group's distinct values into a few ranges, range totals give
    the rank at which each range starts, and only ranges that hold a wanted rank
    are sorted, each on its own.  The sketch steers the work only: whatever it
    returns, the ranges cover all values and the result is exact.
    """
    groups, qs = list(groups), list(qs)
    counts = value_counts(df, groups, value) if counts is None else counts
    margin = 4.0 / SKETCH_ACCURACY
    marks = sorted({min(max(q + d, 0.0), 1.0) for q in qs for d in (-margin, margin)})
    cuts = (df.where(F.col(value).isNotNull()).groupBy(*groups)
            .agg(F.percentile_approx(F.col(value).cast("double"), marks, SKETCH_ACCURACY).alias("_cuts")))
    placed = join_groups(counts, cuts, groups) if groups else counts.withColumn("_cuts", cuts.scalar())
    below = sum((F.col("_v") > F.col("_cuts")[i]).cast("int") for i in range(len(marks)))
    placed = placed.withColumn("_b", below).drop("_cuts")
    totals = placed.groupBy(*groups, "_b").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*groups)
    starts = totals.select(*groups, "_b", "_bc",
                           F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_start"),
                           F.sum("_bc").over(everything).alias("_n"))
    n1 = F.col("_n") - 1

    def ranks(q):
        # 0-based ranks below and above the wanted position, snapped against
        # representation error of q.
        at = F.round(n1 * F.lit(float(q)), 9)
        return F.floor(at), F.ceil(at), at

    hit = F.lit(False)
    for q in qs:
        lo, hi, _ = ranks(q)
        for r in (lo, hi):
            hit = hit | ((r >= F.col("_start")) & (r < F.col("_start") + F.col("_bc")))
    wanted = starts.where(hit).drop("_bc")
    inside = (Window.partitionBy(*groups, "_b").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    # Spread by range, not by group: see grid.spread_spans.
    ranked = (join_groups(placed, wanted, [*groups, "_b"]).repartition(*groups, "_b")
              .withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
              .withColumn("_first", F.col("_end") - F.col("_c")))

    def pick(r):
        return F.max(F.when((r >= F.col("_first")) & (r < F.col("_end")), F.col("_v")))

    aggs = []
    for i, q in enumerate(qs):
        lo, hi, at = ranks(q)
        aggs += [pick(lo).alias(f"_lo{i}"), pick(hi).alias(f"_hi{i}"), F.max(at - lo).alias(f"_w{i}")]
    picked = ranked.groupBy(*groups).agg(F.max("_n").alias("n"), *aggs)
    return picked.select(*groups, "n", *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q_{i}")
        for i in range(len(qs))])


def boxplot_stats(df: DataFrame, groups: Iterable[str], value: str) -> DataFrame:
    """Quartiles, 1.5 x IQR whiskers (extreme values inside the fences), outlier count."""
    groups = list(groups)
    counts = value_counts(df, groups, value)
    q = exact_quantiles(df, groups, value, [0.25, 0.5, 0.75], counts).select(
        *groups, "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (join_groups(counts, q, groups).groupBy(*groups, "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).cast("long").alias("n_outliers")))


def seasonal_profile(df: DataFrame, by: Iterable[str], ts: str = "ts", value: str = "y") -> DataFrame:
    """Box-plot statistics by hour, weekday and month in one pass over the rows."""
    t = F.col(ts)
    parts = F.array(*[F.struct(F.lit(name).alias("part"), c.cast("int").alias("part_value")) for name, c in
                      [("hour", F.hour(t)), ("weekday", F.weekday(t)), ("month", F.month(t))]])
    long = df.where(F.col(value).isNotNull()).select(*by, value, F.inline(parts))
    return boxplot_stats(long, [*by, "part", "part_value"], value)


def measure_boxplots(df: DataFrame, measures: Iterable[str]) -> DataFrame:
    """Ungrouped box-plot statistics, one row per measure."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_value"))
                        for m in measures])
    return boxplot_stats(df.select(F.inline(entries)), ["measure"], "_value")


# --- correlation -----------------------------------------------------------------

def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pair_moments(p: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    rows, cols = np.tril_indices(p, -1)

    def fold(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            s, ss = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, s, s.T, ss, ss.T, x.T @ x])
        yield pd.DataFrame({"i": rows, "j": cols, **{
            name: total[k][rows, cols] for k, name in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}})
    return fold


def corr_matrix(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Lower triangle (feature_a, feature_b, corr) of the pairwise-complete Pearson matrix.

    Each task folds its rows into p x p moment matrices and emits them once, so
    the shuffle carries matrices, not rows.  Columns are shifted by their means
    first (one aggregate row) to keep the moments well scaled.
    """
    features = list(features)
    p = len(features)
    q = [F.col(f"`{c}`").cast("double") for c in features]
    means = df.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{k}")
                              for k, c in enumerate(q)]).alias("_m")).scalar()
    shifted = df.select(*[(c - means.getField(f"m{k}")).alias(f"c{k}") for k, c in enumerate(q)])
    moments = shifted.mapInPandas(
        _pair_moments(p), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    m = moments.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / F.nullif(n, F.lit(0.0)), F.col("syy") - sy * sy / F.nullif(n, F.lit(0.0))
    # A constant column leaves only rounding noise in its centered moment.
    alive = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")) & (n > 1)
    corr = F.when(alive, (F.col("sxy") - sx * sy / F.nullif(n, F.lit(0.0))) / F.sqrt(
        F.when(alive, vx * vy).otherwise(1.0)))
    names = F.array(*[F.lit(c) for c in features])
    return m.select(names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
                    corr.alias("corr"), n.cast("long").alias("n"))


def top_correlated_pairs(df: DataFrame, features: Iterable[str], k: int = 10) -> DataFrame:
    return (corr_matrix(df, features).where("corr IS NOT NULL")
            .orderBy(F.desc(F.abs("corr")), "feature_a", "feature_b").limit(k))


def target_correlation(df: DataFrame, target: str, features: Iterable[str]) -> DataFrame:
    """Correlation of every feature with the target, one aggregate pass."""
    t = F.col(f"`{target}`")
    entries = [F.struct(F.lit(c).alias("feature"), guarded_corr(F.col(f"`{c}`"), t).alias("corr"))
               for c in features]
    return df.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))


def top_k(df: DataFrame, by: Column, k: int, *ties: str | Column) -> DataFrame:
    """The k largest rows; the tie columns make the choice unique."""
    return df.orderBy(by.desc_nulls_last(), *ties).limit(k)


def argmax(df: DataFrame, by: Iterable[str], value: str, ts: str = "ts") -> DataFrame:
    """Timestamp and size of the maximum per group, the earliest on a tie."""
    best = F.min_by(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")),
                    F.struct((-F.col(value)).alias("v"), F.col(ts).alias("t")))
    return (df.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("_b"))
            .select(*by, F.col("_b.t").alias("max_ts"), F.col("_b.v").alias("max_value")))


# --- trend ------------------------------------------------------------------------

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t, one value per fitted series."""
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0
                      else _incomplete_beta(k / 2.0, 0.5, k / (k + v * v)) for v, k in zip(t, df)],
                     dtype="float64")


def ols_trend(df: DataFrame, grid: Grid, value: str = "y") -> DataFrame:
    """Slope, intercept, r, two-sided p-value and slope error of y on its row ordinal."""
    present = df.where(F.col(value).isNotNull())
    y, x = F.col(value), F.col("_t")
    fit = (with_position(present, grid, "_t").groupBy(*grid.by)
           .agg(F.count("*").alias("n"), F.covar_pop(y, x).alias("_cxy"), F.var_pop(x).alias("_vx"),
                F.var_pop(y).alias("_vy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my")))
    slope = F.try_divide(F.col("_cxy"), F.col("_vx"))
    r = F.try_divide(F.col("_cxy"), F.sqrt(F.col("_vx") * F.col("_vy")))
    dof = F.col("n") - 2
    err = F.when(dof > 0, F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * F.try_divide(F.col("_vy"), F.col("_vx"))
                                 / F.nullif(dof, F.lit(0))))
    out = fit.select(*grid.by, "n", slope.alias("slope"),
                     (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                     r.alias("r_value"), err.alias("std_err"), dof.cast("double").alias("_dof"))
    return (out.withColumn("p_value", t_two_sided(F.try_divide(F.col("slope"), F.col("std_err")), "_dof"))
            .drop("_dof"))


def r2_score(y: Column, p: Column) -> Column:
    """1 - residual over total sum of squares, on rows where both are present."""
    both = y.isNotNull() & p.isNotNull()
    yy = F.when(both, y)
    return 1.0 - F.try_divide(F.sum(F.when(both, (y - p) ** 2)), F.var_pop(yy) * F.count(yy))
