"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import D, TYPES, d, h, predictions, query, rd, rs, sql, table, wide
from chronolith.operators import stats


@query("pivot_wide", sql("h", "SELECT ts, " + ", ".join(
    f"max({m}) FILTER (WHERE series_id = '{t}') AS {m}_{t}" for m in ("y", "n") for t in TYPES) + " FROM h GROUP BY 1"))
def _(s, sf):
    return stats.pivot_wide(h(s, sf).withColumn("n", F.col("n").cast("double")), ["ts"], "series_id", ["y", "n"], TYPES)


@query("flag_any", "SELECT date_trunc('hour', ts) AS ts, max((value > 100)::INT) AS is_large, "
                   "max((event_type = 'error')::INT) AS is_error FROM events GROUP BY 1")
def _(s, sf):
    from chronolith.functions.columns import floor_ts
    e = table(s, sf, "events").select(floor_ts(F.col("ts"), 3600).alias("ts"),
                                      (F.col("value") > 100).cast("int").alias("is_large"),
                                      (F.col("event_type") == "error").cast("int").alias("is_error"))
    return stats.flag_any(e, ["ts"], ["is_large", "is_error"])


@query("entity_mean", sql("h", f"SELECT ts, {rs('avg(y)')} AS mean_y FROM h GROUP BY 1"))
def _(s, sf):
    return stats.entity_mean(h(s, sf), ["ts"], "y", "mean_y").withColumn("mean_y", rd("mean_y"))


def _box(source: str, keys: str) -> str:
    return f"""q AS (SELECT {keys}, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM {source} GROUP BY ALL)
    SELECT {keys}, n, {rs('q1')} AS q1, {rs('median')} AS median, {rs('q3')} AS q3,
        min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
        max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM {source} JOIN q USING ({keys}) GROUP BY {keys}, n, q.q1, q.median, q.q3"""


def _rounded(df):
    return df.withColumns({c: rd(c) for c in ("q1", "median", "q3")})


@query("seasonal_profile", sql("h", "SELECT 1", long="""SELECT series_id, part, part_value, y AS v FROM (
    SELECT series_id, y, 'hour' AS part, hour(ts)::INT AS part_value FROM h
    UNION ALL SELECT series_id, y, 'weekday', (isodow(ts) - 1)::INT FROM h
    UNION ALL SELECT series_id, y, 'month', month(ts)::INT FROM h)""").replace(
        " SELECT 1", ", " + _box("long", "series_id, part, part_value")))
def _(s, sf):
    return _rounded(stats.seasonal_profile(h(s, sf), ["series_id"]))


@query("boxplot_stats", "WITH long AS (SELECT 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL "
                        "SELECT 'l_extendedprice', l_extendedprice FROM lineitem), " + _box("long", "measure"))
def _(s, sf):
    return _rounded(stats.measure_boxplots(table(s, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("mae_mape", sql("pred", f"""SELECT model, series_id, count(*) AS n, {rs("avg(abs(y_true - y_pred))")} AS mae,
    {rs("avg(abs(y_true - y_pred) / nullif(abs(y_true), 0)) * 100", 5)} AS mape,
    count(*) FILTER (WHERE y_true = 0) AS n_zero_actual FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2"""))
def _(s, sf):
    from chronolith.operators.backtest import mae_mape
    return mae_mape(predictions(s, sf), ["model", "series_id"]).withColumns({"mae": rd("mae"), "mape": rd("mape", 5)})


@query("r2_score", sql("pred", f"""SELECT model, series_id,
    {rs("1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))")} AS r2
    FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2"""))
def _(s, sf):
    return predictions(s, sf).groupBy("model", "series_id").agg(
        rd(stats.r2_score(F.col("y_true"), F.col("y_pred"))).alias("r2"))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_WIDE = [f"y_{t}" for t in TYPES] + ["total", "n", "peak", "flat"]
_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n,
    CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS corr
    FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
    for i, a in enumerate(_WIDE) for b in _WIDE[:i])
_W = "SELECT *, 5::DOUBLE AS flat FROM wide"


@query("corr_matrix", sql("wide", f"SELECT feature_a, feature_b, n, {rs('corr')} AS corr FROM ({_PAIRS})", w=_W))
def _(s, sf):
    w = wide(s, sf).withColumn("flat", F.lit(5.0))
    return stats.corr_matrix(w, _WIDE).withColumn("corr", rd("corr"))


_LPAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, corr({a}, {b}) AS corr FROM lineitem"
                             for i, a in enumerate(_LI) for b in _LI[:i])


@query("top_correlated_pairs", f"SELECT feature_a, feature_b, n, {rs('corr')} AS corr FROM ({_LPAIRS}) "
                               "ORDER BY abs(corr) DESC, feature_a, feature_b LIMIT 10")
def _(s, sf):
    return stats.top_correlated_pairs(table(s, sf, "lineitem"), _LI, 10).withColumn("corr", rd("corr"))


@query("target_correlation", sql("wide", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 THEN {rs(f'covar_pop(total, {c}) / (stddev_pop({c}) * stddev_pop(total))')} END AS corr
    FROM w WHERE {c} IS NOT NULL AND total IS NOT NULL""" for c in _WIDE if c != "total"), w=_W))
def _(s, sf):
    w = wide(s, sf).withColumn("flat", F.lit(5.0))
    return stats.target_correlation(w, "total", [c for c in _WIDE if c != "total"]).withColumn("corr", rd("corr"))


@query("top_target_correlation", f"""SELECT feature, {rs('corr')} AS corr FROM ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS corr FROM lineitem" for c in _LI if c != "l_extendedprice")})
    ORDER BY abs(corr) DESC, feature LIMIT 3""")
def _(s, sf):
    t = stats.target_correlation(table(s, sf, "lineitem"), "l_extendedprice", [c for c in _LI if c != "l_extendedprice"])
    return stats.top_k(t, F.abs("corr"), 3, "feature").withColumn("corr", rd("corr"))


@query("ols_trend", sql("d", f"""SELECT series_id, count(*) AS n, {rs("regr_slope(y, t)")} AS slope,
    {rs("regr_intercept(y, t)", 4)} AS intercept, {rs("corr(y, t)")} AS r_value,
    {rs("sqrt((1 - corr(y, t) ** 2) * var_pop(y) / var_pop(t) / (count(*) - 2))")} AS std_err
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM d) GROUP BY 1"""))
def _(s, sf):
    return stats.ols_trend(d(s, sf), D).select(
        "series_id", "n", rd("slope").alias("slope"), rd("intercept", 4).alias("intercept"),
        rd("r_value").alias("r_value"), rd("std_err").alias("std_err"))


# Two-sided t probability as the finite trigonometric sum for whole degrees of freedom.
_T_SUM = """SELECT series_id, sum(exp(lp)) AS total FROM (SELECT b.series_id, j,
    sum(CASE WHEN j = first THEN first * ln(cs) ELSE ln((j - 1) / j::DOUBLE) + 2 * ln(cs) END)
        OVER (PARTITION BY b.series_id ORDER BY j) AS lp
    FROM (SELECT *, k % 2 AS first FROM a) b JOIN (SELECT generate_series AS j FROM generate_series(0, 20000)) g
    ON j % 2 = b.first AND j >= b.first AND j <= b.k - 2) GROUP BY 1"""


@query("ols_trend_p_value", sql("d", f"""SELECT a.series_id, {rs("""1 - CASE WHEN k % 2 = 0 THEN sin(th) * total
    ELSE 2 / pi() * (th + sin(th) * total) END""")} AS p_value FROM a JOIN s ON a.series_id = s.series_id""",
    f="""SELECT series_id, count(*) AS n, corr(y, t) AS r FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t
    FROM d) GROUP BY 1""", a="""SELECT series_id, n - 2 AS k, atan(abs(r) / sqrt(1 - r * r)) AS th, cos(atan(abs(r) / sqrt(1 - r * r))) AS cs FROM f""",
    s=_T_SUM))
def _(s, sf):
    return stats.ols_trend(d(s, sf), D).select("series_id", rd("p_value").alias("p_value"))
