"""Leaderboard and benchmark comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import H, W, hf, holidays, predictions, query, rd, rs, sql
from chronolith.functions.calendar import with_day_flags
from chronolith.operators import leaderboard as lb
from chronolith.operators.backtest import mae_mape

# Names under which the test forecasts are filed; ``ord`` is the order of recording.
_BOARD = [
    ("Seasonal Naive 24h", 1, "Naive Floor", "Baseline", "Day-Ahead (h=24)"),
    ("Univariate Daily Mean", 2, "N-HiTS Univariate 168h", "Stage 1", "Day-Ahead (h=24)"),
    ("Univariate Daily Mean", 3, "LightGBM Improved", "Stage 2", "Day-Ahead (h=24)"),
    ("Univariate Daily Mean", 4, "Linear Regression (Leakage)", "Stage 3", None),
    ("TSO Official", 5, "TSO Official (Ceiling)", "Benchmark", "Day-Ahead (h=24)"),
    ("Univariate Intraday Mean", 6, "LightGBM Univariate Intraday", "Stage 4", "Intraday (h=1)"),
    ("TSO Official", 7, "LightGBM Multivariate", "Stage 4", "Intraday (h=1)"),
    ("Univariate Intraday Mean", 8, "LightGBM MLOps Daily Retrain", "Stage 5", "Intraday (h=1)"),
]


def board(s, sf):
    scores = mae_mape(predictions(s, sf), ["model", "series_id"]).withColumnRenamed("model", "_source")
    names = s.createDataFrame(_BOARD, "_source string, ord int, model string, stage string, horizon string")
    return scores.join(names, "_source").select("series_id", "ord", "stage", "model", "horizon", rd("mae").alias("mae"))


_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _BOARD)
_B = f"""SELECT s.series_id, n.ord, n.stage, n.model, n.horizon, s.mae FROM (SELECT model, series_id, {rs('avg(abs(y_true - y_pred))')} AS mae
    FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2) s JOIN (VALUES {_ROWS}) n(source, ord, model, stage, horizon) ON s.model = n.source"""


@query("append_results", sql("pred", "SELECT series_id, ord, stage, model, horizon, mae FROM b UNION ALL "
                                     "SELECT series_id, 9, 'Stage 6', 'Best So Far', 'Day-Ahead (h=24)', min(mae) FROM b GROUP BY 1", b=_B))
def _(s, sf):
    b = board(s, sf)
    more = b.groupBy("series_id").agg(F.min("mae").alias("mae")).select(
        "series_id", F.lit(9).alias("ord"), F.lit("Stage 6").alias("stage"), F.lit("Best So Far").alias("model"),
        F.lit("Day-Ahead (h=24)").alias("horizon"), "mae")
    return lb.append_results(b, more)


@query("find_model", sql("pred", """SELECT series_id, ord, stage, model, horizon, mae FROM b WHERE lower(model) LIKE '%lightgbm%'
    AND lower(model) LIKE '%multivariate%' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ord) = 1""", b=_B))
def _(s, sf):
    return lb.find_model(board(s, sf), "LightGBM", "Multivariate")


@query("find_model_exact", sql("pred", "SELECT series_id, ord, stage, model, horizon, mae FROM b WHERE model = 'LightGBM Improved'", b=_B))
def _(s, sf):
    return lb.find_model(board(s, sf), "LightGBM", exact="LightGBM Improved")


@query("first_valid", sql("pred", """SELECT series_id, ord, stage, model, horizon, mae FROM b WHERE lower(model) LIKE '%retrain%'
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ord) = 1""", b=_B))
def _(s, sf):
    return lb.first_valid(board(s, sf), [("Hourly", "Retrain"), ("Daily", "Retrain"), ("MLOps",)])


@query("benchmark_bounds", sql("pred", """SELECT series_id, f AS floor_mae, t AS target_mae, c AS ceiling_mae, least(f, c) AS zone_low,
    greatest(f, c) AS zone_high FROM (SELECT series_id, max(mae) FILTER (WHERE ord = 1) AS f, max(mae) FILTER (WHERE ord = 5) AS t,
    max(mae) FILTER (WHERE ord = 4) AS c FROM b GROUP BY 1)""", b=_B))
def _(s, sf):
    return lb.benchmark_bounds(board(s, sf))


@query("filter_by_horizon", sql("pred", """SELECT series_id, ord, model, mae FROM b WHERE coalesce(lower(horizon), '') LIKE '%h=1%'
    OR lower(model) LIKE '%intraday%' OR lower(model) LIKE '%mlops%'""", b=_B))
def _(s, sf):
    return lb.filter_by_horizon(board(s, sf), "intraday").select("series_id", "ord", "model", "mae")


@query("model_family", sql("pred", """SELECT series_id, ord, model, CASE WHEN lower(model) LIKE '%prophet%' THEN 'Statistical'
    WHEN lower(model) LIKE '%mlp%' OR lower(model) LIKE '%tabnet%' THEN 'Tabular Neural' WHEN lower(model) LIKE '%lightgbm%' THEN 'Boosted Trees'
    WHEN lower(model) LIKE '%tft%' OR lower(model) LIKE '%n-hits%' THEN 'Deep Sequence' ELSE 'Other' END AS family FROM b""", b=_B))
def _(s, sf):
    return board(s, sf).select("series_id", "ord", "model", lb.model_family(F.col("model")).alias("family"))


_RANK = "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae DESC, model, horizon) AS rank FROM b"


@query("rank_leaderboard", sql("pred", "SELECT series_id, ord, stage, model, horizon, mae, rank FROM r", b=_B, r=_RANK))
def _(s, sf):
    return lb.rank_leaderboard(board(s, sf))


@query("step_improvement", sql("pred", f"""SELECT series_id, model, rank, mae, {rs('mae - lead(mae) OVER w')} AS delta,
    {rs('(mae - lead(mae) OVER w) / mae * 100', 4)} AS delta_pct FROM r WINDOW w AS (PARTITION BY series_id ORDER BY rank)""", b=_B, r=_RANK))
def _(s, sf):
    return lb.step_improvement(board(s, sf)).select(
        "series_id", "model", "rank", "mae", rd("delta").alias("delta"), rd("delta_pct", 4).alias("delta_pct"))


@query("horizon_flip", sql("pred", """SELECT series_id, CASE WHEN ord IN (6, 7, 8) THEN 'intraday' ELSE 'day-ahead' END AS horizon_class,
    min(mae) FILTER (WHERE ord IN (2, 6)) AS univariate, min(mae) FILTER (WHERE ord IN (3, 7, 8)) AS multivariate
    FROM b WHERE ord IN (2, 3, 6, 7, 8) GROUP BY 1, 2""", b=_B))
def _(s, sf):
    return lb.horizon_flip(board(s, sf))


# --- forecast against benchmark -----------------------------------------------------------

_CMP = f"""SELECT *, abs(y_true - q50) AS model_error, abs(y_true - benchmark) AS benchmark_error,
    coalesce(abs(y_true - q50) < abs(y_true - benchmark), false)::INT AS win FROM (
    SELECT series_id, ts, y AS y_true, lag(y, 1) {W} AS q50, lag(y, 24) {W} AS benchmark FROM hf)"""


def compared(s, sf):
    from chronolith.operators.windows import lag_features
    base = lag_features(hf(s, sf), H, lags=(1, 24), prefix="p")
    forecast = base.select("series_id", "ts", F.col("y").alias("y_true"), F.col("p1").alias("q50"))
    bench = base.select("series_id", "ts", F.col("p24").alias("benchmark"))
    return lb.forecast_vs_benchmark(forecast, bench, ["series_id", "ts"])


@query("forecast_vs_benchmark", sql("hf", f"""SELECT series_id, ts, y_true, q50, benchmark, {rs('model_error')} AS model_error,
    {rs('benchmark_error')} AS benchmark_error, win FROM c""", c=_CMP))
def _(s, sf):
    return compared(s, sf).withColumns({"model_error": rd("model_error"), "benchmark_error": rd("benchmark_error")})


@query("win_rate", sql("hf", f"SELECT series_id, count(*) AS n_hours, sum(win)::BIGINT AS n_wins, {rs('avg(win) * 100')} AS win_pct FROM c GROUP BY 1", c=_CMP))
def _(s, sf):
    return lb.win_rate(compared(s, sf), ["series_id"]).withColumn("win_pct", rd("win_pct"))


@query("conditional_mae", sql("hf flags", f"""SELECT c.series_id, count(*) AS n_hours, {rs('avg(model_error)')} AS model_mae,
    {rs('avg(benchmark_error)')} AS benchmark_mae, {rs('avg(win) * 100')} AS win_pct FROM c JOIN flags f ON c.ts::DATE = f.date
    WHERE f.is_holiday = 1 OR f.is_bridge_day = 1 GROUP BY 1""", c=_CMP))
def _(s, sf):
    flagged = with_day_flags(compared(s, sf), holidays(s, sf))
    cond = (F.col("is_holiday") == 1) | (F.col("is_bridge_day") == 1)
    return lb.conditional_mae(flagged, cond, ["series_id"]).withColumns(
        {c: rd(c) for c in ("model_mae", "benchmark_mae", "win_pct")})


@query("hourly_error_profile", sql("hf", f"""SELECT series_id, hour, {rs('m')} AS model_mae, {rs('b')} AS benchmark_mae, {rs('b - m')} AS diff,
    (row_number() OVER (PARTITION BY series_id ORDER BY b - m DESC, hour) = 1)::INT AS is_best FROM (SELECT series_id, hour(ts)::INT AS hour,
    avg(model_error) AS m, avg(benchmark_error) AS b FROM c GROUP BY 1, 2)""", c=_CMP))
def _(s, sf):
    return lb.hourly_error_profile(compared(s, sf), ["series_id"]).withColumns(
        {c: rd(c) for c in ("model_mae", "benchmark_mae", "diff")})
