"""Scaling, model, search and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import H, TRAIN_END, VAL_END, W, d, hf, holidays, hu, predictions, query, rd, rs, sql, table
from chronolith.functions.calendar import with_day_flags
from chronolith.operators import backtest, models, scale
from chronolith.operators.clean import chrono_split, drop_any_null
from chronolith.operators.grid import over_spans
from chronolith.sources.tables import materialize

_TS = f"TIMESTAMP '{TRAIN_END}'"
_TV = f"TIMESTAMP '{VAL_END}'"


def train_rows():
    return F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")


# --- scaling ------------------------------------------------------------------------

@query("naive_validation", sql("hf", f"""SELECT series_id, count(*) AS n, {rs('avg(abs(y - p))')} AS mae,
    {rs('avg(abs(y - p) / nullif(abs(y), 0)) * 100', 5)} AS mape, count(*) FILTER (WHERE y = 0) AS n_zero_actual
    FROM (SELECT *, lag(y, 24) {W} AS p FROM hf) WHERE ts > {_TS} AND ts <= {_TV} AND p IS NOT NULL GROUP BY 1"""))
def _(s, sf):
    from chronolith.operators.windows import seasonal_naive
    naive = chrono_split(seasonal_naive(hf(s, sf), H, period=24), TRAIN_END, VAL_END)
    out = backtest.mae_mape(naive.where("split = 'val'"), ["series_id"], "y", "y_pred")
    return out.withColumns({"mae": rd("mae"), "mape": rd("mape", 5)})


@query("standardize_fit", f"""SELECT {rs('avg(l_quantity)')} AS quantity_mean, {rs('stddev_pop(l_quantity)')} AS quantity_std,
    {rs('avg(l_extendedprice)', 4)} AS price_mean, {rs('stddev_pop(l_extendedprice)', 4)} AS price_std
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-31'""")
def _(s, sf):
    train = F.col("l_shipdate") <= F.lit("1998-12-31").cast("timestamp_ntz")
    p = scale.standardize_fit(table(s, sf, "lineitem"), ["l_quantity", "l_extendedprice"], train)
    return p.select(rd("l_quantity__center").alias("quantity_mean"), rd("l_quantity__scale").alias("quantity_std"),
                    rd("l_extendedprice__center", 4).alias("price_mean"), rd("l_extendedprice__scale", 4).alias("price_std"))


@query("standardize_apply", f"""SELECT l_orderkey, l_linenumber, {rs('(l_quantity - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END')} AS l_quantity,
    {rs('(l_extendedprice - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END')} AS l_extendedprice FROM lineitem, (SELECT avg(l_quantity) AS m1,
    stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-12-31')""")
def _(s, sf):
    train = F.col("l_shipdate") <= F.lit("1998-12-31").cast("timestamp_ntz")
    li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    out = scale.scale_columns(li, train, ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", rd("l_quantity").alias("l_quantity"),
                      rd("l_extendedprice").alias("l_extendedprice"))


@query("standardize_by_series", sql("hu", f"""SELECT series_id, ts, {rs('(y - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS y FROM hu
    JOIN (SELECT series_id, avg(y) AS m, stddev_pop(y) AS sd FROM hu WHERE ts <= {_TS} GROUP BY 1) USING (series_id)"""))
def _(s, sf):
    return scale.scale_columns(hu(s, sf), train_rows(), ["y"], ["series_id"]).withColumn("y", rd("y"))


@query("inverse_scale", sql("hu", f"SELECT series_id, ts, {rs('y', 4)} AS y FROM hu"))
def _(s, sf):
    base = hu(s, sf)
    params = scale.standardize_fit(base, ["y"], train_rows(), ["series_id"])
    scaled = scale.scale_apply(base, params, ["y"], ["series_id"])
    return scale.scale_invert(scaled, params, {"y": "y"}, ["series_id"]).withColumn("y", rd("y", 4))


@query("minmax_scale", sql("hu", f"""SELECT series_id, ts, {rs('(y - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END', 9)} AS y FROM hu
    JOIN (SELECT series_id, min(y) AS lo, max(y) AS hi FROM hu WHERE ts <= {_TS} GROUP BY 1) USING (series_id)"""))
def _(s, sf):
    return scale.minmax_scale(hu(s, sf), ["y"], train_rows(), ["series_id"]).withColumn("y", rd("y", 9))


@query("scale_columns", f"""SELECT unique_id, ds, y, is_bulk_is_active, {rs('(price - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS price FROM
    (SELECT l_returnflag AS unique_id, l_shipdate AS ds, l_quantity AS y, (l_quantity > 40)::INT AS is_bulk_is_active,
    l_extendedprice AS price FROM lineitem), (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-12-31')""")
def _(s, sf):
    train = F.col("ds") <= F.lit("1998-12-31").cast("timestamp_ntz")
    df = table(s, sf, "lineitem").select(
        F.col("l_returnflag").alias("unique_id"), F.col("l_shipdate").alias("ds"), F.col("l_quantity").alias("y"),
        (F.col("l_quantity") > 40).cast("int").alias("is_bulk_is_active"), F.col("l_extendedprice").alias("price"))
    return scale.scale_columns(df, train).withColumn("price", rd("price"))


# --- fits ------------------------------------------------------------------------------

def features(s, sf):
    """hf with short and daily lags, complete rows."""
    def make(f):
        return {"lag_1": f.at("y", -1), "lag_2": f.at("y", -2), "lag_24": f.at("y", -24),
                "mean_24": f.full(F.avg, "y", -24, -1)}
    return drop_any_null(over_spans(hf(s, sf), H, make, back=24))


_FEAT = f"""SELECT * FROM (SELECT series_id, ts, y, lag(y, 1) {W} AS lag_1, lag(y, 2) {W} AS lag_2, lag(y, 24) {W} AS lag_24
    FROM hf) WHERE lag_24 IS NOT NULL"""


@query("fit_predict_gbt")
def _(s, sf):
    f = features(s, sf)
    out = models.fit_predict_gbt(f.where(train_rows()), f.where(~train_rows()), ["lag_1", "lag_24", "mean_24"],
                                 maxIter=5, maxDepth=3, stepSize=0.3)
    return backtest.mae_mape(out, ["series_id"], "y", "y_pred").withColumns({"mae": rd("mae", 4), "mape": rd("mape", 4)})


# Two-regressor least squares in closed form.
def _ols2(source: str, y: str, a: str, b: str, where: str, keys: str = "") -> str:
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}my - ba * ma - bb * mb AS b0, ba, bb FROM (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM (SELECT {lead}avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb,
    var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby
    FROM {source} WHERE {where}{group}))"""


@query("fit_predict_linear", f"""WITH c AS ({_ols2('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount', "l_shipdate <= TIMESTAMP '1998-12-31'")})
    SELECT l_orderkey, l_linenumber, {rs('b0 + ba * l_quantity + bb * l_discount', 3)} AS y_pred FROM lineitem, c
    WHERE l_shipdate > TIMESTAMP '1998-12-31'""")
def _(s, sf):
    li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice")
    train = F.col("l_shipdate") <= F.lit("1998-12-31").cast("timestamp_ntz")
    out = models.fit_predict_linear(li.where(train), li.where(~train), ["l_quantity", "l_discount"], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", rd("y_pred", 3).alias("y_pred"))


@query("fit_predict_linear_panel", sql("hf", f"""SELECT f.series_id, f.ts, {rs('b0 + ba * lag_1 + bb * lag_24', 4)} AS y_pred
    FROM f JOIN c ON f.series_id = c.series_id WHERE ts > {_TS}""", f=_FEAT,
    c=_ols2("f", "y", "lag_1", "lag_24", f"ts <= {_TS}", "series_id")))
def _(s, sf):
    f = features(s, sf)
    coef = models.fit_panel(f.where(train_rows()), ["series_id"], ["lag_1", "lag_24"])
    out = models.predict_panel(f.where(~train_rows()), coef, ["series_id"], ["lag_1", "lag_24"])
    return out.select("series_id", "ts", rd("y_pred", 4).alias("y_pred"))


@query("additive_forecast")
def _(s, sf):
    flagged = with_day_flags(d(s, sf), holidays(s, sf))
    out = models.additive_forecast(flagged, ["series_id"], "1995-01-01 00:00:00", "1999-12-31 00:00:00",
                                   flags=["is_holiday", "is_bridge_day"], daily=0)
    test = out.where(F.col("ts") > F.lit("1999-12-31").cast("timestamp_ntz"))
    return backtest.mae_mape(test, ["series_id"], "y", "y_pred").withColumns({"mae": rd("mae", 3), "mape": rd("mape", 4)})


_TREND = "SELECT *, (epoch(ts) - epoch(TIMESTAMP '1995-01-01')) / 1e8 AS t, (ts::DATE IN (SELECT date FROM hol))::INT AS hd FROM d"


@query("additive_forecast_trend", sql("d hol", f"""SELECT x.series_id, x.ts, {rs('b0 + ba * t + bb * hd', 3)} AS y_pred FROM x JOIN c
    ON x.series_id = c.series_id WHERE ts > TIMESTAMP '1999-12-31'""", x=_TREND,
    c=_ols2("x", "y", "t", "hd", "ts <= TIMESTAMP '1999-12-31'", "series_id")))
def _(s, sf):
    flagged = with_day_flags(d(s, sf), holidays(s, sf))
    out = models.additive_forecast(flagged, ["series_id"], "1995-01-01 00:00:00", "1999-12-31 00:00:00", ridge=0.0,
                                   flags=["is_holiday"], knots=0, yearly=0, weekly=0, daily=0)
    return out.where(F.col("ts") > F.lit("1999-12-31").cast("timestamp_ntz")).select(
        "series_id", "ts", rd("y_pred", 3).alias("y_pred"))


@query("additive_forecast_multiplicative")
def _(s, sf):
    out = models.additive_forecast(d(s, sf), ["series_id"], "1995-01-01 00:00:00", "1999-12-31 00:00:00",
                                   mode="multiplicative", daily=0)
    test = out.where(F.col("ts") > F.lit("1999-12-31").cast("timestamp_ntz"))
    return backtest.mae_mape(test, ["series_id"], "y", "y_pred").withColumns({"mae": rd("mae", 3), "mape": rd("mape", 4)})


@query("quantile_forecast", sql("hf", f"""SELECT t.series_id, t.ts, t.y, {rs('p + r[1]', 5)} AS q05, {rs('p + r[2]', 5)} AS q50,
    {rs('p + r[3]', 5)} AS q95 FROM t JOIN b ON t.series_id = b.series_id AND hour(t.ts) = b.hr WHERE t.ts > {_TV}""",
    t=f"SELECT *, lag(y, 24) {W} AS p FROM hf", b=f"""SELECT series_id, hour(ts) AS hr, quantile_cont(y - p, [0.05, 0.5, 0.95]) AS r FROM t
    WHERE ts > {_TS} AND ts <= {_TV} GROUP BY 1, 2"""))
def _(s, sf):
    from chronolith.operators.windows import seasonal_naive
    split = chrono_split(seasonal_naive(hf(s, sf), H, period=24), TRAIN_END, VAL_END)
    out = models.quantile_forecast(split.where("split = 'val'"), split.where("split = 'test'"), ["series_id"])
    return out.select("series_id", "ts", "y", *[rd(q, 5).alias(q) for q in ("q05", "q50", "q95")])


# --- search ------------------------------------------------------------------------------

@query("time_grid_search", sql("hf", " UNION ALL ".join(f"""SELECT {i} AS trial, NULL::VARCHAR AS error, '{{"column": "{c}"}}' AS params,
    {rs(f'avg(abs(y - (b0 + b1 * {c})))', 5)} AS mae FROM f, (SELECT regr_slope(y, {c}) AS b1, regr_intercept(y, {c}) AS b0 FROM f
    WHERE ts <= {_TS}) WHERE ts > {_TS} AND ts <= {_TV}""" for i, c in enumerate(("lag_1", "lag_24"))), f=_FEAT))
def _(s, sf):
    f = chrono_split(features(s, sf), TRAIN_END, VAL_END)
    def fit(train, val, column):
        return models.fit_predict_linear(train, val, [column])
    return models.time_grid_search(s, f.where("split = 'train'"), f.where("split = 'val'"), fit,
                                   [{"column": "lag_1"}, {"column": "lag_24"}]).withColumn("mae", rd("mae", 5))


@query("time_grid_search_gbt")
def _(s, sf):
    # The trials share one stored table, so the sources are read once however many trials there are.
    f = materialize(chrono_split(features(s, sf), TRAIN_END, VAL_END), s)
    def fit(train, val, **p):
        return models.fit_predict_gbt(train, val, ["lag_1", "lag_24"], **p)
    trials = models.random_trials({"maxDepth": ("int", 2, 3), "maxIter": ("int", 2, 3), "stepSize": ("log", 0.05, 0.5)}, 2)
    return models.time_grid_search(s, f.where("split = 'train'"), f.where("split = 'val'"), fit, trials).withColumn("mae", rd("mae", 4))


@query("ridge_search", sql("hf", f"""SELECT series_id, penalty, {rs('avg(abs(y - (my - slope * mx / (1 + penalty) + slope / (1 + penalty) * lag_1)))', 5)} AS mae
    FROM f JOIN (SELECT series_id, regr_slope(y, lag_1) AS slope, avg(y) AS my, avg(lag_1) AS mx FROM f WHERE ts <= {_TS} GROUP BY 1) c USING (series_id),
    (VALUES (0::DOUBLE), (0.1::DOUBLE), (1::DOUBLE)) v(penalty) WHERE ts > {_TS} AND ts <= {_TV} GROUP BY 1, 2""", f=_FEAT))
def _(s, sf):
    f = chrono_split(features(s, sf), TRAIN_END, VAL_END)
    return models.ridge_search(f.where("split = 'train'"), f.where("split = 'val'"), ["series_id"], ["lag_1"],
                               [0.0, 0.1, 1.0]).withColumn("mae", rd("mae", 5))


_CAND = (24, 25, 26, 48, 168)


@query("best_trial", sql("hf", f"""SELECT series_id, k AS trial, {rs('mae')} AS mae FROM (SELECT series_id, k, avg(abs(y - p)) AS mae FROM ("""
    + " UNION ALL ".join(f"SELECT series_id, ts, y, {k} AS k, lag(y, {k}) {W} AS p FROM hf" for k in _CAND)
    + f""") WHERE ts > {_TS} AND ts <= {_TV} AND p IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mae, k) = 1"""))
def _(s, sf):
    from chronolith.operators.windows import lag_features
    lagged = chrono_split(lag_features(hf(s, sf), H, lags=_CAND, prefix="p_"), TRAIN_END, VAL_END).where("split = 'val'")
    trials = lagged.select("series_id", "y", F.inline(F.array(*[
        F.struct(F.lit(k).alias("trial"), F.col(f"p_{k}").alias("p")) for k in _CAND])))
    scores = trials.where("p IS NOT NULL").groupBy("series_id", "trial").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return models.best_trial(scores, "trial", by=["series_id"]).withColumn("mae", rd("mae"))


@query("ablation_sets", sql("hf", f"""SELECT series_id, 'lag_1 only' AS column_set, {rs('avg(abs(y - (i1 + s1 * lag_1)))', 5)} AS mae FROM v GROUP BY 1
    UNION ALL SELECT series_id, 'both', {rs('avg(abs(y - (b0 + ba * lag_1 + bb * lag_24)))', 5)} FROM v GROUP BY 1""", f=_FEAT,
    c1=f"SELECT series_id, regr_slope(y, lag_1) AS s1, regr_intercept(y, lag_1) AS i1 FROM f WHERE ts <= {_TS} GROUP BY 1",
    c2=_ols2("f", "y", "lag_1", "lag_24", f"ts <= {_TS}", "series_id"),
    v=f"SELECT * FROM f JOIN c1 USING (series_id) JOIN c2 USING (series_id) WHERE ts > {_TS} AND ts <= {_TV}"))
def _(s, sf):
    f = chrono_split(features(s, sf), TRAIN_END, VAL_END)
    return models.ablation_sets(f.where("split = 'train'"), f.where("split = 'val'"), ["series_id"],
                                {"lag_1 only": ["lag_1"], "both": ["lag_1", "lag_24"]}).withColumn("mae", rd("mae", 5))


@query("leakage_probe", sql("hf", "SELECT unnest(['lag_24', 'mean_24_of_day_before']) AS feature, 0::BIGINT AS n_changed"))
def _(s, sf):
    def build(df):
        return over_spans(df, H, lambda f: {"lag_24": f.at("y", -24), "mean_24_of_day_before": f.full(F.avg, "y", -47, -24)}, back=47)
    return models.leakage_probe(hf(s, sf), build, ["series_id", "ts"], TRAIN_END, 24 * 3600)


# --- backtests ------------------------------------------------------------------------------

@query("walk_forward_retrain", sql("hf", f"""SELECT f.series_id, f.ts, {rs('regr.b0 + regr.b1 * f.lag_24', 4)} AS y_pred FROM f JOIN (
    SELECT t.series_id, t.day, regr_slope(h.y, h.lag_24) AS b1, regr_intercept(h.y, h.lag_24) AS b0
    FROM (SELECT DISTINCT series_id, date_trunc('day', ts) AS day FROM f WHERE ts > {_TS}) t
    JOIN f h ON h.series_id = t.series_id AND h.ts < t.day GROUP BY 1, 2) regr
    ON f.series_id = regr.series_id AND date_trunc('day', f.ts) = regr.day WHERE f.ts > {_TS}""", f=_FEAT))
def _(s, sf):
    out = backtest.walk_forward_retrain(features(s, sf), H, ["lag_24"], "2024-01-21 00:00:00")
    return out.select("series_id", "ts", rd("y_pred", 4).alias("y_pred"))


@query("walk_forward_weekly", sql("hf", f"""SELECT f.series_id, f.ts, {rs('regr.b0 + regr.b1 * f.lag_24', 4)} AS y_pred FROM (SELECT *,
    floor((epoch(date_trunc('day', ts)) - epoch(TIMESTAMP '2024-01-14')) / 86400 / 7)::INT AS fold FROM f) f JOIN (
    SELECT t.series_id, t.fold, regr_slope(h.y, h.lag_24) AS b1, regr_intercept(h.y, h.lag_24) AS b0
    FROM (SELECT DISTINCT series_id, fold FROM (SELECT *, floor((epoch(date_trunc('day', ts)) - epoch(TIMESTAMP '2024-01-14')) / 86400 / 7)::INT
    AS fold FROM f) WHERE fold >= 0) t JOIN f h ON h.series_id = t.series_id AND h.ts < TIMESTAMP '2024-01-14' + INTERVAL 7 DAY * t.fold GROUP BY 1, 2) regr
    ON f.series_id = regr.series_id AND f.fold = regr.fold WHERE f.ts >= TIMESTAMP '2024-01-14'""", f=_FEAT))
def _(s, sf):
    out = backtest.walk_forward_retrain(features(s, sf), H, ["lag_24"], "2024-01-14 00:00:00", retrain_every=7)
    return out.select("series_id", "ts", rd("y_pred", 4).alias("y_pred"))


@query("rolling_origin_score", sql("pred", f"""SELECT model, horizon, count(*) AS n, {rs('avg(abs(y_true - y_pred))')} AS mae,
    {rs('avg(abs(y_true - y_pred) / nullif(abs(y_true), 0)) * 100', 5)} AS mape, count(*) FILTER (WHERE y_true = 0) AS n_zero_actual FROM (
    SELECT *, ((epoch(ts) - epoch({_TS})) / 3600 - 1)::BIGINT % 24 + 1 AS horizon, count(*) OVER (PARTITION BY model, series_id,
    floor(((epoch(ts) - epoch({_TS})) / 3600 - 1) / 24)) AS c FROM pred WHERE ts > {_TS}) WHERE c = 24 AND y_pred IS NOT NULL GROUP BY 1, 2"""))
def _(s, sf):
    out = backtest.rolling_origin_score(predictions(s, sf), H, "2024-01-21 00:00:00", 24)
    return out.withColumns({"mae": rd("mae"), "mape": rd("mape", 5)})


@query("rolling_origin_score_h1", sql("pred", f"""SELECT model, 1 AS horizon, count(*) AS n, {rs('avg(abs(y_true - y_pred))')} AS mae,
    {rs('avg(abs(y_true - y_pred) / nullif(abs(y_true), 0)) * 100', 5)} AS mape, count(*) FILTER (WHERE y_true = 0) AS n_zero_actual
    FROM pred WHERE ts > {_TS} AND y_pred IS NOT NULL GROUP BY 1"""))
def _(s, sf):
    out = backtest.rolling_origin_score(predictions(s, sf), H, "2024-01-21 00:00:00", 1)
    return out.withColumns({"mae": rd("mae"), "mape": rd("mape", 5)})


@query("score_model", sql("hf", f"""SELECT 'linear' AS model, f.series_id, f.ts, f.y AS y_true, {rs('b0 + ba * lag_1 + bb * lag_24', 4)} AS y_pred
    FROM f, c WHERE ts > {_TS}""", f=_FEAT, c=_ols2("f", "y", "lag_1", "lag_24", f"ts <= {_TS}")))
def _(s, sf):
    f = features(s, sf)
    model = models.fit_linear(f.where(train_rows()), ["lag_1", "lag_24"])
    return backtest.score_model(model, f.where(~train_rows()), "linear", H).withColumn("y_pred", rd("y_pred", 4))


@query("score_status", sql("pred", """SELECT e.model, e.series_id, coalesce(c.n, 0) > 0 AS ok, coalesce(c.n, 0) AS n_scored FROM
    (SELECT DISTINCT model, series_id FROM pred UNION SELECT DISTINCT 'Missing Model', series_id FROM pred) e LEFT JOIN
    (SELECT model, series_id, count(*) AS n FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2) c
    ON e.model = c.model AND e.series_id = c.series_id"""))
def _(s, sf):
    p = predictions(s, sf)
    expected = p.select("model", "series_id").union(p.select(F.lit("Missing Model"), "series_id"))
    return backtest.score_status(expected, p)
