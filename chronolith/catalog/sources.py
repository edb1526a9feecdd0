"""Source and sink queries: each writes data of the test tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from chronolith.catalog.base import H, W, h, hf, hu, predictions, query, rd, rs, sql, table
from chronolith.operators import models, windows
from chronolith.operators.backtest import mae_mape
from chronolith.sources import tables as src


@query("read_hourly_csv", "SELECT event_id, ts AS ts_utc, value FROM events")
def _(s, sf):
    path = src.work_folder(s)
    text = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = table(s, sf, "events").select(F.concat(text, F.lit("+01:00")).alias("time"), "event_id", "value")
    src.write_master(raw, path, "csv")
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("event_id", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    return src.read_hourly_csv(s, path, schema).drop("time")


@query("read_projected", "SELECT o_orderkey, o_totalprice FROM orders")
def _(s, sf):
    path = src.work_folder(s)
    orders = table(s, sf, "orders")
    src.write_master(orders, path, "csv")
    return src.read_projected(s, path, orders.schema, ["o_orderkey", "o_totalprice"])


@query("read_master", sql("h", "SELECT series_id, ts, y, n FROM h"))
def _(s, sf):
    path = src.work_folder(s)
    master = h(s, sf)
    src.write_master(master, path, "csv")
    return src.read_master(s, path, master.schema)


@query("write_master", sql("hu", "SELECT series_id, ts, y FROM hu"))
def _(s, sf):
    path = src.work_folder(s)
    src.write_master(hu(s, sf), path)
    return src.read_master(s, path)


@query("read_features", sql("hu", f"SELECT series_id, ts, y, strftime(ts, '%Y-%m') AS ym, lag(y, 24) {W} AS load_t_24 FROM hu"))
def _(s, sf):
    path = src.work_folder(s)
    src.write_features(windows.lag_features(hu(s, sf), H, lags=(24,)), path)
    return src.read_features(s, path)


@query("write_feature_matrices", sql("hf", "SELECT 'panel' AS matrix, series_id, count(*) AS n_rows, count(y) AS n_values FROM hf GROUP BY 1, 2 "
                                           f"UNION ALL SELECT 'lags', series_id, count(*), count(p) FROM (SELECT *, lag(y, 24) {W} AS p FROM hf) GROUP BY 1, 2"))
def _(s, sf):
    folder = src.work_folder(s)
    base = hf(s, sf)
    src.write_feature_matrices({"panel": base, "lags": windows.lag_features(base, H, lags=(24,))}, folder)
    def size(name, value):
        return src.read_features(s, f"{folder}/{name}").groupBy(F.lit(name).alias("matrix"), "series_id").agg(
            F.count("*").alias("n_rows"), F.count(value).alias("n_values"))
    return size("panel", "y").unionByName(size("lags", "load_t_24"))


@query("cache_predictions", sql("pred", f"""SELECT model, series_id, count(*) AS n, {rs('avg(abs(y_true - y_pred))')} AS mae
    FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2"""))
def _(s, sf):
    path = src.work_folder(s)
    src.cache_predictions(s, path, lambda: predictions(s, sf))

    def again():
        raise AssertionError("the cached table must be read, not recomputed")

    cached = src.cache_predictions(s, path, again)
    return mae_mape(cached, ["model", "series_id"]).select("model", "series_id", "n", rd("mae").alias("mae"))


@query("append_leaderboard", sql("pred", f"""SELECT model, count(*) AS n, {rs('sum(mae)', 4)} AS mae_sum FROM (SELECT model, series_id,
    round(avg(abs(y_true - y_pred)), 6) AS mae FROM pred WHERE y_pred IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def _(s, sf):
    path = src.work_folder(s)
    scores = mae_mape(predictions(s, sf), ["model", "series_id"]).withColumn("mae", F.round("mae", 6))
    src.append_leaderboard(scores.where("model LIKE 'Univariate%'"), path, "univariate")
    for _ in range(2):  # a retried job must not file its results twice
        src.append_leaderboard(scores.where("model NOT LIKE 'Univariate%'"), path, "others")
    return src.read_features(s, path).groupBy("model").agg(F.count("*").alias("n"), rd(F.sum("mae"), 4).alias("mae_sum"))


@query("save_model", f"""SELECT l_orderkey, l_linenumber, {rs('b0 + b1 * l_quantity', 3)} AS y_pred FROM lineitem,
    (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem)""")
def _(s, sf):
    path = src.work_folder(s)
    li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    src.save_model(models.fit_linear(li, ["l_quantity"], "l_extendedprice"), path)
    scored = models.predict(src.load_model(path), li)
    return scored.select("l_orderkey", "l_linenumber", rd("y_pred", 3).alias("y_pred"))
