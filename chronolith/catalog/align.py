"""Join, alignment, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import H, TRAIN_END, h, hr, hu, query, rd, rs, sql, table, wide
from chronolith.operators import align, grid, stats


@query("regularize", sql("hu", "SELECT series_id, ts, y FROM hu"))
def _(s, sf):
    return hu(s, sf)


@query("regularize_daily", """WITH d AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
    round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1, 2), s AS (SELECT series_id,
    unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY 1)
    SELECT s.series_id, s.ts, d.y FROM s LEFT JOIN d ON s.series_id = d.series_id AND s.ts = d.ts""")
def _(s, sf):
    from chronolith.functions.columns import floor_ts
    day = grid.Grid(by=("series_id",), ts="ts", step=grid.DAY)
    daily = (table(s, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"),
                                              floor_ts(F.col("l_shipdate"), grid.DAY).alias("ts"))
             .agg(F.round(F.sum("l_quantity"), 2).alias("y")))
    return grid.regularize(daily, day)


@query("join_master", sql("h wide", "SELECT h.ts, h.series_id, h.y, wide.total, wide.peak FROM h JOIN wide ON h.ts = wide.ts"))
def _(s, sf):
    return align.join_master(h(s, sf).select("ts", "series_id", "y"), wide(s, sf).select("ts", "total", "peak"), ["ts"])


@query("attach_benchmark", sql("hr", """SELECT hr.series_id, hr.ts, hr.y, b.first_value AS benchmark FROM hr LEFT JOIN
    (SELECT event_type, date_trunc('hour', ts) AS ts, min_by(value, event_id) AS first_value FROM events GROUP BY 1, 2) b
    ON hr.series_id = b.event_type AND hr.ts = b.ts"""))
def _(s, sf):
    from chronolith.functions.columns import floor_ts
    other = table(s, sf, "events").select(F.col("event_type").alias("series_id"), floor_ts(F.col("ts"), 3600).alias("ts"),
                                          F.col("value").alias("benchmark"), "event_id")
    return align.attach_benchmark(hr(s, sf).select("series_id", "ts", "y"), other, ["series_id", "ts"],
                                  ["event_id"]).drop("event_id")


@query("align_to", sql("hs", "SELECT hs.series_id, hs.ts, h.n FROM hs LEFT JOIN h ON hs.series_id = h.series_id AND hs.ts = h.ts"))
def _(s, sf):
    base = h(s, sf)
    return align.align_to(grid.spine(base, H), base.select("series_id", "ts", "n"), ["series_id", "ts"])


@query("lookup_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(s, sf):
    wanted = table(s, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return align.lookup_rows(wanted, table(s, sf, "orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"])


_DAYS = {"o": "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS order_value FROM orders GROUP BY 1",
         "l": "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, count(*) AS shipped FROM lineitem GROUP BY 1"}


def _days(s, sf):
    """Daily value of all orders and daily count of all shipped lines: two whole tables with different days."""
    orders = table(s, sf, "orders").groupBy(F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("order_value"))
    lines = table(s, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.count("*").alias("shipped"))
    return orders, lines


@query("concat_columns", sql("", "SELECT coalesce(o.ts, l.ts) AS ts, order_value, shipped FROM o FULL JOIN l ON o.ts = l.ts", **_DAYS))
def _(s, sf):
    return align.concat_columns(*_days(s, sf), ["ts"])


@query("align_intersection", sql("", "SELECT o.ts, order_value, shipped FROM o JOIN l ON o.ts = l.ts", **_DAYS))
def _(s, sf):
    return align.align_intersection(*_days(s, sf), ["ts"])


@query("sort_time", sql("h", "SELECT series_id, ts, y FROM h ORDER BY ts, series_id"))
def _(s, sf):
    return h(s, sf).select("series_id", "ts", "y").orderBy("ts", "series_id")


@query("sample_head", sql("h", "SELECT series_id, ts, y FROM h ORDER BY ts, series_id LIMIT 10"))
def _(s, sf):
    return h(s, sf).select("series_id", "ts", "y").orderBy("ts", "series_id").limit(10)


@query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def _(s, sf):
    li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.top_k(li, F.col("l_extendedprice"), 10, "l_orderkey", "l_linenumber")


@query("argmax", sql("hu", """SELECT series_id, ts AS max_ts, y AS max_value FROM hu
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY y DESC, ts) = 1"""))
def _(s, sf):
    return stats.argmax(hu(s, sf), ["series_id"], "y")


@query("append_rows", sql("h", f"""SELECT series_id, ts, y, 'train' AS part FROM h WHERE ts <= TIMESTAMP '{TRAIN_END}'
    UNION ALL SELECT series_id, ts, y, 'new' FROM h WHERE ts > TIMESTAMP '{TRAIN_END}'"""))
def _(s, sf):
    base = h(s, sf).select("series_id", "ts", "y")
    edge = F.lit(TRAIN_END).cast("timestamp_ntz")
    return align.append_rows(base.where(F.col("ts") <= edge).withColumn("part", F.lit("train")),
                             base.where(F.col("ts") > edge).withColumn("part", F.lit("new")))


@query("append_series", sql("hf", f"""SELECT series_id, ts, {rs("(y - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END")} AS y,
    part FROM (SELECT *, CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' ELSE 'eval' END AS part FROM hf) JOIN
    (SELECT series_id, min(y) AS lo, max(y) AS hi FROM hf WHERE ts <= TIMESTAMP '{TRAIN_END}' GROUP BY 1) USING (series_id)"""))
def _(s, sf):
    from chronolith.catalog.base import hf
    from chronolith.operators.scale import minmax_fit, scale_apply
    base, edge = hf(s, sf), F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")
    params = minmax_fit(base, ["y"], edge, ["series_id"])
    train = scale_apply(base.where(edge), params, ["y"], ["series_id"]).withColumn("part", F.lit("train"))
    evals = scale_apply(base.where(~edge), params, ["y"], ["series_id"]).withColumn("part", F.lit("eval"))
    return align.append_rows(train, evals).withColumn("y", rd("y"))
