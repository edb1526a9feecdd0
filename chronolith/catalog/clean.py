"""Cleaning and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import TRAIN_END, TYPES, VAL_END, h, hr, hu, predictions, query, rd, rs, sql, table, wide
from chronolith.functions import columns as fc
from chronolith.functions.columns import floor_ts
from chronolith.operators import audit, clean
from chronolith.operators.grid import HOUR


@query("utc_to_local", "SELECT o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS local_ts FROM orders")
def _(s, sf):
    return table(s, sf, "orders").select(
        "o_orderkey", clean.utc_to_local("o_orderdate", "Europe/Madrid").alias("local_ts"))


@query("dedup_first_time", """SELECT date_trunc('hour', ts) AS hour_ts, ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) = 1""")
def _(s, sf):
    e = table(s, sf, "events").select(floor_ts(F.col("ts"), HOUR).alias("hour_ts"), "ts", "event_id", "value")
    return clean.dedup_first(e, ["hour_ts"], ["ts", "event_id"])


@query("dedup_first_key", """SELECT date_trunc('hour', ts) AS hour_ts, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY event_id) = 1""")
def _(s, sf):
    e = table(s, sf, "events").select(floor_ts(F.col("ts"), HOUR).alias("hour_ts"), "event_type", "event_id", "value")
    return clean.dedup_first(e, ["hour_ts", "event_type"], ["event_id"])


@query("duplicate_audit", f"""SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys,
    coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_repeated,
    {rs("coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE * 100")} AS repeated_pct,
    {rs("(sum(n) - count(*)) / sum(n)::DOUBLE * 100")} AS surplus_pct
    FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type)""")
def _(s, sf):
    e = table(s, sf, "events").select(floor_ts(F.col("ts"), HOUR).alias("hour_ts"), "event_type")
    return audit.duplicate_audit(e, ["hour_ts", "event_type"]).withColumns(
        {c: rd(c) for c in ("repeated_pct", "surplus_pct")})


@query("duplicate_sample", """SELECT hour_ts, event_type, event_id FROM (SELECT date_trunc('hour', ts) AS hour_ts,
    event_type, event_id, count(*) OVER (PARTITION BY date_trunc('hour', ts), event_type) AS n FROM events)
    WHERE n > 1 ORDER BY hour_ts, event_type, event_id LIMIT 10""")
def _(s, sf):
    e = table(s, sf, "events").select(floor_ts(F.col("ts"), HOUR).alias("hour_ts"), "event_type", "event_id")
    return audit.duplicate_sample(e, ["hour_ts", "event_type"], ["event_id"])


@query("kelvin_to_celsius", f"SELECT event_id, {rs('value + 260 - 273.15::DOUBLE')} AS celsius FROM events")
def _(s, sf):
    return table(s, sf, "events").select("event_id", rd(fc.kelvin_to_celsius(F.col("value") + 260)).alias("celsius"))


@query("degree_days", sql("hr", f"""SELECT series_id, ts,
    {rs("CASE WHEN y IS NOT NULL THEN greatest(18 - y / 3, 0) END")} AS hdd,
    {rs("CASE WHEN y IS NOT NULL THEN greatest(y / 3 - 18, 0) END")} AS cdd FROM hr"""))
def _(s, sf):
    t = F.col("y") / 3
    return hr(s, sf).select("series_id", "ts", rd(fc.heating_degrees(t)).alias("hdd"),
                            rd(fc.cooling_degrees(t)).alias("cdd"))


_FLAGS = {"is_rain": "rain|drizzle|shower", "is_snow": "snow|sleet",
          "is_extreme": "thunderstorm|squall|heavy|very heavy", "is_obscured": "fog|mist|haze|dust|smoke|sand"}


@query("text_flags", "SELECT doc_id, " + ", ".join(
    f"coalesce(regexp_matches(lower(text), '{p}'), false)::INT AS {n}" for n, p in _FLAGS.items()) + " FROM documents")
def _(s, sf):
    return table(s, sf, "documents").select(
        "doc_id", *[fc.pattern_flag(F.col("text"), p).alias(n) for n, p in clean.WEATHER_PATTERNS.items()])


@query("clip_upper", sql("hr", "SELECT series_id, ts, CASE WHEN y > 25 THEN 25::DOUBLE ELSE y END AS y_25, "
                               "CASE WHEN y > 100 THEN 100::DOUBLE ELSE y END AS y_100 FROM hr"))
def _(s, sf):
    return hr(s, sf).select("series_id", "ts", fc.clip_upper(F.col("y"), 25.0).alias("y_25"),
                            fc.clip_upper(F.col("y"), 100.0).alias("y_100"))


@query("outlier_audit", """SELECT 'l_quantity' AS measure, max(l_quantity) AS max_value,
    count(*) FILTER (WHERE l_quantity > 45) AS n_above FROM lineitem UNION ALL
    SELECT 'l_extendedprice', max(l_extendedprice), count(*) FILTER (WHERE l_extendedprice > 90000) FROM lineitem""")
def _(s, sf):
    return audit.outlier_audit(table(s, sf, "lineitem"), {"l_quantity": 45.0, "l_extendedprice": 90000.0})


@query("scale_constant", f"SELECT l_orderkey, l_linenumber, {rs('l_quantity / 100.0::DOUBLE')} AS quantity_pct FROM lineitem")
def _(s, sf):
    return table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", rd(F.col("l_quantity") / 100.0).alias("quantity_pct"))


@query("drop_null_target", sql("hr", "SELECT series_id, ts, y FROM hr WHERE y IS NOT NULL"))
def _(s, sf):
    return clean.drop_null_target(hr(s, sf).select("series_id", "ts", "y"), "y")


@query("drop_any_null", sql("wide", "SELECT * FROM wide WHERE " + " AND ".join(f"y_{t} IS NOT NULL" for t in TYPES)))
def _(s, sf):
    return clean.drop_any_null(wide(s, sf))


@query("drop_empty_columns", sql("wide", "SELECT ts, " + ", ".join(f"y_{t}" for t in TYPES) + " FROM wide"))
def _(s, sf):
    w = wide(s, sf).select("ts", *[f"y_{t}" for t in TYPES], F.lit(None).cast("double").alias("y_ghost"))
    return clean.drop_empty_columns(w)


@query("drop_listed_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_partkey, l_suppkey, "
                              "l_extendedprice, l_returnflag, l_linestatus FROM lineitem")
def _(s, sf):
    return clean.drop_listed_columns(table(s, sf, "lineitem"), ["l_discount", "l_tax", "not there"])


@query("select_by_pattern", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity FROM lineitem")
def _(s, sf):
    li = table(s, sf, "lineitem")
    numeric = clean.columns_matching(li, ["l_order", "l_line", "l_q"], ["price", "disc"], numeric_only=True)
    return li.select(*numeric)


@query("rename_to_panel", sql("wide", "SELECT 'grid' AS unique_id, ts AS ds, total AS y, n, peak FROM wide"))
def _(s, sf):
    return clean.rename_to_panel(wide(s, sf).select("ts", "total", "n", "peak"), "ts", "total", "grid")


@query("fill_zero", sql("hr", "SELECT series_id, ts, coalesce(y, 0) AS y FROM hr"))
def _(s, sf):
    return clean.fill_zero(hr(s, sf).select("series_id", "ts", "y"), ["y"])


@query("sparse_activity", sql("wide", f"""SELECT ts, coalesce(y_signup > 0, false)::INT AS y_signup_is_active,
    {rs("ln(1 + coalesce(y_signup, 0))")} AS y_signup FROM wide"""))
def _(s, sf):
    out = clean.sparse_activity(wide(s, sf).select("ts", "y_signup"), ["y_signup"])
    return out.withColumn("y_signup", rd("y_signup"))


@query("chrono_split", sql("h", f"""SELECT series_id, CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train'
    WHEN ts <= TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows,
    min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY 1, 2"""))
def _(s, sf):
    return audit.time_bounds(clean.chrono_split(h(s, sf), TRAIN_END, VAL_END), ["series_id", "split"])


@query("mask_invalid", sql("pred", f"SELECT model, series_id, ts, {rs('y_pred')} AS y_pred FROM pred WHERE y_pred IS NOT NULL"))
def _(s, sf):
    return clean.mask_invalid(predictions(s, sf)).select("model", "series_id", "ts", rd("y_pred").alias("y_pred"))


_BY_USER = "SELECT user_id, date_trunc('hour', ts) AS ts, " + ", ".join(
    f"max(value) FILTER (WHERE event_type = '{t}') AS y_{t}" for t in TYPES) + " FROM events GROUP BY 1, 2"
_CENSUS = sql("", f"WITH w AS ({_BY_USER}) " + " UNION ALL ".join(
    f"SELECT 'y_{t}' AS column_name, count(*) FILTER (WHERE y_{t} IS NULL) AS n_missing, "
    + rs(f"count(*) FILTER (WHERE y_{t} IS NULL) / count(*)::DOUBLE * 100") + " AS missing_pct FROM w "
    f"HAVING count(*) FILTER (WHERE y_{t} IS NULL) > 0" for t in TYPES))


@query("missing_census", _CENSUS)
def _(s, sf):
    w = (table(s, sf, "events").groupBy("user_id", floor_ts(F.col("ts"), HOUR).alias("ts"))
         .agg(*[F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(f"y_{t}") for t in TYPES]))
    return audit.missing_census(w).withColumn("missing_pct", rd("missing_pct"))


@query("zero_share", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {rs(f'avg(({c} = 0)::INT) * 100')} AS zero_pct FROM lineitem" for c in ("l_discount", "l_tax")))
def _(s, sf):
    return audit.zero_share(table(s, sf, "lineitem"), ["l_discount", "l_tax"]).withColumn("zero_pct", rd("zero_pct"))


_AUDIT = {"is_rain": "rain|drizzle|shower", "is_snow": "snow|sleet", "is_extreme": "thunderstorm|squall|heavy",
          "is_obscured": "fog|mist|haze|dust|smoke"}


@query("flag_density", " UNION ALL ".join(
    f"SELECT '{n}' AS flag, " + rs(f"avg(coalesce(regexp_matches(lower(text), '{p}'), false)::INT) * 100")
    + " AS density_pct FROM documents" for n, p in _AUDIT.items()))
def _(s, sf):
    return audit.flag_density(table(s, sf, "documents"), "text", clean.AUDIT_PATTERNS).withColumn(
        "density_pct", rd("density_pct"))


@query("time_bounds", sql("hu", "SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM hu GROUP BY 1"))
def _(s, sf):
    return audit.time_bounds(hu(s, sf), ["series_id"])


@query("time_slice", "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem "
                     "WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-09' AND TIMESTAMP '1997-01-22'")
def _(s, sf):
    return clean.time_slice(table(s, sf, "lineitem"), "1997-01-09 00:00:00", "1997-01-22 00:00:00", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("leakage_bound", sql("energy", 'SELECT ts_utc, "total load actual" AS load FROM energy'))
def _(s, sf):
    from chronolith.catalog.base import energy_raw
    return clean.leakage_bound(energy_raw(s, sf)).withColumnRenamed("total load actual", "load")
