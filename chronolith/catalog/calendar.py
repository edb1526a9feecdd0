"""Calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import D, d, h, holidays, query, rd, rs, sql, table
from chronolith.functions import calendar as cal
from chronolith.functions import columns as fc
from chronolith.operators.grid import over_spans


@query("calendar_parts", "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow, "
                         "dayofyear(ts)::INT AS doy, month(ts)::INT AS month FROM events")
def _(s, sf):
    return table(s, sf, "events").select("event_id", *[c.alias(n) for n, c in cal.calendar_parts(F.col("ts")).items()])


_CYC = ", ".join(f"{rs(f'{f}(2 * pi() * {part} / {p}::DOUBLE)')} AS {n}_{f}" for n, part, p in (
    ("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("doy", "dayofyear(ts)", 365.25)) for f in ("sin", "cos"))


@query("cyclical_encode", sql("h", f"SELECT series_id, ts, {_CYC} FROM h"))
def _(s, sf):
    return h(s, sf).select("series_id", "ts", *[rd(c).alias(n) for n, c in cal.cyclical_columns(F.col("ts")).items()])


@query("is_weekend", "SELECT o_orderkey, (isodow(o_orderdate) >= 6)::INT AS is_weekend FROM orders")
def _(s, sf):
    return table(s, sf, "orders").select("o_orderkey", cal.is_weekend(F.col("o_orderdate")).alias("is_weekend"))


@query("is_holiday", sql("hol", """SELECT o_orderkey, o_orderdate, (o_orderdate::DATE IN (SELECT date FROM hol))::INT
    AS is_holiday FROM orders"""))
def _(s, sf):
    return cal.with_holiday(table(s, sf, "orders").select("o_orderkey", "o_orderdate"), holidays(s, sf), "o_orderdate")


@query("is_bridge_day", sql("d flags", """SELECT series_id, ts, y, coalesce(f.is_holiday, 0) AS is_holiday,
    coalesce(f.is_bridge_day, 0) AS is_bridge_day FROM d LEFT JOIN flags f ON d.ts::DATE = f.date"""))
def _(s, sf):
    return cal.with_day_flags(d(s, sf), holidays(s, sf))


@query("is_bridge_day_positional", sql("d hol", """SELECT series_id, ts, ((isodow(ts) = 1 AND coalesce(lead(is_h) OVER w, 0) = 1)
    OR (isodow(ts) = 5 AND coalesce(lag(is_h) OVER w, 0) = 1))::INT AS is_bridge_day
    FROM (SELECT *, (ts::DATE IN (SELECT date FROM hol))::INT AS is_h FROM d)
    WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""))
def _(s, sf):
    flagged = cal.with_holiday(d(s, sf), holidays(s, sf))
    return over_spans(flagged, D, lambda f: {"is_bridge_day": cal.positional_bridge(f, "ts", day=1)},
                      back=1, ahead=1, mode="row").select("series_id", "ts", "is_bridge_day")


@query("holiday_lookup", sql("hol", """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate::DATE IN (SELECT date FROM hol)"""))
def _(s, sf):
    days = holidays(s, sf).select("date").distinct()
    li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return li.join(days, F.to_date("l_shipdate") == F.col("date"), "left_semi")


@query("scalar_math", f"""SELECT c_custkey, {rs("ln(1 + abs(c_acctbal))")} AS log_balance,
    abs(c_acctbal) AS abs_balance, greatest(c_acctbal, 0) AS positive_part FROM customer""")
def _(s, sf):
    b = F.col("c_acctbal")
    return table(s, sf, "customer").select(
        "c_custkey", rd(fc.log1p_filled(F.abs(b))).alias("log_balance"), F.abs(b).alias("abs_balance"),
        fc.clip_lower(b, 0.0).alias("positive_part"))


@query("clean_entity_names", "SELECT p_partkey, replace(p_name, ' ', '_') AS token, "
                             "replace(p_type, 'PROMO', '') AS stripped FROM part")
def _(s, sf):
    return table(s, sf, "part").select("p_partkey", fc.name_token(F.col("p_name")).alias("token"),
                                       fc.strip_suffix(F.col("p_type"), "PROMO").alias("stripped"))
