"""Registry, views over the test tables, and the same views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronolith.functions.calendar import NATIONAL_FIXED, holidays_for
from chronolith.functions.columns import floor_ts
from chronolith.operators.grid import DAY, HOUR, Grid, over_spans, regularize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

H = Grid(by=("series_id",), ts="ts", step=HOUR)
D = Grid(by=("series_id",), ts="ts", step=DAY)
G = Grid(by=(), ts="ts", step=HOUR)

TYPES = ["click", "error", "purchase", "signup", "view"]


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rd(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0::DOUBLE)"


# --- views ------------------------------------------------------------------------

def h(spark, sf) -> DataFrame:
    """Hourly amount and count per event type; hours without an event have no row."""
    return (table(spark, sf, "events")
            .groupBy(F.col("event_type").alias("series_id"), floor_ts(F.col("ts"), HOUR).alias("ts"))
            .agg(F.round(F.sum("value"), 2).alias("y"), F.count("*").alias("n")))


def hr(spark, sf) -> DataFrame:
    """h on the full hourly spine; missing hours are NULL."""
    return regularize(h(spark, sf), H)


def hf(spark, sf) -> DataFrame:
    """h on the full spine with an amount of 0 where nothing happened."""
    return hr(spark, sf).select("series_id", "ts", F.coalesce("y", F.lit(0.0)).alias("y"))


def hu(spark, sf) -> DataFrame:
    """Hourly amount per user on the full spine, 0 where nothing happened."""
    hourly = (table(spark, sf, "events")
              .groupBy(F.col("user_id").alias("series_id"), floor_ts(F.col("ts"), HOUR).alias("ts"))
              .agg(F.round(F.sum("value"), 2).alias("y")))
    return regularize(hourly, H).withColumn("y", F.coalesce("y", F.lit(0.0)))


def d(spark, sf) -> DataFrame:
    """Daily order value per order priority."""
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderpriority").alias("series_id"), floor_ts(F.col("o_orderdate"), DAY).alias("ts"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("y")))


def wide(spark, sf) -> DataFrame:
    """One row per hour: amount of each event type (NULL without events), total and count."""
    v = F.col("value")
    return (table(spark, sf, "events").groupBy(floor_ts(F.col("ts"), HOUR).alias("ts"))
            .agg(*[F.round(F.sum(F.when(F.col("event_type") == t, v)), 2).alias(f"y_{t}") for t in TYPES],
                 F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"), F.max("value").alias("peak")))


TRAIN_END, VAL_END = "2024-01-20 23:00:00", "2024-01-25 23:00:00"
EXTRA_HOLIDAYS = [(1, 16, "Founders Day"), (1, 25, "Harbour Day")]


def holidays(spark, sf) -> DataFrame:
    """Holidays of the years of events and orders."""
    days = (table(spark, sf, "events").select(F.to_date("ts").alias("ts"))
            .union(table(spark, sf, "orders").select(F.to_date("o_orderdate"))))
    return holidays_for(days, fixed=NATIONAL_FIXED + EXTRA_HOLIDAYS)


def predictions(spark, sf) -> DataFrame:
    """Point forecasts of hf from the day before, one row per model, series and hour."""
    def make(f):
        return {"lag24": f.at("y", -24), "mean24": f.full(F.avg, "y", -47, -24), "lag1": f.at("y", -1),
                "mean3": f.full(F.avg, "y", -3, -1)}

    lagged = over_spans(hf(spark, sf), H, make, back=47)
    models = {"Seasonal Naive 24h": "lag24", "Univariate Daily Mean": "mean24",
              "TSO Official": "lag1", "Univariate Intraday Mean": "mean3"}
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in models.items()])
    return lagged.select("series_id", "ts", F.col("y").alias("y_true"), F.inline(rows))


def energy_raw(spark, sf) -> DataFrame:
    """Hourly energy-like table in UTC: target with sensor gaps, generation, price and forecast columns."""
    v, t = F.col("value"), F.col("event_type")

    def total(kind):
        return F.round(F.sum(F.when(t == kind, v)), 2)

    return (table(spark, sf, "events").groupBy(floor_ts(F.col("ts"), HOUR).alias("ts_utc"))
            .agg(F.when(F.count("*") % 11 != 0, F.round(F.sum(v), 2)).alias("total load actual"),
                 (F.count("*") * 20.0).alias("total load forecast"),
                 F.max(v).alias("price actual"),
                 total("click").alias("generation fossil gas"),
                 total("view").alias("generation solar"),
                 total("purchase").alias("generation nuclear"),
                 F.lit(None).cast("double").alias("generation marine"),
                 total("signup").alias("generation hydro pumped storage consumption"),
                 F.max(F.when(t == "error", v)).alias("forecast solar day ahead")))


CITIES = [f"Type {t}" for t in TYPES]
DESCRIPTIONS = ["Light rain", "sky is clear", "Heavy snow", "MIST", "thunderstorm with drizzle", "few clouds"]


def weather_raw(spark, sf) -> DataFrame:
    """Weather-like rows, one per event, so most (hour, city) keys repeat."""
    texts = F.array(*[F.lit(x) for x in DESCRIPTIONS])
    v = F.col("value")
    return table(spark, sf, "events").select(
        floor_ts(F.col("ts"), HOUR).alias("ts_utc"), F.concat(F.lit("Type "), "event_type").alias("city_name"),
        (273.15 + v / 4).alias("temp"), (v * 2).alias("humidity"), (v / 2).alias("wind_speed"),
        (F.col("user_id") % 101).cast("double").alias("clouds_all"),
        texts[(F.col("event_id") % 6).cast("int")].alias("weather_description"), F.col("event_id"))


VIEWS = {
    "h": """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y,
            count(*) AS n FROM events GROUP BY 1, 2""",
    "hs": """SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
            FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1)""",
    "hr": "SELECT hs.series_id, hs.ts, h.y, h.n FROM hs LEFT JOIN h ON hs.series_id = h.series_id AND hs.ts = h.ts",
    "hf": "SELECT series_id, ts, coalesce(y, 0) AS y FROM hr",
    "u": """SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y
            FROM events GROUP BY 1, 2""",
    "us": """SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
            FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM u GROUP BY 1)""",
    "hu": """SELECT us.series_id, us.ts, coalesce(u.y, 0) AS y
            FROM us LEFT JOIN u ON us.series_id = u.series_id AND us.ts = u.ts""",
    "d": """SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
            round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2""",
    "wide": "SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
        f"round(sum(value) FILTER (WHERE event_type = '{t}'), 2) AS y_{t}" for t in TYPES)
        + ", round(sum(value), 2) AS total, count(*) AS n, max(value) AS peak FROM events GROUP BY 1",
    "hol": """SELECT * FROM (
            SELECT make_date(y::INT, m, d) AS date FROM hyears t(y),
                   (VALUES (1,1),(1,6),(5,1),(8,15),(10,12),(11,1),(12,6),(12,8),(12,25),(1,16),(1,25)) v(m, d)
            UNION SELECT easter - 2 FROM heaster)""",
    "hyears": """SELECT unnest(range((SELECT least(min(year(ts)), (SELECT min(year(o_orderdate)) FROM orders)) - 1 FROM events),
            (SELECT greatest(max(year(ts)), (SELECT max(year(o_orderdate)) FROM orders)) + 2 FROM events))) AS y""",
    "heaster": """SELECT make_date(y::INT, (n // 31)::INT, (n % 31 + 1)::INT) AS easter FROM (
            SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM (
            SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
            SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
            SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM hyears))))""",
    "flags": """SELECT date, max(hd) AS is_holiday, max(bd) AS is_bridge_day FROM (
            SELECT date, 1 AS hd, 0 AS bd FROM hol
            UNION ALL SELECT (date - INTERVAL 1 DAY)::DATE, 0, 1 FROM hol WHERE isodow(date) = 2
            UNION ALL SELECT (date + INTERVAL 1 DAY)::DATE, 0, 1 FROM hol WHERE isodow(date) = 4) GROUP BY 1""",
    "plags": """SELECT series_id, ts, y, lag(y, 24) OVER w AS lag24, lag(y, 1) OVER w AS lag1,
            CASE WHEN count(y) OVER (w ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) = 24
                 THEN avg(y) OVER (w ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) END AS mean24,
            CASE WHEN count(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
                 THEN avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS mean3
            FROM hf WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "pred": """SELECT series_id, ts, y AS y_true, 'Seasonal Naive 24h' AS model, lag24 AS y_pred FROM plags
            UNION ALL SELECT series_id, ts, y, 'Univariate Daily Mean', mean24 FROM plags
            UNION ALL SELECT series_id, ts, y, 'TSO Official', lag1 FROM plags
            UNION ALL SELECT series_id, ts, y, 'Univariate Intraday Mean', mean3 FROM plags""",
    "energy": """SELECT date_trunc('hour', ts) AS ts_utc,
            CASE WHEN count(*) % 11 <> 0 THEN round(sum(value), 2) END AS "total load actual",
            count(*) * 20::DOUBLE AS "total load forecast", max(value) AS "price actual",
            round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS "generation fossil gas",
            round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS "generation solar",
            round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS "generation nuclear",
            NULL::DOUBLE AS "generation marine",
            round(sum(value) FILTER (WHERE event_type = 'signup'), 2) AS "generation hydro pumped storage consumption",
            max(value) FILTER (WHERE event_type = 'error') AS "forecast solar day ahead" FROM events GROUP BY 1""",
    "ebase": """SELECT s.ts, e.* EXCLUDE (ts_utc) FROM
            (SELECT unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 1 HOUR)) + INTERVAL 1 HOUR AS ts
             FROM energy) s LEFT JOIN energy e ON e.ts_utc + INTERVAL 1 HOUR = s.ts""",
    "weather": """SELECT date_trunc('hour', ts) AS ts_utc, 'Type ' || event_type AS city_name,
            273.15::DOUBLE + value / 4 AS temp, value * 2 AS humidity, value / 2 AS wind_speed,
            (user_id % 101)::DOUBLE AS clouds_all, (['Light rain', 'sky is clear', 'Heavy snow', 'MIST',
            'thunderstorm with drizzle', 'few clouds'])[(event_id % 6 + 1)::INT] AS weather_description, event_id
            FROM events""",
    "wfirst": """SELECT * FROM weather QUALIFY row_number() OVER (PARTITION BY ts_utc, city_name ORDER BY event_id) = 1""",
    "wmeas": """SELECT ts_utc + INTERVAL 1 HOUR AS ts, city_name,
            greatest(18::DOUBLE - (temp - 273.15::DOUBLE), 0::DOUBLE) AS HDD,
            greatest((temp - 273.15::DOUBLE) - 18::DOUBLE, 0::DOUBLE) AS CDD,
            least(wind_speed, 25::DOUBLE) AS wind_speed, least(humidity, 100::DOUBLE) AS humidity,
            clouds_all / 100 AS cloud_cover_pct,
            regexp_matches(lower(weather_description), 'rain|drizzle|shower')::INT AS is_rain,
            regexp_matches(lower(weather_description), 'snow|sleet')::INT AS is_snow,
            regexp_matches(lower(weather_description), 'thunderstorm|squall|heavy|very heavy')::INT AS is_extreme,
            regexp_matches(lower(weather_description), 'fog|mist|haze|dust|smoke|sand')::INT AS is_obscured
            FROM wfirst""",
    "wfeat": "SELECT ts, " + ", ".join(
        f"max({m}) FILTER (WHERE city_name = 'Type {t}') AS {m}_Type_{t}"
        for m in ["HDD", "CDD", "wind_speed", "humidity", "cloud_cover_pct"] for t in TYPES)
        + ", max(is_rain) AS is_rain, max(is_snow) AS is_snow, max(is_extreme) AS is_extreme,"
          " max(is_obscured) AS is_obscured FROM wmeas GROUP BY 1",
    "master": """SELECT e.*, w.* EXCLUDE (ts) FROM ebase e JOIN wfeat w ON e.ts = w.ts
            WHERE e."total load actual" IS NOT NULL""",
}
NEEDS = {"hs": ["h"], "hr": ["hs", "h"], "hf": ["hr"], "us": ["u"], "hu": ["us", "u"], "flags": ["hol"], "hol": ["hyears", "heaster"], "heaster": ["hyears"],
         "plags": ["hf"], "pred": ["plags"], "ebase": ["energy"], "wfirst": ["weather"], "wmeas": ["wfirst"],
         "wfeat": ["wmeas"], "master": ["ebase", "wfeat"]}


def sql(views: str, body: str, **extra: str) -> str:
    """Body behind the named views (and everything they need) and extra CTEs."""
    order: list[str] = []

    def add(name):
        if name in order:
            return
        for need in NEEDS.get(name, []):
            add(need)
        order.append(name)

    for name in views.split():
        add(name)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


W = "OVER (PARTITION BY series_id ORDER BY ts)"
