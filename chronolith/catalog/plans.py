"""Pipeline queries: raw tables to master, master to model-input matrices, error profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import (
    CITIES, H, TRAIN_END, TYPES, W, energy_raw, hf, holidays, query, rd, rs, sql, weather_raw)
from chronolith.catalog.leaderboard import _CMP
from chronolith.operators import windows
from chronolith.plans import energy, matrices, profile

_TS = f"TIMESTAMP '{TRAIN_END}'"
LOAD = "total load actual"
SPARSE = ["generation hydro pumped storage consumption"]


def _weather(s, sf):
    return energy.weather_features(weather_raw(s, sf), CITIES, order=["event_id"])


def _master(s, sf):
    return energy.master_table(energy.energy_base(energy_raw(s, sf), time=None), _weather(s, sf))


def _rounded(df, skip=(), digits=6):
    """Round every double column and make names plain."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        name = f.name.replace(" ", "_")
        out.append((rd(c, digits) if f.dataType.simpleString() == "double" and f.name not in skip else c).alias(name))
    return df.select(*out)


_EN = ["total load actual", "total load forecast", "price actual", "generation fossil gas", "generation solar",
       "generation nuclear", "generation marine", "generation hydro pumped storage consumption", "forecast solar day ahead"]
_WF = [f"{m}_Type_{t}" for m in ("HDD", "CDD", "wind_speed", "humidity", "cloud_cover_pct") for t in TYPES]
_FL = ["is_rain", "is_snow", "is_extreme", "is_obscured"]


def _q(name: str) -> str:
    return f'{rs(chr(34) + name + chr(34))} AS "{name.replace(" ", "_")}"'


@query("energy_base", sql("ebase", f"SELECT ts, {', '.join(_q(c) for c in _EN)} FROM ebase"))
def _(s, sf):
    return _rounded(energy.energy_base(energy_raw(s, sf), time=None))


@query("weather_features", sql("wfeat", f"SELECT ts, {', '.join(_q(c) for c in _WF)}, {', '.join(_FL)} FROM wfeat"))
def _(s, sf):
    return _rounded(_weather(s, sf))


@query("master_table", sql("master", f"SELECT ts, {', '.join(_q(c) for c in _EN + _WF)}, {', '.join(_FL)} FROM master"))
def _(s, sf):
    return _rounded(_master(s, sf))


_FLAGJ = "LEFT JOIN flags f ON m.ts::DATE = f.date"
_FLAGC = "coalesce(f.is_holiday, 0) AS is_holiday, coalesce(f.is_bridge_day, 0) AS is_bridge_day"
_SIN = "sin(2 * pi() * {0} / {1}::DOUBLE) AS {2}_sin, cos(2 * pi() * {0} / {1}::DOUBLE) AS {2}_cos"
_CYC = ", ".join(_SIN.format(*x) for x in (("hour(m.ts)", 24, "hour"), ("(isodow(m.ts) - 1)", 7, "dow"),
                                            ("dayofyear(m.ts)", 365.25, "doy")))
_CYCN = [f"{p}_{f}" for p in ("hour", "dow", "doy") for f in ("sin", "cos")]


@query("calendar_regressor_matrix", sql("master flags", f'SELECT m.ts AS ds, "total load actual" AS y, {_FLAGC} FROM master m {_FLAGJ}'))
def _(s, sf):
    return matrices.calendar_regressor_matrix(_master(s, sf), holidays(s, sf))


def _frame(a, b):
    return f"(ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


_LAGS = (24, 25, 26, 168, 169, 170)
_Y = '"total load actual"'
_DAY = (f"SELECT m.*, {_CYC}, (isodow(m.ts) >= 6)::INT AS is_weekend, {_FLAGC}, "
        + ", ".join(f"lag({_Y}, {k}) OVER (ORDER BY m.ts) AS load_t_{k}" for k in _LAGS) + ", "
        + ", ".join(f"{a}({_Y}) OVER {_frame(47, 24)} AS rolling_{n}_24h" for n, a in (
            ("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))).replace("ORDER BY ts", "ORDER BY m.ts")
        + f" FROM honest m {_FLAGJ}")
_HONEST = f"SELECT ts, {_Y}, {', '.join(_WF)}, {', '.join(_FL)} FROM master"
_DONE = "SELECT * FROM day0 WHERE load_t_170 IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _WF)
_CALC = _CYCN + ["is_weekend", "is_holiday", "is_bridge_day"]
_ROLL = [f"rolling_{n}_24h" for n in ("mean", "std", "max", "min")]
_INTS = {"is_weekend", "is_holiday", "is_bridge_day", *_FL}


def _cols(names):
    return ", ".join(f"{n}" if n in _INTS else _q(n) for n in names)


_DAYCOLS = [LOAD, *_WF, *_FL, *_CALC, *[f"load_t_{k}" for k in _LAGS], *_ROLL]


def _honest(s, sf):
    from chronolith.operators.clean import leakage_bound
    return leakage_bound(_master(s, sf))


@query("day_ahead_matrix", sql("master flags", f"SELECT ts, {_cols(_DAYCOLS)} FROM da", honest=_HONEST, day0=_DAY, da=_DONE))
def _(s, sf):
    return _rounded(matrices.day_ahead_matrix(_honest(s, sf), holidays(s, sf)))


_FIL = [LOAD, *_FL, *_CALC, *[f"load_t_{k}" for k in _LAGS], *_ROLL]
_HON2 = f"SELECT ts, {_Y}, {', '.join(_FL)} FROM master"
_DONE2 = "SELECT * FROM day0 WHERE load_t_170 IS NOT NULL"


def _plain(s, sf):
    """Honest master without the city measures, so warm-up rows are the only ones lost."""
    return _honest(s, sf).select("ts", f"`{LOAD}`", *_FL)


@query("day_ahead_matrix_plain", sql("master flags", f"SELECT ts, {_cols(_FIL)} FROM da", honest=_HON2, day0=_DAY, da=_DONE2))
def _(s, sf):
    return _rounded(matrices.day_ahead_matrix(_plain(s, sf), holidays(s, sf)))


_SHORT = ", ".join(f"lag({_Y}, {k}) OVER (ORDER BY ts) AS load_t_{k}" for k in (1, 2, 3))
_SIX = ", ".join(f"{a}({_Y}) OVER {_frame(6, 1)} AS rolling_{n}_6h" for n, a in (("mean", "avg"), ("max", "max"), ("min", "min")))
_INTRA = f"SELECT *, load_t_1 - load_t_2 AS load_ramp_1h FROM (SELECT *, {_SHORT}, {_SIX}, row_number() OVER (ORDER BY ts) AS rn FROM da) WHERE rn > 6"
_INTRACOLS = [LOAD, *_FL, *_CALC, *_ROLL, "load_t_1", "load_t_2", "load_t_3", "load_ramp_1h"] + [f"rolling_{n}_6h" for n in ("mean", "max", "min")]


@query("intraday_matrix", sql("master flags", f"SELECT ts, {_cols(_INTRACOLS)} FROM ia", honest=_HON2, day0=_DAY, da=_DONE2, ia=_INTRA))
def _(s, sf):
    return _rounded(matrices.intraday_matrix(_plain(s, sf), holidays(s, sf)))


@query("day_ahead_matrix_time", sql("hf flags", f"""SELECT series_id, ts, is_holiday, is_bridge_day, {rs('y', 4)} AS y, load_t_24, load_t_170, {rs('rm')} AS rolling_mean_24h
    FROM (SELECT m.*, {_FLAGC}, lag(y, 24) {W.replace('series_id', 'm.series_id')} AS load_t_24, lag(y, 170) {W.replace('series_id', 'm.series_id')} AS load_t_170,
    avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) AS rm FROM hf m {_FLAGJ}) WHERE load_t_170 IS NOT NULL"""))
def _(s, sf):
    out = matrices.day_ahead_matrix(hf(s, sf), holidays(s, sf), "y", H, mode="time")
    return out.select("series_id", "ts", "is_holiday", "is_bridge_day", rd("y", 4).alias("y"), "load_t_24", "load_t_170",
                      rd("rolling_mean_24h").alias("rolling_mean_24h"))


_SC = [LOAD, *[f"load_t_{k}" for k in _LAGS], *_ROLL, *_CALC, *_FL]


@query("scaled_matrix", sql("master flags", "SELECT ts, " + ", ".join(
    rs(f'("{c}" - "{c}_m") / CASE WHEN "{c}_s" = 0 THEN 1 ELSE "{c}_s" END') + f' AS "{c.replace(" ", "_")}"' for c in _SC)
    + " FROM da, p", honest=_HON2, day0=_DAY, da=_DONE2,
    p="SELECT " + ", ".join(f'avg("{c}") AS "{c}_m", stddev_pop("{c}") AS "{c}_s"' for c in _SC) + f" FROM da WHERE ts <= {_TS}"))
def _(s, sf):
    return _rounded(matrices.scaled_matrix(_plain(s, sf), holidays(s, sf), TRAIN_END)[0])


_SEQW = [f"{m}_Type_view" for m in ("HDD", "CDD", "wind_speed", "humidity", "cloud_cover_pct")]


@query("sequence_matrix", sql("master flags", f"SELECT 'grid' AS unique_id, ds, y, {_cols([*_FL, *_CYCN, 'is_holiday', 'is_bridge_day'])}, " + ", ".join(
    rs(f"({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END") + f" AS {c}" for c in _SEQW) + " FROM sq, p WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _SEQW),
    sq=f"SELECT m.ts AS ds, {_Y} AS y, {', '.join(_FL)}, {', '.join(_SEQW)}, {_CYC}, {_FLAGC} FROM master m {_FLAGJ}",
    p="SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _SEQW) + f" FROM sq WHERE ds <= {_TS}"))
def _(s, sf):
    m = _honest(s, sf).select("ts", f"`{LOAD}`", *_FL, *_SEQW)
    return _rounded(matrices.sequence_matrix(m, holidays(s, sf), TRAIN_END))


@query("univariate_panel", sql("master", f"SELECT 'grid' AS unique_id, ts AS ds, {_Y} AS y FROM master"))
def _(s, sf):
    return matrices.univariate_panel(_master(s, sf))


# --- leakage studies ------------------------------------------------------------------------

_HYDRO = "generation hydro pumped storage consumption"
_MARKET = ["price actual", "generation fossil gas", "generation solar", "generation nuclear", "forecast solar day ahead"]
_FF = ", ".join(f'coalesce(last_value("{c}" IGNORE NULLS) OVER (ORDER BY ts), 0) AS "{c}"' for c in _MARKET)
_SB = (f'SELECT ts, {_Y}, {", ".join(_FL)}, {_FF}, coalesce("{_HYDRO}" > 0, false)::INT::DOUBLE AS hydro_is_active, '
       f'ln(1 + coalesce("{_HYDRO}", 0)) AS hydro FROM master')


def _market(s, sf):
    return _master(s, sf).select("ts", *[f"`{c}`" for c in _EN], *_FL)


_ACTIVE = f"{_HYDRO}_is_active".replace(" ", "_")
_HYD = _HYDRO.replace(" ", "_")


@query("sandbox_clean", sql("master", f"SELECT ts, {_cols([LOAD, *_FL, *_MARKET])}, hydro_is_active AS {_ACTIVE}, {rs('hydro')} AS {_HYD} FROM sb", sb=_SB))
def _(s, sf):
    return _rounded(matrices.sandbox_clean(_market(s, sf), sparse=SPARSE))


_LAGGED = [c for c in _MARKET if c != "forecast solar day ahead"]
_SBL = (f'SELECT ts, {_Y}, {", ".join(_FL)}, "forecast solar day ahead", ' + ", ".join(
    f'lag("{c}", 24) OVER (ORDER BY ts) AS "{c}_t_24"' for c in _LAGGED)
    + ", lag(hydro, 24) OVER (ORDER BY ts) AS hydro_t_24, lag(hydro_is_active, 24) OVER (ORDER BY ts) AS active_t_24 FROM sb")


@query("sandbox_lagged", sql("master", f"SELECT ts, {_cols([LOAD, *_FL, 'forecast solar day ahead', *[c + '_t_24' for c in _LAGGED]])}, "
                                       f"{rs('hydro_t_24')} AS {_HYD}_t_24, active_t_24 AS {_ACTIVE}_t_24 FROM sl WHERE hydro_t_24 IS NOT NULL",
                             sb=_SB, sl=_SBL))
def _(s, sf):
    return _rounded(matrices.sandbox_lagged(matrices.sandbox_clean(_market(s, sf), sparse=SPARSE)))


@query("sandbox_realtime", sql("master", f"SELECT ts, {_cols([LOAD, *_FL, *_MARKET])}, hydro_is_active AS {_ACTIVE}, {rs('hydro')} AS {_HYD} FROM sb", sb=_SB))
def _(s, sf):
    return _rounded(matrices.sandbox_realtime(matrices.sandbox_clean(_market(s, sf), sparse=SPARSE)))


@query("sandbox_scaled", sql("master", f"SELECT 'grid' AS unique_id, ts AS ds, {_Y} AS y, hydro_is_active AS {_ACTIVE}, " + ", ".join(
    rs(f'("{c}" - "{c}_m") / CASE WHEN "{c}_s" = 0 THEN 1 ELSE "{c}_s" END') + f' AS "{_HYD if c == "hydro" else c.replace(" ", "_")}"'
    for c in [*_MARKET, "hydro", *_FL]) + " FROM sb, p", sb=_SB,
    p="SELECT " + ", ".join(f'avg("{c}") AS "{c}_m", stddev_pop("{c}") AS "{c}_s"' for c in [*_MARKET, "hydro", *_FL])
      + f" FROM sb WHERE ts <= {_TS}"))
def _(s, sf):
    from chronolith.operators.clean import rename_to_panel
    cleaned = matrices.sandbox_realtime(matrices.sandbox_clean(_market(s, sf), sparse=SPARSE))
    return _rounded(matrices.sandbox_scaled(rename_to_panel(cleaned, "ts", LOAD, "grid"), TRAIN_END))


_BUILT = {
    "calendar_regressors": "SELECT count(*) FROM master",
    "univariate_sequence": "SELECT count(*) FROM master",
    "sequence": "SELECT count(*) FROM master",
    "sandbox_realtime_sequence": "SELECT count(*) FROM master",
    "sandbox_lagged_sequence": "SELECT greatest(count(*) - 24, 0) FROM master",
    "day_ahead_trees": "SELECT greatest(count(*) - 170, 0) FROM master",
    "scaled_day_ahead": "SELECT greatest(count(*) - 170, 0) FROM master",
    "sandbox_realtime_trees": "SELECT greatest(count(*) - 170, 0) FROM master",
    "intraday_trees": "SELECT greatest(count(*) - 176, 0) FROM master",
    "sandbox_lagged_trees": "SELECT greatest(count(*) - 194, 0) FROM master",
}


@query("build_all", sql("master", " UNION ALL ".join(f"SELECT '{n}' AS matrix, ({q}) AS n_rows" for n, q in _BUILT.items())))
def _(s, sf):
    from chronolith.sources import tables as src
    folder = src.work_folder(s)
    built = matrices.build_all(_market(s, sf), holidays(s, sf), TRAIN_END, sparse=SPARSE,
                               shared=lambda df: src.materialize(df, s))
    src.write_feature_matrices(built, folder, {n: "ds" if "ds" in df.columns else "ts" for n, df in built.items()})
    out = None
    for name in built:
        size = src.read_features(s, f"{folder}/{name}").agg(F.lit(name).alias("matrix"), F.count("*").alias("n_rows"))
        out = size if out is None else out.unionByName(size)
    return out


# --- error profile -----------------------------------------------------------------------------

def _section(name, hour, where, group):
    return (f"SELECT series_id, '{name}' AS section, {hour} AS hour, count(*) AS n_hours, {rs('avg(model_error)')} AS model_mae, "
            f"{rs('avg(benchmark_error)')} AS benchmark_mae, {rs('avg(win) * 100')} AS win_pct FROM c LEFT JOIN flags f ON c.ts::DATE = f.date "
            f"WHERE {where} GROUP BY {group}")


@query("error_profile", sql("hf flags", " UNION ALL ".join([
    _section("overall", "-1", "true", "series_id"), _section("holiday", "-1", "f.is_holiday = 1 OR f.is_bridge_day = 1", "series_id"),
    _section("hour", "hour(ts)::INT", "true", "series_id, hour(ts)")]), c=_CMP))
def _(s, sf):
    base = windows.lag_features(hf(s, sf), H, lags=(1, 24), prefix="p")
    forecast = base.select("series_id", "ts", F.col("y").alias("y_true"), F.col("p1").alias("q50"))
    bench = base.select("series_id", "ts", F.col("p24").alias("benchmark"))
    out = profile.error_profile(forecast, bench, holidays(s, sf), ["series_id", "ts"])
    return out.withColumns({c: rd(c) for c in ("model_mae", "benchmark_mae", "win_pct")})
