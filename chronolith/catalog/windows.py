"""Window, fill and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import D, H, W, d, h, hf, hr, hu, query, rd, rs, sql
from chronolith.operators import grid, signal, windows

_LAGS = (24, 25, 26, 168, 169, 170)
_LAG_SQL = ", ".join(f"lag(y, {k}) {W} AS load_t_{k}" for k in _LAGS)


@query("lag_features", sql("hu", f"SELECT series_id, ts, y, {_LAG_SQL} FROM hu"))
def _(s, sf):
    return windows.lag_features(hu(s, sf), H)


@query("lag_features_row", sql("h", f"SELECT series_id, ts, y, {_LAG_SQL} FROM h"))
def _(s, sf):
    return windows.lag_features(h(s, sf).drop("n"), H, mode="row")


@query("lag_features_gaps", sql("h", "SELECT h.series_id, h.ts, h.y, " + ", ".join(
    f"a{k}.y AS load_t_{k}" for k in (1, 2, 3)) + " FROM h " + " ".join(
    f"LEFT JOIN h a{k} ON h.series_id = a{k}.series_id AND a{k}.ts = h.ts - INTERVAL {k} HOUR" for k in (1, 2, 3))))
def _(s, sf):
    return windows.lag_features(h(s, sf).drop("n"), H, lags=windows.INTRADAY_LAGS)


@query("lead_flag", sql("hf", f"SELECT series_id, ts, coalesce(lead((y > 50)::INT, 24) {W}, 0) AS busy_lead_24 FROM hf"))
def _(s, sf):
    flagged = hf(s, sf).select("series_id", "ts", (F.col("y") > 50).cast("int").alias("busy"))
    return windows.lead_flag(flagged, H, "busy", 24).drop("busy")


@query("lag_many", sql("h", f"SELECT series_id, ts, lag(y, 24) {W} AS y_t_24, lag(n, 24) {W} AS n_t_24 FROM h"))
def _(s, sf):
    return windows.lag_many(h(s, sf), H, ["y", "n"], 24, mode="row")


@query("ramp", sql("hu", f"SELECT series_id, ts, {rs(f'lag(y, 1) {W} - lag(y, 2) {W}', 4)} AS load_ramp_1h FROM hu"))
def _(s, sf):
    lagged = windows.lag_features(hu(s, sf), H, lags=(1, 2))
    return lagged.select("series_id", "ts", rd(windows.ramp(F.col("load_t_1"), F.col("load_t_2")), 4).alias("load_ramp_1h"))


def _roll(window, lag, stats_):
    agg = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    frame = f"(w ROWS BETWEEN {lag + window - 1} PRECEDING AND {lag} PRECEDING)"
    return ", ".join(f"CASE WHEN count(y) OVER {frame} = {window} THEN " + rs(f"{agg[a]}(y) OVER {frame}")
                     + f" END AS rolling_{a}_{window}h" for a in stats_)


_ROLL24 = ("mean", "std", "max", "min")


@query("rolling_lagged", sql("hu", f"SELECT series_id, ts, y, {_roll(24, 24, _ROLL24)} FROM hu "
                                   "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"))
def _(s, sf):
    out = windows.rolling_lagged(hu(s, sf), H)
    return out.withColumns({f"rolling_{a}_24h": rd(f"rolling_{a}_24h") for a in _ROLL24})


@query("rolling_lagged_6h", sql("h", f"SELECT series_id, ts, y, {_roll(6, 1, ('mean', 'max', 'min'))} FROM h "
                                     "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"))
def _(s, sf):
    out = windows.rolling_lagged(h(s, sf).drop("n"), H, window=6, lag=1, stats=("mean", "max", "min"), mode="row")
    return out.withColumns({f"rolling_{a}_6h": rd(f"rolling_{a}_6h") for a in ("mean", "max", "min")})


@query("centered_ma", sql("d", "SELECT series_id, ts, " + ", ".join(
    f"CASE WHEN count(y) OVER (w ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) = {n} THEN "
    + rs(f"avg(y) OVER (w ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)", 4) + f" END AS ma_{n}"
    for n, b, a in ((7, 3, 3), (30, 15, 14), (365, 182, 182))) + " FROM d WINDOW w AS (PARTITION BY series_id ORDER BY ts)"))
def _(s, sf):
    out = windows.centered_ma(d(s, sf), D, windows=(7, 30, 365))
    return out.select("series_id", "ts", *[rd(f"ma_{n}", 4).alias(f"ma_{n}") for n in (7, 30, 365)])


@query("difference", sql("h", f"SELECT series_id, ts, {rs(f'd24 - lag(d24, 1) {W}', 4)} AS diff_24_1, {rs('d24', 4)} AS diff_24 "
                              f"FROM (SELECT series_id, ts, y - lag(y, 24) {W} AS d24 FROM h)"))
def _(s, sf):
    return windows.difference(h(s, sf).drop("n"), H, lags=(24, 1), steps=True).select(
        "series_id", "ts", rd("diff_24_1", 4).alias("diff_24_1"), rd("diff_24", 4).alias("diff_24"))


@query("seasonal_naive", sql("hu", f"SELECT series_id, ts, y, lag(y, 168) {W} AS y_pred FROM hu"))
def _(s, sf):
    return windows.seasonal_naive(hu(s, sf), H, period=168)


@query("forward_fill", sql("hr", f"SELECT series_id, ts, y, last_value(y IGNORE NULLS) {W} AS y_filled, "
                                 f"last_value(n IGNORE NULLS) {W} AS n_filled FROM hr"))
def _(s, sf):
    return windows.forward_fill(hr(s, sf), H, ["y", "n"], "_filled").drop("n")


@query("interpolate_linear", sql("hr", f"""SELECT series_id, ts, CASE WHEN pv IS NULL THEN NULL WHEN y IS NOT NULL THEN {rs('y')}
    WHEN nt IS NULL THEN {rs('pv')} ELSE {rs("pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt))")} END AS y FROM (
    SELECT *, last_value(y IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS pt,
    first_value(y IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS nt FROM hr
    WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""))
def _(s, sf):
    return windows.interpolate_linear(hr(s, sf).drop("n"), H).withColumn("y", rd("y"))


def _bands(s, sf):
    """Interval columns from the daily-mean model: mean and 2 standard deviations of the day before."""
    def make(f):
        return {"m": f.full(F.avg, "y", -47, -24), "sd": f.full(F.stddev_samp, "y", -47, -24)}
    b = grid.over_spans(hf(s, sf), H, make, back=47)
    return b.select("series_id", "ts", "y", F.round(F.col("m") - 2 * F.col("sd"), 3).alias("q05"),
                    F.round(F.col("m") + 2 * F.col("sd"), 3).alias("q95"))


_BANDS = """SELECT series_id, ts, y, CASE WHEN c = 24 THEN round(m - 2 * sd, 3) END AS q05, CASE WHEN c = 24 THEN round(m + 2 * sd, 3) END AS q95
    FROM (SELECT series_id, ts, y, avg(y) OVER f AS m, stddev_samp(y) OVER f AS sd, count(y) OVER f AS c FROM hf
    WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING))"""
_WIDEST = """SELECT series_id, ts AS end_ts, rm AS mean_width FROM (SELECT series_id, ts,
    CASE WHEN count(q95 - q05) OVER f = 72 THEN avg(q95 - q05) OVER f END AS rm FROM bands
    WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)) WHERE rm IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rm DESC, ts) = 1"""


@query("widest_interval_window", sql("hf", f"""SELECT b.series_id, b.ts, b.y, b.q05, b.q95, w.end_ts, {rs('w.mean_width')} AS mean_width
    FROM bands b JOIN widest w ON b.series_id = w.series_id AND b.ts BETWEEN w.end_ts - INTERVAL 72 HOUR AND w.end_ts""",
    bands=_BANDS, widest=_WIDEST))
def _(s, sf):
    return windows.widest_interval_window(_bands(s, sf), H).withColumn("mean_width", rd("mean_width"))


@query("row_ordinal", sql("hu", f"SELECT series_id, ts, row_number() {W} - 1 AS t FROM hu"))
def _(s, sf):
    return windows.row_ordinal(hu(s, sf), H).select("series_id", "ts", "t")


_DECOMP = """SELECT *, CASE WHEN count(y) OVER (w ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING) = 169 THEN
    (sum(y) OVER (w ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING) + sum(y) OVER (w ROWS BETWEEN 83 PRECEDING AND 84 FOLLOWING)) / 336
    END AS trend, (row_number() OVER w - 1) % 168 AS phase FROM h WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""


@query("seasonal_decompose", sql("h", f"""SELECT t.series_id, t.ts, t.y, {rs('t.trend')} AS trend, {rs('p.s')} AS seasonal,
    {rs('t.y - t.trend - p.s')} AS resid FROM t LEFT JOIN p ON t.series_id = p.series_id AND t.phase = p.phase""",
    t=_DECOMP, p="""SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS s FROM
    (SELECT series_id, phase, avg(y - trend) AS m FROM t GROUP BY 1, 2)"""))
def _(s, sf):
    out = signal.seasonal_decompose(h(s, sf).drop("n"), H, period=168)
    return out.withColumns({c: rd(c) for c in ("trend", "seasonal", "resid")})


_K = 48
_ACF = {
    "c": "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, "
         "y - avg(y) OVER (PARTITION BY series_id) AS dv, count(*) OVER (PARTITION BY series_id) AS n FROM h",
    "g": f"""SELECT a.series_id, k.k AS lag, sum(a.dv * b.dv) / max(a.n) AS gamma, max(a.n) AS n FROM range(0, {_K + 1}) k(k), c a
         JOIN c b ON a.series_id = b.series_id AND b.rn = a.rn + k.k GROUP BY 1, 2""",
    "r": "SELECT series_id, lag, n, gamma / first_value(gamma) OVER (PARTITION BY series_id ORDER BY lag) AS acf FROM g",
}


@query("acf", sql("h", f"""SELECT series_id, lag, {rs('acf')} AS acf, CASE WHEN lag = 0 THEN 0 ELSE {rs('''1.959963984540054 * sqrt((1 + 2 *
    coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n)''')} END AS band FROM r""", **_ACF))
def _(s, sf):
    return signal.acf(h(s, sf), H, max_lag=_K).withColumns({"acf": rd("acf"), "band": rd("band")})


@query("pacf", sql("h", f"""SELECT series_id, lag::INT AS lag, {rs('pacf')} AS pacf FROM (
    SELECT series_id, 0 AS lag, 1::DOUBLE AS pacf FROM rho UNION ALL SELECT series_id, k, phi[k] FROM lev)""",
    **_ACF, rho="SELECT series_id, list(acf ORDER BY lag) AS r FROM r GROUP BY 1",
    lev=f"""SELECT series_id, k, phi FROM (WITH RECURSIVE step(series_id, k, phi, r) AS (
        SELECT series_id, 1, [r[2]], r FROM rho
        UNION ALL
        SELECT series_id, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - p * phi[k + 1 - j]), p), r
        FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
            / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS p FROM step) WHERE k < {_K})
        SELECT series_id, k, phi FROM step)"""))
def _(s, sf):
    return signal.pacf(h(s, sf), H, max_lag=_K).withColumn("pacf", rd("pacf"))


@query("adf_test")
def _(s, sf):
    out = signal.adf_test(h(s, sf), H, max_lag=48)
    return out.withColumns({c: rd(c) for c in ("adf_stat", "p_value", "crit_1", "crit_5", "crit_10")})


_CRIT = {"crit_1": (-3.43035, -6.5393, -16.786, -79.433), "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
         "crit_10": (-2.56677, -1.5384, -2.809, 0.0)}


@query("adf_test_no_lags", sql("h", f"""SELECT series_id, {rs('b / sqrt((vd - b * cxy) / (n - 2) / vx)', 5)} AS adf_stat, 0 AS used_lag, n AS n_obs, """
    + ", ".join(rs(" + ".join(f"({c}) / pow(n, {i})" for i, c in enumerate(cs))) + f" AS {name}" for name, cs in _CRIT.items())
    + f""" FROM (SELECT series_id, count(*) AS n, regr_slope(dy, x) AS b, var_pop(dy) AS vd, covar_pop(dy, x) AS cxy, var_pop(x) AS vx FROM (
    SELECT series_id, lag(y, 1) {W} AS x, y - lag(y, 1) {W} AS dy FROM h) WHERE x IS NOT NULL GROUP BY 1)"""))
def _(s, sf):
    out = signal.adf_test(h(s, sf), H, max_lag=0).drop("p_value")
    return out.withColumns({c: rd(c) for c in ("crit_1", "crit_5", "crit_10")}).withColumn("adf_stat", rd("adf_stat", 5))


def _kpss(lags: int) -> dict[str, str]:
    return {
        "c": _ACF["c"],
        "e": """SELECT series_id, sum(cs * cs) / max(n * n) AS eta FROM (SELECT series_id, n,
             sum(dv) OVER (PARTITION BY series_id ORDER BY rn) AS cs FROM c) GROUP BY 1""",
        "v": f"""SELECT series_id, sum(CASE WHEN lag = 0 THEN gamma ELSE 2 * (1 - lag / ({lags} + 1)::DOUBLE) * gamma END) AS v
             FROM (SELECT a.series_id, k.k AS lag, sum(a.dv * b.dv) / max(a.n) AS gamma FROM range(0, {lags + 1}) k(k), c a
             JOIN c b ON a.series_id = b.series_id AND b.rn = a.rn + k.k GROUP BY 1, 2) GROUP BY 1""",
        "st": "SELECT series_id, eta / v AS kpss_stat FROM e JOIN v USING (series_id)",
    }


_KPSS_P = """CASE WHEN kpss_stat <= 0.347 THEN 0.1 WHEN kpss_stat <= 0.463 THEN 0.1 + (kpss_stat - 0.347) * (0.05 - 0.1) / (0.463 - 0.347)
    WHEN kpss_stat <= 0.574 THEN 0.05 + (kpss_stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
    WHEN kpss_stat <= 0.739 THEN 0.025 + (kpss_stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END"""


@query("kpss_test", sql("h", f"SELECT series_id, {rs('kpss_stat')} AS kpss_stat, {rs(_KPSS_P)} AS p_value, 72 AS lags FROM st", **_kpss(72)))
def _(s, sf):
    return signal.kpss_test(h(s, sf), H, n_lags=72).withColumns({"kpss_stat": rd("kpss_stat"), "p_value": rd("p_value")})


@query("kpss_test_auto", sql("h", f"""SELECT series_id, {rs('eta / v')} AS kpss_stat, lags FROM e JOIN (
    SELECT series_id, max(lags)::INT AS lags, sum(CASE WHEN lag = 0 THEN gamma WHEN lag <= lags THEN 2 * (1 - lag / (lags + 1)::DOUBLE) * gamma END) AS v
    FROM g JOIN pick USING (series_id) GROUP BY 1) USING (series_id)""",
    c=_kpss(72)["c"], e=_kpss(72)["e"], g="""SELECT a.series_id, k.k AS lag, sum(a.dv * b.dv) / max(a.n) AS gamma, max(a.n) AS n
    FROM range(0, 200) k(k), c a JOIN c b ON a.series_id = b.series_id AND b.rn = a.rn + k.k GROUP BY 1, 2""",
    pick="""SELECT series_id, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3::DOUBLE) * pow(n, 1 / 3::DOUBLE)), n - 1)::INT AS lags FROM (
    SELECT series_id, max(n) AS n, sum(CASE WHEN lag = 0 THEN gamma ELSE 2 * gamma END) AS s0,
    sum(CASE WHEN lag > 0 THEN 2 * lag * gamma ELSE 0 END) AS s1 FROM g WHERE lag <= floor(pow(n, 2 / 9::DOUBLE)) GROUP BY 1)"""))
def _(s, sf):
    return signal.kpss_test(h(s, sf), H, n_lags="auto").select("series_id", rd("kpss_stat").alias("kpss_stat"), "lags")


@query("stationarity_verdict")
def _(s, sf):
    out = signal.stationarity_verdict(h(s, sf), H)
    return out.withColumns({c: rd(c) for c in ("adf_stat", "adf_p", "kpss_stat", "kpss_p")})


def _chunk_sql(back: int, ahead: int, stride: int, view: str = "hu") -> str:
    return sql(view, f"""SELECT series_id, origin, first_in, {rs('sum_in', 2)} AS sum_in, n_in, first_out, {rs('sum_out', 2)} AS sum_out, n_out
    FROM (SELECT series_id, row_number() OVER w - 1 AS origin, lag(y, {back - 1}) OVER w AS first_in,
    sum(y) OVER (w ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW) AS sum_in, count(y) OVER (w ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW) AS n_in,
    lead(y, 1) OVER w AS first_out, sum(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) AS sum_out,
    count(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) AS n_out FROM {view} WINDOW w AS (PARTITION BY series_id ORDER BY ts))
    WHERE n_in = {back} AND n_out = {ahead} AND (origin - {back - 1}) % {stride} = 0""")


def _chunks(df, grid, back, ahead, stride):
    out = windows.sequence_windows(df, grid, input_len=back, output_len=ahead, stride=stride)
    def total(c):
        return rd(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return out.select("series_id", "origin", F.col("chunk_in")[0].alias("first_in"), total("chunk_in").alias("sum_in"),
                      F.size("chunk_in").alias("n_in"), F.col("chunk_out")[0].alias("first_out"),
                      total("chunk_out").alias("sum_out"), F.size("chunk_out").alias("n_out"))


@query("sequence_windows", _chunk_sql(168, 24, 24))
def _(s, sf):
    return _chunks(hu(s, sf), H, 168, 24, 24)


@query("sequence_windows_month", _chunk_sql(720, 24, 24, "d"))
def _(s, sf):
    return _chunks(d(s, sf), D, 720, 24, 24)


@query("sequence_windows_hour", _chunk_sql(24, 1, 24))
def _(s, sf):
    return _chunks(hu(s, sf), H, 24, 1, 24)
