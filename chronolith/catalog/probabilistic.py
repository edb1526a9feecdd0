"""Queries of probabilistic retraining, forecasts from an origin and boosted trees by series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.catalog.base import D, H, TRAIN_END, VAL_END, W, d, h, hf, holidays, query, rd, rs, sql
from chronolith.catalog.models import _FEAT, _TS, features
from chronolith.functions.columns import epoch_seconds
from chronolith.operators import backtest, bands, boosting, differencing, models, recursion, sparse
from chronolith.operators.clean import chrono_split
from chronolith.operators.grid import over_spans
from chronolith.operators.windows import seasonal_naive, widest_interval_window
from chronolith.plans.profile import error_profile
from chronolith.sources.tables import grow_features, materialize, store_raw, work_folder, write_features

# --- daily refits with bands from the residuals before each fold ------------------

START, WINDOW, MIN_ROWS = "2024-01-08 00:00:00", 10, 4

#: Point forecasts of every fold: one regressor, refitted each day on all rows before the day.
_POINT = f"""SELECT f.series_id, f.ts, f.y, datediff('day', TIMESTAMP '{START}', f.ts) AS fold, r.b0 + r.b1 * f.lag_24 AS p FROM f LEFT JOIN (
    SELECT t.series_id, t.day, regr_slope(h.y, h.lag_24) AS b1, regr_intercept(h.y, h.lag_24) AS b0
    FROM (SELECT DISTINCT series_id, date_trunc('day', ts) AS day FROM f WHERE ts >= TIMESTAMP '{START}') t
    JOIN f h ON h.series_id = t.series_id AND h.ts < t.day GROUP BY 1, 2) r
    ON f.series_id = r.series_id AND date_trunc('day', f.ts) = r.day WHERE f.ts >= TIMESTAMP '{START}'"""


def _bands_sql(every: int = 1) -> str:
    first = f"(fold // {every}) * {every}"
    return f"""SELECT a.series_id, a.ts, a.y, a.p, CASE WHEN len(r) >= {MIN_ROWS} THEN a.p + list_aggregate(r, 'quantile_cont', 0.05) END AS q05,
    CASE WHEN len(r) >= {MIN_ROWS} THEN a.p + list_aggregate(r, 'quantile_cont', 0.5) END AS q50,
    CASE WHEN len(r) >= {MIN_ROWS} THEN a.p + list_aggregate(r, 'quantile_cont', 0.95) END AS q95 FROM (
    SELECT x.series_id, x.ts, any_value(x.y) AS y, any_value(x.p) AS p, list(z.y - z.p) FILTER (WHERE z.y - z.p IS NOT NULL) AS r
    FROM (SELECT *, {first} AS lead FROM point) x LEFT JOIN point z ON z.series_id = x.series_id AND hour(z.ts) = hour(x.ts)
    AND z.fold < x.lead AND z.fold >= x.lead - {WINDOW} GROUP BY 1, 2) a"""


def banded(s, sf, every: int = 1):
    """Point forecasts refitted daily, bands refitted every `every` days."""
    point = backtest.walk_forward_retrain(features(s, sf), H, ["lag_24"], START)
    return bands.rolling_bands(point, H, START, WINDOW, MIN_ROWS, every)


@query("walk_forward_quantiles", sql("hf", f"""SELECT series_id, ts, y, {rs('p', 4)} AS y_pred, {rs('q05', 4)} AS q05,
    {rs('q50', 4)} AS q50, {rs('q95', 4)} AS q95 FROM banded""", f=_FEAT, point=_POINT, banded=_bands_sql()))
def _(s, sf):
    out = bands.walk_forward_quantiles(features(s, sf), H, ["lag_24"], START, window_days=WINDOW, min_rows=MIN_ROWS)
    return out.select("series_id", "ts", "y", *[rd(c, 4).alias(c) for c in ("y_pred", "q05", "q50", "q95")])


@query("rolling_bands_three_days", sql("hf", f"""SELECT series_id, ts, {rs('q05', 4)} AS q05, {rs('q95', 4)} AS q95 FROM banded""",
                                       f=_FEAT, point=_POINT, banded=_bands_sql(3)))
def _(s, sf):
    return banded(s, sf, 3).select("series_id", "ts", rd("q05", 4).alias("q05"), rd("q95", 4).alias("q95"))


@query("band_coverage", sql("hf", f"""SELECT series_id, count(*) AS n, {rs('avg((y >= q05 AND y <= q95)::INT) * 100', 5)} AS covered_pct,
    {rs('avg(q95 - q05)', 4)} AS mean_width FROM banded WHERE q05 IS NOT NULL GROUP BY 1""", f=_FEAT, point=_POINT, banded=_bands_sql()))
def _(s, sf):
    return bands.coverage(banded(s, sf), ["series_id"]).withColumns({"covered_pct": rd("covered_pct", 5), "mean_width": rd("mean_width", 4)})


@query("banded_error_profile", sql("hf flags", f"""SELECT series_id, section, hour, count(*) AS n_hours, {rs('avg(me)', 4)} AS model_mae,
    {rs('avg(be)', 4)} AS benchmark_mae, {rs('avg(coalesce(me < be, false)::INT) * 100', 4)} AS win_pct FROM (
    SELECT c.*, unnest(['overall', 'hour', CASE WHEN flagged THEN 'holiday' END]) AS section,
    unnest([-1, hour(ts), -1])::INT AS hour FROM (SELECT b.series_id, b.ts, abs(b.y - b.q50) AS me, abs(b.y - n.p) AS be,
    coalesce(g.is_holiday = 1 OR g.is_bridge_day = 1, false) AS flagged
    FROM banded b LEFT JOIN n ON b.series_id = n.series_id AND b.ts = n.ts LEFT JOIN flags g ON g.date = b.ts::DATE WHERE q50 IS NOT NULL) c)
    WHERE section IS NOT NULL GROUP BY 1, 2, 3""", f=_FEAT, point=_POINT, banded=_bands_sql(), n=f"SELECT series_id, ts, lag(y, 24) {W} AS p FROM hf"))
def _(s, sf):
    forecast = banded(s, sf).where("q50 IS NOT NULL").select("series_id", "ts", F.col("y").alias("y_true"), "q05", "q50", "q95")
    benchmark = seasonal_naive(hf(s, sf), H, period=24).select("series_id", "ts", F.col("y_pred").alias("benchmark"))
    out = error_profile(forecast, benchmark, holidays(s, sf), ["series_id", "ts"])
    return out.withColumns({c: rd(c, 4) for c in ("model_mae", "benchmark_mae", "win_pct")})


@query("widest_band_window", sql("hf", f"""SELECT b.series_id, b.ts, m.ts AS end_ts, {rs('b.q95 - b.q05', 3)} AS width FROM banded b JOIN (
    SELECT series_id, ts FROM (SELECT series_id, ts, q95 - q05 AS w, avg(q95 - q05) OVER v AS mw, count(q95 - q05) OVER v AS c FROM banded
    WINDOW v AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 71 PRECEDING AND CURRENT ROW))
    WHERE c = 72 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(mw, 9) DESC, ts) = 1) m
    ON b.series_id = m.series_id AND b.ts BETWEEN m.ts - INTERVAL 72 HOUR AND m.ts""", f=_FEAT, point=_POINT, banded=_bands_sql()))
def _(s, sf):
    out = widest_interval_window(banded(s, sf), H)
    return out.select("series_id", "ts", "end_ts", rd(F.col("q95") - F.col("q05"), 3).alias("width"))


# --- 24 steps from an origin ---------------------------------------------------------

_LAGS = (1, 24)


@query("recursive_forecast", "WITH RECURSIVE " + sql("hf", f"""SELECT p.series_id, p.origin, p.origin + INTERVAL 1 HOUR * p.step AS ts, p.step, a.y AS y_true,
    {rs('p.held[-1]', 4)} AS y_pred FROM path p JOIN hf a ON a.series_id = p.series_id AND a.ts = p.origin + INTERVAL 1 HOUR * p.step WHERE p.step > 0""",
    f=_FEAT, c=f"""SELECT series_id, my - ba * ma - bb * mb AS b0, ba, bb FROM (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM (SELECT series_id, avg(y) AS my, avg(lag_1) AS ma, avg(lag_24) AS mb,
    var_pop(lag_1) AS saa, var_pop(lag_24) AS sbb, covar_pop(lag_1, lag_24) AS sab, covar_pop(lag_1, y) AS say, covar_pop(lag_24, y) AS sby
    FROM f WHERE ts <= {_TS} GROUP BY 1))""",
    o=f"""SELECT h.series_id, h.ts AS origin, (SELECT list(k.y ORDER BY k.ts) FROM hf k WHERE k.series_id = h.series_id AND k.ts <= h.ts
    AND k.ts > h.ts - INTERVAL 24 HOUR) AS held FROM hf h JOIN (SELECT series_id, max(ts) AS last FROM hf GROUP BY 1) e ON e.series_id = h.series_id
    WHERE h.ts >= {_TS} AND h.ts < e.last AND (epoch(h.ts) - epoch({_TS}))::BIGINT % 86400 = 0""",
    path="""SELECT series_id, origin, held, 0 AS step FROM o UNION ALL
    SELECT p.series_id, p.origin, list_append(p.held, c.b0 + c.ba * p.held[-1] + c.bb * p.held[-24]), p.step + 1
    FROM path p JOIN c ON p.series_id = c.series_id WHERE p.step < 24""").removeprefix("WITH "))
def _(s, sf):
    data = hf(s, sf)
    fit = recursion.fit_lags(data.where(F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")), H, _LAGS)
    out = recursion.recursive_forecast(data, fit, H, _LAGS, "2024-01-21 00:00:00", 24)
    return out.withColumn("y_pred", rd("y_pred", 4))


# --- boosted trees by series -----------------------------------------------------------

_XS = ("lag_1", "lag_24")
_BINS = 8


def _forest_sql(train: str, trials: list[dict], rounds: int, tag: str) -> dict[str, str]:
    """CTEs of depth-1 boosting: every bin of every feature of every series and trial is tried in each round."""
    ranks = [k / _BINS for k in range(1, _BINS)]
    out = {f"{tag}x": " UNION ALL ".join(f"SELECT series_id, ts, y, {k} AS feature, {x} AS x FROM {train}" for k, x in enumerate(_XS)),
           f"{tag}e": f"SELECT DISTINCT series_id, feature, unnest(quantile_disc(x, {ranks})) AS edge FROM {tag}x GROUP BY 1, 2",
           f"{tag}t": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {t['step']}::DOUBLE)" for k, t in enumerate(trials)) + ") v(trial, step)",
           f"{tag}f0": f"SELECT series_id, ts, y, trial, avg(y) OVER (PARTITION BY series_id, trial) AS f FROM {train}, {tag}t"}
    for r in range(rounds):
        out[f"{tag}s{r}"] = f"""SELECT series_id, trial, feature, edge, step * gl / nl AS lv, step * (gt - gl) / (nt - nl) AS rv FROM (
            SELECT e.series_id, g.trial, e.feature, e.edge, sum(g.y - g.f) FILTER (WHERE x.x <= e.edge) AS gl, count(*) FILTER (WHERE x.x <= e.edge) AS nl,
            sum(g.y - g.f) AS gt, count(*) AS nt FROM {tag}e e JOIN {tag}x x ON x.series_id = e.series_id AND x.feature = e.feature
            JOIN {tag}f{r} g ON g.series_id = x.series_id AND g.ts = x.ts GROUP BY 1, 2, 3, 4) JOIN {tag}t USING (trial) WHERE nl > 0 AND nl < nt
            QUALIFY row_number() OVER (PARTITION BY series_id, trial ORDER BY round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 6) DESC,
            feature, edge) = 1"""
        out[f"{tag}f{r + 1}"] = f"""SELECT g.series_id, g.ts, g.y, g.trial, g.f + CASE WHEN x.x <= s.edge THEN s.lv ELSE s.rv END AS f
            FROM {tag}f{r} g JOIN {tag}s{r} s USING (series_id, trial) JOIN {tag}x x ON x.series_id = g.series_id AND x.ts = g.ts AND x.feature = s.feature"""
    return out


def _scored_sql(rows: str, tag: str, rounds: int) -> str:
    """(series_id, ts, y, trial, p) of rows under the first trees of a forest."""
    value = " + ".join([f"CASE WHEN (CASE s{r}.feature WHEN 0 THEN v.{_XS[0]} ELSE v.{_XS[1]} END) <= s{r}.edge THEN s{r}.lv ELSE s{r}.rv END" for r in range(rounds)])
    joins = " ".join(f"JOIN {tag}s{r} s{r} ON s{r}.series_id = v.series_id AND s{r}.trial = b.trial" for r in range(rounds))
    return f"SELECT v.series_id, v.ts, v.y, b.trial, b.base + {value} AS p FROM {rows} v JOIN (SELECT series_id, trial, avg(y) AS base FROM {tag}f0 GROUP BY 1, 2) b ON b.series_id = v.series_id {joins}"


_ONE = [{"step": 0.3, "depth": 1}]
_TRAINED = f"SELECT * FROM f WHERE ts <= {_TS}"


@query("fit_boosted_panel", sql("hf", f"SELECT series_id, ts, {rs('p', 4)} AS y_pred FROM scored", f=_FEAT, tr=_TRAINED,
                                ho=f"SELECT * FROM f WHERE ts > {_TS}", **_forest_sql("tr", _ONE, 5, "b"), scored=_scored_sql("ho", "b", 5)))
def _(s, sf):
    f = materialize(features(s, sf), s)
    early = F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")
    model = boosting.fit_boosted_panel(f.where(early), ["series_id"], _XS, lambda df: materialize(df, s), rounds=5, bins=_BINS, **_ONE[0])
    out = boosting.predict_boosted(f.where(~early), model, ["series_id"], _XS, 1)
    return out.select("series_id", "ts", rd("y_pred", 4).alias("y_pred"))


_STEPS = [{"step": x, "depth": 1} for x in (0.05, 0.2, 0.5, 1.0)]
_VALID = f"SELECT * FROM f WHERE ts > {_TS} AND ts <= TIMESTAMP '{VAL_END}'"


@query("boosted_halving_search", sql("hf", f"""SELECT series_id, trial, rounds, {rs('mae', 4)} AS mae FROM rung0
    UNION ALL SELECT series_id, trial, rounds, {rs('mae', 4)} FROM rung1""", f=_FEAT, tr=_TRAINED, va=_VALID, **_forest_sql("tr", _STEPS, 4, "b"),
    rung0=f"SELECT series_id, trial, 2 AS rounds, avg(abs(y - p)) AS mae FROM ({_scored_sql('va', 'b', 2)}) GROUP BY 1, 2",
    rung1=f"""SELECT q.series_id, q.trial, 4 AS rounds, avg(abs(y - p)) AS mae FROM ({_scored_sql('va', 'b', 4)}) q JOIN (SELECT * FROM rung0
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(mae, 9), trial) <= 2) k ON k.series_id = q.series_id AND k.trial = q.trial GROUP BY 1, 2"""))
def _(s, sf):
    f = materialize(chrono_split(features(s, sf), TRAIN_END, VAL_END), s)
    scores, _ = boosting.halving_search(f.where("split = 'train'"), f.where("split = 'val'"), ["series_id"], _XS, _STEPS, (2, 4),
                                        lambda df: materialize(df, s), bins=_BINS)
    return scores.select("series_id", "trial", "rounds", rd("mae", 4).alias("mae"))


@query("boosted_champions", sql("hf", f"""SELECT q.series_id, q.trial, count(*) AS n, {rs('avg(abs(y - p))', 4)} AS mae FROM ({_scored_sql('te', 'c', 4)}) q JOIN (
    SELECT q.series_id, q.trial FROM ({_scored_sql('va', 'b', 4)}) q JOIN (SELECT * FROM rung0
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(mae, 9), trial) <= 2) k ON k.series_id = q.series_id AND k.trial = q.trial GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY q.series_id ORDER BY round(avg(abs(y - p)), 9), q.trial) = 1) w
    ON w.series_id = q.series_id AND w.trial = q.trial GROUP BY 1, 2""", f=_FEAT, tr=_TRAINED, va=_VALID,
    te=f"SELECT * FROM f WHERE ts > TIMESTAMP '{VAL_END}'", tv=f"SELECT * FROM f WHERE ts <= TIMESTAMP '{VAL_END}'",
    **_forest_sql("tr", _STEPS, 4, "b"), rung0=f"SELECT series_id, trial, avg(abs(y - p)) AS mae FROM ({_scored_sql('va', 'b', 2)}) GROUP BY 1, 2",
    **_forest_sql("tv", _STEPS, 4, "c")))
def _(s, sf):
    """Search, pick, refit on training and validation, save, load, score the test rows."""
    def store(df):
        return materialize(df, s)
    f = store(chrono_split(features(s, sf), TRAIN_END, VAL_END))
    _, champions = boosting.halving_search(f.where("split = 'train'"), f.where("split = 'val'"), ["series_id"], _XS, _STEPS, (2, 4), store, bins=_BINS)
    model = boosting.refit_champions(f.where("split <> 'test'"), store(champions), ["series_id"], _XS, _STEPS, 4, store, bins=_BINS)
    path = work_folder(s)
    boosting.save_boosted(model, path)
    out = boosting.predict_boosted(f.where("split = 'test'"), boosting.load_boosted(s, path), ["series_id"], _XS)
    return out.groupBy("series_id", "trial").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("y_pred"))).alias("mae")).withColumn("mae", rd("mae", 4))


# --- pinball trees ------------------------------------------------------------------------

_TAUS = (0.05, 0.5, 0.95)


def _quantile_forest_sql(train: str, rounds: int, step: float, tag: str = "p") -> dict[str, str]:
    """Depth-1 boosting of the pinball loss: splits by slope, leaves by residual quantile."""
    ranks = [k / _BINS for k in range(1, _BINS)]
    out = {f"{tag}x": " UNION ALL ".join(f"SELECT series_id, ts, y, {k} AS feature, {x} AS x FROM {train}" for k, x in enumerate(_XS)),
           f"{tag}e": f"SELECT DISTINCT series_id, feature, unnest(quantile_disc(x, {ranks})) AS edge FROM {tag}x GROUP BY 1, 2",
           f"{tag}base": " UNION ALL ".join(f"SELECT series_id, {k} AS trial, {t}::DOUBLE AS tau, quantile_disc(y, {t}) AS base FROM {train} GROUP BY 1" for k, t in enumerate(_TAUS)),
           f"{tag}f0": f"SELECT v.series_id, ts, y, trial, tau, base AS f FROM {train} v JOIN {tag}base b ON b.series_id = v.series_id"}
    leaf = "CASE trial " + " ".join(f"WHEN {k} THEN quantile_disc(y - f, {t}) FILTER (WHERE {{side}})" for k, t in enumerate(_TAUS)) + " END"
    for r in range(rounds):
        out[f"{tag}c{r}"] = f"""SELECT series_id, trial, feature, edge FROM (SELECT e.series_id, g.trial, e.feature, e.edge,
            sum(tau - (g.y - g.f <= 0)::INT) FILTER (WHERE x.x <= e.edge) AS gl, count(*) FILTER (WHERE x.x <= e.edge) AS nl,
            sum(tau - (g.y - g.f <= 0)::INT) AS gt, count(*) AS nt FROM {tag}e e JOIN {tag}x x ON x.series_id = e.series_id AND x.feature = e.feature
            JOIN {tag}f{r} g ON g.series_id = x.series_id AND g.ts = x.ts GROUP BY 1, 2, 3, 4) WHERE nl > 0 AND nl < nt
            QUALIFY row_number() OVER (PARTITION BY series_id, trial ORDER BY round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 6) DESC,
            feature, edge) = 1"""
        out[f"{tag}s{r}"] = f"""SELECT series_id, trial, feature, edge, {step} * {leaf.format(side='x <= edge')} AS lv, {step} * {leaf.format(side='x > edge')} AS rv
            FROM (SELECT g.series_id, g.trial, c.feature, c.edge, g.y, g.f, x.x FROM {tag}f{r} g JOIN {tag}c{r} c ON c.series_id = g.series_id AND c.trial = g.trial
            JOIN {tag}x x ON x.series_id = g.series_id AND x.ts = g.ts AND x.feature = c.feature) GROUP BY series_id, trial, feature, edge"""
        out[f"{tag}f{r + 1}"] = f"""SELECT g.series_id, g.ts, g.y, g.trial, g.tau, g.f + CASE WHEN x.x <= s.edge THEN s.lv ELSE s.rv END AS f
            FROM {tag}f{r} g JOIN {tag}s{r} s ON s.series_id = g.series_id AND s.trial = g.trial
            JOIN {tag}x x ON x.series_id = g.series_id AND x.ts = g.ts AND x.feature = s.feature"""
    return out


def _quantile_scored_sql(rows: str, rounds: int, tag: str = "p") -> str:
    value = " + ".join([f"CASE WHEN (CASE s{r}.feature WHEN 0 THEN v.{_XS[0]} ELSE v.{_XS[1]} END) <= s{r}.edge THEN s{r}.lv ELSE s{r}.rv END" for r in range(rounds)])
    joins = " ".join(f"JOIN {tag}s{r} s{r} ON s{r}.series_id = v.series_id AND s{r}.trial = b.trial" for r in range(rounds))
    return f"SELECT v.series_id, v.ts, list_sort(list(b.base + {value})) AS q FROM {rows} v JOIN {tag}base b ON b.series_id = v.series_id {joins} GROUP BY 1, 2"


@query("quantile_trees", sql("hf", f"SELECT series_id, ts, {rs('q[1]')} AS q05, {rs('q[2]')} AS q50, {rs('q[3]')} AS q95 FROM scored", f=_FEAT, tr=_TRAINED,
                             ho=f"SELECT * FROM f WHERE ts > {_TS}", **_quantile_forest_sql("tr", 3, 0.5), scored=_quantile_scored_sql("ho", 3)))
def _(s, sf):
    f = materialize(features(s, sf), s)
    early = F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")
    model = boosting.fit_quantile_panel(f.where(early), ["series_id"], _XS, lambda df: materialize(df, s), taus=_TAUS, rounds=3, bins=_BINS, step=0.5, depth=1)
    out = boosting.predict_quantiles(f.where(~early), model, ["series_id", "ts"], ["series_id"], _XS, _TAUS, 1)
    return out.select("series_id", "ts", *[rd(q).alias(q) for q in ("q05", "q50", "q95")])


# --- versions of a fit ----------------------------------------------------------------------

@query("score_as_of", sql("hf", f"""SELECT f.series_id, f.ts, r.day AS valid_from, {rs('r.b0 + r.b1 * f.lag_24', 4)} AS y_pred FROM f LEFT JOIN (
    SELECT t.series_id, t.day, regr_slope(h.y, h.lag_24) AS b1, regr_intercept(h.y, h.lag_24) AS b0
    FROM (SELECT DISTINCT series_id, TIMESTAMP '2024-01-21' + INTERVAL 3 DAY * (datediff('day', TIMESTAMP '2024-01-21', ts) // 3) AS day FROM f WHERE ts > {_TS}) t
    JOIN f h ON h.series_id = t.series_id AND h.ts < t.day GROUP BY 1, 2) r
    ON f.series_id = r.series_id AND r.day = TIMESTAMP '2024-01-21' + INTERVAL 3 DAY * (datediff('day', TIMESTAMP '2024-01-21', f.ts) // 3) AND f.ts > {_TS}""", f=_FEAT))
def _(s, sf):
    """Every row under the version of the fit that is in force, versions made every three days."""
    f = features(s, sf)
    versions = materialize(backtest.versioned_fits(f, H, ["lag_24"], "2024-01-21 00:00:00", retrain_every=3), s)
    return backtest.score_as_of(f, versions, H, ["lag_24"]).select("series_id", "ts", "valid_from", rd("y_pred", 4).alias("y_pred"))


# --- a feature table that grows -----------------------------------------------------------------

def _order_features(df):
    return over_spans(df, D, lambda f: {"lag_1": f.at("y", -1), "lag_7": f.at("y", -7), "mean_7": f.full(F.avg, "y", -7, -1)}, back=7)


@query("grow_features", sql("d", f"""SELECT series_id, ts, y, lag_1, lag_7, {rs('CASE WHEN c = 7 THEN m END', 4)} AS mean_7 FROM (
    SELECT a.series_id, a.ts, a.y, b.y AS lag_1, e.y AS lag_7, avg(a.y) OVER w AS m, count(a.y) OVER w AS c FROM d a
    LEFT JOIN d b ON b.series_id = a.series_id AND b.ts = a.ts - INTERVAL 1 DAY LEFT JOIN d e ON e.series_id = a.series_id AND e.ts = a.ts - INTERVAL 7 DAY
    WINDOW w AS (PARTITION BY a.series_id ORDER BY a.ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""))
def _(s, sf):
    """The table built without two stretches of days, then grown by them: the same as one built at once."""
    whole = materialize(d(s, sf), s)
    late = (F.col("ts") >= F.lit("2001-07-30").cast("timestamp_ntz")) | F.col("ts").between(
        F.lit("1997-02-26").cast("timestamp_ntz"), F.lit("1997-02-27").cast("timestamp_ntz"))
    raw, stored = work_folder(s), work_folder(s)
    store_raw(whole.where(~late), raw)
    write_features(_order_features(whole.where(~late)), stored)
    grow_features(s, raw, stored, whole.where(late), ["series_id", "ts"], _order_features, "7 days")
    return s.read.parquet(stored).select("series_id", "ts", "y", "lag_1", "lag_7", rd("mean_7", 4).alias("mean_7"))


# --- differences that the tests choose ---------------------------------------------------------------

_LAG = 12


@query("difference_by_test", sql("h", f"""SELECT x.series_id, x.ts, o.stage, {rs("CASE o.stage WHEN 'raw' THEN raw WHEN 'D1' THEN d1 ELSE d2 END", 4)} AS z
    FROM x JOIN o ON o.series_id = x.series_id""",
    x=f"""SELECT series_id, ts, y AS raw, y - lag(y, 24) {W} AS d1, y - lag(y, 24) {W} - (lag(y, 1) {W} - lag(y, 25) {W}) AS d2 FROM h""",
    long="SELECT series_id, ts, 'raw' AS stage, raw AS v FROM x UNION ALL SELECT series_id, ts, 'D1', d1 FROM x UNION ALL SELECT series_id, ts, 'd1_D1', d2 FROM x",
    c="""SELECT series_id, stage, v - avg(v) OVER (PARTITION BY series_id, stage) AS dv, count(*) OVER (PARTITION BY series_id, stage) AS n,
    row_number() OVER (PARTITION BY series_id, stage ORDER BY ts) AS rn FROM long WHERE v IS NOT NULL""",
    e="""SELECT series_id, stage, sum(cs * cs) / max(n * n) AS eta FROM (SELECT *, sum(dv) OVER (PARTITION BY series_id, stage ORDER BY rn) AS cs FROM c) GROUP BY 1, 2""",
    v=f"""SELECT series_id, stage, sum(CASE WHEN lag = 0 THEN gamma ELSE 2 * (1 - lag / ({_LAG} + 1)::DOUBLE) * gamma END) AS v FROM (
    SELECT a.series_id, a.stage, k.k AS lag, sum(a.dv * b.dv) / max(a.n) AS gamma FROM range(0, {_LAG + 1}) k(k), c a
    JOIN c b ON a.series_id = b.series_id AND a.stage = b.stage AND b.rn = a.rn + k.k GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    o="""SELECT series_id, coalesce(min_by(stage, list_position(['raw', 'D1', 'd1_D1'], stage)) FILTER (WHERE eta / v < 0.463), 'd1_D1') AS stage
    FROM e JOIN v USING (series_id, stage) GROUP BY 1"""))
def _(s, sf):
    data = h(s, sf).select("series_id", "ts", "y")
    orders = differencing.differencing_orders(data, H, n_lags=_LAG, tests="kpss")
    return differencing.apply_differencing(data, H, orders).select("series_id", "ts", "stage", rd("z", 4).alias("z"))


# --- change points under a penalty ---------------------------------------------------------------------

_PENALTIES = (0.02, 0.3)
_A, _B = "1995-01-01 00:00:00", "1999-12-31 00:00:00"
#: Trend and its single hinge, as the design of one knot has them.
_T = f"(epoch(ts) - epoch(TIMESTAMP '{_A}')) / (epoch(TIMESTAMP '{_B}') - epoch(TIMESTAMP '{_A}'))::DOUBLE"


@query("sparse_trend_path", sql("d", f"""SELECT x.series_id, penalty, {rs('b')} AS hinge, {rs('bt')} AS trend, {rs('my - bt * mt - b * mh', 4)} AS intercept FROM (
    SELECT *, bs * sy / sh AS b, (rty - rht * bs) * sy / st AS bt FROM (SELECT *, CASE WHEN sign(c) * greatest(abs(c) - penalty, 0) = 0 THEN 0 ELSE
    sign(c) * greatest(abs(c) - penalty, 0) / (1 - rht * rht) END AS bs FROM (SELECT *, rhy - rht * rty AS c FROM m, (VALUES """
    + ", ".join(f"({p}::DOUBLE)" for p in _PENALTIES) + """) v(penalty)))) x""",
    t=f"SELECT series_id, y, {_T} AS t, greatest({_T} - 0.4::DOUBLE, 0) AS hg FROM d WHERE ts BETWEEN TIMESTAMP '{_A}' AND TIMESTAMP '{_B}'",
    m="""SELECT series_id, avg(y) AS my, avg(t) AS mt, avg(hg) AS mh, stddev_pop(y) AS sy, stddev_pop(t) AS st, stddev_pop(hg) AS sh, corr(hg, t) AS rht,
    corr(hg, y) AS rhy, corr(t, y) AS rty FROM t GROUP BY 1"""))
def _(s, sf):
    columns = models.additive_design(epoch_seconds(F.col("ts")).cast("double"), _A, _B, knots=1, yearly=0, weekly=0, daily=0)
    train = d(s, sf).where(F.col("ts").between(F.lit(_A).cast("timestamp_ntz"), F.lit(_B).cast("timestamp_ntz"))).withColumns(columns)
    path = sparse.fit_path(train, ["series_id"], ["x_trend", "x_hinge_1"], ["x_hinge_1"], _PENALTIES)
    rows = path.select("series_id", F.posexplode("betas").alias("k", "b"))
    return rows.select("series_id", F.get(F.array(*[F.lit(p) for p in _PENALTIES]), F.col("k")).alias("penalty"),
                       rd(F.col("b")[2]).alias("hinge"), rd(F.col("b")[1]).alias("trend"), rd(F.col("b")[0], 4).alias("intercept"))


@query("sparse_trend_forecast")
def _(s, sf):
    """Twenty offered change points, the penalty by validation; error on the days after it."""
    out = sparse.sparse_trend_forecast(d(s, sf), ["series_id"], _A, _B, "2000-12-31 00:00:00", (0.001, 0.003, 0.01, 0.03, 0.1, 0.3), knots=20, daily=0)
    test = out.where(F.col("ts") > F.lit("2000-12-31").cast("timestamp_ntz"))
    return (test.groupBy("series_id", "penalty", "n_changes").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("y_pred"))).alias("mae"))
            .withColumn("mae", rd("mae", 3)))


# --- a probe that must find something ---------------------------------------------------------------------

@query("leakage_probe_control", sql("hf", f"""SELECT 'lag_1' AS feature, count(*) FILTER (WHERE ts > {_TS} + INTERVAL 1 HOUR) AS n_changed FROM hf
    WHERE ts <= {_TS} + INTERVAL 24 HOUR UNION ALL SELECT 'lag_23', count(*) FILTER (WHERE ts > {_TS} + INTERVAL 23 HOUR) FROM hf
    WHERE ts <= {_TS} + INTERVAL 24 HOUR UNION ALL SELECT 'lag_24', 0"""))
def _(s, sf):
    """Features that do leak: each is caught on exactly the hours where it looks past the cutoff."""
    def build(df):
        return over_spans(df, H, lambda f: {f"lag_{k}": f.at("y", -k) for k in (1, 23, 24)}, back=24)
    return models.leakage_probe(hf(s, sf), build, ["series_id", "ts"], TRAIN_END, 24 * 3600)
