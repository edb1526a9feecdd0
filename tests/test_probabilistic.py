"""Rolling bands, forecasts from an origin and boosted trees against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import backtest, bands, boosting, grid as grids, recursion
from chronolith.operators.grid import Grid
from chronolith.sources.tables import materialize

H = Grid(by=("series_id",), ts="ts", step=3600)
T0 = datetime(2024, 1, 1)


def hours(spark, n, seed=1, series=("a", "b"), gaps=()):
    r = random.Random(seed)
    rows = [(s, T0 + timedelta(hours=k), None if (s, k) in gaps else round(float(10 * np.sin(k / 4)) + r.gauss(20, 4), 2))
            for s in series for k in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


# --- bands ---------------------------------------------------------------------------

def plain_bands(rows, start, window, least, every):
    """rows: (series, ts, y, p)."""
    day0 = start.date()
    residual = {}
    for s, ts, y, p in rows:
        if y is not None and p is not None:
            residual.setdefault((s, ts.hour), {})[ts.date()] = y - p
    out = {}
    for s, ts, y, p in rows:
        lead = day0 + timedelta(days=(ts.date() - day0).days // every * every)
        own = [v for d, v in residual.get((s, ts.hour), {}).items() if lead - timedelta(days=window) <= d < lead]
        out[s, ts] = tuple(p + np.quantile(own, q) if p is not None and len(own) >= least else None for q in (0.05, 0.5, 0.95))
    return out


@pytest.mark.parametrize("window,every", [(6, 1), (5, 3)])
def test_bands_are_order_statistics_of_earlier_residuals(spark, monkeypatch, window, every):
    monkeypatch.setattr(grids, "SPAN", 8)
    gaps = {("a", 50), ("a", 74), ("b", 300)}
    df = hours(spark, 480, gaps=gaps).withColumn("p", F.when(F.hour("ts") != 5, F.lit(21.0))).where("NOT (series_id = 'b' AND ts >= '2024-01-09' AND ts < '2024-01-11')")
    start = datetime(2024, 1, 4)
    got = bands.rolling_bands(df, H, str(start), window, 3, every, "y", "p").collect()
    want = plain_bands([(r.series_id, r.ts, r.y, r.p) for r in df.collect()], start, window, 3, every)
    assert len(got) == len(want)
    for r in got:
        for value, w in zip((r.q05, r.q50, r.q95), want[r.series_id, r.ts]):
            assert (value is None) == (w is None) and (w is None or abs(value - w) < 1e-9)


def test_later_residuals_move_no_band(spark):
    df = hours(spark, 600).withColumn("p", F.lit(20.0))
    cut = datetime(2024, 1, 15)
    changed = df.withColumn("y", F.when(F.col("ts") >= F.lit(str(cut)).cast("timestamp_ntz"), F.col("y") + 1000).otherwise(F.col("y")))

    def run(x):
        return {(r.series_id, r.ts): (r.q05, r.q50, r.q95) for r in bands.rolling_bands(x, H, "2024-01-05 00:00:00", 7, 3, 1, "y", "p").collect()}
    a, b = run(df), run(changed)
    day = cut + timedelta(days=1)
    assert all(a[k] == b[k] for k in a if k[1] < day)
    assert any(a[k] != b[k] for k in a if k[1] >= day)


def test_bands_without_rows_and_coverage(spark):
    df = hours(spark, 400).withColumn("p", F.lit(20.0))
    assert bands.rolling_bands(df.limit(0), H, "2024-01-05 00:00:00", 7, 3, 1, "y", "p").count() == 0
    out = bands.rolling_bands(df, H, "2024-01-05 00:00:00", 7, 3, 1, "y", "p")
    assert out.where("q05 > q50 OR q50 > q95").count() == 0
    got = {r.series_id: r for r in bands.coverage(out, ["series_id"]).collect()}
    rows = [r for r in out.collect() if r.q05 is not None and r.series_id == "a"]
    assert got["a"].n == len(rows)
    assert abs(got["a"].covered_pct - 100 * np.mean([r.q05 <= r.y <= r.q95 for r in rows])) < 1e-9


def test_retraining_around_a_centre_is_the_same(spark):
    df = hours(spark, 300).withColumn("x", F.sin(F.hour("ts") / 3.0) + 1e6).withColumn("y", F.col("y") + 5e5)
    plain = df.withColumn("x", F.col("x") - 1e6).withColumn("y", F.col("y") - 5e5)
    a = backtest.walk_forward_retrain(df, H, ["x"], "2024-01-05 00:00:00", centre=[1e6, 5e5]).collect()
    b = {(r.series_id, r.ts): r.y_pred for r in backtest.walk_forward_retrain(plain, H, ["x"], "2024-01-05 00:00:00").collect()}
    assert len(a) == len(b) and all(abs(r.y_pred - 5e5 - b[r.series_id, r.ts]) < 1e-4 for r in a)


# --- recursion -------------------------------------------------------------------------

@pytest.mark.parametrize("horizon,stride", [(24, None), (10, 7)])
def test_recursion_uses_its_own_forecasts(spark, monkeypatch, horizon, stride):
    monkeypatch.setattr(grids, "SPAN", 16)
    df = hours(spark, 200, gaps={("b", 120)})
    fit = spark.createDataFrame([("a", [1.0, 0.5, 0.3]), ("b", [0.0, 0.2, 0.7])], "series_id string, beta array<double>")
    got = recursion.recursive_forecast(df, fit, H, [1, 24], "2024-01-03 00:00:00", horizon, stride).collect()
    values = {(r.series_id, r.ts): r.y for r in df.collect()}
    beta = {"a": (1.0, 0.5, 0.3), "b": (0.0, 0.2, 0.7)}
    want = {}
    for s in "ab":
        origin = datetime(2024, 1, 2, 23)
        while origin + timedelta(hours=1) < T0 + timedelta(hours=200):
            held = [values.get((s, origin - timedelta(hours=k))) for k in range(23, -1, -1)]
            for step in range(1, horizon + 1):
                x = None if held[-1] is None or held[-24] is None else beta[s][0] + beta[s][1] * held[-1] + beta[s][2] * held[-24]
                held.append(x)
                ts = origin + timedelta(hours=step)
                if (s, ts) in values:
                    want[s, origin, ts] = (step, values[s, ts], x)
            origin += timedelta(hours=stride or horizon)
    assert len(got) == len(want)
    for r in got:
        step, y, x = want[r.series_id, r.origin, r.ts]
        assert (r.step, r.y_true) == (step, y) and (r.y_pred is None) == (x is None) and (x is None or abs(r.y_pred - x) < 1e-9)


def test_recursion_never_sees_actuals_after_the_origin(spark):
    df = hours(spark, 200)
    fit = recursion.fit_lags(df, H, [1, 24])
    later = df.withColumn("y", F.when(F.col("ts") > F.lit("2024-01-05 23:00:00").cast("timestamp_ntz"), 0.0).otherwise(F.col("y")))

    def run(x):
        out = recursion.recursive_forecast(x, fit, H, [1, 24], "2024-01-06 00:00:00").where("origin = '2024-01-05 23:00:00'")
        return sorted((r.series_id, r.step, r.y_pred) for r in out.collect())
    assert run(df) == run(later) and len(run(df)) == 48


# --- boosted trees -----------------------------------------------------------------------

def plain_boost(x, y, edges, rounds, step, depth, l2, least):
    """Predictions of boosting with the given edges, on the training rows."""
    f = np.full(len(y), y.mean())
    bins = np.array([[sum(e < v for e in edges[k]) for k, v in enumerate(row)] for row in x])
    for _ in range(rounds):
        node = np.ones(len(y), int)
        value = np.zeros(len(y))
        g = y - f
        for level in range(depth):
            for n in sorted(set(node[node >= 1 << level])):
                own = np.flatnonzero(node == n)
                best = None
                for k in range(x.shape[1]):
                    for cut in sorted(set(bins[own, k])):
                        left = own[bins[own, k] <= cut]
                        right = own[bins[own, k] > cut]
                        if len(left) >= least and len(right) >= least:
                            def score(r):
                                return g[r].sum() ** 2 / (len(r) + l2)
                            gain = round(score(left) + score(right) - score(own), 6)
                            if gain > 1e-6 and (best is None or gain > best[0]):
                                best = (gain, left, right)
                if best:
                    for side, rows in ((0, best[1]), (1, best[2])):
                        node[rows] = 2 * n + side
                        value[rows] = step * g[rows].sum() / (len(rows) + l2)
        f = f + value
    return f


def table(spark, seed=3, n=160):
    r = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        for k in range(n):
            x1, x2 = round(r.uniform(0, 10), 1), float(r.randrange(4))
            rows.append((s, k, x1, x2, round((x1 > 4) * 5 + x2 * (1 if s == "a" else -2) + r.gauss(0, 1), 3)))
    return spark.createDataFrame(rows, "series_id string, k int, x1 double, x2 double, y double")


def test_boosting_is_plain_boosting(spark):
    df = table(spark)
    store = lambda d: materialize(d, spark)
    trials = [{"step": 0.4, "depth": 2, "l2": 1.0, "min_rows": 3}, {"step": 1.0, "depth": 1}]
    forest = boosting.Forest(df, ["series_id"], ["x1", "x2"], "y", trials, 6, store, refresh=2)
    forest.grow(5)
    model = store(forest.model())
    assert model.count() == 4
    out = boosting.predict_boosted(df, model, ["series_id"], ["x1", "x2"]).collect()
    for s in ("a", "b"):
        edges = model.where(f"series_id = '{s}'").first().edges
        for trial, t in enumerate(trials):
            own = sorted((r for r in out if r.series_id == s and r.trial == trial), key=lambda r: r.k)
            x, y = np.array([[r.x1, r.x2] for r in own]), np.array([r.y for r in own])
            want = plain_boost(x, y, edges, 5, t["step"], t["depth"], t.get("l2", 0.0), t.get("min_rows", 1))
            assert np.allclose([r.y_pred for r in own], want, atol=1e-9)


def test_boosting_edges_missing_values_and_models_on_disk(spark):
    store = lambda d: materialize(d, spark)
    rows = [("one", 1.0, 5.0)] * 3 + [("same", 2.0, float(k)) for k in range(4)] + [("gaps", None if k % 3 == 0 else float(k), float(k % 3 == 0)) for k in range(1, 13)]
    df = spark.createDataFrame(rows + [("none", 1.0, None)], "series_id string, x double, y double")
    model = boosting.fit_boosted_panel(df, ["series_id"], ["x"], store, rounds=3, bins=4, step=1.0, depth=2)
    path = f"{materialize(df, spark).inputFiles()[0].rsplit('/', 1)[0]}-model"
    boosting.save_boosted(model, path)
    out = boosting.predict_boosted(df, boosting.load_boosted(spark, path), ["series_id"], ["x"]).collect()
    assert len(out) == len(rows) + 1
    assert {r.y_pred for r in out if r.series_id == "one"} == {5.0} and {r.y_pred for r in out if r.series_id == "same"} == {1.5}
    assert {r.y_pred for r in out if r.series_id == "none"} == {None}
    gaps = [r for r in out if r.series_id == "gaps"]
    assert max(r.y_pred for r in gaps if r.x is not None and r.x > 6) < min(r.y_pred for r in gaps if r.x is None)
    empty = boosting.fit_boosted_panel(df.limit(0), ["series_id"], ["x"], store, rounds=1, bins=4, depth=1)
    assert boosting.predict_boosted(df.where("y > 90"), empty, ["series_id"], ["x"]).count() == 0


def test_halving_keeps_the_better_half_of_each_series(spark):
    df = table(spark, 5)
    store = lambda d: materialize(d, spark)
    trials = [{"step": s, "depth": d} for s, d in ((0.01, 1), (0.5, 2), (1.0, 1), (0.001, 1), (0.3, 2))]
    train, val = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    scores, champions = boosting.halving_search(train, val, ["series_id"], ["x1", "x2"], trials, (1, 2, 4), store, bins=6)
    by_rung = {}
    for r in scores.collect():
        by_rung.setdefault((r.series_id, r.rung), {})[r.trial] = r.mae
    best = {r.series_id: r.trial for r in champions.collect()}
    for s in ("a", "b"):
        assert [len(by_rung[s, k]) for k in range(3)] == [5, 3, 2]
        for k in range(2):
            kept = sorted(by_rung[s, k], key=lambda t: (round(by_rung[s, k][t], 9), t))[:len(by_rung[s, k + 1])]
            assert set(kept) == set(by_rung[s, k + 1])
        assert best[s] == min(by_rung[s, 2], key=lambda t: (round(by_rung[s, 2][t], 9), t))
    model = boosting.refit_champions(df, champions, ["series_id"], ["x1", "x2"], trials, 4, store, bins=6)
    assert {r.series_id: r.trial for r in model.collect()} == best


def test_histograms_are_added_before_they_move(spark):
    """The largest table that is shuffled has a row for each key, node, feature and bin, not for each row."""
    df = table(spark, 7, 400)
    store = lambda d: materialize(d, spark)
    forest = boosting.Forest(df, ["series_id"], ["x1", "x2"], "y", [{"depth": 1}], 6, store)
    hist = forest._current().select("series_id", "trial", F.posexplode("_bins").alias("feature", "bin")).groupBy("series_id", "trial", "feature", "bin").count()
    plan = hist._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "CartesianProduct" not in plan
    assert hist.count() <= 2 * 2 * 6


def test_pinball_trees_are_plain_pinball_boosting(spark):
    df = table(spark, 11)
    store = lambda d: materialize(d, spark)
    taus, step, rounds, depth = (0.1, 0.5, 0.9), 0.4, 4, 2
    model = boosting.fit_quantile_panel(df, ["series_id"], ["x1", "x2"], store, taus=taus, rounds=rounds, bins=5, step=step, depth=depth)
    out = boosting.predict_quantiles(df, model, ["series_id", "k"], ["series_id"], ["x1", "x2"], taus).collect()
    rows = sorted(df.collect(), key=lambda r: r.k)
    trees = {(m.series_id, m.trial): m for m in model.collect()}

    def disc(v, tau):
        return sorted(v)[max(int(np.ceil(round(tau * len(v), 9))), 1) - 1]

    for s in ("a", "b"):
        own = [r for r in rows if r.series_id == s]
        y = np.array([r.y for r in own])
        made = []
        for trial, tau in enumerate(taus):
            edges = trees[s, trial].edges
            bins = np.array([[sum(e < v for e in edges[k]) for k, v in enumerate((r.x1, r.x2))] for r in own])
            f = np.full(len(y), disc(y, tau))
            for _ in range(rounds):
                node, r = np.ones(len(y), int), y - f
                g = np.where(r > 0, tau, tau - 1)
                split = False
                for level in range(depth):
                    for n in sorted(set(node[node >= 1 << level])):
                        at = np.flatnonzero(node == n)
                        best = None
                        for k in range(2):
                            for cut in sorted(set(bins[at, k])):
                                left, right = at[bins[at, k] <= cut], at[bins[at, k] > cut]
                                if len(left) and len(right):
                                    gain = round(g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[at].sum() ** 2 / len(at), 6)
                                    if gain > 1e-6 and (best is None or gain > best[0]):
                                        best = (gain, left, right)
                        if best:
                            node[best[1]], node[best[2]], split = 2 * n, 2 * n + 1, True
                if split:
                    for n in set(node):
                        f[node == n] += step * disc(r[node == n], tau)
            made.append(f)
        want = np.sort(np.array(made), axis=0)
        got = {r.k: (r.q10, r.q50, r.q90) for r in out if r.series_id == s}
        for i, r in enumerate(own):
            assert np.allclose(got[r.k], want[:, i], atol=1e-9)
    share = np.mean([r.y < q for r, q in ((r, next(o.q90 for o in out if (o.series_id, o.k) == (r.series_id, r.k))) for r in rows[:80])])
    assert 0.75 < share <= 1


# --- versions --------------------------------------------------------------------------------

def test_scoring_as_of_is_retraining(spark, monkeypatch):
    monkeypatch.setattr(grids, "SPAN", 16)
    df = hours(spark, 300).withColumn("x", F.cos(F.hour("ts") / 4.0))
    want = {(r.series_id, r.ts): r.y_pred for r in backtest.walk_forward_retrain(df, H, ["x"], "2024-01-04 00:00:00", retrain_every=2).collect()}
    versions = backtest.versioned_fits(df, H, ["x"], "2024-01-04 00:00:00", retrain_every=2)
    got = backtest.score_as_of(df, versions, H, ["x"]).collect()
    assert len(got) == 600
    for r in got:
        w = want.get((r.series_id, r.ts))
        assert (r.y_pred is None) == (w is None) and (w is None or abs(r.y_pred - w) < 1e-9)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_carries_versions_over_spans(spark, strict):
    from chronolith.operators.align import asof_join
    df = hours(spark, 120).where("NOT (series_id = 'a' AND hour(ts) = 7)")
    df = df.unionByName(spark.createDataFrame([("a", None, 1.0), ("c", T0, 2.0)], df.schema))
    r = random.Random(2)
    marks = {(s, T0 + timedelta(hours=h)): h * 10 for s in ("a", "b", "d") for h in r.sample(range(-50, 110), 6)}
    versions = spark.createDataFrame([(s, t, v) for (s, t), v in marks.items()] + [("a", None, -1)], "series_id string, valid_from timestamp_ntz, v int")
    got = asof_join(df, versions, H, strict=strict, span=8).collect()
    assert len(got) == df.count()
    for x in got:
        known = [(t, v) for (s, t), v in marks.items() if s == x.series_id and x.ts is not None and (t < x.ts or t == x.ts and not strict)]
        assert (x.valid_from, x.v) == (max(known) if known else (None, None))
    plan = asof_join(df, versions, H)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        asof_join(df, versions.withColumnRenamed("v", "y"), H)


# --- growing tables ------------------------------------------------------------------------------

def test_grown_table_is_the_rebuilt_one(spark):
    from chronolith.operators.grid import over_spans
    from chronolith.sources.tables import grow_features, store_raw, work_folder, write_features
    df = hours(spark, 24 * 100)
    build = lambda x: over_spans(x, H, lambda f: {"lag": f.at("y", -30), "mean": f.full(F.avg, "y", -48, -1)}, back=48)
    late = F.col("ts") >= F.lit("2024-04-01").cast("timestamp_ntz")
    raw, path = work_folder(spark), work_folder(spark)
    store_raw(df.where(~late), raw)
    write_features(build(df.where(~late)), path)
    untouched = lambda: {f for f in spark.read.parquet(path).inputFiles() if "ym=2024-01" in f}
    before = untouched()
    fixed = df.where("ts = '2024-02-29T12:00:00' AND series_id = 'a'").withColumn("y", F.lit(-5.0))
    want = build(df.withColumn("y", F.when((F.col("ts") == F.lit("2024-02-29 12:00:00").cast("timestamp_ntz")) & (F.col("series_id") == "a"), -5.0).otherwise(F.col("y"))))
    for _ in range(2):  # once more changes nothing
        months = grow_features(spark, raw, path, df.where(late).unionByName(fixed), ["series_id", "ts"], build, "48 hours")
        assert months == ["2024-02", "2024-03", "2024-04"]
        rows = lambda x: sorted((r.series_id, r.ts, r.y, r["lag"], None if r["mean"] is None else round(r["mean"], 9)) for r in x.collect())
        assert rows(spark.read.parquet(path)) == rows(want)
    assert untouched() == before and before
    assert grow_features(spark, raw, path, df.limit(0), ["series_id", "ts"], build, "48 hours") == []


# --- differences by test -----------------------------------------------------------------------

def test_each_series_gets_the_differences_it_needs(spark):
    from chronolith.operators import differencing as dg
    r = random.Random(7)
    n, rows, walk, season = 24 * 40, [], 0.0, [r.gauss(0, 3) for _ in range(24)]
    drift = [0.0] * 24
    for k in range(n):
        ts = T0 + timedelta(hours=k)
        walk += r.gauss(0, 1)
        drift[k % 24] += r.gauss(0, 2)
        rows += [("noise", ts, r.gauss(0, 1)), ("seasonal_walk", ts, drift[k % 24] + r.gauss(0, 0.1)), ("trend", ts, 0.02 * k * k / 100 + season[k % 24] + walk)]
    df = spark.createDataFrame(rows + [("short", T0, 1.0)], "series_id string, ts timestamp_ntz, y double")
    orders = {x.series_id: x.stage for x in dg.differencing_orders(df, H, max_lag=6, n_lags=24).collect()}
    assert orders["noise"] == "raw" and orders["seasonal_walk"] != "raw" and orders["trend"] != "raw" and orders["short"] == "d1_D1"
    given = spark.createDataFrame([("noise", "raw"), ("seasonal_walk", "D1"), ("trend", "d1_D1")], "series_id string, stage string")
    out = dg.apply_differencing(df, H, given).withColumn("z_pred", F.col("z"))
    y = {(s, t): v for s, t, v in rows}
    hour = timedelta(hours=1)
    back = {(x.series_id, x.ts): x for x in dg.restore_levels(out, H).collect()}
    assert len(back) == len(rows) + 1 and back["short", T0].z == 1.0
    for (s, t), v in y.items():
        old = [y.get((s, t - k * hour)) for k in (1, 24, 25)]
        want = {"noise": v, "seasonal_walk": None if old[1] is None else v - old[1],
                "trend": None if old[2] is None else v - old[1] - (old[0] - old[2])}[s]
        got = back[s, t]
        assert (got.z is None) == (want is None) and (want is None or abs(got.z - want) < 1e-9)
        # The difference itself as forecast gives the value back.
        assert got.y_pred is None if want is None else abs(got.y_pred - v) < 1e-9


def test_parts_of_a_split_reach_the_scan(spark):
    from chronolith.operators.clean import chrono_split, split_rows
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ends = ("2024-01-20 23:00:00", "2024-01-25 23:00:00")
    for part in ("train", "val", "test"):
        own = split_rows(df, *ends, part)
        assert own.count() == chrono_split(df, *ends).where(F.col("split") == part).count()
        text = own._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(ts)" in text and ("LessThanOrEqual(ts" in text or "GreaterThan(ts" in text)


# --- change points --------------------------------------------------------------------------------

def test_path_meets_the_conditions_of_its_minimum():
    from chronolith.operators.sparse import lasso_path
    r = np.random.Generator(np.random.PCG64(5))
    x = r.normal(size=(300, 6)) @ r.normal(size=(6, 6))
    x[:, 4] = 2.0  # constant
    y = x @ np.array([1.0, 0, -2, 0, 5, 0.1]) + r.normal(size=300)
    z = np.column_stack([np.ones(300), x, y])
    penalties = [0.2, 0.01, 0.0]
    pen = [2, 3, 6]
    for penalty, beta in zip(penalties, lasso_path(z.T @ z, pen, penalties)):
        resid = y - beta[0] - x @ beta[1:]
        assert abs(resid.mean()) < 1e-8 and beta[5] == 0
        for k in range(1, 7):
            if k == 5:
                continue
            slope = (resid * (x[:, k - 1] - x[:, k - 1].mean())).mean() / (x[:, k - 1].std() * y.std())
            if k not in pen or beta[k] != 0:
                assert abs(slope - (penalty * np.sign(beta[k]) if k in pen else 0)) < 1e-7
            else:
                assert abs(slope) <= penalty + 1e-7
    assert [b.tolist() for b in lasso_path(np.zeros((4, 4)), [1], [0.1])] == [[0, 0, 0]]


def test_planted_change_points_are_found(spark):
    from chronolith.operators.sparse import sparse_trend_forecast
    r = random.Random(3)
    rows = []
    for k in range(1400):
        ts = datetime(1995, 1, 1) + timedelta(days=k)
        rows += [("bent", ts, 100 + 0.05 * k - (0.2 * (k - 480) if k > 480 else 0) + r.gauss(0, 1)), ("straight", ts, 50 + 0.03 * k + r.gauss(0, 1)),
                 ("flat", ts, 7.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    out = sparse_trend_forecast(df, ["series_id"], "1995-01-01 00:00:00", "1998-01-01 00:00:00", "1998-06-01 00:00:00",
                                [0.0005, 0.005, 0.05, 0.5], knots=9, yearly=0, weekly=0, daily=0)
    last = {x.series_id: x for x in out.groupBy("series_id", "penalty", "n_changes").agg(
        F.avg(F.when(F.col("ts") > F.lit("1998-06-01").cast("timestamp_ntz"), F.abs(F.col("y") - F.col("y_pred")))).alias("mae")).collect()}
    assert 1 <= last["bent"].n_changes <= 5 and last["bent"].mae < 8
    assert last["straight"].n_changes <= 2 and last["straight"].mae < 2.5
    assert last["flat"].n_changes == 0 and last["flat"].mae < 1e-9
