"""Numerical operators against brute force, with spans cut short so that every carry is exercised."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronolith.operators import backtest, grid, models, signal, stats, windows
from chronolith.operators.grid import Grid, over_spans
from chronolith.operators.clean import chrono_split

H = Grid()
T0 = datetime(2018, 1, 1)


def panel(spark, series: dict):
    rows = [(k, T0 + timedelta(hours=i), float(v)) for k, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


@pytest.fixture(params=[64, 4096])
def span(request, monkeypatch):
    monkeypatch.setattr(grid, "SPAN", request.param)
    monkeypatch.setattr(signal, "SPAN", request.param)
    return request.param


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(42)
    e = rng.normal(size=700)
    ar = np.zeros(700)
    for i in range(2, 700):
        ar[i] = 0.5 * ar[i - 1] - 0.2 * ar[i - 2] + e[i]
    return {"walk": np.cumsum(rng.normal(size=700)), "ar": ar + 1000.0}


def np_acov(x, k):
    d = x - x.mean()
    return d[k:] @ d[:len(d) - k] / len(d)


def np_adf(x, max_lag):
    def fit(lag, start):
        d = np.diff(x)
        t = np.arange(start, len(d))
        cols = [np.ones(len(t)), x[t]] + [d[t - j] for j in range(1, lag + 1)]
        a, b = np.column_stack(cols), d[t]
        beta, *_ = np.linalg.lstsq(a, b, rcond=None)
        r = b - a @ beta
        n = len(b)
        aic = n * (math.log(2 * math.pi) + math.log(r @ r / n) + 1) + 2 * a.shape[1]
        se = math.sqrt(r @ r / (n - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return aic, beta[1] / se, n
    lag = min((fit(p, max_lag)[0], p) for p in range(max_lag + 1))[1]
    _, tau, n = fit(lag, lag)
    return tau, lag, n


def test_acf_and_pacf(spark, span, walks):
    df = panel(spark, walks)
    a = signal.acf(df, H, max_lag=30).toPandas()
    p = signal.pacf(df, H, max_lag=30).toPandas()
    for k, x in walks.items():
        r = np.array([np_acov(x, j) for j in range(31)]) / np_acov(x, 0)
        assert np.allclose(a[a.series_id == k].sort_values("lag").acf, r, atol=1e-9)
        direct = [1.0]
        for m in range(1, 31):
            toeplitz = np.array([[r[abs(i - j)] for j in range(m)] for i in range(m)])
            direct.append(np.linalg.solve(toeplitz, r[1:m + 1])[-1])
        assert np.allclose(p[p.series_id == k].sort_values("lag").pacf, direct, atol=1e-7)
        var = np.concatenate([[0, 1], 1 + 2 * np.cumsum(r[1:-1] ** 2)]) / len(x)
        assert np.allclose(a[a.series_id == k].sort_values("lag").band, 1.959963984540054 * np.sqrt(var), atol=1e-9)


def test_adf(spark, span, walks):
    got = {r["series_id"]: r for r in signal.adf_test(panel(spark, walks), H, max_lag=12).collect()}
    for k, x in walks.items():
        tau, lag, n = np_adf(x, 12)
        assert (got[k]["used_lag"], got[k]["n_obs"]) == (lag, n)
        assert got[k]["adf_stat"] == pytest.approx(tau, rel=1e-6)
    assert got["walk"]["p_value"] > 0.05 > got["ar"]["p_value"]


def test_adf_p_values_meet_the_critical_values():
    for level, name in ((0.01, "crit_1"), (0.05, "crit_5"), (0.10, "crit_10")):
        assert signal._adf_p(signal.TAU_CRITICAL[name][0]) == pytest.approx(level, abs=6e-4)
    assert signal._adf_p(-30.0) == 0.0 and signal._adf_p(5.0) == 1.0


def test_kpss(spark, span, walks):
    got = {r["series_id"]: r for r in signal.kpss_test(panel(spark, walks), H, n_lags=20).collect()}
    for k, x in walks.items():
        n, d = len(x), x - x.mean()
        lrv = np_acov(x, 0) + 2 * sum((1 - i / 21) * np_acov(x, i) for i in range(1, 21))
        assert got[k]["kpss_stat"] == pytest.approx((np.cumsum(d) ** 2).sum() / n ** 2 / lrv, rel=1e-9)
        assert got[k]["p_value"] == pytest.approx(
            np.interp(got[k]["kpss_stat"], signal.KPSS_CRITICAL, signal.KPSS_P))


def test_verdict_agrees_with_single_tests(spark, walks):
    both = {(r["series_id"], r["stage"]): r for r in signal.stationarity_verdict(panel(spark, walks), H).collect()}
    adf = {r["series_id"]: r for r in signal.adf_test(panel(spark, walks), H).collect()}
    kpss = {r["series_id"]: r for r in signal.kpss_test(panel(spark, walks), H).collect()}
    for k in walks:
        assert both[k, "raw"]["adf_stat"] == pytest.approx(adf[k]["adf_stat"])
        assert both[k, "raw"]["kpss_stat"] == pytest.approx(kpss[k]["kpss_stat"])
    diffed = {k: np.diff(x[24:] - x[:-24]) for k, x in walks.items()}
    final = {r["series_id"]: r for r in signal.adf_test(panel(spark, diffed), H).collect()}
    assert both["walk", "d1_D1"]["adf_stat"] == pytest.approx(final["walk"]["adf_stat"], rel=1e-6)
    assert both["walk", "raw"]["verdict"] == "non-stationary: d=1"


def test_decompose_recovers_the_season(spark, span):
    t = np.arange(400)
    y = 10 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 24)
    out = signal.seasonal_decompose(panel(spark, {"a": y}), H, period=24).toPandas().sort_values("ts")
    assert out.trend.isna().sum() == 24 and out.seasonal.notna().all()
    inner = out.dropna()
    assert np.allclose(inner.trend + inner.seasonal + inner.resid, inner.y)
    assert np.allclose(inner.trend, 10 + 0.1 * t[12:-12], atol=1e-6)
    assert np.allclose(inner.resid, 0, atol=1e-6)


def test_windows_equal_pandas(spark, span):
    rng = np.random.default_rng(1)
    x = pd.Series(rng.normal(100, 10, size=900))
    df = panel(spark, {"a": x, "b": x[:100]})
    roll = windows.rolling_lagged(df, H).toPandas().sort_values(["series_id", "ts"])
    a = roll[roll.series_id == "a"].reset_index()
    for name in ("mean", "std", "max", "min"):
        want = getattr(x.shift(24).rolling(24), name)()
        assert np.allclose(a[f"rolling_{name}_24h"], want, equal_nan=True)
    ma = windows.centered_ma(df, H, windows=(7, 24, 168)).toPandas().sort_values(["series_id", "ts"])
    for n in (7, 24, 168):
        assert np.allclose(ma[ma.series_id == "a"][f"ma_{n}"], x.rolling(n, center=True).mean(), equal_nan=True)
    assert ma[ma.series_id == "b"].ma_168.isna().all()
    d = windows.difference(df, H, lags=(24, 1)).toPandas().sort_values(["series_id", "ts"])
    assert np.allclose(d[d.series_id == "a"].diff_24_1, x.diff(24).diff(1), equal_nan=True)
    order = windows.row_ordinal(df, H).toPandas().sort_values(["series_id", "ts"])
    assert order.t.tolist() == list(range(900)) + list(range(100))


def test_sequence_windows(spark, span):
    x = np.arange(500.0)
    out = windows.sequence_windows(panel(spark, {"a": x}), H, input_len=48, output_len=12, stride=12).collect()
    got = {r["origin"]: (r["chunk_in"], r["chunk_out"]) for r in out}
    want = range(47, 500 - 12, 12)
    assert sorted(got) == list(want)
    for o in want:
        assert got[o] == (list(x[o - 47:o + 1]), list(x[o + 1:o + 13]))


def test_interpolation_matches_pandas(spark, span):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.normal(size=600))
    x[rng.random(600) < 0.5] = np.nan
    x[100:300] = np.nan
    rows = [("a", T0 + timedelta(hours=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    got = windows.interpolate_linear(df, H).toPandas().sort_values("ts").y.to_numpy(dtype=float)
    assert np.allclose(got, x.interpolate("linear").to_numpy(), equal_nan=True)
    filled = windows.forward_fill(df, H, ["y"]).toPandas().sort_values("ts").y.to_numpy(dtype=float)
    assert np.allclose(filled, x.ffill().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("kind", ["smooth", "copies", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    data = {"smooth": rng.normal(size=5000), "copies": np.where(rng.random(5000) < 0.4, 7.0, rng.integers(0, 20, 5000)),
            "tiny": np.array([3.0, 1.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": data.astype(float)}))
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    r = stats.exact_quantiles(df, ["g"], "v", qs).first()
    assert [r[f"q_{i}"] for i in range(5)] == pytest.approx(list(np.quantile(data, qs)))
    whole = stats.exact_quantiles(df, [], "v", qs).first()
    assert [whole[f"q_{i}"] for i in range(5)] == pytest.approx(list(np.quantile(data, qs)))


def test_corr_is_pairwise_complete_and_well_scaled(spark):
    rng = np.random.default_rng(6)
    x = pd.DataFrame(rng.normal(size=(2000, 4)), columns=list("abcd"))
    x["b"] = 1e7 + x.a + 0.1 * x.b
    x.loc[rng.random(2000) < 0.3, "c"] = np.nan
    df = spark.createDataFrame(x).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcd"]).repartition(5)
    want = x.corr()
    for r in stats.corr_matrix(df, list("abcd")).collect():
        assert r["corr"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-7)


def test_trend_p_value(spark):
    # Reference point: t = 2.228 with 10 degrees of freedom is the two-sided 5 % point.
    df = spark.createDataFrame([(2.228138852, 10.0), (0.0, 5.0), (1.959963985, 1e7), (-12.706204736, 1.0)],
                               "t double, k double")
    p = [r[0] for r in df.select(stats.t_two_sided("t", "k")).collect()]
    assert p == pytest.approx([0.05, 1.0, 0.05, 0.05], abs=1e-7)


def test_panel_fit_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    frames, want = [], {}
    for k in "ab":
        x = rng.normal(50, 5, size=(300, 3))
        y = x @ [1.0, -2.0, 0.5] + 10 + rng.normal(size=300)
        frames.append(pd.DataFrame({"series_id": k, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y}))
        want[k] = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    df = spark.createDataFrame(pd.concat(frames)).repartition(6)
    for r in models.fit_panel(df, ["series_id"], ["x1", "x2", "x3"]).collect():
        assert r["beta"] == pytest.approx(list(want[r["series_id"]]), rel=1e-7)


def test_walk_forward_equals_refitting_each_day(spark):
    rng = np.random.default_rng(8)
    n = 24 * 12
    x = rng.normal(size=(n, 2))
    y = 3 + x @ [1.0, 2.0] + rng.normal(size=n)
    pdf = pd.DataFrame({"series_id": "a", "ts": [T0 + timedelta(hours=i) for i in range(n)],
                        "x1": x[:, 0], "x2": x[:, 1], "y": y})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for every in (1, 3):
        out = backtest.walk_forward_retrain(df, H, ["x1", "x2"], "2018-01-06 00:00:00",
                                            retrain_every=every).toPandas().sort_values("ts")
        want = []
        for day in range(5, 12):
            cut = 24 * (5 + (day - 5) // every * every)
            b = np.linalg.lstsq(np.column_stack([np.ones(cut), x[:cut]]), y[:cut], rcond=None)[0]
            rows = slice(24 * day, 24 * day + 24)
            want.extend(b[0] + x[rows] @ b[1:])
        assert np.allclose(out.y_pred, want)


def test_additive_and_trees_beat_the_naive_floor(spark):
    t = np.arange(24 * 7 * 10)
    rng = np.random.default_rng(9)
    y = 100 + 0.02 * t + 20 * np.sin(2 * np.pi * t / 24) + 10 * np.sin(2 * np.pi * t / 168) + rng.normal(0, 2, len(t))
    df = panel(spark, {"a": y})
    end = str(T0 + timedelta(hours=24 * 7 * 8))
    test = F.col("ts") > F.lit(end).cast("timestamp_ntz")
    naive = backtest.mae_mape(windows.seasonal_naive(df, H).where(test), (), "y", "y_pred").first()["mae"]
    for mode in ("additive", "multiplicative"):
        add = models.additive_forecast(df, ["series_id"], str(T0), end, mode=mode, yearly=0).where(test)
        assert backtest.mae_mape(add, (), "y", "y_pred").first()["mae"] < naive * (1.0 if mode == "additive" else 1.6)

    def lags(f):
        return {"l1": f.at("y", -1), "l24": f.at("y", -24), "l168": f.at("y", -168)}
    feats = over_spans(df, H, lags, back=168).dropna()
    trees = models.fit_predict_gbt(feats.where(~test), feats.where(test), ["l1", "l24", "l168"], maxIter=10, maxDepth=4)
    assert backtest.mae_mape(trees, (), "y", "y_pred").first()["mae"] < naive * 1.2


def test_quantiles_are_ordered_and_cover(spark):
    rng = np.random.default_rng(10)
    df = panel(spark, {"a": 50 + rng.normal(size=24 * 200)})
    split = chrono_split(df.withColumn("y_pred", F.lit(50.0)), "2018-02-01 00:00:00", "2018-05-01 00:00:00")
    out = models.quantile_forecast(split.where("split = 'val'"), split.where("split = 'test'"), ["series_id"])
    r = out.agg(F.count_if((F.col("q05") > F.col("q50")) | (F.col("q50") > F.col("q95"))).alias("crossed"),
                F.avg(F.col("y").between(F.col("q05"), F.col("q95")).cast("double")).alias("cover")).first()
    assert r["crossed"] == 0 and 0.85 < r["cover"] < 0.94


def test_random_trials_and_failures(spark):
    trials = models.random_trials(models.GBT_SPACE, 20)
    assert trials == models.random_trials(models.GBT_SPACE, 20)
    assert all(1e-3 <= t["stepSize"] <= 0.1 and 4 <= t["maxDepth"] <= 12 for t in trials)
    df = panel(spark, {"a": np.arange(10.0)})

    def fit(train, val, bias):
        if bias > 1:
            return val.withColumn("y_pred", F.raise_error(F.lit("does not fit")).cast("double"))
        return val.withColumn("y_pred", F.col("y") + bias)
    board = models.time_grid_search(spark, df, df, fit, [{"bias": 1.0}, {"bias": 2.0}, {"bias": 0.5}])
    best = models.best_trial(board, "trial").first()
    assert best["trial"] == 2 and best["mae"] == 0.5
    failed = board.where("trial = 1").first()
    assert failed["mae"] is None and "does not fit" in failed["error"]
    with pytest.raises(AnalysisException):  # a mistake in the call is no failed trial
        models.time_grid_search(spark, df, df, lambda a, b: b.select("no such column"), [{}])
    assert models.refit_champion(board, lambda full, bias: (full.count(), bias), df) == (10, 0.5)


def test_bandwidth_lags_follow_the_longest_series():
    assert signal.short_lags(10) == 1 and signal.short_lags(10 ** 9) == 100


def test_holidays_cover_the_years_of_the_data(spark):
    from chronolith.functions.calendar import holidays_for, with_holiday

    days = spark.createDataFrame([(datetime(1961, 12, 25),), (datetime(2187, 1, 1),), (datetime(2050, 7, 3),)], "ts timestamp_ntz")
    got = {r.ts.year: r.is_holiday for r in with_holiday(days, holidays_for(days)).collect()}
    assert got == {1961: 1, 2187: 1, 2050: 0}


def test_pivot_loses_no_entity(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "zz", 5.0), (2, None, 7.0)], "k int, e string, v double")
    found = stats.pivot_wide(rows, ["k"], "e", ["v"])
    assert {r.k: r.v_zz for r in found.collect()} == {1: None, 2: 5.0}
    with pytest.raises(Exception, match="unlisted entity"):
        stats.pivot_wide(rows, ["k"], "e", ["v"], ["a"]).collect()


def test_rows_without_a_fit_stay(spark):
    rng = np.random.default_rng(3)
    df = panel(spark, {"a": rng.normal(size=100), "b": rng.normal(size=100)}).withColumn("x", F.col("y") * 2)
    fitted = models.fit_panel(df.where("series_id = 'a'"), ["series_id"], ["x"])
    out = models.predict_panel(df, fitted, ["series_id"], ["x"])
    assert out.count() == 200 and out.where("series_id = 'b' AND y_pred IS NULL").count() == 100
    folds = backtest.walk_forward_retrain(df, H, ["x"], "2018-01-01 00:00:00")
    assert folds.count() == 200 and folds.where("fold = 0 AND y_pred IS NOT NULL").count() == 0


def test_large_offsets_keep_their_coefficient(spark):
    x = 1e9 + 0.1 * np.arange(200)
    df = panel(spark, {"a": 3.0 + 2.0 * (x - 1e9)}).withColumn("x", F.lit(1e9) + (F.unix_seconds(F.col("ts").cast("timestamp"))
                                                                          - F.unix_seconds(F.lit("2018-01-01").cast("timestamp"))) / 36000.0)
    out = models.predict_panel(df, models.fit_panel(df, ["series_id"], ["x"]), ["series_id"], ["x"])
    assert out.where(F.abs(F.col("y") - F.col("y_pred")) > 1e-3).count() == 0


@pytest.mark.parametrize("n", [12, 13])
def test_linear_value_of_narrow_and_wide_designs(spark, n):
    df = spark.range(3).select(*[(F.col("id") + i).cast("double").alias(f"x{i}") for i in range(n)])
    beta = F.array(*[F.lit(float(k)) for k in range(n + 1)])
    got = df.select("x0", models.linear_value(df.columns, beta).alias("v")).collect()
    assert all(abs(r.v - sum((i + 1) * (r.x0 + i) for i in range(n))) < 1e-9 for r in got)


def test_null_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r.g: r.q_0 for r in stats.exact_quantiles(rows, ["g"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "a": 5.0}
    df = spark.createDataFrame([(None, T0, 1.0), ("a", T0, 2.0)], "series_id string, ts timestamp_ntz, y double")
    with pytest.raises(Exception, match="NULL in series key"):
        windows.row_ordinal(df, H).collect()


def test_nan_does_not_spread(spark):
    xs = np.arange(20.0)
    xs[5] = np.nan
    out = windows.centered_ma(panel(spark, {"a": xs}), H, windows=(3,)).orderBy("ts").collect()
    assert all(r.ma_3 is None for r in out[4:7]) and out[10].ma_3 == 10.0 and out[18].ma_3 == 18.0


def test_names_of_the_comparison(spark):
    from chronolith.operators import leaderboard

    rows = [("N-HiTS 168h", "day-ahead", 5.0), ("LightGBM Initial", "day-ahead", 1.0), ("LightGBM Improved", "day-ahead", 7.0)]
    board = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "series_id string, ord int, model string, horizon string, mae double")
    r = leaderboard.horizon_flip(board).first()
    assert (r.univariate, r.multivariate) == (5.0, 7.0)
    assert leaderboard.find_model(board, exact="absent").first().model == "N-HiTS 168h"


def test_trees_take_a_share_of_columns(spark):
    rng = np.random.default_rng(4)
    df = panel(spark, {"a": rng.normal(size=60)}).withColumns({"x1": F.col("y") * 2, "x2": F.lit(1.0)})
    assert models.fit_gbt(df, ["x1", "x2"], maxIter=2, featureFraction=0.5).stages[1].getFeatureSubsetStrategy() == "0.5"
