"""Small inputs with answers worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronolith.functions import calendar as cal
from chronolith.functions import columns as fc
from chronolith.operators import align, audit, backtest, clean, grid, leaderboard as lb, scale, signal, stats, windows
from chronolith.operators.grid import Grid, over_spans
from chronolith.plans import energy

H = Grid()
T0 = datetime(2018, 1, 1)


def hours(spark, values, series="a", start=T0, skip=()):
    rows = [(series, start + timedelta(hours=i), v) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


def column(df, name="y", order="ts"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_dst_fall_keeps_first_of_a_repeated_local_hour(spark):
    raw = spark.createDataFrame([(datetime(2018, 10, 28, 0, 30), 1.0), (datetime(2018, 10, 28, 1, 30), 2.0)],
                                "ts_utc timestamp_ntz, y double")
    local = raw.withColumn("ts", clean.utc_to_local("ts_utc", "Europe/Madrid"))
    assert column(local, "ts", "ts_utc") == [datetime(2018, 10, 28, 2, 30)] * 2
    first = clean.dedup_first(local, ["ts"], ["ts_utc"])
    assert [r["y"] for r in first.collect()] == [1.0]


def test_dst_spring_gap_becomes_a_null_row(spark):
    raw = spark.createDataFrame([(datetime(2018, 3, 25, h), float(h)) for h in range(3)],
                                "ts_utc timestamp_ntz, `total load actual` double")
    base = energy.energy_base(raw, time=None)
    assert column(base, "total load actual") == [0.0, None, 1.0, 2.0]
    assert column(base, "ts")[1] == datetime(2018, 3, 25, 2)


def test_gap_lag_differs_between_row_and_time_mode(spark):
    df = hours(spark, [float(i) for i in range(30)], skip={10})
    at = {r["ts"].hour: r for r in windows.lag_features(df, H, lags=(1,)).where(
        F.col("ts") < F.lit(T0 + timedelta(hours=24)).cast("timestamp_ntz")).collect()}
    assert at[11]["load_t_1"] is None and at[12]["load_t_1"] == 11.0
    row = {r["ts"].hour: r for r in windows.lag_features(df, H, lags=(1,), mode="row").where(
        F.col("ts") < F.lit(T0 + timedelta(hours=24)).cast("timestamp_ntz")).collect()}
    assert row[11]["load_t_1"] == 9.0


def test_null_clip_and_degree_days(spark):
    df = spark.createDataFrame([(None, None), (10.0, 283.15), (30.0, 300.15)], "wind double, k double")
    t = fc.kelvin_to_celsius(F.col("k"))
    out = df.select(fc.clip_upper(F.col("wind"), 25.0), F.round(fc.heating_degrees(t), 9),
                    F.round(fc.cooling_degrees(t), 9)).collect()
    assert [tuple(r) for r in out] == [(None, None, None), (10.0, 8.0, 0.0), (25.0, 0.0, 9.0)]


def test_null_text_is_zero(spark):
    df = spark.createDataFrame([(None,), ("Heavy Rain",), ("sky is clear",)], "d string")
    for pattern in ("rain|drizzle", "(rain|drizzle)"):
        assert [r[0] for r in df.select(fc.pattern_flag(F.col("d"), pattern)).collect()] == [0, 1, 0]


def test_duplicate_join_key_does_not_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 10, 2), (1, 20, 1)], "k int, v int, o int")
    out = align.attach_benchmark(left, right, ["k"], ["o"]).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in out] == [(1, 20), (2, None)]
    with pytest.raises(PySparkException, match="repeats"):
        align.attach_benchmark(left, right, ["k"]).collect()


def test_lookup_of_a_missing_key_is_an_error(spark):
    wanted = spark.createDataFrame([(1,), (9,)], "k int")
    table = spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(PySparkException, match="not found"):
        align.lookup_rows(wanted, table, ["k"], ["v"]).collect()


def test_partial_frame_is_null_until_full(spark):
    df = hours(spark, [1.0] * 50)
    out = column(windows.rolling_lagged(df, H), "rolling_mean_24h")
    assert out[:47] == [None] * 47 and out[47:] == [1.0] * 3


def test_leading_gap(spark):
    df = hours(spark, [None, None, 1.0, None, 3.0, None])
    assert column(windows.forward_fill(df, H, ["y"])) == [None, None, 1.0, 1.0, 3.0, 3.0]
    assert column(windows.interpolate_linear(df, H)) == [None, None, 1.0, 2.0, 3.0, 3.0]


def test_fill_reaches_across_spans(spark, monkeypatch):
    monkeypatch.setattr(grid, "SPAN", 4)
    df = hours(spark, [None, 5.0] + [None] * 18 + [25.0, None])
    assert column(windows.forward_fill(df, H, ["y"])) == [None] + [5.0] * 19 + [25.0] * 2
    assert column(windows.interpolate_linear(df, H)) == [None] + [
        pytest.approx(5.0 + 20.0 * i / 19) for i in range(20)] + [25.0]


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert stats.corr_matrix(df, ["x", "c"]).first()["corr"] is None
    assert stats.target_correlation(df, "x", ["c"]).first()["corr"] is None
    assert [r["c"] for r in scale.scale_columns(df, F.lit(True), ["c"]).collect()] == [0.0] * 3
    flat = hours(spark, [2.0] * 300)
    assert signal.acf(flat, H, max_lag=3).first()["acf"] is None
    assert signal.kpss_test(flat, H).first()["kpss_stat"] is None
    assert signal.adf_test(flat, H).first()["adf_stat"] is None


def test_zero_actual_is_counted(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 1.0)], "y_true double, y_pred double")
    r = backtest.mae_mape(df).first()
    assert (r["n"], r["mae"], r["mape"], r["n_zero_actual"]) == (2, 1.0, 50.0, 1)


def test_tie_argmax_takes_the_earliest(spark):
    r = stats.argmax(hours(spark, [1.0, 7.0, 3.0, 7.0]), ["series_id"], "y").first()
    assert r["max_ts"] == T0 + timedelta(hours=1) and r["max_value"] == 7.0


def test_benchmark_gap_is_no_win(spark):
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.0)], "k int, y_true double, q50 double")
    b = spark.createDataFrame([(1, 12.0)], "k int, benchmark double")
    r = lb.win_rate(lb.forecast_vs_benchmark(p, b, ["k"])).first()
    assert (r["n_hours"], r["n_wins"], r["win_pct"]) == (2, 1, 50.0)


def test_bridge_days(spark):
    # 2019-05-14 is a Tuesday, 2019-05-23 a Thursday.
    hol = spark.createDataFrame([("2019-05-14",), ("2019-05-23",), ("2019-05-25",)], "date string").select(
        F.to_date("date").alias("date"), F.lit("x").alias("name"))
    flags = {str(r["date"]): (r["is_holiday"], r["is_bridge_day"]) for r in cal.day_flags(hol).collect()}
    assert flags == {"2019-05-14": (1, 0), "2019-05-13": (0, 1), "2019-05-23": (1, 0), "2019-05-24": (0, 1),
                     "2019-05-25": (1, 0)}


def test_easter(spark):
    years = spark.createDataFrame([(1961,), (2000,), (2018,), (2024,), (2038,)], "year int")
    got = {r["year"]: str(r["easter"]) for r in cal.with_easter(years).collect()}
    assert got == {1961: "1961-04-02", 2000: "2000-04-23", 2018: "2018-04-01", 2024: "2024-03-31", 2038: "2038-04-25"}


def test_short_block_is_dropped(spark):
    df = hours(spark, [float(i) for i in range(50)]).withColumn("model", F.lit("m"))
    kept = backtest.rolling_origin(df, H, "2018-01-01 00:00:00", 24, ["model"])
    assert kept.count() == 48
    assert backtest.rolling_origin(df, H, "2018-01-01 00:00:00", 24, ["model"], ragged="keep").count() == 50


def test_weekday_is_monday_zero_and_interpretation_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = hours(spark, [1.0, 2.0, 3.0], start=datetime(2018, 3, 11, 1))
        parts = df.select(*[c.alias(n) for n, c in cal.calendar_parts(F.col("ts")).items()]).collect()
        assert [r["hour"] for r in parts] == [1, 2, 3] and parts[0]["dow"] == 6
        back = df.select(fc.ts_of_step(fc.step_of(F.col("ts"), 3600), 3600).alias("t"),
                         fc.floor_ts(F.col("ts"), 3600).alias("f"), "ts").collect()
        assert all(r["t"] == r["ts"] == r["f"] for r in back)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_floor_of_early_and_fractional_times(spark):
    df = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59, 999999),), (datetime(1950, 6, 1, 5, 30),)],
                               "ts timestamp_ntz")
    got = [tuple(r) for r in df.select(fc.floor_ts(F.col("ts"), 3600), fc.floor_ts(F.col("ts"), 86400),
                                       fc.floor_ts(F.col("ts"), 7200)).collect()]
    assert got == [(datetime(1969, 12, 31, 23), datetime(1969, 12, 31), datetime(1969, 12, 31, 22)),
                   (datetime(1950, 6, 1, 5), datetime(1950, 6, 1), datetime(1950, 6, 1, 4))]


def test_quiet_audits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    r = audit.duplicate_audit(df, ["k"]).first()
    assert (r["n_rows"], r["n_keys"], r["n_repeated"], r["surplus_pct"]) == (2, 2, 0, 0.0)
    assert audit.missing_census(df).count() == 0


def test_widest_window_ties_and_size(spark):
    df = hours(spark, [0.0] * 200).select("series_id", "ts", "y", F.lit(0.0).alias("q05"), F.lit(2.0).alias("q95"))
    out = windows.widest_interval_window(df, H)
    assert out.first()["end_ts"] == T0 + timedelta(hours=71)
    assert out.count() == 72  # the slice reaches one hour before the first row


def test_find_model_falls_back_to_terms(spark):
    b = spark.createDataFrame([("s", 2, "A Retrain x", 1.0), ("s", 1, "Retrain", 2.0)],
                              "series_id string, ord int, model string, mae double")
    assert lb.find_model(b, "retrain").first()["model"] == "Retrain"
    assert lb.find_model(b, "retrain", exact="A Retrain x").first()["model"] == "A Retrain x"
    assert lb.find_model(b, "retrain", exact="none").first()["model"] == "Retrain"
    assert lb.first_valid(b, [("nope",), ("x", "retrain")]).first()["model"] == "A Retrain x"
