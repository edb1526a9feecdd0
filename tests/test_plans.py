"""What the physical plans must and must not contain, and invariants of the feature builders."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.catalog import QUERIES
from chronolith.catalog.base import H, hf
from chronolith.functions.calendar import holiday_table
from chronolith.operators import clean, grid, models, stats, windows
from chronolith.operators.grid import over_spans
from chronolith.plans import matrices
from chronolith.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lag_features", "rolling_lagged", "seasonal_naive", "sequence_windows", "acf",
                                  "forward_fill", "interpolate_linear", "centered_ma"])
def test_windows_shuffle_by_series_and_span(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "_span#" in text and "hashpartitioning(series_id#" in text
    for line in text.splitlines():
        # Windows over lags (max-lag + 1 rows) and over chunk totals are short by construction.
        if "Window [" in line and not any(k in line for k in ("_span", "_chunk", "lag#", "_sum#")):
            raise AssertionError("window over a whole series: " + line[:300])


def test_scan_prunes_and_pushes(spark):
    df = clean.time_slice(spark.read.parquet(f"{SF}/lineitem.parquet"), "1997-01-09 00:00:00", "1997-01-22 00:00:00",
                          "l_shipdate").select("l_quantity", "l_shipdate")
    text = plan(df)
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThanOrEqual(l_shipda" in text
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_lags_share_one_sort(spark):
    text = plan(windows.lag_features(spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y")), H))
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 1


def test_row_mode_equals_time_mode_without_gaps(spark):
    base = hf(spark, SF)
    a, b = (windows.lag_features(base, H, mode=m) for m in ("row", "time"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_spans_do_not_change_results(spark, monkeypatch):
    base = hf(spark, SF)
    whole = windows.rolling_lagged(base, H)
    monkeypatch.setattr(grid, "SPAN", 50)
    cut = windows.rolling_lagged(base, H)
    keep = ["series_id", "ts", *[F.round(f"rolling_{s}_24h", 8) for s in ("mean", "std", "max", "min")]]
    assert whole.select(*keep).exceptAll(cut.select(*keep)).count() == 0


def test_input_order_does_not_matter(spark):
    base = hf(spark, SF)
    shuffled = base.repartition(7, "y").sortWithinPartitions(F.desc("ts"))
    a, b = windows.seasonal_naive(base, H), windows.seasonal_naive(shuffled, H)
    assert a.exceptAll(b).count() == 0


def test_day_ahead_features_do_not_see_the_future(spark):
    hol = holiday_table(spark, 2024, 2024)
    base = hf(spark, SF)
    def build(df):
        return matrices.day_ahead_matrix(df, hol, "y", H, mode="time").drop("y")
    changed = models.leakage_probe(base, build, ["series_id", "ts"], "2024-01-20 23:00:00", 24 * 3600)
    assert changed.agg(F.sum("n_changed")).first()[0] == 0
    # The probe itself notices a feature that does see it.
    def leaky(df):
        return over_spans(df, H, lambda f: {"lag_1": f.at("y", -1)}, back=1).drop("y")
    assert models.leakage_probe(base, leaky, ["series_id", "ts"], "2024-01-20 23:00:00", 24 * 3600).first()["n_changed"] > 0


def test_feature_columns_of_the_matrices(spark):
    t0 = datetime(2018, 1, 1)
    rows = [(t0 + timedelta(hours=i), float(i % 24), 1.0) for i in range(400)]
    master = spark.createDataFrame(rows, "ts timestamp_ntz, `total load actual` double, HDD_X double")
    hol = holiday_table(spark, 2018, 2018)
    day = matrices.day_ahead_matrix(master, hol)
    assert day.count() == 230 and "load_t_170" in day.columns and "_y" not in day.columns
    intra = matrices.intraday_matrix(master, hol)
    assert intra.count() == 224 and "load_t_24" not in intra.columns and "rolling_std_24h" in intra.columns
    scaled, params = matrices.scaled_matrix(master, hol, "2018-01-12 00:00:00")
    back = scaled.agg(F.avg(F.when(F.col("ts") <= F.lit("2018-01-12").cast("timestamp_ntz"), F.col("total load actual")))).first()[0]
    assert back == pytest.approx(0.0, abs=1e-9) and params.count() == 1


def test_work_folder_follows_the_cluster_setting(spark):
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "hdfs:///shared/place/"}.get(key, default)

    assert tables.work_folder(Named).startswith("hdfs:///shared/place/chronolith-")
    assert tables.work_folder(spark) != tables.work_folder(spark)


def test_write_features_partitions_by_month(spark, tmp_path):
    tables.write_features(hf(spark, SF), str(tmp_path / "m"))
    text = plan(spark.read.parquet(str(tmp_path / "m")).where("ym = '2024-01'"))
    assert "PartitionFilters: [isnotnull(ym" in text
    assert tables.exists(spark, str(tmp_path / "m" / "_SUCCESS")) and not tables.exists(spark, str(tmp_path / "none"))


def test_quantiles_never_hold_a_group_in_one_aggregate(spark):
    text = plan(stats.exact_quantiles(hf(spark, SF), ["series_id"], "y", [0.5]))
    assert "percentile(" not in text and "percentile_approx(" in text
