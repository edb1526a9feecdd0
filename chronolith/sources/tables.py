"""Readers and writers: raw CSV tables, master table, feature matrices, predictions, models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chronolith.functions.columns import nan_to_null


def work_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that all machines share.

    spark.checkpoint.dir names it; else it lies in the home folder of the cluster's default file system.  A
    file system of one machine serves a local session only: elsewhere executors could not read each other.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        jvm = spark._jvm
        fs = jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if fs.getScheme() != "file":
            base = f"{fs.getHomeDirectory().toString()}/.chronolith"
        elif local:
            base = f"file:{jvm.java.lang.System.getProperty('java.io.tmpdir')}/chronolith-work"
        else:
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that all executors reach")
    return f"{base.rstrip('/')}/chronolith-{uuid.uuid4().hex}"


# --- raw tables -------------------------------------------------------------------

def energy_schema(measures: Iterable[str], time: str = "time") -> T.StructType:
    return T.StructType([T.StructField(time, T.StringType())]
                        + [T.StructField(m, T.DoubleType()) for m in measures])


# Columns of the weather table.
WEATHER_SCHEMA = T.StructType(
    [T.StructField("dt_iso", T.StringType()), T.StructField("city_name", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("temp", "humidity", "wind_speed", "clouds_all",
                                                  "rain_1h", "rain_3h", "snow_3h")]
    + [T.StructField("weather_description", T.StringType())])


def instant_to_utc(c: Column) -> Column:
    """Zone-free UTC from text with an offset, whatever the session time zone."""
    micros = F.unix_micros(F.to_timestamp(c))
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats})


def read_hourly_csv(spark: SparkSession, path: str, schema: T.StructType, time: str = "time",
                    utc: str = "ts_utc") -> DataFrame:
    """Typed CSV scan (no inference pass) with the time text parsed to zone-free UTC."""
    raw = spark.read.schema(schema).option("nullValue", "").csv(path, header=True)
    return without_nan(raw).withColumn(utc, instant_to_utc(F.col(f"`{time}`")))


def read_projected(spark: SparkSession, path: str, schema: T.StructType, columns: Iterable[str]) -> DataFrame:
    """Only the named columns leave the CSV parser."""
    raw = spark.read.schema(schema).option("enforceSchema", "true").csv(path, header=True)
    return raw.select(*[f"`{c}`" for c in columns])


def read_master(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Master table from parquet, or from CSV when a schema is given."""
    if schema is None:
        return without_nan(spark.read.parquet(path))
    return without_nan(spark.read.schema(schema).csv(path, header=True))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


# --- writers ------------------------------------------------------------------------

def write_master(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def with_month(df: DataFrame, ts: str = "ts", name: str = "ym") -> DataFrame:
    return df.withColumn(name, F.date_format(ts, "yyyy-MM"))


def write_features(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet by month.  Rebalancing gathers the rows of a month into few files
    and splits a month that is too large for one task."""
    with_month(df, ts).hint("rebalance", F.col("ym")).write.mode("overwrite").partitionBy("ym").parquet(path)


def write_feature_matrices(matrices: dict[str, DataFrame], folder: str, ts: dict[str, str] | str = "ts") -> None:
    for name, df in matrices.items():
        write_features(df, f"{folder}/{name}", ts if isinstance(ts, str) else ts[name])


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def store_raw(df: DataFrame, path: str, ts: str = "ts") -> None:
    """A raw table by month, the form that grow_features appends to."""
    write_features(df, path, ts)


def grow_features(spark: SparkSession, raw_path: str, feature_path: str, new_rows: DataFrame, keys: Iterable[str],
                  build: Callable[[DataFrame], DataFrame], back: str, ts: str = "ts") -> list[str]:
    """Takes new raw rows into a stored feature table without building it anew; returns the months it rewrote.

    `keys` name a raw row: a new row replaces a stored one.  `build` turns raw rows into features with the same `ts`, and
    must be clock-based: a feature of a row depends on raw rows of the stretch `back` (as "47 hours") before it, and on
    none after it.  Rewritten are the months that hold a new row or whose features reach back to one; read are these and
    those that their features reach back to, all other months are pruned.  Months are replaced whole (dynamic partition
    overwrite), so a run that is repeated gives the same table.
    """
    keys = list(keys)
    new = materialize(with_month(new_rows, ts), spark)
    late = F.col(ts) + F.expr(f"INTERVAL {back}")
    # Months of new rows and of the rows their values reach: one short list on the driver, bounded by the calendar.
    touched = sorted({r[0] for r in new.select(F.explode(F.sequence(F.trunc(F.to_date(ts), "month"), F.trunc(F.to_date(late), "month"),
                                                                    F.expr("INTERVAL 1 MONTH"))).alias("m"))
                      .select(month_of(F.col("m"))).distinct().collect()})
    if not touched:
        return []
    own = [r[0] for r in new.select("ym").distinct().collect()]
    stored_raw = spark.read.parquet(raw_path)
    kept = stored_raw.where(F.col("ym").isin(own)).join(new.select(*keys), keys, "left_anti")
    replaced = materialize(kept.unionByName(new, allowMissingColumns=True), spark)
    _replace_months(replaced, raw_path)
    known = {r[0] for r in spark.read.parquet(raw_path).select("ym").distinct().collect()}
    touched = [m for m in touched if m in known]
    first = F.lit(touched[0] + "-01").cast("timestamp_ntz") - F.expr(f"INTERVAL {back}")
    needed = spark.read.parquet(raw_path).where(F.col("ym").between(month_of(first), F.lit(touched[-1]))).drop("ym")
    features = with_month(build(needed), ts).where(F.col("ym").isin(touched))
    _replace_months(materialize(features, spark), feature_path)
    return touched


def _replace_months(df: DataFrame, path: str) -> None:
    (df.hint("rebalance", F.col("ym")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ym").parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def cache_predictions(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Predictions table by model: read if it was written to the end, else computed once.

    The success marker decides, so a run that died half-way is computed again.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").partitionBy("model").parquet(path)
    return spark.read.parquet(path)


def append_leaderboard(df: DataFrame, path: str, run: str) -> None:
    """File the results of a run; filing the same run again replaces its rows."""
    (df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def materialize(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write a frame that several results share to the work folder and read it back.

    A written table survives lost executors and cuts the lineage.
    """
    path = work_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
