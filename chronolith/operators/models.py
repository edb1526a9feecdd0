"""Fitting and predicting: boosted trees, linear models, additive and quantile forecasts.

Two kinds of fit.  One model for the whole table goes through ``pyspark.ml``.
One model per series (or per fold, penalty, column set) is linear: a task folds
its rows into small cross-product matrices, the shuffle adds those up, and the
solves run over rows of matrices.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import NumberFormatException, SparkRuntimeException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from chronolith.functions.calendar import cyclical
from chronolith.functions.columns import epoch_seconds
from chronolith.operators.stats import exact_quantiles, join_groups

# --- one model for the table ---------------------------------------------------


def fit_gbt(train: DataFrame, features: Iterable[str], target: str = "y", loss: str = "squared",
            seed: int = 42, **params) -> PipelineModel:
    """Boosted trees; ``params`` are GBTRegressor settings such as maxIter, maxDepth, stepSize.

    featureFraction is the share of columns that each split may look at.
    """
    if "featureFraction" in params:
        params["featureSubsetStrategy"] = str(float(params.pop("featureFraction")))
    tree = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="y_pred", lossType=loss,
                        seed=seed, cacheNodeIds=False, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), tree]).fit(train)


def fit_linear(train: DataFrame, features: Iterable[str], target: str = "y", ridge: float = 0.0) -> PipelineModel:
    line = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="y_pred", solver="normal",
                            regParam=ridge)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), line]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_x")


def fit_predict_gbt(train: DataFrame, score: DataFrame, features, target: str = "y", **params) -> DataFrame:
    return predict(fit_gbt(train, features, target, **params), score)


def fit_predict_linear(train: DataFrame, score: DataFrame, features, target: str = "y",
                       ridge: float = 0.0) -> DataFrame:
    return predict(fit_linear(train, features, target, ridge), score)


# --- cross products ---------------------------------------------------------------

FLUSH_KEYS = 2048


def _fold_gram(by: list[str], width: int):
    tri = np.triu_indices(width)

    def fold(batches):
        held: dict[tuple, np.ndarray] = {}

        def drain():
            keys = list(held)
            out = {c: [k[i] for k in keys] for i, c in enumerate(by)}
            out["_g"] = [held[k][tri] for k in keys]
            held.clear()
            return pd.DataFrame(out)

        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch.drop(columns=by).to_numpy(dtype=float)])
            where = batch.groupby(by, sort=False, dropna=False).indices if by else {(): np.arange(len(batch))}
            for key, rows in where.items():
                key = key if isinstance(key, tuple) else (key,)
                block = z[rows]
                g = block.T @ block
                held[key] = held[key] + g if key in held else g
            if len(held) > FLUSH_KEYS:
                yield drain()
        if held:
            yield drain()
    return fold


def column_means(df: DataFrame, columns: Iterable[str]) -> list[float]:
    """Mean of each column over all rows (one row is read back); products are taken around it."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [0.0 if m is None else m for m in row]


def gram_cells(df: DataFrame, by: Iterable[str], xs: Iterable[str], y: str = "y",
               shift: list[float] | None = None) -> DataFrame:
    """(by, _i, _v): cells of the upper triangle of [1, xs, y]' [1, xs, y] over complete rows, each column less its shift.

    Rows are reduced where they are read; only matrices are shuffled, and they
    are summed cell by cell with partial aggregation, so a dominant series costs
    no more than the others.
    """
    by, xs = list(by), list(xs)
    width = len(xs) + 2
    shift = shift or [0.0] * (width - 1)
    cols = [(F.col(f"`{c}`").cast("double") - F.lit(float(m))).alias(f"z{i}")
            for i, (c, m) in enumerate(zip([*xs, y], shift))]
    complete = df.select(*by, *cols).where(" AND ".join(f"z{i} IS NOT NULL" for i in range(width - 1)))
    types = {f.name: f.dataType.simpleString() for f in df.select(*by).schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["_g array<double>"])
    cells = complete.mapInPandas(_fold_gram(by, width), schema).select(*by, F.posexplode("_g").alias("_i", "_v"))
    return cells.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))


def collect_cells(cells: DataFrame, by: Iterable[str]) -> DataFrame:
    """(by, gram): the cells of each key in order."""
    return cells.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda e: e["_v"]).alias("gram"))


def gram(df: DataFrame, by: Iterable[str], xs: Iterable[str], y: str = "y",
         shift: list[float] | None = None) -> DataFrame:
    """(by, gram): the upper triangle of gram_cells as one array."""
    return collect_cells(gram_cells(df, by, xs, y, shift), by)


def _square(cells, width: int) -> np.ndarray:
    g = np.zeros((width, width))
    g[np.triu_indices(width)] = np.asarray(cells, dtype=float)
    return g + np.triu(g, 1).T


def solve_gram(g: np.ndarray, keep: list[int], ridge: float = 0.0) -> np.ndarray:
    """Coefficients of the kept columns (0 = intercept); the others get 0.

    A column counts as constant where its variance is no more than the rounding of its second moment;
    columns that depend on others are settled by the rank of the scaled matrix.

    Columns are centered and brought to unit scale through the matrix itself, so
    the penalty is per standard deviation and leaves the intercept alone.
    """
    n = g[0, 0]
    beta = np.zeros(g.shape[0] - 1)
    if n <= 0:
        return beta
    mean = g[0, :] / n
    cov = g / n - np.outer(mean, mean)
    cols = [k for k in keep if k > 0 and cov[k, k] > 1e-14 * max(abs(g[k, k] / n), 1e-300)]
    if cols:
        sd = np.sqrt(np.diag(cov)[cols])
        a = cov[np.ix_(cols, cols)] / np.outer(sd, sd) + ridge * np.eye(len(cols))
        beta[cols] = np.linalg.pinv(a, hermitian=True, rcond=1e-12) @ (cov[cols, -1] / sd) / sd
    beta[0] = mean[-1] - beta[1:] @ mean[1:-1]
    return beta


def _solver(width: int, shift: list[float]):
    moved = np.asarray(shift, dtype=float)

    def back(beta: np.ndarray) -> np.ndarray:
        beta[0] += moved[-1] - beta[1:] @ moved[:-1]
        return beta

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(cells: pd.Series, keep: pd.Series, ridge: pd.Series) -> pd.Series:
        return pd.Series([back(solve_gram(_square(c, width), [int(i) for i in k], r))
                          for c, k, r in zip(cells, keep, ridge)])
    return solve


def linear_coefficients(grams: DataFrame, width: int, keep: Column | None = None,
                        ridge: Column | float = 0.0, shift: list[float] | None = None) -> DataFrame:
    """Coefficients on the raw columns; `shift` is what the matrices' columns were taken around."""
    keep = keep if keep is not None else F.array(*[F.lit(i) for i in range(width - 1)])
    ridge = ridge if isinstance(ridge, Column) else F.lit(float(ridge))
    return grams.withColumn("beta", _solver(width, shift or [0.0] * (width - 1))("gram", keep, ridge)).drop("gram")


def linear_value(xs: Iterable[str], beta: Column) -> Column:
    """Intercept plus dot product; wide designs go through arrays to keep generated code small."""
    cols = [F.col(f"`{c}`").cast("double") for c in xs]
    if len(cols) > 12:
        x = F.array(F.lit(1.0), *cols)
        return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    total = beta[0]
    for i, c in enumerate(cols, start=1):
        total = total + c * beta[i]
    return total


def fit_panel(train: DataFrame, by: Iterable[str], xs: Iterable[str], y: str = "y",
              ridge: float = 0.0) -> DataFrame:
    """(by, beta): one least-squares fit per series, all in one job."""
    xs = list(xs)
    shift = column_means(train, [*xs, y])
    return linear_coefficients(gram(train, by, xs, y, shift), len(xs) + 2, ridge=ridge, shift=shift)


def predict_panel(df: DataFrame, coefficients: DataFrame, by: Iterable[str], xs: Iterable[str],
                  name: str = "y_pred") -> DataFrame:
    """Every row stays; a series without a fit gets NULL, which score_status and the denominators see."""
    by = list(by)
    if by:
        joined = join_groups(df, coefficients.select(*by, "beta"), by, "left")
    else:
        joined = df.withColumn("beta", coefficients.select("beta").scalar())
    return joined.withColumn(name, linear_value(xs, F.col("beta"))).drop("beta")


# --- additive forecast ------------------------------------------------------------

YEAR_SECONDS = 365.25 * 86400.0


def additive_design(seconds: Column, start: str, end: str, knots: int = 5, yearly: int = 3, weekly: int = 3,
                    daily: int = 4, flags: Iterable[str] = ()) -> dict[str, Column]:
    """Trend with hinge change points on the first 80 % of training, Fourier terms, flags."""
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    origin = datetime(1970, 1, 1)
    t = (seconds - (a - origin) / timedelta(seconds=1)) / ((b - a) / timedelta(seconds=1))
    out = {"trend": t}
    for i in range(1, knots + 1):
        at = 0.8 * i / (knots + 1)
        out[f"hinge_{i}"] = F.when(t > at, t - at).otherwise(0.0)
    for name, period, order in (("year", YEAR_SECONDS, yearly), ("week", 7 * 86400.0, weekly),
                                ("day", 86400.0, daily)):
        for k in range(1, order + 1):
            out[f"{name}_sin_{k}"], out[f"{name}_cos_{k}"] = cyclical(seconds, period, k)
    out.update({f: F.col(f).cast("double") for f in flags})
    return {f"x_{k}": v for k, v in out.items()}


def additive_forecast(df: DataFrame, by: Iterable[str], train_start: str, train_end: str, ts: str = "ts",
                      y: str = "y", mode: str = "additive", ridge: float = 1e-4, flags: Iterable[str] = (),
                      **design) -> DataFrame:
    """Trend + seasonality + calendar regressors per series; adds y_pred.

    Trained on the rows from ``train_start`` to ``train_end``; all rows are predicted.
    "multiplicative" fits the logarithm and keeps positive targets only.
    """
    by = list(by)
    columns = additive_design(F.col("_seconds"), train_start, train_end, flags=flags, **design)
    xs = list(columns)
    target = F.col(y) if mode == "additive" else F.when(F.col(y) > 0, F.ln(y))
    full = (df.withColumn("_seconds", epoch_seconds(F.col(ts)).cast("double"))
            .withColumns({**columns, "_target": target}).drop("_seconds"))
    train = full.where(F.col(ts).between(F.lit(train_start).cast("timestamp_ntz"), F.lit(train_end).cast("timestamp_ntz")))
    out = predict_panel(full, fit_panel(train, by, xs, "_target", ridge), by, xs)
    if mode != "additive":
        out = out.withColumn("y_pred", F.exp("y_pred"))
    return out.drop("_target", *xs)


# --- quantiles ------------------------------------------------------------------------

# Levels of the probabilistic forecast.
TAUS = (0.05, 0.50, 0.95)


def quantile_forecast(calibration: DataFrame, score: DataFrame, by: Iterable[str], ts: str = "ts",
                      y: str = "y", y_pred: str = "y_pred", taus=TAUS) -> DataFrame:
    """Point forecast plus exact residual quantiles by hour of day, from held-out rows.

    Adds q05, q50, q95 (named by level), sorted so that they cannot cross.
    """
    by = list(by)
    held = calibration.select(*by, F.hour(ts).alias("_hour"), (F.col(y) - F.col(y_pred)).alias("_res"))
    bands = exact_quantiles(held, [*by, "_hour"], "_res", taus).drop("n")
    joined = score.withColumn("_hour", F.hour(ts)).join(bands, [*by, "_hour"], "left")
    ordered = F.sort_array(F.array(*[F.col(y_pred) + F.col(f"q_{i}") for i in range(len(taus))]))
    out = joined.withColumn("_q", ordered)
    names = {f"q{round(t * 100):02d}": F.col("_q")[i] for i, t in enumerate(sorted(taus))}
    return out.withColumns(names).drop("_q", "_hour", *[f"q_{i}" for i in range(len(taus))])


# --- search ---------------------------------------------------------------------------

def random_trials(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """Draws from {"name": ("int", lo, hi) | ("float", lo, hi) | ("log", lo, hi) | ("choice", [..])}."""
    rng = random.Random(seed)

    def draw(kind, *args):
        if kind == "int":
            return rng.randint(*args)
        if kind == "float":
            return rng.uniform(*args)
        if kind == "log":
            return math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))
        return rng.choice(args[0])

    return [{name: draw(*spec) for name, spec in space.items()} for _ in range(n)]


# Search spaces, wide for clean features, narrow for noisy ones, and for one step ahead.
GBT_SPACE = {"maxDepth": ("int", 4, 12), "maxIter": ("int", 100, 1000), "stepSize": ("log", 1e-3, 0.1),
             "featureFraction": ("float", 0.5, 1.0)}
GBT_SPACE_NOISY = {"maxDepth": ("int", 3, 7), "maxIter": ("int", 100, 1000), "stepSize": ("log", 1e-3, 0.1),
                   "featureFraction": ("float", 0.3, 0.7)}
GBT_SPACE_INTRADAY = {"maxDepth": ("int", 4, 12), "maxIter": ("int", 100, 1000), "stepSize": ("log", 0.01, 0.1),
                      "featureFraction": ("float", 0.5, 1.0), "subsamplingRate": ("float", 0.5, 1.0)}


def time_grid_search(spark: SparkSession, train: DataFrame, val: DataFrame,
                     fit_predict: Callable[..., DataFrame], trials: list[dict], y: str = "y") -> DataFrame:
    """(trial, params, mae, error): every trial fitted on train and scored on the later val rows.

    The loop submits one distributed fit per trial; only its error comes back.  Parameters are JSON, so
    that :func:`refit_champion` can read them.  A fit whose job fails gets NULL and its message and the
    search goes on; a mistake in the call (an unknown column or parameter) ends it.
    """
    rows = []
    for i, params in enumerate(trials):
        mae, error = None, None
        try:
            scored = fit_predict(train, val, **params)
            mae = scored.agg(F.avg(F.abs(F.col(y) - F.col("y_pred")))).first()[0]
        except (Py4JJavaError, SparkRuntimeException, NumberFormatException) as failure:
            error = str(failure).splitlines()[0][:500]
        rows.append((i, json.dumps(params, sort_keys=True), mae, error))
    return spark.createDataFrame(rows, "trial int, params string, mae double, error string")


def refit_champion(trials: DataFrame, fit: Callable[..., PipelineModel], full: DataFrame) -> PipelineModel:
    """The best trial's parameters fitted on the full training range."""
    best = best_trial(trials, "trial").first()
    if best is None:
        raise ValueError("no trial could be fitted")
    return fit(full, **json.loads(best["params"]))


def ridge_search(train: DataFrame, val: DataFrame, by: Iterable[str], xs: Iterable[str], penalties,
                 y: str = "y") -> DataFrame:
    """(by, penalty, mae) for all penalties in one job: one pass over train, one over val."""
    by, xs = list(by), list(xs)
    shift = column_means(train, [*xs, y])
    grams = gram(train, by, xs, y, shift).withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))
    coef = linear_coefficients(grams, len(xs) + 2, ridge=F.col("penalty"), shift=shift)
    return _score_variants(val, coef, by, "penalty", xs, y)


def ablation_sets(train: DataFrame, val: DataFrame, by: Iterable[str], sets: dict[str, list[str]],
                  y: str = "y") -> DataFrame:
    """(by, column_set, mae): the same linear fit on different column sets.

    Every set is a block of one cross-product matrix, so the training rows are
    read once for all sets.
    """
    by = list(by)
    xs = sorted({c for cols in sets.values() for c in cols})
    entries = [F.struct(F.lit(name).alias("column_set"),
                        F.array(*[F.lit(xs.index(c) + 1) for c in cols]).alias("_keep"))
               for name, cols in sets.items()]
    complete = train.where(" AND ".join(f"`{c}` IS NOT NULL" for c in xs))
    shift = column_means(complete, [*xs, y])
    grams = gram(complete, by, xs, y, shift).select(*by, "gram", F.inline(F.array(*entries)))
    coef = linear_coefficients(grams, len(xs) + 2, keep=F.col("_keep"), shift=shift).drop("_keep")
    return _score_variants(val, coef, by, "column_set", xs, y)


def _score_variants(val: DataFrame, coef: DataFrame, by: list[str], variant: str, xs: list[str],
                    y: str) -> DataFrame:
    """MAE per series and variant; each row meets a fixed handful of coefficient vectors."""
    packed = coef.groupBy(*by).agg(F.collect_list(F.struct(F.col(variant), "beta")).alias("_models"))
    joined = val.join(packed, by) if by else val.withColumn("_models", packed.select("_models").scalar())
    scored = (joined.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*xs, y]))
              .select(*by, F.col(y).alias("_y"), *[f"`{c}`" for c in xs], F.inline("_models"))
              .withColumn("_p", linear_value(xs, F.col("beta"))))
    return scored.groupBy(*by, variant).agg(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("mae"))


def best_trial(trials: DataFrame, *ties: str, by: Iterable[str] = (), mae: str = "mae") -> DataFrame:
    """The row with the lowest error (per series), ties by the given columns; failed trials (NULL) are no candidates."""
    by, trials = list(by), trials.where(F.col(mae).isNotNull())
    others = [c for c in trials.columns if c not in by]
    best = trials.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(mae, *ties)).alias("_b"))
    return best.select(*by, "_b.*")


# --- causality probe ---------------------------------------------------------------------

def leakage_probe(df: DataFrame, build: Callable[[DataFrame], DataFrame], keys: Iterable[str], cutoff: str,
                  horizon_seconds: int, ts: str = "ts", y: str = "y", delta: float = 1000.0) -> DataFrame:
    """Per feature: rows up to cutoff + horizon whose value moves when y after the cutoff does.

    The executable form of "no feature at t uses y newer than t - h"; all counts
    must be 0.
    """
    from chronolith.functions.columns import shift_ts

    keys = list(keys)
    edge = F.lit(cutoff).cast("timestamp_ntz")
    moved = df.withColumn(y, F.when(F.col(ts) > edge, F.col(y) + delta).otherwise(F.col(y)))
    a, b = build(df), build(moved)
    features = [c for c in a.columns if c not in (*keys, y)]
    joined = (a.where(F.col(ts) <= shift_ts(edge, horizon_seconds)).select(*keys, *features)
              .join(b.select(*keys, *[F.col(c).alias(f"{c}__moved") for c in features]), keys))
    entries = [F.struct(F.lit(c).alias("feature"),
                        F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}__moved"))).alias("n_changed"))
               for c in features]
    return joined.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))
