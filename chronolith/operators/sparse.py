"""Change points under an L1 penalty: the whole path of penalties for every series in one job.

Rows are folded into one matrix for each series; the path is coordinate descent on that matrix, so its cost does not
depend on the length of the series.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from chronolith.functions.columns import epoch_seconds
from chronolith.operators.models import _square, additive_design, column_means, gram, linear_value
from chronolith.operators.stats import join_groups

#: Largest change of a standardised coefficient at which descent stops, and its most passes.
TOLERANCE, PASSES = 1e-12, 10_000


def lasso_path(g: np.ndarray, penalised: list[int], penalties: Iterable[float]) -> list[np.ndarray]:
    """Coefficients for each penalty out of a cross-product matrix of [1, x.., y].

    Minimises mean squared error / 2 + penalty * sd(y) * sum of sd(x) * |b| over the penalised columns; the others are
    free and are eliminated exactly.  Constant columns and a constant target give 0.
    """
    n = g[0, 0]
    width = g.shape[0]
    zero = np.zeros(width - 1)
    if n <= 0:
        return [zero.copy() for _ in penalties]
    mean = g[0] / n
    cov = g / n - np.outer(mean, mean)
    alive = np.diag(cov) > 1e-14 * np.maximum(np.abs(np.diag(g)) / n, 1e-300)
    sd = np.sqrt(np.where(alive, np.diag(cov), 1.0))
    corr = cov / np.outer(sd, sd)
    wanted = set(penalised)
    p = [k for k in range(1, width - 1) if alive[k] and k in wanted]
    u = [k for k in range(1, width - 1) if alive[k] and k not in wanted]
    back = np.linalg.pinv(corr[np.ix_(u, u)], hermitian=True, rcond=1e-12) if u else np.zeros((0, 0))
    r, c = corr[np.ix_(p, p)], corr[p, -1]
    if u:
        cross = corr[np.ix_(p, u)]
        r, c = r - cross @ back @ cross.T, c - cross @ back @ corr[u, -1]
    if not alive[-1]:
        c = np.zeros(len(p))
    out, b = {}, np.zeros(len(p))
    for penalty in sorted(penalties, reverse=True):  # each penalty starts from the solution of the one above
        for _ in range(PASSES):
            moved = 0.0
            for j in range(len(p)):
                if r[j, j] <= 1e-12:
                    continue
                left = c[j] - r[j] @ b + r[j, j] * b[j]
                new = np.sign(left) * max(abs(left) - penalty, 0.0) / r[j, j]
                moved = max(moved, abs(new - b[j]))
                b[j] = new
            if moved <= TOLERANCE:
                break
        beta = zero.copy()
        if alive[-1]:
            beta[p] = b * sd[-1] / sd[p]
            if u:
                beta[u] = back @ (corr[u, -1] - corr[np.ix_(u, p)] @ b) * sd[-1] / sd[u]
        beta[0] = mean[-1] - beta[1:] @ mean[1:-1]
        out[penalty] = beta
    return [out[x] for x in penalties]


def fit_path(train: DataFrame, by: Iterable[str], xs: Iterable[str], penalised: Iterable[str], penalties: Iterable[float],
             y: str = "y") -> DataFrame:
    """(by, betas): one array of coefficients for each penalty, in the order given."""
    by, xs, penalties = list(by), list(xs), [float(x) for x in penalties]
    chosen = [1 + xs.index(x) for x in penalised]
    shift = column_means(train, [*xs, y])
    moved = np.asarray(shift, dtype=float)

    @pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def solve(cells: pd.Series) -> pd.Series:
        rows = []
        for c in cells:
            path = lasso_path(_square(c, len(xs) + 2), chosen, penalties)
            for beta in path:
                beta[0] += moved[-1] - beta[1:] @ moved[:-1]
            rows.append([beta.tolist() for beta in path])
        return pd.Series(rows)

    return gram(train, by, xs, y, shift).select(*by, solve("gram").alias("betas"))


def sparse_trend_forecast(df: DataFrame, by: Iterable[str], train_start: str, train_end: str, val_end: str, penalties: Iterable[float],
                          ts: str = "ts", y: str = "y", **design) -> DataFrame:
    """Additive forecast whose change points are chosen by the data; adds penalty, n_changes and y_pred.

    Many hinges are offered (`knots`), an L1 penalty keeps few.  Every series takes the penalty with the smallest mean
    absolute error on the rows after `train_end` up to `val_end` (the largest penalty among equals); a series without
    such rows takes the largest.
    """
    by, penalties = list(by), sorted({float(x) for x in penalties}, reverse=True)
    columns = additive_design(F.col("_seconds"), train_start, train_end, **design)
    xs = list(columns)
    hinges = [x for x in xs if x.startswith("x_hinge_")]
    full = df.withColumn("_seconds", epoch_seconds(F.col(ts)).cast("double")).withColumns(columns).drop("_seconds")
    time = F.col(ts)
    start, end, last = (F.lit(x).cast("timestamp_ntz") for x in (train_start, train_end, val_end))
    path = fit_path(full.where(time.between(start, end)), by, xs, hinges, penalties, y)
    val = join_groups(full.where((time > end) & (time <= last)), path, by)
    errors = val.select(*by, F.posexplode(F.transform("betas", lambda b: F.abs(F.col(y) - linear_value(xs, b)))).alias("_k", "_e"))
    mae = errors.groupBy(*by, "_k").agg(F.avg("_e").alias("_mae")).where("_mae IS NOT NULL")
    best = mae.groupBy(*by).agg(F.min_by("_k", F.struct(F.round("_mae", 9), "_k")).alias("_k"))
    chosen = join_groups(path, best, by, "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    beta = F.get("betas", F.col("_k"))
    changes = F.aggregate(F.slice("_beta", 2 + xs.index(hinges[0]), len(hinges)) if hinges else F.array().cast("array<double>"), F.lit(0),
                          lambda n, b: n + (F.abs(b) > 0).cast("int"))
    models = chosen.select(*by, F.get(F.array(*[F.lit(x) for x in penalties]), F.col("_k")).alias("penalty"), beta.alias("_beta")).withColumn("n_changes", changes)
    out = join_groups(full, models, by, "left")
    return out.withColumn("y_pred", linear_value(xs, F.col("_beta"))).drop("_beta", *xs)
