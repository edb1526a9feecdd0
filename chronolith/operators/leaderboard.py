"""Ranking and comparing models, for every series at once.

A leaderboard has one row per (series, model, horizon) with ``mae``, ``mape``,
``stage`` and ``ord``, the order in which results were recorded.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Name fragments that place a model in a family.
FAMILIES = {
    "prophet": "Statistical",
    "mlp": "Tabular Neural",
    "tabnet": "Tabular Neural",
    "lightgbm": "Boosted Trees",
    "tft": "Deep Sequence",
    "n-hits": "Deep Sequence",
}
# Lookups of the benchmark rows, in order of preference.
FLOOR_TERMS = [("naïve",), ("naive",)]
TARGET_TERMS = [("tso", "ceiling"), ("tso",)]
CEILING_TERMS = [("god mode",), ("leakage",)]
# Name fragments of each horizon and comparison group.
INTRADAY_TEXT = "h=1"
INTRADAY_NAME = "intraday"
RETRAIN_NAME = "mlops"
DAY_AHEAD_NAME = "day-ahead"
BENCHMARK_NAMES = ["naïve", "naive", "tso"]
UNFINISHED_NAMES = ["initial"]
UNIVARIATE_NAMES = ["univariate", "sarima"]
UNIVARIATE_SEQUENCE = ["n-hits", "168h"]
NOT_MULTIVARIATE = ["naïve", "naive", "tso", "leakage", "univariate", "sarima", "sandbox", "god mode"]


def name_has_all(name: Column, terms: Sequence[str]) -> Column:
    low = F.lower(name)
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.contains(low, F.lit(t.lower()))
    return hit


def name_has_any(name: Column, terms: Sequence[str]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t.lower()))
    return hit


def _preference(lookups: Sequence[Sequence[str]], exact: str | None) -> Column:
    """0, 1, ... for the first lookup a row satisfies; NULL for none."""
    model = F.col("model")
    rank = F.when(model == exact, F.lit(-1)) if exact is not None else F.when(F.lit(False), F.lit(-1))
    for i, terms in enumerate(lookups):
        rank = rank.when(name_has_all(model, terms), F.lit(i))
    return rank


def first_valid(board: DataFrame, lookups: Sequence[Sequence[str]], by: Iterable[str] = ("series_id",),
                exact: str | None = None) -> DataFrame:
    """Per series the row of the first lookup that finds any; earliest recorded row wins."""
    by = list(by)
    others = [c for c in board.columns if c not in by]
    ranked = board.withColumn("_rank", _preference(lookups, exact)).where("_rank IS NOT NULL")
    best = ranked.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct("_rank", "ord")).alias("_b"))
    return best.select(*by, "_b.*")


def find_model(board: DataFrame, *terms: str, exact: str | None = None,
               by: Iterable[str] = ("series_id",)) -> DataFrame:
    """Exact name if given and present, else the first name that contains all terms (the first row, without terms)."""
    return first_valid(board, [terms], by, exact)


def _first_mae(lookups: Sequence[Sequence[str]]) -> Column:
    return F.min_by(F.when(_preference(lookups, None).isNotNull(), F.col("mae")),
                    F.when(_preference(lookups, None).isNotNull(),
                           F.struct(_preference(lookups, None).alias("r"), F.col("ord").alias("o"))))


def benchmark_bounds(board: DataFrame, by: Iterable[str] = ("series_id",)) -> DataFrame:
    """Floor, target and ceiling error per series and the zone between floor and ceiling."""
    out = board.groupBy(*by).agg(_first_mae(FLOOR_TERMS).alias("floor_mae"),
                                 _first_mae(TARGET_TERMS).alias("target_mae"),
                                 _first_mae(CEILING_TERMS).alias("ceiling_mae"))
    both = F.col("floor_mae").isNotNull() & F.col("ceiling_mae").isNotNull()
    return (out.withColumn("zone_low", F.when(both, F.least("floor_mae", "ceiling_mae")))
            .withColumn("zone_high", F.when(both, F.greatest("floor_mae", "ceiling_mae"))))


def horizon_class(model: Column, horizon: Column) -> Column:
    """"intraday" or "day-ahead" from the horizon text or the model name, null-safe."""
    text = F.coalesce(F.lower(horizon), F.lit(""))
    intraday = (F.contains(text, F.lit(INTRADAY_TEXT)) | F.contains(F.lower(model), F.lit(INTRADAY_NAME))
                | F.contains(F.lower(model), F.lit(RETRAIN_NAME)))
    return (F.when(intraday, "intraday").when(F.contains(text, F.lit(DAY_AHEAD_NAME)), "day-ahead"))


def filter_by_horizon(board: DataFrame, which: str) -> DataFrame:
    return board.where(horizon_class(F.col("model"), F.col("horizon")) == which)


def model_family(model: Column) -> Column:
    out = None
    for fragment, family in FAMILIES.items():
        hit = F.contains(F.lower(model), F.lit(fragment))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("Other")


def model_kind(model: Column) -> Column:
    """"univariate", "multivariate", or NULL for benchmarks and leakage studies."""
    return (F.when(name_has_any(model, BENCHMARK_NAMES + UNFINISHED_NAMES), F.lit(None).cast("string"))
            .when(name_has_any(model, UNIVARIATE_NAMES) | name_has_all(model, UNIVARIATE_SEQUENCE), "univariate")
            .when(~name_has_any(model, NOT_MULTIVARIATE), "multivariate"))


def rank_leaderboard(board: DataFrame, by: Iterable[str] = ("series_id",)) -> DataFrame:
    """rank 1 = largest error; a series' leaderboard is a few dozen rows."""
    w = Window.partitionBy(*by).orderBy(F.desc("mae"), "model", "horizon")
    return board.withColumn("rank", F.row_number().over(w))


def step_improvement(board: DataFrame, by: Iterable[str] = ("series_id",)) -> DataFrame:
    """Absolute and percent gain from each model to the next better one."""
    w = Window.partitionBy(*by).orderBy("rank")
    gain = F.col("mae") - F.lead("mae").over(w)
    return (rank_leaderboard(board, by).withColumn("delta", gain)
            .withColumn("delta_pct", F.try_divide(F.col("delta"), F.col("mae")) * 100.0))


def horizon_flip(board: DataFrame, by: Iterable[str] = ("series_id",)) -> DataFrame:
    """Best univariate and best multivariate error side by side for each horizon class."""
    kind = F.col("_kind")
    best = {k: F.min(F.when(kind == k, F.col("mae"))) for k in ("univariate", "multivariate")}
    return (board.withColumn("horizon_class", horizon_class(F.col("model"), F.col("horizon")))
            .withColumn("_kind", model_kind(F.col("model")))
            .where("horizon_class IS NOT NULL AND _kind IS NOT NULL")
            .groupBy(*by, "horizon_class").agg(*[c.alias(k) for k, c in best.items()]))


def append_results(board: DataFrame, more: DataFrame) -> DataFrame:
    return board.unionByName(more)


# --- forecast against benchmark ---------------------------------------------------------

def forecast_vs_benchmark(predictions: DataFrame, benchmark: DataFrame, keys: Iterable[str],
                          forecast: str = "q50", name: str = "benchmark") -> DataFrame:
    """Actual, forecast and benchmark side by side with absolute errors and the win flag.

    An hour without benchmark counts as no win and stays in the table.
    """
    from chronolith.functions.columns import true_or_zero
    from chronolith.operators.align import attach_benchmark

    joined = attach_benchmark(predictions, benchmark, keys)
    y = F.col("y_true")
    return (joined.withColumn("model_error", F.abs(y - F.col(forecast)))
            .withColumn("benchmark_error", F.abs(y - F.col(name)))
            .withColumn("win", true_or_zero(F.col("model_error") < F.col("benchmark_error"))))


def win_rate(compared: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    return compared.groupBy(*by).agg(F.count("*").alias("n_hours"), F.sum("win").cast("long").alias("n_wins"),
                                     (F.avg("win") * 100.0).alias("win_pct"))


def conditional_mae(compared: DataFrame, condition: Column, by: Iterable[str] = ()) -> DataFrame:
    """Errors and win rate inside the hours where the condition holds."""
    inside = compared.where(F.coalesce(condition, F.lit(False)))
    return inside.groupBy(*by).agg(
        F.count("*").alias("n_hours"), F.avg("model_error").alias("model_mae"),
        F.avg("benchmark_error").alias("benchmark_mae"), (F.avg("win") * 100.0).alias("win_pct"))


def hourly_error_profile(compared: DataFrame, by: Iterable[str] = (), ts: str = "ts") -> DataFrame:
    """Mean errors by hour of day, their difference, and a mark on the most valuable hour.

    At most 24 rows per series, so the marking window is small.
    """
    by = list(by)
    hours = compared.groupBy(*by, F.hour(ts).alias("hour")).agg(
        F.avg("model_error").alias("model_mae"), F.avg("benchmark_error").alias("benchmark_mae"))
    hours = hours.withColumn("diff", F.col("benchmark_mae") - F.col("model_mae"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("diff"), "hour")
        return hours.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))
    best = hours.where("diff IS NOT NULL").agg(F.min_by("hour", F.struct((-F.col("diff")).alias("d"), "hour")).alias("_best"))
    return hours.withColumn("is_best", (F.col("hour") == best.scalar()).cast("int"))
