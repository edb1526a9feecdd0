"""Boosted regression trees for every series, and for every trial of a search, grown together.

Rows are binned once (edges from quantile sketches) and stored.  A level of a round is one job for all series and
trials: gradient sums by (key, node, feature, bin), running sums over the bins, the best split of each node.  No task
holds a series: rows are added up where they are read, and what is shuffled is bounded by nodes times bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chronolith.operators.stats import join_groups

#: What a trial sets; a trial may name some of them.  With `tau` it minimises the pinball loss of that level, else the
#: squared error.
DEFAULTS = {"step": 0.1, "depth": 3, "l2": 0.0, "min_rows": 1, "tau": None}
#: Relative rank error of the sketches that give a leaf its residual quantile.
LEAF_ACCURACY = 10_000
#: Gains below this are rounding.
LEAST_GAIN = 1e-6
#: Rounds after which the predictions so far are written instead of being worked out from the trees again.
REFRESH = 10

_SPLIT = "struct<feature:int,cut:int,left_value:double,right_value:double>"


def bin_edges(train: DataFrame, by: Iterable[str], xs: Iterable[str], y: str = "y", bins: int = 32, accuracy: int = 10_000,
              taus: Iterable[float] = ()) -> DataFrame:
    """(by, edges, mean, levels): for each feature the distinct values at ranks 1/bins, 2/bins, ..., the mean of y and its
    quantiles at `taus`."""
    ranks = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    none = F.array().cast("array<double>")
    edges = [F.coalesce(F.array_distinct(F.percentile_approx(F.col(f"`{x}`").cast("double"), ranks, accuracy)), none) for x in xs]
    target = F.col(f"`{y}`").cast("double")
    levels = [F.percentile_approx(target, F.lit(float(t)), accuracy) for t in taus]
    return train.where(target.isNotNull()).groupBy(*by).agg(F.array(*edges).alias("edges"), F.avg(target).alias("mean"),
                                                            F.array(*levels).cast("array<double>").alias("levels"))


def row_bins(xs: Iterable[str], edges: Column) -> Column:
    """Bin of each feature: how many edges lie below the value; a missing value is in bin 0."""
    def bin_of(k: int, x: str) -> Column:
        value = F.col(f"`{x}`").cast("double")
        return F.coalesce(F.size(F.filter(edges[k], lambda e: e < value)), F.lit(0))
    return F.array(*[bin_of(k, x) for k, x in enumerate(xs)])


def _at(tree: Column, bins: Column, levels: int) -> Column:
    """struct(node, value) where a row ends in a tree after `levels` splits; a tree without splits gives node 1, value 0."""
    def down(state, _):
        split = F.try_element_at(tree, state["node"])
        left = F.get(bins, split["feature"]) <= split["cut"]
        return F.when(split.isNull(), state).when(left, F.struct(
            (state["node"] * 2).alias("node"), split["left_value"].alias("value"))).otherwise(F.struct(
                (state["node"] * 2 + 1).alias("node"), split["right_value"].alias("value")))
    if levels == 0:
        return F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value")), down)


def trees_value(trees: Column, bins: Column, depth: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + _at(tree, bins, depth)["value"])


def best_splits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, feature, cut, left_value, right_value) out of (keys, node, feature, bin, g, n, step, l2, min_rows).

    The cut with the largest gain of squared error, smallest feature and bin among equals (gains to six decimals); nodes
    where no cut gains or leaves enough rows on both sides have no row.
    """
    ordered = Window.partitionBy(*keys, "node", "feature").orderBy("bin")
    whole = Window.partitionBy(*keys, "node", "feature")
    sums = hist.withColumns({"gl": F.sum("g").over(ordered), "nl": F.sum("n").over(ordered),
                             "gt": F.sum("g").over(whole), "nt": F.sum("n").over(whole)})
    gr, nr = F.col("gt") - F.col("gl"), F.col("nt") - F.col("nl")

    def score(g, n):
        return F.coalesce(F.try_divide(g * g, n + F.col("l2")), F.lit(0.0))

    def value(g, n):
        return F.col("step") * F.coalesce(F.try_divide(g, n + F.col("l2")), F.lit(0.0))

    gain = F.round(score(F.col("gl"), F.col("nl")) + score(gr, nr) - score(F.col("gt"), F.col("nt")), 6)
    cuts = (sums.where((F.col("nl") >= F.greatest("min_rows", F.lit(1))) & (nr >= F.greatest("min_rows", F.lit(1))))
            .select(*keys, "node", gain.alias("gain"), "feature", "bin", value(F.col("gl"), F.col("nl")).alias("lv"), value(gr, nr).alias("rv"))
            .where(F.col("gain") > LEAST_GAIN))
    best = cuts.groupBy(*keys, "node").agg(F.max_by(F.struct("feature", "bin", "lv", "rv"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b"))
    return best.select(*keys, "node", F.col("b.feature").alias("feature"), F.col("b.bin").alias("cut"),
                       F.col("b.lv").alias("left_value"), F.col("b.rv").alias("right_value"))


class Forest:
    """Trees of all keys in the making.  `store` writes a frame to the shared folder and reads it back."""

    def __init__(self, train: DataFrame, by: Iterable[str], xs: Iterable[str], y: str, trials: list[dict], bins: int,
                 store: Callable[[DataFrame], DataFrame], refresh: int = REFRESH):
        self.by, self.xs, self.store, self.refresh = list(by), list(xs), store, refresh
        self.keys = [*self.by, "trial"]
        self.depth = max(int({**DEFAULTS, **t}["depth"]) for t in trials)
        settings = [{**DEFAULTS, **t} for t in trials]
        self.taus = sorted({float(t["tau"]) for t in settings if t["tau"] is not None})
        rows = F.array(*[F.struct(F.lit(k).alias("trial"), F.lit(float(t["step"])).alias("step"), F.lit(int(t["depth"])).alias("depth"),
                                  F.lit(float(t["l2"])).alias("l2"), F.lit(int(t["min_rows"])).alias("min_rows"),
                                  F.lit(t["tau"]).cast("double").alias("tau"),
                                  F.lit(None if t["tau"] is None else self.taus.index(float(t["tau"]))).cast("int").alias("level"))
                         for k, t in enumerate(settings)])
        edges = store(bin_edges(train, self.by, self.xs, y, bins, taus=self.taus))
        base = F.when(F.col("tau").isNull(), F.col("mean")).otherwise(F.get("levels", F.col("level")))
        self.active = store(edges.select(*self.by, "edges", "mean", "levels", F.inline(rows))
                            .select(*self.by, "edges", base.alias("base"), "trial", "step", "depth", "l2", "min_rows", "tau", "level"))
        binned = join_groups(train.where(F.col(f"`{y}`").isNotNull()), edges, self.by)
        # Binned once for all trials, rounds and levels.
        self.rows = store(binned.select(*self.by, row_bins(self.xs, F.col("edges")).alias("_bins"),
                                        F.col(f"`{y}`").cast("double").alias("_y")))
        self.state = None  # rows by trial with the predictions as of the last refresh
        self.trees: list[DataFrame] = []  # long tables of splits, by round and level
        self.round = self.since = 0

    def _splits(self, begin: int = 0) -> DataFrame | None:
        parts = [t for t in self.trees]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("round") >= begin) if begin else out

    def _maps(self, splits: DataFrame) -> DataFrame:
        """(keys, round, tree): the splits of each tree by node."""
        entry = F.struct("node", F.struct("feature", "cut", "left_value", "right_value"))
        return splits.groupBy(*self.keys, "round").agg(F.map_from_entries(F.collect_list(entry)).alias("tree"))

    def model(self, begin: int = 0) -> DataFrame:
        """(keys, edges, base, step, depth, l2, min_rows, trees) for every active key."""
        splits = self._splits(begin)
        if splits is None:
            return self.active.withColumn("trees", F.array().cast(f"array<map<int,{_SPLIT}>>"))
        lists = self._maps(splits).groupBy(*self.keys).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("round", F.map_entries("tree").alias("e"))), lambda a, b: a["round"] - b["round"]),
            lambda x: F.map_from_entries(x["e"])).alias("trees"))
        none = F.array().cast(f"array<map<int,{_SPLIT}>>")
        return join_groups(self.active, lists, self.keys, "left").withColumn("trees", F.coalesce("trees", none))

    def _current(self) -> DataFrame:
        """Rows by trial with their predictions `_f` before this round.

        The trees are written before they meet the rows: the planner then knows their size, and the rows are not moved to
        them as long as it is small.
        """
        held = self.store(self.model(self.round - self.since))
        if self.state is None:
            joined = join_groups(self.rows, held, self.by)
            before = F.col("base")
        else:
            joined = join_groups(self.state, held, self.keys)
            before = F.col("_f")
        return joined.withColumn("_f", before + trees_value(F.col("trees"), F.col("_bins"), self.depth)).drop("trees", "edges", "base")

    def grow(self, rounds: int) -> None:
        """`rounds` more trees for every active key."""
        for _ in range(rounds):
            if self.since >= self.refresh:
                self.state = self.store(self._current().select(*self.keys, "_bins", "_y", "_f"))
                self.since = 0
            current = self._current()
            self.round += 1
            own: list[DataFrame] = []
            for level in range(self.depth):
                data = current.where(F.col("depth") > level)
                if own:
                    splits = own[0]
                    for p in own[1:]:
                        splits = splits.unionByName(p)
                    partial = self.store(self._maps(splits).drop("round"))
                    data = join_groups(data, partial, self.keys)
                    data = data.withColumn("node", _at(F.col("tree"), F.col("_bins"), level)["node"]).where(F.col("node") >= (1 << level))
                else:
                    data = data.withColumn("node", F.lit(1))
                residual = F.col("_y") - F.col("_f")
                slope = F.when(F.col("tau").isNull(), residual).otherwise(F.col("tau") - (residual <= 0).cast("double"))
                terms = data.select(*self.keys, "node", "step", "l2", "min_rows", slope.alias("_g"),
                                    F.posexplode("_bins").alias("feature", "bin"))
                hist = terms.groupBy(*self.keys, "node", "feature", "bin").agg(
                    F.sum("_g").alias("g"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("step", "l2", "min_rows")])
                made = self.store(best_splits(hist, self.keys).withColumn("round", F.lit(self.round - 1)))
                own.append(made)
            if self.taus:
                own = [self._renewed(current, own)]
            self.trees += own
            self.since += 1

    def _renewed(self, current: DataFrame, own: list[DataFrame]) -> DataFrame:
        """The splits of a round with the values of the leaves of pinball trials: residual quantiles, out of sketches."""
        splits = own[0]
        for p in own[1:]:
            splits = splits.unionByName(p)
        data = join_groups(current.where("tau IS NOT NULL"), self.store(self._maps(splits).drop("round")), self.keys)
        leaves = (data.withColumn("node", _at(F.col("tree"), F.col("_bins"), self.depth)["node"])
                  .groupBy(*self.keys, "node", "step", "level")
                  .agg(F.percentile_approx(F.col("_y") - F.col("_f"), F.array(*[F.lit(t) for t in self.taus]), LEAF_ACCURACY).alias("q"))
                  .select(*self.keys, F.col("node").alias("_leaf"), (F.col("step") * F.get("q", F.col("level"))).alias("_value")))
        leaves = self.store(leaves)
        out = splits
        for side, column in ((0, "left_value"), (1, "right_value")):
            out = join_groups(out.withColumn("_leaf", F.col("node") * 2 + side), leaves, [*self.keys, "_leaf"], "left")
            out = out.withColumn(column, F.coalesce("_value", column)).drop("_leaf", "_value")
        return self.store(out)

    def keep(self, chosen: DataFrame) -> None:
        """Goes on with these keys only."""
        self.active = self.store(self.active.join(chosen.select(*self.keys).distinct(), self.keys, "left_semi"))


def predict_boosted(df: DataFrame, model: DataFrame, by: Iterable[str], xs: Iterable[str], depth: int | None = None) -> DataFrame:
    """Adds y_pred (and trial, where the model holds several); a series without a model gets NULL.

    `depth` is the largest depth of the model's trees (read from its rows if not given).
    """
    by = list(by)
    if depth is None:
        depth = int(model.agg(F.max("depth")).first()[0] or 0)
    held = model.select(*by, "trial", "edges", "base", "trees")
    joined = join_groups(df, held, by, "left")
    return joined.withColumn("y_pred", F.col("base") + trees_value(
        F.col("trees"), row_bins(xs, F.col("edges")), depth)).drop("edges", "base", "trees")


def fit_boosted_panel(train: DataFrame, by: Iterable[str], xs: Iterable[str], store: Callable[[DataFrame], DataFrame], y: str = "y",
                      rounds: int = 100, bins: int = 32, refresh: int = REFRESH, **settings) -> DataFrame:
    """(by, trial, edges, base, ..., trees): one boosted model for each series; settings as in DEFAULTS.

    Rows without a target are left out; a missing feature goes to the left; a constant feature never splits; a series of one
    value keeps its mean.
    """
    forest = Forest(train, by, xs, y, [settings], bins, store, refresh)
    forest.grow(rounds)
    return store(forest.model())


def halving_search(train: DataFrame, val: DataFrame, by: Iterable[str], xs: Iterable[str], trials: list[dict], rungs: Iterable[int],
                   store: Callable[[DataFrame], DataFrame], y: str = "y", bins: int = 32) -> tuple[DataFrame, DataFrame]:
    """(scores, champions): successive halving of the trials, for each series on its own.

    A trial is one more grouping key, so a rung is the same jobs however many trials there are.  A rung grows all trials
    left to its number of trees and scores them on `val`; the better half (rounded up) goes on, earliest trial among
    equals.  scores: (by, trial, rung, rounds, mae); champions: (by, trial, rounds, mae) after the last rung.
    """
    by, xs, rungs = list(by), list(xs), list(rungs)
    forest = Forest(train, by, xs, y, trials, bins, store)
    scores = None
    for k, rounds in enumerate(rungs):
        forest.grow(rounds - forest.round)
        scored = predict_boosted(val, forest.model(), by, xs, forest.depth).where(F.col("trial").isNotNull())
        mae = store(scored.groupBy(*by, "trial").agg(F.avg(F.abs(F.col(y) - F.col("y_pred"))).alias("mae"))
                    .select(*by, "trial", F.lit(k).alias("rung"), F.lit(rounds).alias("rounds"), "mae"))
        scores = mae if scores is None else scores.unionByName(mae)
        place = Window.partitionBy(*by).orderBy(F.round("mae", 9), "trial")
        ranked = mae.withColumns({"_place": F.row_number().over(place), "_all": F.count("*").over(Window.partitionBy(*by))})
        last = k == len(rungs) - 1
        chosen = ranked.where(F.col("_place") == 1 if last else F.col("_place") * 2 <= F.col("_all") + 1)
        if last:
            return scores, chosen.select(*by, "trial", "rounds", "mae")
        forest.keep(chosen)
    raise ValueError("a search needs at least one rung")


def refit_champions(train: DataFrame, champions: DataFrame, by: Iterable[str], xs: Iterable[str], trials: list[dict], rounds: int,
                    store: Callable[[DataFrame], DataFrame], y: str = "y", bins: int = 32) -> DataFrame:
    """Each series' winning trial, fitted again on all rows of `train` with `rounds` trees."""
    forest = Forest(train, by, xs, y, trials, bins, store)
    forest.keep(champions)
    forest.grow(rounds)
    return store(forest.model())


def fit_quantile_panel(train: DataFrame, by: Iterable[str], xs: Iterable[str], store: Callable[[DataFrame], DataFrame], y: str = "y",
                       taus: Iterable[float] = (0.05, 0.5, 0.95), rounds: int = 100, bins: int = 32, **settings) -> DataFrame:
    """One boosted model for each series and level, all grown together; trial k is the k-th level in ascending order.

    Splits follow the slope of the pinball loss, a leaf's value is the residual quantile of its rows.
    """
    forest = Forest(train, by, xs, y, [{**settings, "tau": t} for t in sorted(taus)], bins, store)
    forest.grow(rounds)
    return store(forest.model())


def predict_quantiles(df: DataFrame, model: DataFrame, keys: Iterable[str], by: Iterable[str], xs: Iterable[str],
                      taus: Iterable[float] = (0.05, 0.5, 0.95), depth: int | None = None) -> DataFrame:
    """(keys, q05, q50, ...): the levels of each row in ascending order, so that they cannot cross.  `keys` name a row.

    The models of a series come as one list, so a row is met once for all levels; a series without models has NULLs.
    """
    taus, by = sorted(taus), list(by)
    if depth is None:
        depth = int(model.agg(F.max("depth")).first()[0] or 0)
    lists = model.groupBy(*by).agg(F.first("edges").alias("edges"), F.transform(
        F.sort_array(F.collect_list(F.struct("trial", "base", F.transform("trees", F.map_entries).alias("trees")))), lambda m: m).alias("models"))
    joined = join_groups(df, lists, by, "left").withColumn("_bins", row_bins(xs, F.col("edges")))
    values = F.array_sort(F.transform("models", lambda m: m["base"] + trees_value(
        F.transform(m["trees"], F.map_from_entries), F.col("_bins"), depth)))
    return joined.withColumn("_q", values).select(*keys, *[F.get("_q", F.lit(k)).alias(f"q{round(t * 100):02d}") for k, t in enumerate(taus)])


def save_boosted(model: DataFrame, path: str) -> None:
    """A model is a table: one row for each series."""
    model.write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
