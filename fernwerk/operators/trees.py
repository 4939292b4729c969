"""Decision stumps, trees and forests grown level by level from sums over ranges of values; boosting on weighted rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..sources.scratch import forget, stored
from .base import Fitted, Learner
from .cuts import Criterion, CutSearch, Drawn, Tree, quantile_edges

#: Ranges of each feature in which rows are summed up first, rows that say where they are cut, and rounds of boosting after which rows are written with their weights.
RANGES, SAMPLE, KEEP = 64, 50_000, 8
#: Distinct labels that are counted where two are needed.
MOST_NAMED = 1000


def xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))


def set_entropy(df: DataFrame, label: str = "label") -> DataFrame:
    """Entropy (natural log) of the label counts."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(whole), F.lit(True)).agg((-F.sum(xlogx(F.col("n") / F.col("t")))).alias("entropy"))


def information_gain(pl: Column, nl: Column, pt: Column, nt: Column) -> Column:
    """Less the entropies of both sides, weighted by their rows."""
    side = lambda p, n: -(n / nt) * -(xlogx(p / n) + xlogx((n - p) / n))
    return side(pl, nl) + side(pt - pl, nt - nl)


def neg_z1_loss(pl: Column, nl: Column, pt: Column, nt: Column) -> Column:
    """Less the weight that is wrong if each side predicts its majority."""
    return -(F.least(pl, nl - pl) + F.least(pt - pl, nt - nl - pt + pl))


def table_of(df: DataFrame, features: str = "features", y: str = "y", w: str | None = None, id: str | None = None) -> DataFrame:
    """What CutSearch reads: rows without features take no part."""
    key = F.xxhash64(F.col(id), doubles(features)) if id else F.lit(0).cast("long")
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return df.select(doubles(features).alias("x"), F.col(y).cast("double").alias("y"), weight.alias("w"), key.alias("key")).filter("x is not null and y is not null and w > 0")


def splits(df: DataFrame, criterion: Criterion, features: str = "features", y: str = "y", w: str | None = None, ranges: int = RANGES) -> DataFrame:
    """(feature, cutoff, gain, pl, nl, pt, nt) for every split x < cutoff that leaves rows on both sides: sums over ranges first, then over the values of each range."""
    return CutSearch(table_of(df, features, y, w), quantile_edges(df, features, ranges, sample=SAMPLE), criterion).every()


class Split:
    """A node: rows with feature value below the cutoff go left."""

    def __init__(self, feature: int, cutoff: float, left, right):
        self.feature, self.cutoff, self.left, self.right = feature, cutoff, left, right

    def value(self, v: Column) -> Column:
        side = lambda n: n.value(v) if isinstance(n, Split) else F.lit(float(n))
        return F.when(v[self.feature] < F.lit(self.cutoff), side(self.left)).otherwise(side(self.right))

    def __repr__(self) -> str:
        return f"Split({self.feature}, {self.cutoff}, {self.left}, {self.right})"


def tree_value(root, v: Column) -> Column:
    return root.value(v) if isinstance(root, Split) else F.lit(float(root))


def grow(search: CutSearch, trees: int = 1, min_split: int = 4, max_depth: int = 30, subsample: int | None = None, seed: int = 0) -> list[Split | float]:
    """The roots of so many trees, grown level by level, all trees' nodes of a level at once; no row is copied or moved for it.

    Tasks find each row's node in every tree themselves, so the rows stay as they are. What reaches the driver is a cut for each node of
    at least min_split rows. Pure nodes are leaves: to split them would change no prediction.
    """
    growing, width = [Tree() for _ in range(trees)], len(search.edges)
    sums = {(t, 0): v for t, v in search.totals(growing).items()}
    level = list(sums)
    for _ in range(max_depth):
        mixed = [(t, k) for t, k in level if sums[t, k][2] >= min_split and 1e-12 < sums[t, k][0] / sums[t, k][1] < 1 - 1e-12]
        random = lambda t, k: np.sort(np.random.default_rng((seed, t, k)).permutation(width)[:subsample])  # noqa: E731  all without subsample
        level = []
        for r in search.best(growing, [(t, k, random(t, k) if subsample else np.arange(width)) for t, k in mixed]) if mixed else []:
            left, right = growing[r["tree"]].cut(r["node"], r["feature"], r["cutoff"])
            sums[r["tree"], left] = (r["pl"], r["nl"], r["cl"])
            sums[r["tree"], right] = (r["pt"] - r["pl"], r["nt"] - r["nl"], r["ct"] - r["cl"])
            level += [(r["tree"], left), (r["tree"], right)]
        if not level:
            break

    def build(t: int, k: int) -> Split | float:
        tree = growing[t]
        if tree.feature[k] < 0:
            p, n, _ = sums.get((t, k), (0.0, 1.0, 0))
            return p / n if n else 0.0
        return Split(tree.feature[k], tree.cutoff[k], build(t, tree.left[k]), build(t, tree.right[k]))

    return [build(t, 0) for t in range(trees)]


def two_names(df: DataFrame, label: str) -> tuple[DataFrame, list]:
    """df with y, 1.0 for the second of two labels in order; the labels. Rows stay where they are: to join them by label would put each class into one task."""
    found = F.col(label)
    names = [r[0] for r in df.select(found.alias("name")).filter("name is not null").distinct().limit(MOST_NAMED).orderBy("name").collect()]
    if len(names) > 2:
        raise ValueError(f"two classes are needed, not {len(names)}{' or more' if len(names) == MOST_NAMED else ''}")
    of = df.schema[label].dataType
    return df.withColumn("y", F.coalesce(*(F.when(found == F.lit(n).cast(of), float(k)) for k, n in enumerate(names)), F.lit(None).cast("double"))), names


class TreeLearner(Learner):
    """A binary decision tree by greedy splits x < cutoff, at any value; with bins at that many quantiles only. ranges: of each feature, in which rows are summed up first."""

    def __init__(self, criterion: Criterion = information_gain, min_split: int = 4, return_label: bool = True, subsample: int | None = None, seed: int = 0, weight: str | None = None, max_depth: int = 30, bins: int | None = None, ranges: int = RANGES, edges=None, **columns):
        super().__init__(**columns, criterion=criterion, min_split=min_split, return_label=return_label, subsample=subsample, seed=seed, weight=weight, max_depth=max_depth, bins=bins, ranges=ranges, edges=edges)

    def _fit(self, dataset: DataFrame) -> TreeModel:
        data, names = two_names(dataset, self.label)
        table = table_of(data, self.features, "y", self.weight).persist()
        try:
            search = CutSearch(table, self.edges or quantile_edges(table, "x", self.bins or self.ranges, sample=None if self.bins else SAMPLE), self.criterion, binned=bool(self.bins))
            (root,) = grow(search, 1, self.min_split, self.max_depth, self.subsample, self.seed)
        finally:
            table.unpersist()
        return TreeModel(**self._columns(), roots=[root], names=names, return_label=self.return_label, forest=False)


class TreeModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = doubles(self.features)
        if self.forest:
            votes = [F.when(tree_value(r, v) > 0.5, 1.0).otherwise(0.0) for r in self.roots]
            value = sum(votes[1:], votes[0]) / len(votes)
            yes = sum(votes[1:], votes[0]) > len(votes) // 2
        else:
            value = tree_value(self.roots[0], v)
            yes = value > 0.5
        if not self.return_label:
            return dataset.withColumn(self.prediction, value)
        first, last = (F.lit(n) for n in (self.names[0], self.names[-1]))
        return dataset.withColumn(self.prediction, F.when(yes, last).otherwise(first))


class ForestLearner(Learner):
    """rf trees, each on bootstrap counts of the rows (Poisson of mean frac, what draws with replacement tend to), by majority.

    A row's count in a tree follows from its id and features, so no row is copied for a tree; rows equal in both have equal counts.
    """

    def __init__(self, rf: int = 101, frac: float = 0.7, seed: int = 0, return_label: bool = True, min_split: int = 4, subsample: int | None = None, max_depth: int = 12, bins: int | None = 64, ranges: int = RANGES, **columns):
        super().__init__(**columns, rf=rf, frac=frac, seed=seed, return_label=return_label, min_split=min_split, subsample=subsample, max_depth=max_depth, bins=bins, ranges=ranges)

    def _fit(self, dataset: DataFrame) -> TreeModel:
        data, names = two_names(dataset, self.label)
        table = table_of(data, self.features, "y", id=self.id).persist()
        try:
            search = CutSearch(table, quantile_edges(table, "x", self.bins or self.ranges), information_gain, bool(self.bins), Drawn(self.frac, self.seed))
            roots = grow(search, self.rf, self.min_split, self.max_depth, self.subsample, self.seed)
        finally:
            table.unpersist()
        return TreeModel(**self._columns(), roots=roots, names=names, return_label=self.return_label, forest=True)


class StumpLearner(Learner):
    """The single split that gets least weight wrong, in the direction that does. compat: predicts x > cutoff as it comes."""

    def __init__(self, weight: str | None = None, compat: bool = False, ranges: int = RANGES, edges=None, **columns):
        super().__init__(**columns, weight=weight, compat=compat, ranges=ranges, edges=edges)

    def _fit(self, dataset: DataFrame) -> StumpModel:
        data, names = two_names(dataset, self.label)
        table = table_of(data, self.features, "y", self.weight)
        edges = self.edges or quantile_edges(table, "x", self.ranges, sample=SAMPLE)
        found = CutSearch(table, edges, neg_z1_loss).best([Tree()], [(0, 0, np.arange(len(edges)))])
        if not found:
            p, n, _ = CutSearch(table, edges, neg_z1_loss).totals([Tree()]).get(0, (0.0, 0.0, 0))
            return StumpModel(**self._columns(), feature=0, cutoff=float("-inf"), names=names, flipped=2 * p <= n, compat=False)
        s = found[0]
        right = (s["pt"] - s["pl"]) / (s["nt"] - s["nl"])
        flipped = right < s["pl"] / s["nl"] and not self.compat
        return StumpModel(**self._columns(), feature=s["feature"], cutoff=s["cutoff"], names=names, flipped=flipped, compat=self.compat)


class StumpModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = doubles(self.features)[self.feature]
        yes = x > F.lit(self.cutoff) if self.compat else x >= F.lit(self.cutoff)
        first, last = (F.lit(n) for n in (self.names[0], self.names[-1]))
        return dataset.withColumn(self.prediction, F.when(yes != F.lit(self.flipped), last).otherwise(first))


class Weighing:
    """Rows whose weight __d changes from round to round: an expression over a cached table, which every KEEP rounds is written anew with its weights, so that neither plan nor lineage grows with the rounds."""

    def __init__(self, data: DataFrame, base: Learner, **columns):
        self.root = data.persist()
        n = self.root.count()
        self.now, self.rounds, self.kept = self.root.withColumn("__d", F.lit(1.0 / max(n, 1))), 0, None
        self.learner = base.with_options(weight="__d", prediction="__h", **columns)
        if n and hasattr(base, "edges") and not base.edges:  # values don't change, so their ranges are cut once
            bins = getattr(base, "bins", None)
            self.learner.edges = quantile_edges(self.root, columns["features"], bins or base.ranges, sample=None if bins else SAMPLE)

    def fit(self, label: str) -> tuple:
        """(model, the rows with its prediction __h and whether it is wrong, summed weight of the wrong ones, summed weight)."""
        model = self.learner.fit(self.now)
        scored = model.transform(self.now).withColumn("__wrong", F.col("__h") != F.col(label))
        wrong, whole = scored.agg(F.coalesce(F.sum(F.when(F.col("__wrong"), F.col("__d"))), F.lit(0.0)), F.sum("__d")).first()
        return model, scored, wrong, whole

    def weigh(self, scored: DataFrame, right: float, wrong: float) -> None:
        """Factors of the weights of right and wrong rows."""
        self.now = scored.withColumn("__d", F.col("__d") * F.when(F.col("__wrong"), F.lit(wrong)).otherwise(F.lit(right))).drop("__h", "__wrong")
        self.rounds += 1
        if self.rounds % KEEP == 0:
            before, self.now = self.kept, stored(self.now, "weights")
            self.kept = self.now
            (forget(before) if before is not None else self.root.unpersist())

    def close(self) -> None:
        self.root.unpersist()
        if self.kept is not None:
            forget(self.kept)


class BoostLearner(Learner):
    """AdaBoost: rounds of a weighted base learner; coefficient ln((1 - E) / E) / 2, by compat that of the older formula."""

    def __init__(self, base: Learner, max_iters: int = 100, compat: bool = False, **columns):
        super().__init__(**columns, base=base, max_iters=max_iters, compat=compat)

    def _fit(self, dataset: DataFrame) -> BoostModel:
        data, names = two_names(dataset, self.label)
        weighing = Weighing(data.select(*dataset.columns), self.base, label=self.label, features=self.features, id=self.id)
        models, coefs = [], []
        for _ in range(self.max_iters):
            model, scored, wrong, whole = weighing.fit(self.label)
            e = wrong / whole
            if e > 0.5:
                break
            bounded = min(max(e, 1e-10), 1 - 1e-10)
            a = 0.5 * math.log((1 + e) / (1 - bounded)) if self.compat else 0.5 * math.log((1 - bounded) / bounded)
            models.append(model)
            coefs.append(a)
            if e < 1e-10:
                break
            whole = wrong * math.exp(a) + (whole - wrong) * math.exp(-a)
            weighing.weigh(scored, math.exp(-a) / whole, math.exp(a) / whole)
        weighing.close()
        return BoostModel(**self._columns(), models=models, coefs=coefs, names=names)


class BoostModel(Fitted):
    """The second label where the models' weighted share of votes for it is over a half."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, votes = dataset, F.lit(0.0)
        for k, (m, a) in enumerate(zip(self.models, self.coefs, strict=True)):
            m = m.copy()
            m.prediction = f"__h{k}"
            out = m.transform(out)
            votes = votes + F.when(F.col(f"__h{k}") == F.lit(self.names[-1]), F.lit(a)).otherwise(0.0)
        yes = votes > F.lit(sum(self.coefs) / 2)
        out = out.withColumn(self.prediction, F.when(yes, F.lit(self.names[-1])).otherwise(F.lit(self.names[0])))
        return out.drop(*(f"__h{k}" for k in range(len(self.models))))


class WeightedVotingBoost(Learner):
    """Rounds in which only wrong rows gain weight, by exp of the model's coefficient; any number of labels; labels get their models' coefficients."""

    def __init__(self, base: Learner, size: int = 10, **columns):
        super().__init__(**columns, base=base, size=size)

    def _fit(self, dataset: DataFrame) -> WeightedVotingModel:
        weighing = Weighing(dataset, self.base, label=self.label, features=self.features, id=self.id)
        models, coefs = [], []
        for _ in range(self.size):
            model, scored, wrong, whole = weighing.fit(self.label)
            e = wrong / whole
            models.append(model)
            if abs(e) < 1e-6:
                coefs.append(1.0)
                break
            a = 0.5 * math.log((1 - e) / e) if e < 1 else -10.0
            coefs.append(a)
            whole = wrong * math.exp(a) + whole - wrong
            weighing.weigh(scored, 1 / whole, math.exp(a) / whole)
        weighing.close()
        return WeightedVotingModel(**self._columns(), models=models, coefs=coefs)


class WeightedVotingModel(Fitted):
    """The label of greatest summed coefficient, of equals the lowest."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for k, m in enumerate(self.models):
            m = m.copy()
            m.prediction = f"__h{k}"
            out = m.transform(out)
        votes = F.array(*(F.struct(F.col(f"__h{k}").alias("l"), F.lit(a).alias("a")) for k, a in enumerate(self.coefs)))
        sums = F.transform(votes, lambda v: F.struct((-F.aggregate(F.filter(votes, lambda u: u["l"] == v["l"]), F.lit(0.0), lambda s, u: s + u["a"])).alias("s"), v["l"].alias("l")))
        return out.withColumn(self.prediction, F.array_min(sums)["l"]).drop(*(f"__h{k}" for k in range(len(self.models))))
