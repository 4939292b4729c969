"""The best cut of each node of growing trees: tasks sum rows up by ranges of values, and only ranges that can hold the best cut are opened."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from .blocks import matrix_of

#: Of positives and rows left of a cut, and in all, what a split is worth. Convex in the first two, so that between two prefixes none is worth more than the best of the corners.
Criterion = Callable[[Column, Column, Column, Column], Column]
#: (node, feature, range) cells that one job sums up; more nodes go in several jobs.
CELLS = 1_000_000
#: Distinct values that a task holds before it adds them up.
HELD = 500_000
#: Up to so many (feature, range) the second pass filters rows before tasks see them.
FILTERED = 64
KEYS = ["tree", "node", "feature"]


@dataclass
class Tree:
    """Nodes by number, the root 0: rows with the feature below the cutoff go left. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cutoff: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])

    def cut(self, node: int, feature: int, cutoff: float) -> tuple[int, int]:
        """The numbers of the node's new children."""
        self.feature[node], self.cutoff[node], n = feature, cutoff, len(self.feature)
        self.left[node], self.right[node] = n, n + 1
        for column, value in ((self.feature, -1), (self.cutoff, 0.0), (self.left, -1), (self.right, -1)):
            column += [value, value]
        return n, n + 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row is in so far."""
        feature, cutoff, left, right = (np.array(v) for v in (self.feature, self.cutoff, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            below = x[rows, np.maximum(feature[at], 0)] < cutoff[at]
            at = np.where(inner, np.where(below, left[at], right[at]), at)
        return at


def own_weight(w: np.ndarray, key: np.ndarray, tree: int) -> np.ndarray:
    return w


@dataclass
class Drawn:
    """Bootstrap counts of a tree's rows: Poisson of mean `frac`, which draws with replacement tend to, from a hash of the row and the tree."""

    frac: float
    seed: int

    def __call__(self, w: np.ndarray, key: np.ndarray, tree: int) -> np.ndarray:
        z = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + (self.seed << 20))) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
        terms = np.exp(-self.frac) * np.cumprod([1.0, *(self.frac / k for k in range(1, 30))])
        return w * np.searchsorted(np.cumsum(terms), u, side="right")


def quantile_edges(df: DataFrame, features: str, ranges: int, error: float = 0.005, sample: int | None = None) -> list[np.ndarray]:
    """Cuts of each feature that leave about as many rows in every range. sample: of about so many rows, enough where any cuts give the same result."""
    from .preprocess import width

    n = width(df, features)
    if sample:
        rows = df.count()
        df = df.sample(sample / rows, seed=0) if rows > sample else df
    wide = df.select(*(doubles(features)[k].alias(f"c{k}") for k in range(n)))
    return [np.unique(e) for e in wide.approxQuantile([f"c{k}" for k in range(n)], [q / ranges for q in range(ranges)], error)]


class CutSearch:
    """Rows (x: features, y: 0 or 1, w, key: long), the ranges of their values, and how rows weigh in a tree.

    binned: cuts are looked for at edges of ranges only. Else every value is a cut: the first pass sums rows up by (node, feature, range); with it no
    range can hold a better cut than its best corner, all its positives or all its others first; the second pass sums up the values of those ranges
    that can beat the best edge. What is sorted is the values of a range, never all values of a feature.
    """

    def __init__(self, data: DataFrame, edges: Sequence[np.ndarray], criterion: Criterion, binned: bool = False, weigh=own_weight):
        self.data, self.edges, self.criterion, self.binned, self.weigh = data.select("x", "y", "w", "key"), edges, criterion, binned, weigh
        self.ranges = max((len(e) for e in edges), default=0) + 1

    def _each(self, trees: Sequence[Tree], chosen: Sequence[int]) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        """Of a batch, for each tree: (number, x, each cell's range, leaves, weights, y) of its rows that weigh anything."""
        shared = self.data.sparkSession.sparkContext.broadcast((list(trees), list(self.edges)))
        weigh = self.weigh

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            trees, edges = shared.value
            x = matrix_of(batch.column("x"))
            y, w, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "key"))
            at = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)
            for t in chosen:
                mine = weigh(w, key, t)
                rows = np.flatnonzero(mine > 0)
                yield t, x[rows], at[rows], trees[t].nodes(x[rows]), mine[rows], y[rows]

        return each

    def totals(self, trees: Sequence[Tree]) -> dict[int, tuple[float, float, int]]:
        """By tree: the weight of positives, of all rows, and how many weigh anything."""
        each = self._each(trees, range(len(trees)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(trees), 3))
            for batch in batches:
                for t, _, _, _, w, y in each(batch):
                    sums[t] += [(w * y).sum(), w.sum(), len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()), *(pa.array(v) for v in sums.T)], names=["tree", "p", "n", "c"])

        got = self.data.mapInArrow(work, "tree int, p double, n double, c double").groupBy("tree").agg(*(F.sum(c).alias(c) for c in "pnc")).collect()
        return {r["tree"]: (r["p"], r["n"], int(r["c"])) for r in got}

    def range_sums(self, trees: Sequence[Tree], nodes: Sequence[tuple[int, int, np.ndarray]]) -> DataFrame:
        """(tree, node, feature, r, p, n, c) of nodes (tree, node, features to try), from one pass in which every task sends its sums."""
        width, ranges = max(len(f) for _, _, f in nodes), self.ranges
        place = numbered(trees, [n[:2] for n in nodes])
        tried = np.array([np.pad(f, (0, width - len(f)), constant_values=-1) for _, _, f in nodes])
        each = self._each(trees, sorted(place))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(nodes) * width * ranges))
            for batch in batches:
                for t, _, at, leaf, w, y in each(batch):
                    k = place[t][leaf]
                    rows = np.flatnonzero(k >= 0)
                    if not len(rows):
                        continue
                    k = k[rows]
                    cell = np.take_along_axis(at[rows], np.maximum(tried[k], 0), axis=1) + (k[:, None] * width + np.arange(width)) * ranges
                    real = (tried[k] >= 0).ravel()
                    cell = cell.ravel()[real]
                    for i, v in enumerate((w[rows] * y[rows], w[rows], np.ones(len(rows)))):
                        sums[i] += np.bincount(cell, np.repeat(v, width)[real], minlength=sums.shape[1])
            full = np.flatnonzero(sums[2])
            k, f, r = full // (width * ranges), full // ranges % width, full % ranges
            keys = [np.array([n[0] for n in nodes])[k], np.array([n[1] for n in nodes])[k], tried[k, f], r]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in keys), *(pa.array(v[full]) for v in sums)], names=[*KEYS, "r", "p", "n", "c"])

        found = self.data.mapInArrow(work, "tree int, node int, feature int, r int, p double, n double, c double")
        return found.groupBy(*KEYS, "r").agg(*(F.sum(c).alias(c) for c in "pnc"))

    def value_sums(self, trees: Sequence[Tree], wanted: Sequence[tuple[int, int, int, int]]) -> DataFrame:
        """(tree, node, feature, r, x, p, n, c) for each value in the wanted (tree, node, feature, range), added up in the tasks first."""
        ranges, width = self.ranges, len(self.edges)
        open_nodes = sorted({w[:2] for w in wanted})
        place = numbered(trees, open_nodes)
        number = {n: k for k, n in enumerate(open_nodes)}
        mask = np.zeros((len(open_nodes), width, ranges), bool)
        for t, node, f, r in wanted:
            mask[number[t, node], f, r] = True
        each = self._each(trees, sorted(place))
        names = np.array(open_nodes)

        def add(parts: list[np.ndarray]) -> np.ndarray:
            """Rows (cell, x, p, n, c) with one for each cell and value."""
            whole = np.concatenate(parts, axis=1)
            whole = whole[:, np.lexsort((whole[1], whole[0]))]
            first = np.ones(whole.shape[1], bool)
            first[1:] = (whole[0, 1:] != whole[0, :-1]) | (whole[1, 1:] != whole[1, :-1])
            starts = np.flatnonzero(first)
            return np.concatenate([whole[:2, starts], np.add.reduceat(whole[2:], starts, axis=1)]) if len(starts) else whole

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [np.zeros((5, 0))], 0
            for batch in batches:
                for t, x, at, leaf, w, y in each(batch):
                    k = place[t][leaf]
                    rows = np.flatnonzero(k >= 0)
                    i, f = np.nonzero(mask[k[rows][:, None], np.arange(width), at[rows]])
                    i = rows[i]
                    cell = (k[i] * width + f) * ranges + at[i, f]
                    known = ~np.isnan(x[i, f])
                    held.append(add([np.stack([cell, x[i, f], w[i] * y[i], w[i], np.ones(len(i))])[:, known]]))
                    n += held[-1].shape[1]
                    if n > HELD:
                        held = [add(held)]
                        n = held[0].shape[1] // 2  # so that values that are many are not added up with each batch
            whole = add(held)
            cell = whole[0].astype(np.int64)
            keys = [*names[cell // (width * ranges)].T, cell // ranges % width, cell % ranges]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in keys), *(pa.array(v) for v in whole[1:])], names=[*KEYS, "r", "x", "p", "n", "c"])

        data, spans = self.data, {(f, r) for _, _, f, r in wanted}
        if len(spans) <= FILTERED:  # rows outside all wanted ranges needn't leave the JVM
            inside = F.lit(False)
            for f, r in sorted(spans):
                x, edges = F.col("x")[f], self.edges[f]
                inside = inside | ((x >= float(edges[r - 1]) if r else F.lit(True)) & (x < float(edges[r]) if r < len(edges) else F.lit(True)))
            data = data.filter(inside)
        found = data.mapInArrow(work, "tree int, node int, feature int, r int, x double, p double, n double, c double")
        return found.groupBy(*KEYS, "r", "x").agg(*(F.sum(c).alias(c) for c in "pnc"))

    def _ranged(self, trees: Sequence[Tree], nodes: Sequence[tuple[int, int, np.ndarray]]) -> DataFrame:
        """The range sums with what is left of each range and in all, and what the cut at its lower edge is worth. A window has a feature's ranges, a few dozen rows."""
        every = Window.partitionBy(*KEYS)
        before = every.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        run = self.range_sums(trees, nodes)
        run = run.select(*KEYS, "r", "p", "n", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}l") for c in "pnc"), *(F.sum(c).over(every).alias(f"{c}t") for c in "pnc"))
        pl, nl, pt, nt = (F.col(c) for c in ("pl", "nl", "pt", "nt"))
        return run.withColumn("gain", F.when((nl > 0) & (nl < nt), self.criterion(pl, nl, pt, nt)))

    def _valued(self, trees: Sequence[Tree], ranges: DataFrame, wanted: Sequence[tuple[int, int, int, int]]) -> DataFrame:
        """Every cut at a value of the wanted ranges; ranges are their sums left of them and in all."""
        own = Window.partitionBy(*KEYS, "r")
        before = own.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        values = self.value_sums(trees, wanted).join(F.broadcast(ranges), [*KEYS, "r"])
        left = [(F.col(f"{c}l") + F.coalesce(F.sum(c).over(before), F.lit(0.0))).alias(f"{c}l") for c in "pnc"]
        cuts = values.select(*KEYS, F.col("x").alias("cutoff"), *left, "pt", "nt", "ct").filter((F.col("nl") > 0) & (F.col("nl") < F.col("nt")))
        return cuts.withColumn("gain", self.criterion(F.col("pl"), F.col("nl"), F.col("pt"), F.col("nt")))

    def best(self, trees: Sequence[Tree], nodes: Sequence[tuple[int, int, np.ndarray]]) -> list:
        """Rows (tree, node, feature, cutoff, gain, pl, nl, cl, pt, nt, ct): the cut of highest gain of each node, of equals that of the lowest feature and cutoff."""
        out, width = [], max((len(f) for _, _, f in nodes), default=1)
        step = max(1, CELLS // (width * self.ranges))
        for at in range(0, len(nodes), step):
            out += self._best(trees, nodes[at : at + step])
        return out

    def _best(self, trees: Sequence[Tree], nodes: Sequence[tuple[int, int, np.ndarray]]) -> list:
        spark = self.data.sparkSession
        run = self._ranged(trees, nodes)
        if self.binned:
            edges = [(f, r + 1, float(c)) for f, e in enumerate(self.edges) for r, c in enumerate(e)]
            cuts = run.filter("gain is not null").join(F.broadcast(spark.createDataFrame(edges, "feature int, r int, cutoff double")), ["feature", "r"])
            return highest(cuts).collect()
        inside = [(F.col("pl") + a, F.col("nl") + b) for a, b in ((0, 0), (F.col("p"), F.col("p")), (0, F.col("n") - F.col("p")), (F.col("p"), F.col("n")))]
        nt = F.col("nt")
        corner = lambda p, n: self.criterion(p, F.greatest(F.least(n, nt * (1 - 1e-12)), nt * 1e-12), F.col("pt"), nt)  # noqa: E731  no side of no rows
        found = run.withColumn("most", F.greatest(*(corner(p, n) for p, n in inside))).toPandas()
        top = found.groupby(["tree", "node"])["gain"].transform("max").fillna(-np.inf)
        kept = found[(found["most"] >= top - 1e-11)]
        if not len(kept):
            return []
        wanted = list(kept[[*KEYS, "r"]].itertuples(index=False, name=None))
        ranges = spark.createDataFrame(kept[[*KEYS, "r", "pl", "nl", "cl", "pt", "nt", "ct"]], "tree int, node int, feature int, r int, pl double, nl double, cl double, pt double, nt double, ct double")
        return highest(self._valued(trees, ranges, wanted)).collect()

    def every(self) -> DataFrame:
        """(feature, cutoff, gain, pl, nl, pt, nt): all cuts of all rows."""
        trees = [Tree()]
        nodes = [(0, 0, np.arange(len(self.edges)))]
        run = self._ranged(trees, nodes)
        wanted = [(0, 0, f, r) for f in range(len(self.edges)) for r in range(self.ranges)]
        return self._valued(trees, run.drop("p", "n", "gain"), wanted).select("feature", "cutoff", "gain", "pl", "nl", "pt", "nt")


def numbered(trees: Sequence[Tree], nodes: Sequence[tuple[int, int]]) -> dict[int, np.ndarray]:
    """By tree, for each of its nodes the place among the (tree, node) given, or -1."""
    place = {t: np.full(len(trees[t].feature), -1) for t, _ in nodes}
    for k, (t, node) in enumerate(nodes):
        place[t][node] = k
    return place


def highest(cuts: DataFrame) -> DataFrame:
    """The cut of highest gain (to 12 digits) of each node; of equals the lowest feature and cutoff."""
    keep = F.struct("feature", "cutoff", "gain", "pl", "nl", "cl", "pt", "nt", "ct")
    return cuts.groupBy("tree", "node").agg(F.max_by(keep, F.struct(F.round("gain", 12), -F.col("feature"), -F.col("cutoff"))).alias("s")).select("tree", "node", "s.*")
