"""Nearest neighbours by a forest of random-projection trees: one priority queue over the nodes of all trees, then exact scores of leaf members."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import best, matrix_of, merged, opened, packed, rows_of
from .common import written
from .negatives import finite

#: Vectors in a block of the index, queries in a block, and vectors that a group of neighbouring leaves should have.
ROWS, QUERIES, GROUP = 2048, 1024, 4096
#: Queue entries that a task holds at once.
HELD = 4_000_000
#: Row blocks whose results a task merges before it hands them on.
BAND = 64


@dataclass
class Forest:
    """Trees over vectors with a last component that gives all of them one length, so that the nearest has the largest inner product.

    directions: tree x level x component. A node's rows are told apart by their product with its level's direction: below the node's cut left, else
    right. cuts[tree][level] are the cuts of its nodes, or a single one for all nodes of levels deeper than the sample tells apart.
    """

    directions: np.ndarray
    cuts: list[list[np.ndarray]]
    reach: float

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        width = self.directions.shape[2] - 1
        out = np.zeros((len(x), width + 1))
        out[:, : x.shape[1]] = x
        if not query:
            out[:, width] = np.sqrt(np.maximum(self.reach**2 - (x * x).sum(axis=1), 0))
        return out

    def cut(self, tree: int, level: int, nodes: np.ndarray) -> np.ndarray:
        cuts = self.cuts[tree][level]
        return cuts[nodes] if len(cuts) > 1 else np.broadcast_to(cuts, nodes.shape)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row."""
        p = self.lifted(x) @ self.directions[tree].T
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + (p[:, level] >= self.cut(tree, level, node))
        return node

    def search(self, x: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, tree, leaf) of the first leaves that come out of the queue for each query, in that order.

        A node costs its parent's cost, and on the far side of the cut the squared distance from it on top; the cheapest node of all trees comes
        first, of equal ones that of the lowest number. The queue goes down level by level: a node's near child costs what it costs, so of each
        level the `leaves` cheapest nodes have all leaves that would come out first, and no more are kept.
        """
        n, trees = len(x), len(self.cuts)
        # to a query of length 0 in the last component lengths don't matter; scaled to those of the rows its distances from the cuts are theirs
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        p = np.einsum("nd,tld->ntl", self.lifted(x, query=True) * (self.reach / np.where(size > 0, size, 1)), self.directions)
        tree = np.broadcast_to(np.arange(trees), (n, trees))
        node, cost = np.zeros((n, trees), np.int64), np.zeros((n, trees))
        rows = np.arange(n)[:, None]
        for level in range(self.depth):
            cut = np.empty(node.shape)
            for t in range(trees):
                mine = tree == t
                cut[mine] = self.cut(t, level, node[mine])
            margin = p[rows, tree, level] - cut
            far = margin * margin
            cost = np.concatenate([cost + np.where(margin < 0, 0, far), cost + np.where(margin < 0, far, 0)], axis=1)
            node, tree = np.concatenate([2 * node, 2 * node + 1], axis=1), np.concatenate([tree, tree], axis=1)
            if cost.shape[1] > leaves:
                at = np.lexsort((node, tree, cost), axis=1)[:, :leaves]
                cost, node, tree = cost[rows, at], node[rows, at], tree[rows, at]
        at = np.lexsort((node, tree, cost), axis=1)
        return cost[rows, at], tree[rows, at], node[rows, at]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(row, id, x) of the vectors that take part, as a written table; row is another number for each."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("x")).filter(F.col("id").isNotNull() & finite(F.col("x")))
    return written(kept.filter(F.exists("x", lambda c: c != 0)).select(F.monotonically_increasing_id().alias("row"), "id", "x"), "vectors")


def grown(rows: DataFrame, n: int, width: int, reach: float, trees: int, leaf: int, sample: int, seed: int, enough: int = 8) -> Forest:
    """Cuts are medians of a sample of the rows, as deep as a node has `enough` of it; deeper ones the median of the whole sample."""
    depth = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
    random = np.random.default_rng(seed)
    directions = random.normal(size=(trees, max(depth, 1), width + 1))
    directions = directions[:, :depth] / np.linalg.norm(directions[:, :depth], axis=2, keepdims=True)
    chosen = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "x")).orderBy("h", "id", "x").limit(sample).select("x").toArrow()
    forest = Forest(directions, [], reach)
    x = forest.lifted(np.concatenate([matrix_of(c) for c in chosen.column("x").chunks]))
    for t in range(trees):
        p, node, cuts = x @ directions[t].T, np.zeros(len(x), np.int64), []
        for level in range(depth):
            if len(x) >= enough << level:
                order = np.lexsort((p[:, level], node))
                count = np.bincount(node, minlength=1 << level)
                cut = p[order[np.minimum(np.cumsum(count) - count + count // 2, len(x) - 1)], level]
                cut = np.where(count > 0, cut, np.median(p[:, level]))
            else:
                cut = np.array([np.median(p[:, level])])
            cuts.append(cut)
            node = 2 * node + (p[:, level] >= (cut[node] if len(cut) > 1 else cut[0]))
        forest.cuts.append(cuts)
    return forest


def record(key: dict[str, int], columns: dict) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key.values()), *lists], names=[*key, *columns])


def inner(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows a[i] and b[j], summed from the first component on, so that equal vectors have equal scores wherever they are."""
    out = np.zeros(len(i))
    for u, v in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=False):
        out += u[i] * v[j]
    return out


def scored(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the k rows j of b with the largest product with row i of a, among those asked for (all) whose id is not i's own; of equals the first by id and row."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    allowed = own[:, None] != ids[None, :]
    i, j = np.nonzero(allowed if asked is None else allowed & asked)
    rough = (a @ b.T)[i, j]
    at = best(i, [-rough], k)  # the k-th of each, and what rounding can bring before it
    edge = np.full(len(a), np.inf)
    np.minimum.at(edge, i[at], rough[at])
    slack = 1e-12 * np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1).max(initial=0))
    near = np.flatnonzero(rough >= (edge - slack)[i])
    i, j = i[near], j[near]
    score = inner(a, b, i, j)
    at = best(i, [-score, ids[j], rows[j]], k)
    return i[at], j[at], score[at]


def judged(rows: DataFrame, x: np.ndarray, own: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k rows nearest to each of a few queries, by one pass over all rows: query number and vector."""
    shared = rows.sparkSession.sparkContext.broadcast((x, own))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = shared.value
        for batch in batches:
            ids, row = (batch.column(c).to_numpy() for c in ("id", "row"))
            i, j, score = scored(x, own, matrix_of(batch.column("x")), ids, row, k)
            yield record({"g": 0}, {"q": i, "score": score, "id": ids[j], "row": row[j], "x": batch.column("x").take(pa.array(j))})

    found = rows.mapInArrow(work, "g long, q array<long>, score array<double>, id array<long>, row array<long>, x array<array<double>>")
    got = merged(found, ["g"], k, ["score", "id", "row"], ["score"]).select("q", "x").toArrow().to_batches()
    return {c: np.concatenate([f(b.column(c).flatten()) for b in got]) for c, f in (("q", lambda v: v.to_numpy()), ("x", matrix_of))}


def leaves_needed(forest: Forest, rows: DataFrame, queries: DataFrame, k: int, probes: int, recall: float, seed: int) -> int:
    """How many leaves of the queue a search takes so that `recall` of the true neighbours of `probes` queries, found by a pass over all rows, are in them."""
    chosen = queries.withColumn("h", F.xxhash64(F.lit(seed), "row")).orderBy("h").limit(probes).select("id", "x").toArrow()
    x = np.concatenate([matrix_of(c) for c in chosen.column("x").chunks])
    true = judged(rows, x, chosen.column("id").to_numpy(), k)
    if not len(true["q"]):
        return 1
    member = [forest.leaves(true["x"], t) for t in range(len(forest.cuts))]
    whole, leaves = len(forest.cuts) << forest.depth, 64
    while True:
        place = np.full(len(true["q"]), np.inf)
        for part in np.array_split(np.arange(len(x)), -(-len(x) * 2 * leaves // HELD)):
            _, tree, leaf = forest.search(x[part], leaves)
            for q, trees, found in zip(part, tree, leaf, strict=True):
                at = {pair: n for n, pair in enumerate(zip(trees.tolist(), found.tolist(), strict=True))}
                for one in np.flatnonzero(true["q"] == q):
                    place[one] = min(at.get((t, int(m[one])), np.inf) for t, m in enumerate(member))
        needed = np.sort(place)[int(np.ceil(recall * len(place))) - 1]
        if needed < np.inf or leaves >= whole:
            return int(min(needed + 1, whole))
        leaves *= 4


def index(rows: DataFrame, forest: Forest, shift: int) -> DataFrame:
    """Blocks (block, tree, grp, leaf, id, row, x) of every row in every tree; grp is a subtree, the leaf without its last `shift` levels.

    Ranges are cut by tree, leaf and row, so a leaf of many equal vectors is many tasks' work and has many blocks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"))
            for t in range(len(shared.value.cuts)):
                leaf = shared.value.leaves(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf >> shift), pa.array(leaf), *(batch.column(c) for c in ("id", "row", "x"))], names=["tree", "grp", "leaf", "id", "row", "x"])

    placed = rows.select("id", "row", "x").mapInArrow(work, "tree int, grp long, leaf long, id long, row long, x array<double>")
    return written(packed(placed.repartitionByRange("tree", "leaf", "row").sortWithinPartitions("tree", "leaf", "row"), ROWS, ["tree", "grp"]), "forest")


def routed(queries: DataFrame, forest: Forest, leaves: int, shift: int, everything: bool = False) -> DataFrame:
    """For each block of queries and each subtree that any of them visits: those queries, and who visits which leaf. everything: all of the first tree."""
    shared = queries.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for r in range(len(batch)):
                x, (row, own) = rows_of(batch, r), (batch.column(c)[r].values.to_numpy() for c in ("row", "id"))
                visits = []
                for part in [] if everything else np.array_split(np.arange(len(x)), -(-len(x) * 2 * leaves // HELD)):
                    _, tree, leaf = forest.search(x[part], leaves)
                    visits.append(np.stack([np.repeat(part, tree.shape[1]), tree.ravel(), leaf.ravel()]))
                if everything:
                    every = np.arange(1 << forest.depth)
                    visits.append(np.stack([np.repeat(np.arange(len(x)), len(every)), np.zeros(len(x) * len(every), np.int64), np.tile(every, len(x))]))
                q, tree, leaf = np.concatenate(visits, axis=1)
                order = np.lexsort((q, leaf, tree))
                q, tree, leaf = q[order], tree[order], leaf[order]
                cut = np.flatnonzero(np.diff(tree) | np.diff(leaf >> shift)) + 1
                for s, e in zip([0, *cut], [*cut, len(q)], strict=True):
                    here, at = np.unique(q[s:e], return_inverse=True)
                    out = record({"qb": batch.column("qb")[r].as_py(), "tree": tree[s], "grp": leaf[s] >> shift}, {"q": row[here], "own": own[here], "v_q": at.astype(np.int32), "v_leaf": leaf[s:e]})
                    out = out.append_column("p", pa.array([x[here].tobytes()], pa.binary())).append_column("p_width", pa.array([x.shape[1]], pa.int32()))
                    yield out.set_column(1, "tree", out.column("tree").cast(pa.int32()))

    return queries.mapInArrow(work, "qb long, tree int, grp long, q array<long>, own array<long>, v_q array<int>, v_leaf array<long>, p binary, p_width int")


def visited(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(qb, band, q, score, id, row, own): the k best of each query among the rows of a block that lie in leaves it visits."""
    where = blocks.select("tree", "grp", "block")
    both = asked.join(where, ["tree", "grp"]).join(blocks.drop("tree", "grp"), "block")
    bands = blocks.count() // BAND + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                p, x = rows_of(batch, r, "p"), rows_of(batch, r)
                q, own, v_q, v_leaf, leaf, ids, row = (batch.column(c)[r].values.to_numpy() for c in ("q", "own", "v_q", "v_leaf", "leaf", "id", "row"))
                present, number = np.unique(leaf, return_inverse=True)
                at = np.searchsorted(present, v_leaf)
                hit = present[np.minimum(at, len(present) - 1)] == v_leaf
                asks = np.zeros((len(q), len(present)), bool)
                asks[v_q[hit], at[hit]] = True
                i, j, score = scored(p, own, x, ids, row, k, asks[:, number])
                if len(i):
                    yield record({"qb": batch.column("qb")[r].as_py(), "band": batch.column("block")[r].as_py() % bands}, {"q": q[i], "score": score, "id": ids[j], "row": row[j], "own": own[i]})

    found = both.mapInArrow(work, "qb long, band long, q array<long>, score array<double>, id array<long>, row array<long>, own array<long>")
    order = {"order": ["score", "id", "row"], "descending": ["score"], "unique": True}
    return merged(merged(found, ["qb", "band"], k, **order).drop("band"), ["qb"], k, **order)


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 8, leaf: int = 32, sample: int = 32_768, probes: int = 64, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding): for each row whose vec_id is divisible by `every` the k other rows of largest inner product found.

    Every row lies in a leaf of each tree. A query takes leaves from one queue over the nodes of all trees, cheapest first; members of its leaves get their
    exact score, of equal ones the smaller vec_id comes first. The forest is fitted on at most `sample` rows: a few cuts for each
    node, sent to all tasks. How many leaves a query takes is measured on at most `probes` queries against all rows, so that `recall` of their true neighbours
    are in them; it is the same for all queries. A query whose leaves hold fewer than k others searches all rows.

    Leaves lie in blocks of rows; queries go in blocks to the subtrees that they visit, and leave the best of each block, merged over blocks and trees.
    Evenly scattered vectors have near neighbours behind most cuts, and most of the forest is visited; the work is then in proportion to queries times rows.

    Vectors null, zero or with null or non-finite components take no part, nor do rows with a null vec_id. A shorter vector ends in zeros. Rows of a
    query's own vec_id are never its candidates; candidates that are there twice count twice, a query that is there twice has its rows twice. No query: no row.
    Other columns are not read.
    """
    rows = kept_vectors(vectors)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    n, width, reach, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(norm), F.sum((F.col("id") % every == 0).cast("long"))).first()
    if not asking:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    forest = grown(rows, n, width, reach, trees, leaf, sample, seed)
    shift = min(forest.depth, max(0, int(np.log2(GROUP / leaf))))
    queries = rows.filter(F.col("id") % every == 0)
    leaves = leaves_needed(forest, rows, queries, k, probes, recall, seed)
    blocks = index(rows, forest, shift)
    parts = asking // QUERIES + 1
    dealt = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(parts)))
    in_blocks = lambda df: packed(df.repartition(parts, "qb").sortWithinPartitions("qb", "row"), QUERIES, ["qb"])
    found = written(visited(routed(in_blocks(dealt), forest, leaves, shift), blocks, k), "found")

    counted = found.select(F.explode("q").alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("have"))
    short = written(dealt.join(counted, "row", "left").filter(F.coalesce("have", F.lit(0)) < min(k, n - 1)).drop("have"), "short")
    if short.count():
        again = visited(routed(in_blocks(short), forest, 0, shift, everything=True), blocks, k)
        order = {"order": ["score", "id", "row"], "descending": ["score"], "unique": True}
        found = merged(found.unionByName(again), ["qb"], k, **order)
    return opened(found, ["qb"]).select(F.col("own").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
