"""Distances, similarities, kernels and neighbours between the rows of two frames, without a join of all pairs where k are enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, sqdist
from ..sources.scratch import stored
from .base import Fitted, Learner
from .blocks import best, least, merged, numbers, opened, packed, rows_of

#: Bytes of features in a block of the base and of the queries; rows of a tile of distances.
BASE_BYTES, QUERY_BYTES, TILE = 2_000_000, 1_000_000, 256
#: Blocks are larger by the times that the base is of so many bytes, up to LARGER: queries are sent to fewer blocks.
LARGE, LARGER = 32_000_000, 4
#: Rows of a tile whose windows are summed at once.
STRIP = 32
#: Blocks of the base whose results a task merges before it hands them on.
BAND = 64

#: Of two matrices with a row for each example, the value of every pair.
PairValue = Callable[[np.ndarray, np.ndarray], np.ndarray]


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with zeros up to the wider one's columns."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, from differences, so that near pairs keep their digits."""
    out = np.zeros((len(a), len(b)))
    for u, v in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        d = u[:, None] - v[None, :]
        out += d * d
    return out


def pairs(x: DataFrame, y: DataFrame | None, value: PairValue, out: str = "d", features: str = "features", id: str = "id") -> DataFrame:
    """(i, j, out) for every row i of x and j of y (or x). The result itself has all pairs; rows meet in blocks, and a task makes a tile of them at a time.

    Rows without features have no pairs; a shorter vector ends in zeros.
    """
    other = x if y is None else y
    of = lambda df, name: df.select(F.col(id).alias(name), doubles(features).alias("x")).filter("x is not null")
    a = packed(of(x, "i").repartition(x.sparkSession.sparkContext.defaultParallelism), TILE)
    b = packed(of(other, "j"), 8 * TILE).select("j", F.col("x").alias("y"), F.col("x_width").alias("y_width"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                p, q = same_width(rows_of(batch, r), rows_of(batch, r, "y"))
                i, j = (batch.column(c)[r].values for c in ("i", "j"))
                for at in range(0, len(p), 16):
                    part = p[at : at + 16]
                    row, column = np.indices((len(part), len(q))).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([i.take(pa.array(row + at)), j.take(pa.array(column)), pa.array(value(part, q).ravel())], names=["i", "j", out])

    kinds = [df.schema[id].dataType.simpleString() for df in (x, other)]
    return a.select("i", "x", "x_width").crossJoin(b).mapInArrow(work, f"i {kinds[0]}, j {kinds[1]}, {out} double")


def pdist(x: DataFrame, y: DataFrame | None = None, distance: str = "euclidean2", **columns) -> DataFrame:
    if distance not in ("euclidean2", "euclidean"):
        raise ValueError(f"unknown distance {distance!r}")
    return pairs(x, y, squared if distance == "euclidean2" else lambda a, b: np.sqrt(squared(a, b)), **columns)


def tiles(x: DataFrame, y: DataFrame, value: Callable[[np.ndarray, np.ndarray, dict, dict], dict], schema: str) -> DataFrame:
    """What value(p, q, own, others) makes of every tile of rows of x and y: p and q are their columns x as matrices, own and others their other columns as arrays.

    Sums over pairs are taken in the tile, so that no pair becomes a row. Rows without x have no part.
    """
    left = packed(x.filter("x is not null").repartition(x.sparkSession.sparkContext.defaultParallelism), TILE)
    right = packed(y.filter("x is not null"), 8 * TILE)
    names = [[c for c in df.columns if c != "x"] for df in (x, y)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                p, q = same_width(rows_of(batch, r), rows_of(batch, r, "other_x"))
                own, others = ({c: batch.column(prefix + c)[r].values for c in of} for prefix, of in zip(("", "other_"), names, strict=True))
                yield pa.RecordBatch.from_pydict(value(p, q, own, others))

    return left.crossJoin(right.select(*(F.col(c).alias("other_" + c) for c in right.columns))).mapInArrow(work, schema)


def near(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Squared distances by products where those are off by less than 1e-11 of scale, else from differences."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if not 3e-16 * max(a.shape[1], 1) * (own.max(initial=0) + other.max(initial=0)) <= 1e-11 * scale:  # also where any is not a number
        return squared(a, b)
    d = a @ b.T
    d *= -2
    d += own[:, None]
    d += other
    return np.maximum(d, 0, out=d)


def window(d: np.ndarray, scale: float) -> np.ndarray:
    """exp(-d / scale), in the place of d."""
    d /= -scale
    return np.exp(d, out=d)


def windows(d: np.ndarray, scales: Sequence[float]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the scale, exp(-d / scale)) from the widest scale on; each is gone when the next is asked for. One that the scale before is 2, 4 .. 256 times of is that one's square, or the square of this."""
    w = before = None
    for k in sorted(range(len(scales)), key=lambda k: -scales[k]):
        turns = np.log2(before / scales[k]) if w is not None and scales[k] > 0 else -1
        if turns in range(9):
            for _ in range(int(turns)):
                np.multiply(w, w, out=w)
        else:
            w = window(d.copy(), scales[k])
        before = scales[k]
        yield k, w


def equal_ids(own: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs of a tile whose ids are equal."""
    a, b = own.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
    return np.nonzero(a[:, None] == b) if len(np.intersect1d(a, b)) else (np.zeros(0, int), np.zeros(0, int))


#: Ranges that values are counted in at once; so many values between two edges are collected.
MEDIAN_RANGES, MEDIAN_HELD = 65_536, 500_000


def median_distance(x: DataFrame) -> float | None:
    """The median of the squared distances of all pairs of rows of x (column x), a row with itself included: pairs are counted by ranges, and those of the middle are looked at closer."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    n, top = x.filter("x is not null").agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return None
    if not np.isfinite(4 * top):
        return pairs(x.withColumn("i", F.lit(0)), None, squared, features="x", id="i").agg(F.median("d")).first()[0]
    found = {}

    def counts(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        edges = np.unique(np.linspace(low, high, MEDIAN_RANGES + 1))

        def count(p, q, own, others):
            at, m = np.unique(np.searchsorted(edges, squared(p, q).ravel(), side="right") - 1, return_counts=True)
            return {"at": pa.array(at, pa.int64()), "m": pa.array(m, pa.int64())}

        got = tiles(x, x, count, "at long, m long").filter((F.col("at") >= 0) & (F.col("at") < len(edges) - 1)).groupBy("at").agg(F.sum("m").alias("m")).toPandas()
        out = np.zeros(len(edges) - 1, np.int64)
        out[got["at"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
        return edges, out

    def values(low: float, high: float) -> np.ndarray:
        def inside(p, q, own, others):
            d = squared(p, q).ravel()
            return {"d": pa.array(d[(d >= low) & (d < high)])}

        return np.sort(tiles(x, x, inside, "d double").toPandas()["d"].to_numpy())

    def ranked(k: int) -> float:
        low, high = 0.0, float(np.nextafter(4 * top * (1 + 1e-9), np.inf))
        while True:
            if (low, high) not in found:
                found[low, high] = counts(low, high)
            edges, m = found[low, high]
            at = int(np.searchsorted(np.cumsum(m), k, side="right"))
            k -= int(m[:at].sum())
            low, high = float(edges[at]), float(edges[at + 1])
            if np.nextafter(low, np.inf) >= high:
                return low
            if m[at] <= MEDIAN_HELD:
                if (low, high, "values") not in found:
                    found[low, high, "values"] = values(low, high)
                return float(found[low, high, "values"][k])

    return (ranked((n * n - 1) // 2) + ranked(n * n // 2)) / 2


def plike(x: DataFrame, sigma2: float | None = None, features: str = "features", id: str = "id") -> DataFrame:
    """exp(-d^2 / sigma2) for all pairs; sigma2 is by default the median of all d^2, the diagonal included."""
    if sigma2 is None:
        sigma2 = median_distance(x.select(doubles(features).alias("x")))
    scale = F.lit(None).cast("double") if sigma2 is None else F.lit(float(sigma2))
    return pdist(x, features=features, id=id).select("i", "j", F.exp(-F.col("d") / scale).alias("s"))


def rbf_kernel(x: DataFrame, y: DataFrame | None, sigma: float, beta: float = 1.0) -> DataFrame:
    return pairs(x, y, lambda a, b: beta * np.exp(-squared(a, b) / sigma), "k")


def polynomial_kernel(x: DataFrame, y: DataFrame | None, degree: float, c: float = 1.0) -> DataFrame:
    return pairs(x, y, lambda a, b: (a @ b.T + c) ** degree, "k")


def dot_kernel(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return pairs(x, y, lambda a, b: a @ b.T, "k")


def precomputed_kernel(rows: DataFrame, columns: DataFrame, matrix: DataFrame) -> DataFrame:
    """(i, j, k) of a kernel table for the row ids and column ids given."""
    return matrix.join(rows.select(F.col("id").alias("i")), "i", "left_semi").join(columns.select(F.col("id").alias("j")), "j", "left_semi")


def fingerprint(features: Column) -> list[Column]:
    """128 bits of an array of doubles, equal for equal ones: what stands for a row of features where its id may be null or not its own."""
    v = F.transform(features, lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return [F.xxhash64(v), F.xxhash64(F.lit("second"), v)]


def projected(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """x times matrix, summed from the first row on, so that equal rows have equal products wherever they lie."""
    out = np.zeros((len(x), matrix.shape[1]))
    for u, v in zip(np.ascontiguousarray(x.T), matrix, strict=False):
        out += u[:, None] * v
    return out


def nearest_records(queries: DataFrame, base: DataFrame, k: int, matrix: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Records (block, q, d, id, label, the queries' columns as arrays but x): the k rows of base (id, label, x) nearest to each of queries (x, ..), q being its number in the block.

    Both are dealt into blocks of bounded bytes, the base by a hash of its rows. Every block of queries goes to each number of a base block; a task measures
    one pair of blocks at a time and leaves the k best of each query; those are merged over the blocks of the base, BAND of them at a time where
    there are more. Distances are equal for equal rows wherever they lie; of equal ones the smaller id comes first, null before all.
    With a matrix (a row for each feature) distances are those of the products with it.
    """
    m = None if matrix is None else np.array(matrix, float)
    kept = base.filter("x is not null")
    n, width = kept.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    row = 8 * max(width or 1, 1)
    larger = min(max(n * row // LARGE, 1), LARGER)
    size, parts = max(larger * BASE_BYTES // row, 1), -(-n * row // (larger * BASE_BYTES)) or 1
    others = [c for c in queries.columns if c != "x"]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int"))
    blocks = packed(dealt.repartition("part").sortWithinPartitions("part", "id", "x"), size, ["part"]).select("part", "id", "label", F.col("x").alias("y"), F.col("x_width").alias("y_width"))
    asking = packed(queries.filter("x is not null").repartition(*others, "x").sortWithinPartitions(*others, "x"), max(larger * QUERY_BYTES // row, 1))
    both = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                a, b = same_width(rows_of(batch, r), rows_of(batch, r, "y"))
                if m is not None:
                    a, b = projected(a, m), projected(b, m)
                norm = (b * b).sum(axis=1)
                found = [np.zeros((3, 0))]
                for at in range(0, len(a), TILE):
                    part = a[at : at + TILE]
                    own = (part * part).sum(axis=1)
                    i, j = least(norm - 2 * part @ b.T, k, 1e-12 * (1 + own + norm.max(initial=0)))
                    d = np.zeros(len(i))  # the few within rounding of the k-th are measured exactly
                    for u, v in zip(np.ascontiguousarray(part.T), np.ascontiguousarray(b.T), strict=True):
                        d += (u[i] - v[j]) ** 2
                    mine = best(i, [d, j], k)  # a block is in order of id
                    found.append(np.stack([i[mine] + at, j[mine], d[mine]]))
                i, j, d = np.concatenate(found, axis=1)
                i, j = i.astype(np.int64), pa.array(j.astype(np.int64))
                columns = [pa.array(i), pa.array(d), batch.column("id")[r].values.take(j), batch.column("label")[r].values.take(j), *(batch.column(c)[r].values.take(pa.array(i)) for c in others)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), pa.array([batch.column("part")[r].as_py() // BAND], pa.int32()), *lists], names=["block", "band", "q", "d", "id", "label", *others])

    kinds = dict(blocks.dtypes) | dict(asking.dtypes)
    schema = ", ".join(["block long, band int, q array<long>, d array<double>", *(f"`{c}` {kinds[c]}" for c in ("id", "label", *others))])
    found = both.mapInArrow(work, schema)
    if parts > BAND:
        found = merged(found, ["block", "band"], k, ["d", "id"])
    return merged(found.drop("band"), ["block"], k, ["d", "id"]) if parts > 1 else found.drop("band")


def of_base(base: DataFrame, features: str, id: str, label: str) -> DataFrame:
    return base.select(F.col(id).alias("id"), F.col(label).alias("label"), doubles(features).alias("x"))


def nearest(queries: DataFrame, base: DataFrame, k: int, features: str = "features", id: str = "id", label: str = "label") -> DataFrame:
    """(q, rank from 1, id, label, d): the k rows of base nearest to each row of queries, by squared distance and id; q is the query's id.

    Rows of equal or null id are rows of their own. Rows without features have none and are nobody's.
    """
    rows = queries.select(F.col(id).alias("own"), doubles(features).alias("x"))
    return opened(nearest_records(rows, of_base(base, features, id, label), k), ["block"]).select(F.col("own").alias("q"), "rank", "id", "label", "d")


def vote(records: DataFrame, ks: Sequence[int | None] = (None,)) -> DataFrame:
    """(a, b, prediction, then prediction1, ..) of nearest_records() of queries (a, b, x): for each of ks the commonest label of the k nearest (None: of all), of equally common ones that of the nearest."""
    names = ["prediction" + (str(at) if at else "") for at in range(len(ks))]

    def winners(q: np.ndarray, code: np.ndarray) -> np.ndarray:
        order = np.lexsort((code, q))  # stable: within a label the nearest first
        changed = np.ones(len(q), bool)
        changed[1:] = (np.diff(q[order]) != 0) | (code[order][1:] != code[order][:-1])
        first = np.flatnonzero(changed)
        count = np.diff(np.append(first, len(q)))
        place = order[first]
        return place[best(q[place], [-count, place], 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                q, label = batch.column("q")[r].values.to_numpy(), batch.column("label")[r].values
                code = numbers(label) if len(label) else np.zeros(0, np.int64)
                found = []
                for k in ks:
                    inside = np.arange(len(q)) if k is None else best(q, [np.arange(len(q))], k)
                    found.append(inside[winners(q[inside], code[inside])])
                columns = [batch.column(c)[r].values.take(pa.array(found[0])) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*columns, *(label.take(pa.array(w)) for w in found)], names=["a", "b", *names])

    kind = dict(records.dtypes)["label"].removeprefix("array<")[:-1]
    return records.select("q", "a", "b", "label").mapInArrow(work, "a long, b long, " + ", ".join(f"{c} {kind}" for c in names))


class KNN(Learner):
    """k nearest neighbours by plurality. Without features a row's prediction is null, as with an empty base."""

    def __init__(self, k: int = 1, **columns):
        super().__init__(**columns, k=k)

    def _fit(self, dataset: DataFrame) -> KNNModel:
        return KNNModel(**self._columns(), k=self.k, matrix=None, base=dataset.select(self.id, self.features, self.label))


class KNNModel(Fitted):
    """Rows of equal features are asked once, and get the answer by a fingerprint of their features, whatever their ids. With a matrix the distances are those of projections."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.by_each(dataset, [self.k], [self.prediction])

    def by_each(self, dataset: DataFrame, ks: Sequence[int], names: Sequence[str]) -> DataFrame:
        """dataset with the prediction of each of ks neighbours; these are looked for once."""
        a, b = fingerprint(doubles(self.features))
        rows = dataset.withColumns({"__a": a, "__b": b})
        asked = rows.select(F.col("__a").alias("a"), F.col("__b").alias("b"), doubles(self.features).alias("x")).dropDuplicates(["a", "b"])
        records = nearest_records(asked, of_base(self.base, self.features, self.id, self.label), max(ks), self.matrix)
        found = vote(records, ks).toDF("__a", "__b", *names)
        return rows.join(found, ["__a", "__b"], "left").select(*dataset.columns, *names)


class ApproximateKNN(Learner):
    """KNN on ndims random projections with weights uniform in [0, 1), or on a given matrix (features x ndims)."""

    def __init__(self, k: int = 1, ndims: int = 8, seed: int = 0, matrix: Sequence[Sequence[float]] | None = None, **columns):
        super().__init__(**columns, k=k, ndims=ndims, seed=seed, matrix=matrix)

    def _fit(self, dataset: DataFrame) -> KNNModel:
        from .preprocess import width

        m = self.matrix if self.matrix is not None else np.random.default_rng(self.seed).random((width(dataset, self.features), self.ndims)).tolist()
        return KNNModel(**self._columns(), k=self.k, matrix=m, base=dataset.select(self.id, self.features, self.label))


def project(v: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """v (an array) times a matrix with a row for each of its elements."""
    from ..functions.vectors import lit_vector

    return F.array(*(dot(doubles(v), lit_vector([row[c] for row in matrix])) for c in range(len(matrix[0]))))


class NearestExemplar(Learner):
    """The cheap learner: remembers the first example of every label, and predicts the nearest one's label, of equals the lowest."""

    def _fit(self, dataset: DataFrame) -> NearestExemplarModel:
        first = dataset.groupBy(F.col(self.label).alias("__label")).agg(F.min_by(doubles(self.features), self.id).alias("__exemplar"))
        return NearestExemplarModel(**self._columns(), exemplars=first)


class NearestExemplarModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        e = self.exemplars.agg(F.array_sort(F.collect_list(F.struct("__label", "__exemplar"))).alias("__all"))
        v = doubles(self.features)
        scored = F.transform("__all", lambda x: F.struct(sqdist(v, x["__exemplar"]).alias("d"), x["__label"].alias("l")))
        return dataset.join(F.broadcast(e), F.lit(True)).withColumn(self.prediction, F.array_min(scored)["l"]).drop("__all")


def fisher_criterion(df: DataFrame, sigmas: Sequence[float], label: str = "label", features: str = "features", id: str = "id") -> DataFrame:
    """(sigma, f): separability of two classes (0 and 1) under the RBF kernel of each sigma; lower is better.

    Squared distances are taken once; tiles of pairs send their sums by classes for all sigmas.
    """
    rows = df.select(doubles(features).alias("x"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    scales = [float(v) for v in sigmas]

    def sums(p, q, own, others):
        left, right = (np.stack([y == 0, y == 1]).astype(float) for y in (c["y"].to_numpy() for c in (own, others)))
        found = np.zeros((len(scales), 2, 2))
        for at in range(0, len(p), STRIP):  # what is held of a strip of pairs stays in the caches
            for k, w in windows(near(p[at : at + STRIP], q, min(scales)), scales):
                found[k] += left[:, at : at + STRIP] @ (w @ right.T)
        return {f"c{k}_{a}{b}": pa.array([float(m[a, b])]) for k, m in enumerate(found) for a, b in cells}

    cells = ((0, 0), (1, 1), (0, 1))
    names = [f"c{k}_{a}{b}" for k in range(len(scales)) for a, b in cells]
    n = rows.agg(*(F.sum(F.when(F.col("y") == c, 1.0)).alias(f"n{c + 1}") for c in (0, 1)))
    one = tiles(rows, rows, sums, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c).alias(c) for c in names)).crossJoin(n)
    n1, n2 = F.col("n1"), F.col("n2")
    values = []
    for k, v in enumerate(scales):
        c1, c2, c12 = F.col(f"c{k}_00") / n1, F.col(f"c{k}_11") / n2, F.col(f"c{k}_01") / (n1 * n2)
        values.append(F.struct(F.lit(v).alias("sigma"), ((n1 + n2 - c1 - c2) / (c1 / n1 + c2 / n2 - 2 * c12)).alias("f")))
    return one.select(F.inline(F.array(*values)))


#: Share of a row's summed weights below which its vote is taken again from differences.
CLOSE_VOTE = 1e-8


def parzen_loocv(df: DataFrame, sigma: float, label: str = "label", features: str = "features", id: str = "id") -> DataFrame:
    """(id, label, prediction): by the RBF-weighted vote of all other rows of labels 0 and 1. Votes within rounding are counted again from exact distances."""
    rows = df.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y"), doubles(features).alias("x")).filter("i is not null")
    voters = rows.filter("y is not null").withColumn("y", (2 * F.col("y") - 1).cast("double"))
    kind = rows.schema["i"].dataType.simpleString()

    def votes(distance):
        def sums(p, q, own, others):
            w = window(distance(p, q), sigma)
            w[equal_ids(own["i"], others["i"])] = 0
            y = others["y"].to_numpy()
            return {"i": own["i"], "y": own["y"], "w": pa.array(w @ y), "size": pa.array(w @ np.abs(y))}

        return sums

    def counted(some, distance):
        return tiles(some, voters, votes(distance), f"i {kind}, y int, w double, size double").groupBy("i", "y").agg(F.sum("w").alias("w"), F.sum("size").alias("size"))

    first = stored(counted(rows, lambda p, q: near(p, q, sigma)), "votes")
    close = F.abs("w") <= CLOSE_VOTE * F.col("size")
    found = first
    if not first.filter(close).isEmpty():
        again = counted(rows.join(first.filter(close).select("i").distinct(), "i", "left_semi"), squared)
        found = first.join(first.filter(close).select("i").distinct(), "i", "left_anti").unionByName(again)
    unknown = rows.filter("x is null").select("i", "y", F.lit(None).cast("double").alias("w"))
    return found.select("i", "y", "w").unionByName(unknown).groupBy("i", "y").agg(F.sum("w").alias("w")).select(F.col("i").alias("id"), F.col("y").alias("label"), (F.col("w") > 0).cast("int").alias("prediction"))


def parzen_1class(df: DataFrame, h: float, features: str = "features", id: str = "id") -> DataFrame:
    """(f, fprime): the leave-one-out criterion of a one-class Parzen window of width h, and its derivative."""
    rows = df.select(F.col(id).alias("i"), doubles(features).alias("x")).filter("i is not null")

    def sums(p, q, own, others):
        d = near(p, q, 2 * h)
        k = window(d.copy(), 2 * h)
        equal = equal_ids(own["i"], others["i"])
        k[equal] = 0
        d[equal] = 0
        n = k.size - len(equal[0])
        return {"f": pa.array([k.sum() if n else None], pa.float64()), "kd": pa.array([(k * d).sum() if n else None], pa.float64())}

    f, kd = F.sum("f") / F.sqrt(F.lit(2 * h * np.pi)), F.sum("kd") / F.sqrt(F.lit(2 * h * np.pi))
    return tiles(rows, rows, sums, "f double, kd double").agg(f.alias("f"), (kd / (2 * h * h) - f / (2 * h)).alias("fprime"))


def parzen_density(queries: DataFrame, base: DataFrame, h: float) -> DataFrame:
    """(i, density): the mean of Gaussian windows of variance h around base's rows."""
    from .preprocess import width

    n = width(base, "features")
    rows, others = queries.select(F.col("id").alias("i"), doubles("features").alias("x")), base.select(doubles("features").alias("x"))

    def sums(p, q, own, others):
        return {"i": own["i"], "s": pa.array(window(near(p, q, 2 * h), 2 * h).sum(axis=1)), "m": pa.array(np.full(len(p), len(q)), pa.int64())}

    found = tiles(rows, others, sums, f"i {rows.schema['i'].dataType.simpleString()}, s double, m long").groupBy("i")
    return found.agg((F.sum("s") / F.sum("m") / F.lit((2 * np.pi * h) ** (n / 2))).alias("density"))
