"""Principal components, multidimensional scaling, nonnegative factors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..sources.scratch import forget, stored
from .base import Fitted, Learner
from .cluster import scatter
from .folds import rank_within
from .linear import matrix, summed
from .pairwise import pdist, project


class Pca(Learner):
    """Components of the covariance of centred, or z-scored, features by descending variance; k of them, all if not given."""

    def __init__(self, k: int | None = None, zscore: bool = True, **columns):
        super().__init__(**columns, k=k, zscore=zscore)

    def _fit(self, dataset: DataFrame) -> PcaModel:
        n, s, ss = scatter(dataset, self.features)
        mean = s / n
        cov = (ss - np.outer(s, s) / n) / n
        std = np.sqrt(np.maximum(np.diag(cov), 0)) if self.zscore else np.ones(len(s))
        std[std == 0] = 1
        values, vectors = np.linalg.eigh(cov / np.outer(std, std) * n / max(1, n - 1))
        order = np.argsort(-values, kind="stable")[: self.k]
        vectors = vectors[:, order]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
        return PcaModel(**self._columns(), mean=mean.tolist(), std=std.tolist(), components=vectors.tolist(), variances=values[order].tolist())


class PcaModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ..functions.vectors import affine

        return dataset.withColumn(self.features, project(affine(doubles(self.features), self.mean, self.std), self.components))


#: Ids whose whole table of distances is solved; tables of more go by landmarks. Ids among which landmarks are looked for.
EXACT, CANDIDATES = 1500, 1500
#: Steps of sparse factors after which rows are written with their w.
KEEP = 8


def farthest(d: np.ndarray, k: int) -> list[int]:
    """Places of k rows of a square table of distances: the first, then always the row farthest from those taken."""
    taken, gap = [0], d[0].copy()
    while len(taken) < min(k, len(d)):
        at = int(gap.argmax())
        if gap[at] <= 0:
            break  # all others are copies of rows taken
        taken.append(at)
        gap = np.minimum(gap, d[at])
    return taken


def square(pairs: DataFrame, ids: list) -> np.ndarray:
    """The table (i, j, d) as a matrix in the order of ids; an error where a pair is missing."""
    place = {v: k for k, v in enumerate(ids)}
    pdf = pairs.select("i", "j", F.col("d").cast("double").alias("d")).toPandas()
    out = np.full((len(ids), len(ids)), np.nan)
    out[pdf["i"].map(place), pdf["j"].map(place)] = pdf["d"]
    if np.isnan(out).any():
        raise ValueError("the table of distances lacks pairs")
    return out


def scaled(d: np.ndarray, ndims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of squared distances: (coordinates, weights by which a row's squared distances, less their means, are its coordinates). Axes without variance are 0."""
    centred = d - d.mean(axis=0)
    centred = centred - centred.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(-(centred + centred.T) / 4)
    order = np.argsort(-values, kind="stable")[:ndims]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    real = values > 1e-9 * max(np.abs(values).max(initial=0), 1e-300)
    root = np.sqrt(np.where(real, values, 1))
    pad = np.zeros((len(d), max(0, ndims - len(order))))
    return np.hstack([vectors * np.where(real, root, 0), pad]), np.hstack([-vectors * np.where(real, 1 / root, 0) / 2, pad])


def mds_dists(distances: DataFrame, ndims: int, landmarks: int = 200, exact: int = EXACT) -> DataFrame:
    """(id, features) of ndims axes from squared distances (i, j, d).

    Up to `exact` ids the whole table is solved on the driver. Beyond, that many landmarks, each the farthest from those before it among CANDIDATES ids drawn by
    hash, are solved, and every id is placed by its distances to them: a sum over its rows of the table, which Spark groups. Rows of the table without a landmark aren't
    read again. Distances are then kept as well as by the whole table if landmarks span what the ids span (Euclidean in ndims axes and ndims + 1
    landmarks in general position: exactly); otherwise what lies off the landmarks' axes is lost. An id without a distance to every landmark gets null.
    """
    def onto(js: DataFrame) -> DataFrame:
        return distances.join(js, "j", "left_semi")

    return _scaled_by(distances.select("i"), onto, ndims, landmarks, exact)


def mds_rows(df: DataFrame, ndims: int, landmarks: int = 200, exact: int = EXACT, features: str = "features", id: str = "id") -> DataFrame:
    """mds_dists() of the squared distances of the rows of df, which are made to the drawn ids and the landmarks only: never between all rows."""
    some = df.filter(F.col(features).isNotNull())

    def onto(js: DataFrame) -> DataFrame:
        return pdist(some, some.join(js.withColumnRenamed("j", id), id, "left_semi"), features=features, id=id)

    return _scaled_by(some.select(F.col(id).alias("i")), onto, ndims, landmarks, exact)


def _scaled_by(ids_of: DataFrame, onto: Callable[[DataFrame], DataFrame], ndims: int, landmarks: int, exact: int) -> DataFrame:
    """ids_of: rows with every i; onto(js): the distances (i, j, d) of all i to the j of js."""
    spark, kind = ids_of.sparkSession, ids_of.schema["i"].dataType.simpleString()
    known = ids_of.select("i").filter("i is not null").distinct()
    ids = sorted(r["i"] for r in known.limit(exact + 1).collect())
    if not ids:
        return spark.createDataFrame([], f"id {kind}, features array<double>")
    if len(ids) <= exact:
        x, _ = scaled(square(onto(known.withColumnRenamed("i", "j")).filter("i is not null"), ids), ndims)
        return spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), f"id {kind}, features array<double>")
    drawn = [r["i"] for r in known.orderBy(F.xxhash64("i"), "i").limit(max(CANDIDATES, landmarks)).collect()]
    some = F.broadcast(spark.createDataFrame([(v,) for v in drawn], f"i {kind}"))
    among = square(onto(some.withColumnRenamed("i", "j")).join(some, "i", "left_semi"), drawn)
    at = farthest(among, landmarks)
    d = among[np.ix_(at, at)]
    _, weights = scaled(d, ndims)
    marks = spark.createDataFrame([(drawn[k], float(m), w) for k, m, w in zip(at, d.mean(axis=0), weights.tolist(), strict=True)], f"j {kind}, mean double, w array<double>")
    placed = onto(F.broadcast(marks.select("j"))).join(F.broadcast(marks), "j").groupBy("i").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("d") - F.col("mean")) * F.col("w")[c]).alias(f"c{c}") for c in range(ndims)))
    every = F.when(F.col("n") == len(at), F.array(*(F.col(f"c{c}") for c in range(ndims))))
    return known.withColumnRenamed("i", "id").join(placed.select(F.col("i").alias("id"), every.alias("features")), "id", "left")


def mds(df: DataFrame, ndims: int, features: str = "features", id: str = "id") -> DataFrame:
    """(id, features): ndims axes that keep the squared distances of the rows of df as well as any can.

    Scaling of Euclidean distances is a turn onto the principal axes; so it is exact for any number of rows, with sums of features x features
    and one projection, and no table of pairs. Rows without features keep null; axes beyond the width are 0.
    """
    rows = df.select(F.col(id).alias("id"), doubles(features).alias("features"))
    some = rows.filter("features is not null")
    if some.isEmpty():
        return rows
    got = Pca(ndims, zscore=False).fit(some).transform(rows)
    more = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(ndims) - F.size("features")))
    return got.withColumn("features", F.when(F.col("features")[0].isNotNull(), F.concat("features", more)))


def lee_seung(df: DataFrame, r: int, max_iter: int = 200, tol: float = 1e-8, seed: int = 0, features: str = "features", id: str = "id", cost: str = "norm2", checkpoint_every: int = 10) -> tuple[DataFrame, np.ndarray, list[float]]:
    """V = W H by multiplicative steps: (id, w), H, and the squared errors by step.

    Rows of W stay with the rows of V; a step needs W^T W and W^T V only, r x (r + m) sums, and each row's own w.
    Both are computed from the row, its w and H in one pass. w is kept by replaying the H of all steps from its seed,
    so a lost task recomputes only its own rows.
    """
    if cost != "norm2":
        raise ValueError("only 'norm2' is supported")
    data = df.select(F.col(id).alias("id"), doubles(features).alias("v")).cache()
    m = len(data.first()["v"])
    h = np.random.default_rng(seed).standard_normal((r, m)) ** 2
    start = F.array(*(F.pow(F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1))), F.lit(2.0)) + 1e-3 for k in range(r)))
    now = data.withColumn("w", start).cache()
    errors: list[float] = []
    for it in range(max_iter):
        def sums(batch, h=h):
            v, w = matrix(batch.column(0)), matrix(batch.column(1))
            return np.concatenate([(w.T @ w).ravel(), (w.T @ v).ravel(), [((v - w @ h) ** 2).sum()]])

        got = summed(now.select("v", "w"), sums, r * r + r * m + 1)
        ww, wv = got[: r * r].reshape(r, r), got[r * r : -1].reshape(r, m)
        errors.append(float(got[-1]))
        new = h * wv / (ww @ h + 1e-8)
        change = np.abs(1 - new / np.maximum(h, 1e-300)).max()
        h = new
        now = _w_step(now, h)
        if it % checkpoint_every == checkpoint_every - 1:
            now = now.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else now.cache()
        if change < tol:
            break
    return now.select("id", "w"), h, errors


def _w_step(now: DataFrame, h: np.ndarray) -> DataFrame:
    hh, ht = h @ h.T, h.T

    def step(batches):
        for b in batches:
            if len(b):
                v, w = matrix(b.column(1)), matrix(b.column(2))
                w = w * (v @ ht) / (w @ hh + 1e-8)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["id", "v", "w"])

    kind = now.schema["id"].dataType.simpleString()
    return now.mapInArrow(step, f"id {kind}, v array<double>, w array<double>").cache()


def sparseness(x: np.ndarray) -> float:
    n = len(x)
    return float((np.sqrt(n) - np.abs(x).sum() / max(np.sqrt((x * x).sum()), 1e-300)) / (np.sqrt(n) - 1))


def project_sparse(x: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The nearest nonnegative vector with these norms: shifted onto the sum, moved away from its centre to the length, with negative entries fixed at 0, until none is."""
    n = len(x)
    s = x + (l1 - x.sum()) / n
    zero = np.zeros(n, bool)
    for _ in range(n):
        centre = np.where(zero, 0.0, l1 / max(1, n - zero.sum()))
        d = s - centre
        a, b, c = d @ d, 2 * (centre @ d), centre @ centre - l2 * l2
        t = (-b + np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a) if a > 1e-300 else 0.0
        s = centre + t * d
        if (s >= -1e-12).all():
            break
        zero |= s < 0
        s[zero] = 0
        s[~zero] += (l1 - s.sum()) / max(1, (~zero).sum())
    return np.maximum(s, 0)


def _shaped(rows: np.ndarray, s: float) -> np.ndarray:
    """The rows projected to sparseness s and length 1."""
    return np.stack([project_sparse(x, np.sqrt(len(x)) - s * (np.sqrt(len(x)) - 1), 1.0) for x in rows])


def sparse_nnmf(v: np.ndarray, r: int, sparse_w: float | None = None, sparse_h: float | None = None, max_iter: int = 500, seed: int = 0, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """V = W H, columns of W and rows of H of given sparseness, for a matrix that fits one task: each column of W needs all rows at once."""
    rng = np.random.default_rng(seed)
    n, m = v.shape
    w, h = rng.random((n, r)), rng.random((r, m))
    if sparse_w is not None:
        w = _shaped(w.T, sparse_w).T
    if sparse_h is not None:
        h = _shaped(h, sparse_h)
    loss = lambda: float(((v - w @ h) ** 2).sum())
    rw = rh = rate
    for _ in range(max_iter):
        if sparse_w is None:
            w = w * (v @ h.T) / (w @ h @ h.T + 1e-8)
        else:
            old, was = w, loss()
            for _ in range(30):
                w = _shaped((old - rw * (old @ h - v) @ h.T).T, sparse_w).T
                if loss() <= was + 1e-12:
                    break
                rw /= 2
                w = old
            rw *= 1.2
        if sparse_h is None:
            h = h * (w.T @ v) / (w.T @ w @ h + 1e-8)
        else:
            old, was = h, loss()
            for _ in range(30):
                h = _shaped(old - rh * w.T @ (w @ old - v), sparse_h)
                if loss() <= was + 1e-12:
                    break
                rh /= 2
                h = old
            rh *= 1.2
    return w, h


def sparse_nnmf_frame(df: DataFrame, r: int, features: str = "features", id: str = "id", sparse_w: float | None = None, sparse_h: float | None = None, max_iter: int = 500, seed: int = 0, rate: float = 0.15) -> tuple[DataFrame, np.ndarray]:
    """sparse_nnmf() of a frame's rows in id order, (id, w) and H, for any number of rows.

    A step of H needs W^T W and W^T V only, which tasks sum up, and a step of a row's w only the row. A row makes its w from its place in the order and the
    H of the steps since w was last written, every KEEP steps. With sparse_w a column of W needs all rows at once: they are gathered, 20 000 at most.
    """
    data = df.select(F.col(id).alias("id"), doubles(features).alias("v"))
    if sparse_w is not None:
        rows = data.orderBy("id").limit(20_001).collect()
        if len(rows) > 20_000:
            raise ValueError("sparse columns of W are needed whole in one place: 20 000 rows at most")
        w, h = sparse_nnmf(np.array([x["v"] for x in rows]), r, sparse_w, sparse_h, max_iter, seed, rate)
        return df.sparkSession.createDataFrame([(x["id"], y) for x, y in zip(rows, w.tolist(), strict=True)], "id long, w array<double>"), h
    n, m = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    h = np.random.Generator(np.random.PCG64(seed).advance(n * r)).random((r, m))
    if sparse_h is not None:
        h = _shaped(h, sparse_h)

    def start(batches):
        bits = np.random.PCG64(seed)
        first = bits.state
        for b in batches:
            w = []
            for k in b.column(2).to_pylist():
                bits.state = first
                w.append(np.random.Generator(bits.advance(k * r)).random(r))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.list_(pa.float64()))], names=["id", "v", "w"])

    def stepped(now: DataFrame, hs: list[np.ndarray]) -> DataFrame:
        def step(batches):
            for b in batches:
                if len(b):
                    w = _moved(matrix(b.column(1)), matrix(b.column(2)), hs)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["id", "v", "w"])

        return now.mapInArrow(step, now.schema)

    kind = data.schema["id"].dataType.simpleString()
    now = stored(rank_within(data, [], ["id"], "at").select("id", "v", "at").mapInArrow(start, f"id {kind}, v array<double>, w array<double>"), "factors")
    hs, rh = [], rate
    for _ in range(max_iter):
        hs.append(h)

        def sums(batch, hs=tuple(hs)):
            v = matrix(batch.column(0))
            w = _moved(v, matrix(batch.column(1)), hs)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ v).ravel(), [(v * v).sum()]])

        got = summed(now.select("v", "w"), sums, r * r + r * m + 1)
        ww, wv, vv = got[: r * r].reshape(r, r), got[r * r : -1].reshape(r, m), got[-1]
        if sparse_h is None:
            h = h * wv / (ww @ h + 1e-8)
        else:
            loss = lambda h: float(vv - 2 * (wv * h).sum() + ((ww @ h) * h).sum())  # noqa: B023, E731
            old, was, slope = h, loss(h), ww @ h - wv
            for _ in range(30):
                h = _shaped(old - rh * slope, sparse_h)
                if loss(h) <= was + 1e-12:
                    break
                rh /= 2
                h = old
            rh *= 1.2
        if len(hs) == KEEP:
            before, now = now, stored(stepped(now, hs), "factors")
            forget(before)
            hs = []
    return stepped(now, hs).select("id", "w"), h


def _moved(v: np.ndarray, w: np.ndarray, hs: Sequence[np.ndarray]) -> np.ndarray:
    """The rows' w after a step with each of hs."""
    for h in hs:
        w = w * (v @ h.T) / (w @ h @ h.T + 1e-8)
    return w
