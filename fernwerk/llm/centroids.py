"""K-means in whole numbers by sort-means: a vector's scan over centroids ends early by the distances between centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import packed, rows_of
from .common import forget, written
from .negatives import finite

#: Vectors in a block.
BLOCK = 2048
#: Components stay below this, so that squared distances and sums are longs.
MOST_COMPONENT = 2**27


def starts(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of `seed:id`, in order of it; of one id in order of components."""
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    rows = first.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return whole(np.array([r["x"] for r in rows]))


def whole(x: np.ndarray) -> np.ndarray:
    if np.abs(x).max(initial=0) >= MOST_COMPONENT:
        raise ValueError(f"components must be below {MOST_COMPONENT} after scaling")
    return x.astype(np.int64)


def scan(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, of equally near ones the smallest number.

    Each row goes through the centroids in the order of their distance from the one it had before, and stops at the first whose distance from
    that one is strictly more than twice its own distance to it: no centroid from there on can be nearer, nor as near.
    """
    gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    at, least = np.array(before, np.int32), np.zeros(len(x), np.int64)
    for c in np.unique(before):
        mine = np.flatnonzero(before == c)
        own = ((x[mine] - centroids[c]) ** 2).sum(axis=1)
        number, near = np.full(len(mine), c, np.int32), own.copy()
        for other in order[c]:
            if other == c:
                continue
            going = np.flatnonzero(gap[c, other] <= 4 * own)  # squares: twice the distance
            if not len(going):
                break
            d = ((x[mine[going]] - centroids[other]) ** 2).sum(axis=1)
            better = (d < near[going]) | ((d == near[going]) & (other < number[going]))
            near[going[better]], number[going[better]] = d[better], other
        at[mine], least[mine] = number, near
    return at, least


def assigned(blocks: DataFrame, centroids: np.ndarray, name: str) -> DataFrame:
    """blocks with every vector's cluster and squared distance, found from the cluster it had, as a written table."""
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x = whole(rows_of(batch, r))
                at, near = scan(x, batch.column("cluster")[r].values.to_numpy(), shared.value)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (at, near)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in ("x", "x_width", "id")), *lists], names=["x", "x_width", "id", "cluster", "distance"])

    return written(blocks.mapInArrow(work, "x binary, x_width int, id array<long>, cluster array<int>, distance array<long>"), name)


def next_round(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned(), and the table before it is deleted."""
    now = assigned(blocks, centroids, "assigned")
    forget(blocks)
    return now


def sums(blocks: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: its vectors, their squared distances and their components, summed exactly: first within tasks, then by Spark in decimals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for r in range(len(batch)):
                x, at = rows_of(batch, r).astype(np.int64), batch.column("cluster")[r].values.to_numpy()
                near = batch.column("distance")[r].values.to_numpy()
                for c in np.unique(at).tolist():
                    part = [int((at == c).sum()), sum(near[at == c].tolist()), *x[at == c].sum(axis=0).tolist()]
                    total[c] = [a + b for a, b in zip(total.get(c, [0] * len(part)), part, strict=True)]
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array([str(s) for s in v])], names=["c", "i", "s"])

    found = blocks.mapInArrow(work, "c int, i int, s string").groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["c"], r["i"])):
        out.setdefault(r["c"], []).append(int(r["s"]))
    return {c: (v[0], v[1], v[2:]) for c, v in out.items()}


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, embedding): k-means over floor(scale * component).

    Vectors of exactly `width` components, none null or non-finite, are kept. Centroids start as the k of least sha256 of `seed:vec_id`, all vectors if they are
    fewer. Each round assigns every vector to the nearest centroid, of equally near ones the smallest number, and takes the floors of its vectors' means for
    every centroid that has any; then all are assigned once more. Each assignment scans from the one before (the first from centroid 0).

    Vectors stay in blocks, written anew with their clusters in each round, the round's before it deleted; what meets on the driver is a sum for each centroid and
    component. No grouping by cluster moves a vector, so a cluster of any size is worked on by all tasks.

    A null vec_id is kept and starts a centroid only where others lack; repeated rows count each. No vector kept: no row. Components of 2 ** 27 and more after
    scaling raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    kept = vectors.filter(finite(v) & (F.size(v) == width)).select(F.col("vec_id").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("x"))
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = written(packed(kept.withColumn("cluster", F.lit(0)), BLOCK), "vectors")
    for _ in range(rounds):
        now = next_round(now, centroids)
        for c, (n, _, s) in sums(now).items():
            centroids[c] = [x // n for x in s]
    now = next_round(now, centroids)
    inertia = {c: s for c, (_, s, _) in sums(now).items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = now.select(F.inline(F.arrays_zip("id", "cluster", "distance"))).toDF("vec_id", "cluster", "distance")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sort_means_sql(k: int = 8, rounds: int = 10) -> str:
    """The same by plain rounds: all distances, then floors of means."""
    near = "select v.row, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, {c} c qualify row_number() over (partition by v.row order by d, c.c) = 1"
    out = [
        "v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))::bigint) as x from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id), x) - 1)::int as c, x from v qualify row_number() over (order by sha256('3:' || vec_id), x) <= {k})",
    ]
    for r in range(rounds):
        out.append(f"a{r} as materialized ({near.format(c=f'c{r}')})")
        out.append(f"m{r} as (select c, i, sum(y)::bigint as s, count(*) as n from (select c, unnest(x) as y, generate_subscripts(x, 1) as i from a{r}) group by c, i)")
        out.append(f"n{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from m{r} group by c)")
        out.append(f"c{r + 1} as materialized (select c.c, coalesce(n.x, c.x) as x from c{r} c left join n{r} n on n.c = c.c)")
    out.append(f"a as materialized ({near.format(c=f'c{rounds}')})")
    return f"with {', '.join(out)} select a.vec_id, a.c as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a join c{rounds} c on c.c = a.c"
