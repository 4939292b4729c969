"""Hard negatives, nearest neighbours and sort-means against plain numpy."""

import hashlib
import heapq

import numpy as np
import pytest

from fernwerk.llm import centroids, forest, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(None, [1.0, 2.0], 1), (1, None, 1), (3, [], 1), (5, [None, 1.0], 2), (7, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 0), (11, [0.0, 0.0], 1), (40, [1.0], 1), (200, [0.5, 0.25], None)]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], None if y is None else int(y)) for i, v, y in rows], SCHEMA).repartition(parts)


def random_rows(n, d, labels, seed, ids=None, copies=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[:copies] = x[0]
    return list(zip(ids if ids is not None else range(n), x.tolist(), r.integers(0, labels, n).tolist(), strict=True))


def usable(rows, need_label):
    return [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (y is not None or not need_label)]


def padded(vectors):
    width = max((len(v) for v in vectors), default=0)
    return np.array([np.pad(v, (0, width - len(v))) for v in vectors]).reshape(len(vectors), width)


def plain_negatives(rows, every=100):
    rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in usable(rows, True)]
    x = np.floor(256 * padded([v for _, v, _ in rows])).astype(np.int64)
    out = []
    for a, (i, _, y) in enumerate(rows):
        if i % every:
            continue
        score = x @ x[a]
        others = sorted((-int(score[b]), j, z) for b, (j, _, z) in enumerate(rows) if j != i)
        for s, j, _ in [o for o in others if o[2] == y][:5]:
            fits = [(t, k) for t, k, z in others if z != y and -30 * s <= -100 * t <= -90 * s][:10]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("n", "d", "labels", "copies"), [(600, 40, 3, 200), (300, 33, 200, 0), (150, 8, 1, 150), (5, 70, 2, 0)])
def test_negatives_are_those_of_all_scores(spark, n, d, labels, copies):
    """Many labels in a block, one label alone, a third of equal vectors, and more dimensions than a chunk has."""
    rows = random_rows(n, d, labels, n, copies=copies) + ODD
    got = negatives.hard_negatives(table(spark, rows), rows=64, anchors=4, chunk=16).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_odd_tables(spark):
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    assert negatives.hard_negatives(table(spark, ODD)).count() == 0
    rows = random_rows(400, 5, 4, 1)
    twice = sorted(map(tuple, negatives.hard_negatives(table(spark, rows + rows), rows=50, anchors=3).collect()))
    assert twice == plain_negatives(rows + rows)
    clash = table(spark, rows).withColumns({"id": negatives.F.lit(1), "block": negatives.F.lit("b"), "x": negatives.F.lit(0)})
    assert sorted(map(tuple, negatives.hard_negatives(clash).collect())) == plain_negatives(rows)
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(table(spark, [(0, [1e20], 1), (1, [1e20], 1)])).collect()


def test_tiles_of_large_whole_numbers_are_exact(spark):
    rows = [(i, [float((i * 7919) % 1000) * 4000 + 0.5, float(i)], i % 2) for i in range(0, 300, 3)]
    assert sorted(map(tuple, negatives.hard_negatives(table(spark, rows), rows=16, anchors=2).collect())) == plain_negatives(rows)


def plain_neighbours(rows, every=20, k=20):
    rows = [(i, v) for i, v, _ in usable(rows, False) if np.any(v)]
    x = padded([v for _, v in rows])
    out = {}
    for a, (i, _) in enumerate(rows):
        if i % every == 0:
            out[i] = sorted((-sum(p * q for p, q in zip(x[b], x[a], strict=True)), j) for b, (j, _) in enumerate(rows) if j != i)[:k]
    return out


@pytest.mark.parametrize(("n", "d", "copies"), [(3000, 16, 0), (1500, 8, 500), (90, 64, 0), (12, 3, 0)])
def test_neighbours_recall(spark, n, d, copies):
    rows = random_rows(n, d, 2, n, ids=range(1000, 1000 + n), copies=copies) + ODD
    want = plain_neighbours(rows)
    got = forest.nearest_neighbours(table(spark, rows)).toPandas()
    hits = 0
    for i, near in want.items():
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(near) + 1))  # never fewer than there are
        found = list(zip((-mine.score).tolist(), mine.vec_id.tolist(), strict=True))
        assert found == sorted(found) and len({v for _, v in found}) == len(found)
        worst = near[-1][0] + 1e-12
        hits += sum(s <= worst for s, _ in found)
    assert set(got.query_id) == set(want) and hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_unequal_lengths_are_by_product(spark):
    r = np.random.default_rng(5)
    rows = [(i, (v * s).tolist(), 0) for i, (v, s) in enumerate(zip(r.normal(size=(2000, 12)), np.exp(r.normal(size=2000)), strict=True))]
    want, got = plain_neighbours(rows), forest.nearest_neighbours(table(spark, rows)).toPandas()
    found = {(q, v) for q, v in zip(got.query_id, got.vec_id, strict=True)}
    assert sum((i, j) in found for i, near in want.items() for _, j in near) >= 0.9 * len(found)


def test_neighbours_odd_tables(spark):
    assert forest.nearest_neighbours(table(spark, [])).count() == 0
    assert sorted(map(tuple, forest.nearest_neighbours(table(spark, ODD)).collect())) == [(40, 1, 200, 0.5), (200, 1, 40, 0.5)]
    rows = random_rows(60, 4, 2, 3)
    got = forest.nearest_neighbours(table(spark, rows + rows), k=5).toPandas()
    assert len(got) == 2 * 3 * 5  # each of the two rows of a query has its own
    for _, mine in got.groupby("query_id"):
        assert (mine.groupby("vec_id").size() >= 2).all()
    assert forest.nearest_neighbours(table(spark, [(0, [1.0, 0.0], 1)])).count() == 0


def heap_search(f, x, leaves):
    """One node at a time from a heap over all trees."""
    size = np.linalg.norm(x)
    p = np.einsum("d,tld->tl", f.lifted(x[None], query=True)[0] * f.reach / size, f.directions)
    heap, out = [(0.0, 0, t, 0) for t in range(len(f.cuts))], []
    heapq.heapify(heap)
    while heap and len(out) < leaves:
        cost, level, t, node = heapq.heappop(heap)
        if level == f.depth:
            out.append((round(cost, 9), t, node))
            continue
        m = p[t, level] - f.cut(t, level, np.array([node]))[0]
        heapq.heappush(heap, (cost + (0 if m < 0 else m * m), level + 1, t, 2 * node))
        heapq.heappush(heap, (cost + (m * m if m < 0 else 0), level + 1, t, 2 * node + 1))
    return out


def test_queue_by_levels_gives_what_a_heap_gives(spark):
    rows = forest.kept_vectors(table(spark, random_rows(2000, 10, 2, 8)))
    f = forest.grown(rows, 2000, 10, 6.0, 3, 16, 1000, 1)
    x = np.random.default_rng(2).normal(size=(20, 10))
    cost, tree, leaf = f.search(x, 40)
    for q in range(len(x)):
        want = heap_search(f, x[q], 40)
        assert [c for c, _, _ in want] == [round(c, 9) for c in cost[q]]
        assert {w[1:] for w in want} == set(zip(tree[q].tolist(), leaf[q].tolist(), strict=True))


def plain_means(rows, k=8, rounds=10, width=64):
    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest(), x[r].tolist()))
    c = x[order[:k]].copy()
    far = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        at = far().argmin(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]
    d = far()
    at, near = d.argmin(axis=1), d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((i, int(a), int(e), int(near[at == a].sum()), int(near.sum()), digest[a]) for (i, _), a, e in zip(kept, at, near, strict=True)), key=str)


@pytest.mark.parametrize(("n", "copies", "scale"), [(400, 0, 1.0), (300, 150, 0.001), (5, 0, 1.0), (200, 200, 1.0)])
def test_means_are_those_of_plain_rounds(spark, n, copies, scale):
    """Also coarse vectors with many ties, fewer vectors than centroids, and all equal."""
    rows = [(i, (np.array(v) * scale).tolist(), y) for i, v, y in random_rows(n, 64, 2, n, copies=copies)] + ODD + [(None, [0.25] * 64, 1)]
    got = centroids.sort_means(table(spark, rows).withColumn("cluster", negatives.F.lit(5)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_means(rows)


def test_means_odd_tables(spark):
    assert centroids.sort_means(table(spark, ODD)).count() == 0
    rows = random_rows(30, 64, 2, 4)
    assert sorted(map(tuple, centroids.sort_means(table(spark, rows + rows)).collect()), key=str) == plain_means(rows + rows)
    with pytest.raises(Exception, match="must be below"):
        centroids.sort_means(table(spark, [(1, [1e30] * 64, 1)])).collect()


def test_scan_skips_centroids(spark):
    """Far centroids aren't measured: the scan gives the same as all distances while it stops early."""
    r = np.random.default_rng(0)
    c = (r.integers(0, 100, (8, 5)) * 1000).astype(np.int64)
    x = c[r.integers(0, 8, 500)] + r.integers(-50, 50, (500, 5))
    at, near = centroids.scan(x, r.integers(0, 8, 500).astype(np.int32), c)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()
