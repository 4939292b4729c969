import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learners import blobs, frame

from fernwerk.operators import factor, graph, pairwise, tasks


def test_scaling_by_landmarks_keeps_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) * [5, 2, 1]
    x[7] = x[3]  # a copy
    d = lambda m: ((m[:, None] - m[None]) ** 2).sum(2)
    table = pairwise.pdist(frame(spark, x))
    of = lambda df: np.array([r.features for r in df.orderBy("id").collect()])
    whole, placed = of(factor.mds_dists(table, 4)), of(factor.mds_dists(table, 4, landmarks=12, exact=20))
    assert np.allclose(d(whole), d(x), atol=1e-9) and np.allclose(d(placed), d(x), atol=1e-8) and np.allclose(placed[:, 3], 0)
    # a plane of rows that lie off it a little: what is lost is what lies off it
    flat = of(factor.mds_dists(table, 2, landmarks=40, exact=20))
    best = of(factor.mds(frame(spark, x), 2))
    assert np.abs(d(flat) - d(x)).mean() < 1.3 * np.abs(d(best) - d(x)).mean()
    with pytest.raises(ValueError):
        factor.mds_dists(table.filter("i <> 4 or j <> 9"), 2)
    assert factor.mds_dists(table.limit(0), 2).count() == 0
    assert factor.farthest(d(np.array([[0.0], [1], [10], [10]])), 4) == [0, 2, 1]
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 5.0]), (2, [3.0, 5.0])], "id long, features array<double>")
    got = [(r.id, r.features and len(r.features)) for r in factor.mds(odd, 3).orderBy("id").collect()]
    assert got == [(0, 3), (1, None), (2, 3), (2, 3)] and factor.mds(odd.limit(0), 3).count() == 0


def test_sparse_affinity_equals_the_dense_form(spark):
    x = np.concatenate([np.random.default_rng(k).normal(size=(12, 2)) + 4 * k for k in range(3)])
    dense = -((x[:, None] - x[None]) ** 2).sum(2)
    _, label = graph.affinity_propagation(dense, preference=-30.0, convit=10, damping=0.6)
    df = frame(spark, x).drop("label")
    got = graph.sparse_affinity(df, k=35, preference=-30.0, convit=10, damping=0.6)
    assert [r.exemplar for r in got.orderBy("id").collect()] == label.tolist() and len(set(label)) > 1


def test_sparse_affinity_of_few_neighbours_and_odd_rows(spark):
    x = np.concatenate([np.random.default_rng(k).normal(size=(20, 2)) * 0.2 + 5 * k for k in range(3)])
    rows = frame(spark, x).drop("label").unionByName(spark.createDataFrame([(100, None), (None, [0.0, 0.0])], "id long, features array<double>"))
    got = {r.id: r.exemplar for r in graph.sparse_affinity(rows, k=8, convit=5, maxit=40, damping=0.7).collect()}
    assert len(got) == 62 and got.pop(100) is None and got.pop(None) is None
    assert all(got[e] == e and e // 20 == i // 20 for i, e in got.items())
    assert [tuple(r) for r in graph.sparse_affinity(rows.filter("id = 3")).collect()] == [(3, 3)]
    assert graph.sparse_affinity(rows.limit(0)).count() == 0


def test_expected_impacts_in_one_job_equal_the_loop(spark):
    x, y = blobs(21, 24, 2, 2, 1.0)
    df = frame(spark, x, y)
    train, pool = df.filter("id < 12"), df.filter("id >= 12")
    p = spark.createDataFrame([(k, c, 0.25 + 0.5 * c) for k in (12, 15, 20) for c in (0, 1)], "id long, label int, p double")
    learner = tasks.Perceptron(max_iters=20)
    one = {r.id: r.impact for r in graph.expected_impacts(train, pool, learner, p).collect()}
    was = {r.id: r.prediction for r in learner.fit(train).transform(pool).collect()}
    want = dict.fromkeys(one, 0.0)
    for r in p.collect():
        more = pool.filter(F.col("id") == r.id).withColumn("label", F.lit(r.label))
        now = learner.fit(train.unionByName(more)).transform(pool).collect()
        want[r.id] += r.p * sum(n.prediction != was[n.id] for n in now)
    assert one == pytest.approx(want) and any(want.values())
    with pytest.raises(Exception, match="label"):
        graph.expected_impacts(train, pool, learner, p.withColumn("label", F.lit(7))).collect()


def test_messages_in_blocks_equal_those_in_one_place(spark, monkeypatch):
    """More rows than one place takes: the same exemplars, with blocks of a few rows that are written every few rounds."""
    x = np.random.default_rng(8).normal(size=(45, 3))
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    of = lambda **options: [r.exemplar for r in graph.affinity_frame(df, **options).orderBy("id").collect()]
    cases = ({"damping": 0.7, "maxit": 30}, {"damping": 0.7, "preference": -60.0, "convit": 5, "maxit": 30}, {"maxit": 1})
    whole = [of(**options) for options in cases]
    assert 1 < len(set(whole[0])) < 45
    monkeypatch.setattr(graph, "WHOLE_ROWS", 10)
    monkeypatch.setattr(graph, "BLOCK_CELLS", 45 * 7)
    monkeypatch.setattr(graph, "WRITTEN_ROUNDS", 12)
    assert [of(**options) for options in cases] == whole


@pytest.mark.parametrize("held", [0, 600_000_000])
def test_messages_held_by_tasks_equal_those_in_tables(spark, monkeypatch, held):
    """All rounds of what the tasks can hold are one job, whatever their number."""
    x = np.random.default_rng(8).normal(size=(45, 3))
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    of = lambda **options: [r.exemplar for r in graph.affinity_frame(df, **options).orderBy("id").collect()]
    cases = ({"damping": 0.7, "maxit": 30}, {"damping": 0.7, "preference": -60.0, "convit": 5, "maxit": 30}, {"maxit": 1})
    whole, stores, store = [of(**options) for options in cases], [], graph.stored
    monkeypatch.setattr(graph, "WHOLE_ROWS", 10)
    monkeypatch.setattr(graph, "BLOCK_CELLS", 45 * 7)
    monkeypatch.setattr(graph, "HELD_CELLS", 45 * 4)
    monkeypatch.setattr(graph, "HELD_BYTES", held)
    monkeypatch.setattr(graph, "WRITTEN_ROUNDS", 12)
    monkeypatch.setattr(graph, "stored", lambda *a: stores.append(a) or store(*a))
    assert [of(**options) for options in cases] == whole
    assert bool(stores) == (held == 0)


def test_impacts_of_sums_take_any_number_of_rows(spark, monkeypatch):
    """More rows than one task's learner takes: models of added sums change what models trained anew change."""
    from fernwerk.plans.catalogue import Means

    x, y = blobs(23, 30, 2, 2, 1.0)
    df = frame(spark, x, y)
    p = spark.createDataFrame([(k, c, 0.3 + 0.4 * c) for k in range(1, len(x), 3) for c in (0, 1)], "id long, label int, p double")
    monkeypatch.setattr(graph, "MOST_ROWS", 5)
    monkeypatch.setattr(graph, "MOST_POOL", 5)
    train, pool = df.filter("id % 3 = 0"), df.filter("id % 3 = 1")
    got = {r.id: r.impact for r in graph.expected_impacts(train, pool, Means(), p).collect()}
    known, z = np.arange(0, len(x), 3), x[1::3]
    said = lambda u, v: Means().solve(u, v).decide(z) >= 0
    was = said(x[known], y[known])
    want = {k: sum((0.3 + 0.4 * c) * (said(np.vstack([x[known], x[k]]), np.append(y[known], c)) != was).sum() for c in (0, 1)) for k in range(1, len(x), 3)}
    assert got == pytest.approx(want) and any(want.values())
