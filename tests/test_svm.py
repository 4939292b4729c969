"""Both solvers against the optimum's conditions, and the machine of parts against the one of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwerk.kernels import solvers
from fernwerk.operators import compose, tasks

EIGHT = np.array([[1, 0], [2, 1], [2, 0], [4, 2], [0, 1], [0, 2], [1, 2], [2, 8]], float)
SIGNS = np.array([1, 1, 1, 1, -1, -1, -1, -1.0])


def problem(seed, n=300, noise=1.0, copies=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    x[:copies] = x[0]
    return x, np.where(x[:, 0] + x[:, 1] ** 2 / 3 + noise * r.normal(size=n) > 0.3, 1.0, -1.0)


@pytest.mark.parametrize("algorithm", ["pairs", "smo"])
class TestSolvers:
    def test_two_points(self, algorithm):
        a, b = solvers.solved(np.array([[1.0], [2.0]]), np.array([1.0, -1.0]), solvers.Dot(), 4.0, algorithm=algorithm)
        assert np.allclose(a, 2, atol=1e-3) and abs(b + 3) < 1e-3

    def test_eight_points(self, algorithm):
        a, b = solvers.solved(EIGHT, SIGNS, solvers.Dot(), 4.0, algorithm=algorithm)
        score = EIGHT @ EIGHT.T @ (a * SIGNS) - b
        assert solvers.greatest_violation(score, a, SIGNS, np.full(8, 4.0)) < 1e-3 and abs(a @ SIGNS) < 1e-9
        assert (score * SIGNS > 0).all() and not a[[3, 5]].any()

    @pytest.mark.parametrize(("kernel", "noise", "copies"), [(solvers.Rbf(3.0), 1.0, 0), (solvers.Rbf(3.0), 0.0, 100), (solvers.Polynomial(2), 0.3, 0), (solvers.Dot(), 1.0, 50)])
    def test_conditions(self, algorithm, kernel, noise, copies):
        """Also for copies, of which pairs have no curvature, and for a bound of each row's own."""
        x, y = problem(3, noise=noise, copies=copies)
        for c in (np.full(len(y), 2.0), np.random.default_rng(1).random(len(y)) + 0.1):
            a, b = solvers.solved(x, y, kernel, c, 1e-3, algorithm)
            assert (a >= 0).all() and (a <= c).all() and abs(a @ y) < 1e-8
            assert solvers.greatest_violation(kernel(x, x) @ (a * y) - b, a, y, c) < 3e-3

    def test_option(self, algorithm, spark):
        x, y = problem(5, 80)
        df = spark.createDataFrame([(i, v, int(s > 0)) for i, (v, s) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, label int")
        got = tasks.RbfSvm(3.0, raw=True).with_options(algorithm=algorithm).fit(df).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
        a, b = solvers.solved(x, y, solvers.Rbf(3.0), 1.0)
        assert np.allclose(got, solvers.Rbf(3.0)(x, x) @ (a * y) - b, atol=5e-3)


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="unknown algorithm"):
        solvers.solved(EIGHT, SIGNS, solvers.Dot(), 1.0, algorithm="other")


def test_kernel_rows_are_dropped_and_made_again():
    x, y = problem(7, 120)
    few = solvers.KernelRows(solvers.Rbf(3.0), x, bytes=8 * 120 * 3)
    a, b = solvers.svm_dual(few, y, np.full(120, 1.0))
    want, _ = solvers.solved(x, y, solvers.Rbf(3.0), 1.0)
    assert np.allclose(a, want) and len(few.kept) <= 3


def frame(spark, x, y):
    return spark.createDataFrame([(i, v, int(s > 0)) for i, (v, s) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, label int").repartition(4)


@pytest.mark.parametrize(("n", "noise", "copies"), [(2000, 0.2, 0), (900, 0.5, 300)])
def test_cascade_is_the_machine_of_all_rows(spark, n, noise, copies):
    """Parts of 200 rows, a few violators each round, and a third of equal rows."""
    x, y = problem(11, n, noise, copies)
    df = frame(spark, x, y)
    kernel = solvers.Rbf(3.0)
    model = tasks.CascadeSvm(kernel, 1.0, eps=1e-4, rows=200, worst=50, raw=True).fit(df)
    got = model.transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    a, b = solvers.solved(x, y, kernel, 1.0)
    assert np.abs(got - (kernel(x, x) @ (a * y) - b)).max() < 2e-2
    assert (np.sign(got) == np.sign(kernel(x, x) @ (a * y) - b)).mean() > 0.998


def test_cascade_of_odd_rows(spark):
    x, y = problem(13, 300, 0.0)
    df = frame(spark, x, y)
    one = tasks.CascadeSvm(rows=100).fit(df.filter("label = 1")).transform(df)
    assert {r.prediction for r in one.collect()} == {1}
    more = df.union(spark.createDataFrame([(1000, None, 1), (1001, [0.0] * 4, None)], df.schema))
    got = tasks.CascadeSvm(rows=100, raw=True).fit(more.filter("label is not null")).transform(df)
    assert got.filter("prediction is null").count() == 0
    with pytest.raises(Exception, match="support vectors"):
        tasks.CascadeSvm(rows=100, most_vectors=5).fit(df)


def noisy(spark, n=400, d=3, seed=5):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.standard_normal(n) > 0).astype(int)
    return x, y, spark.createDataFrame([(k, v, int(c)) for k, (v, c) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, label int")


@pytest.mark.parametrize("kernel", [solvers.Dot(), solvers.Rbf(2.0)], ids=["dot", "rbf"])
def test_more_rows_than_a_task_takes_give_the_same_machine(spark, monkeypatch, kernel):
    x, y, df = noisy(spark)
    want = solvers.train_svm(x, y, kernel, 1.0, 1e-6).decide(x)
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    got = tasks.Svm(kernel, eps=1e-6, raw=True).fit(df).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 2e-3


def test_members_of_more_rows_than_a_task_takes(spark, monkeypatch):
    x, y, df = noisy(spark)
    rows = df.withColumn("label", F.col("label") + F.when(F.col("features")[2] > 0.5, 2).otherwise(0))
    want = compose.OneAgainstRest(tasks.Svm(eps=1e-6)).fit(rows).transform(rows).orderBy("id").toPandas()["prediction"]
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    got = compose.OneAgainstRest(tasks.Svm(eps=1e-6)).fit(rows).transform(rows).orderBy("id").toPandas()["prediction"]
    assert (got == want).mean() >= 0.99


@pytest.mark.parametrize("kernel", [solvers.Dot(), solvers.Rbf(2.0)], ids=["dot", "rbf"])
def test_cascade_of_too_many_vectors_for_a_task(spark, monkeypatch, kernel):
    x, y, df = noisy(spark)
    want = solvers.train_svm(x, y, kernel, 1.0, 1e-6).decide(x)
    monkeypatch.setattr(tasks, "TASK_ROWS", 60)
    got = tasks.CascadeSvm(kernel, eps=1e-6, tol=1e-4, rows=100, raw=True).fit(df).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 2e-3


def test_perceptron_of_more_rows_than_a_task_takes(spark, monkeypatch):
    x, _, df = noisy(spark)
    df = df.withColumn("label", (F.col("features")[0] > F.col("features")[1]).cast("int")).filter("abs(features[0] - features[1]) > 0.3")
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    got = tasks.Perceptron(max_iters=60).fit(df).transform(df)
    assert got.filter("prediction <> label").count() == 0


@pytest.mark.parametrize("passes", [1, 3])
def test_perceptron_does_not_depend_on_how_many_rows_a_task_takes(spark, monkeypatch, passes):
    x, y, df = noisy(spark)
    learner = tasks.Perceptron(max_iters=passes, raw=True)
    raw = lambda rows: rows.orderBy("id").toPandas()["prediction"].to_numpy()
    rest = compose.OneAgainstRest(tasks.Perceptron(max_iters=passes))
    rows = df.withColumn("label", F.col("label") + F.when(F.col("features")[2] > 0.5, 2).otherwise(0)).repartition(5)
    want, all_of = raw(learner.fit(df).transform(df)), raw(rest.fit(rows).transform(rows))
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    assert np.allclose(raw(learner.fit(df.repartition(3)).transform(df)), want, rtol=0, atol=1e-9)
    assert (raw(rest.fit(rows).transform(rows)) == all_of).all()


def test_pairs_just_below_what_a_task_takes_go_over_tasks_too(spark, monkeypatch):
    """The solver by pairs takes minutes for a pair of classes of nearly TASK_ROWS rows."""
    x, y, df = noisy(spark)
    want = tasks.Svm(eps=1e-6, raw=True).fit(df).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    monkeypatch.setattr(tasks, "DOT_ROWS", 300)
    monkeypatch.setattr(tasks.Svm, "solve", None)
    got = tasks.Svm(raw=True).fit(df).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 2e-3
