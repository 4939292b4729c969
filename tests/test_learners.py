import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwerk.kernels import solvers
from fernwerk.operators import cluster, compose, factor, graph, linear, pairwise, preprocess, select, tasks, trees, tuning


def frame(spark, x, y=None):
    y = [0] * len(x) if y is None else y
    return spark.createDataFrame([(k, list(map(float, v)), int(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")


def blobs(seed=0, n=40, d=3, classes=2, gap=3.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return rng.normal(size=(n, d)) + gap * y[:, None], y


def share(df):
    return df.agg(F.avg((F.col("prediction").cast("int") == F.col("label")).cast("int"))).first()[0]


# -- kernels ------------------------------------------------------------------------------------------


def test_svm_of_two_points():
    x = np.array([[1.0], [2.0]])
    a, b = solvers.svm_dual(x @ x.T, np.array([1.0, -1.0]), 4.0)
    assert a.tolist() == pytest.approx([2, 2]) and b == pytest.approx(-3)
    with pytest.raises(ValueError):
        solvers.svm_dual(x @ x.T, np.array([1.0, 1.0]), 4.0)
    with pytest.raises(ValueError):
        solvers.svm_dual(x @ x.T, np.array([1.0, -1.0]), np.inf)


@pytest.mark.parametrize("kernel", [solvers.Dot(), solvers.Rbf(2.0), solvers.Polynomial(2)])
def test_svm_meets_the_optimality_conditions(kernel):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), np.where(np.arange(60) % 2, 1.0, -1.0)
    k, c = kernel(x, x), 2.0
    a, b = solvers.svm_dual(k, y, c, eps=1e-5)
    margin = y * (k @ (a * y) - b)
    assert abs(a @ y) < 1e-8
    assert (margin[a < 1e-9] > 1 - 1e-3).all() and (margin[a > c - 1e-9] < 1 + 1e-3).all()
    inside = (a > 1e-9) & (a < c - 1e-9)
    assert np.allclose(margin[inside], 1, atol=1e-3)


def test_callable_and_precomputed_kernels():
    sets = [{1, 2, 3}, {1, 2}, {2, 3}, {1, 3}, {7, 8, 9}, {7, 8}, {8, 9}, {7, 9}]
    y = np.array([1, 1, 1, 1, 0, 0, 0, 0])
    k = solvers.PairFunction(lambda a, b: len(a & b))
    model = solvers.train_svm(sets, y, k, 1.0)
    assert ((model.decide(sets) >= 0) == (y > 0)).all()
    rows = np.arange(8.0)[:, None]
    again = solvers.train_svm(rows, y, solvers.Precomputed(k(sets, sets)), 1.0)
    assert np.allclose(again.decide(rows), model.decide(sets), atol=1e-6)


def test_sigmoid_is_where_the_likelihood_is_flat():
    rng = np.random.default_rng(3)
    f, y = rng.normal(size=200) + np.repeat([-1, 1], 100), np.repeat([0, 1], 100)
    a, b = solvers.fit_sigmoid(f, y)
    p = 1 / (1 + np.exp(f * a + b))
    t = np.where(y, 101 / 102, 1 / 102)
    assert abs((f * (t - p)).sum()) < 1e-3 and abs((t - p).sum()) < 1e-3 and a < 0


def test_f_distribution_closed_form():
    for x in (0.1, 1.0, 3.0, 20.0):
        assert solvers.f_cdf(x, 2, 10) == pytest.approx(1 - (1 + x / 5) ** -5, rel=1e-10)


def test_lasso_meets_the_subgradient_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 10))
    y = x @ np.array([2, 0, 0, -1, 0, 0, 0, 0, 0.5, 0]) + 0.1 * rng.normal(size=80)
    g, xy = x.T @ x / 80, x.T @ y / 80
    b = solvers.lasso_gram(g, xy, 0.2, tol=1e-10)
    slope = xy - g @ b
    assert np.allclose(slope[b != 0], 0.2 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(slope[b == 0]) <= 0.2 + 1e-6).all()


def test_map_update_against_a_slow_loop():
    rng = np.random.default_rng(22)
    grid, points = rng.random((5, 6, 2)), rng.random((9, 2))
    slow = grid.copy()
    for p in points:
        wy, wx = np.unravel_index(((slow - p) ** 2).sum(2).argmin(), (5, 6))
        for y in range(max(0, wy - 2), min(5, wy + 2)):
            for x in range(max(0, wx - 2), min(6, wx + 2)):
                w = 0.2 / (1 + abs(y - wy) + abs(x - wx))
                slow[y, x] = (1 - w) * slow[y, x] + w * p
    assert np.allclose(solvers.put_points(grid, points, 0.2, 2), slow)


# -- learners -----------------------------------------------------------------------------------------


def test_two_class_learners(spark):
    x, y = blobs()
    df = frame(spark, x, y)
    for learner in (tasks.Svm(), tasks.RbfSvm(4.0), tasks.Perceptron(), trees.TreeLearner(), trees.StumpLearner(), trees.ForestLearner(rf=7), trees.BoostLearner(trees.StumpLearner(), 5), trees.WeightedVotingBoost(trees.StumpLearner(), 3), pairwise.KNN(3), pairwise.ApproximateKNN(3, 2)):
        assert share(learner.fit(df).transform(df)) > 0.9, learner
    p = linear.Logistic(0.01).fit(df).transform(df)
    assert share(p.withColumn("prediction", F.col("prediction") > 0.5)) > 0.9


def test_stump_finds_the_feature_and_direction(spark):
    rng = np.random.default_rng(111)
    x = rng.random((40, 2))
    x[20:, 0] += 2
    y = np.repeat([1, 0], 20)
    model = trees.StumpLearner().fit(frame(spark, x, y))
    assert model.feature == 0 and model.flipped and share(model.transform(frame(spark, x, y))) == 1


def test_tree_separates_what_a_stump_cannot(spark):
    x = [(a, b) for a in range(8) for b in range(8)]
    y = [(a >= 4) != (b >= 3) for a, b in x]
    df = frame(spark, x, y)
    assert share(trees.TreeLearner().fit(df).transform(df)) > 0.95


def test_many_classes(spark):
    x, y = blobs(4, 60, 2, 3, 4.0)
    df = frame(spark, x, y)
    for base in (tasks.Svm(), trees.StumpLearner()):
        assert share(compose.OneAgainstOne(base).fit(df).transform(df)) > 0.9
    for wrapper in (compose.OneAgainstRest(tasks.RbfSvm(8.0)), compose.Ecoc(tasks.RbfSvm(8.0)), compose.Ecoc(tasks.RbfSvm(8.0), probability=True), compose.MultiTree(tasks.RbfSvm(8.0))):
        assert share(wrapper.fit(df).transform(df)) > 0.9, wrapper


def test_class_tree_and_codes():
    assert compose.class_tree({3: 4, 2: 2, 1: 1, 0: 1}) == (3, (2, (0, 1)))
    codes = compose.ecoc_codes(4)
    assert codes.shape == (4, 7) and codes[0].all() and len({tuple(c) for c in codes.T}) == 7
    assert len({tuple(min(tuple(c), tuple(~c))) for c in codes.T}) == 7


def test_multi_label(spark):
    x, y = blobs(5, 40, 2, 2, 4.0)
    df = frame(spark, x, y).withColumn("label", F.when(F.col("label") == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    got = compose.OneAgainstRestMulti(tasks.Svm()).fit(df.filter("id < 40")).transform(df).collect()
    assert sum(r.prediction == r.label for r in got) >= 38


def test_groups_and_bags(spark):
    rng = np.random.default_rng(22)
    rows = [(g, m, (rng.normal(size=3) + 4 * (g % 2)).tolist(), g % 2, g * 10 + m, [float(g % 2)]) for g in range(12) for m in range(6)]
    df = spark.createDataFrame(rows, "group_id long, member_id int, features array<double>, label int, id long, extra array<double>")
    got = {r.group_id: r.prediction for r in compose.Grouped(tasks.Svm()).fit(df).transform(df).collect()}
    assert got == {g: g % 2 for g in range(12)}
    means = compose.Grouped(tasks.Svm(raw=True), how="mean").fit(df).transform(df).collect()
    assert all((r.prediction >= 0) == (r.group_id % 2) for r in means)
    bags = compose.Precluster(pairwise.KNN(1), ks=[2], extra="extra").fit(df).transform(df).collect()
    assert all(r.prediction == r.group_id % 2 and len(r.features) == 3 and abs(sum(r.features[:2]) - 1) < 1e-9 for r in bags)


def test_views(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.4), (0.6, 0.6), (0.3, 0.6)], "a double, b double")
    assert [r[0] for r in df.select(compose.product_rule(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]


def test_grid_search(spark):
    x, y = blobs(6, 60, 2, 2, 2.0)
    df = frame(spark, x, y)
    params = {"C": [0.001, 1.0], "sigma": [0.01, 4.0]}
    errors = tuning.grid_errors(df, tasks.RbfSvm(), params, 4)
    assert [o for o, _ in errors] == tuning.grid(params) and len(errors) == 4
    for o, e in errors[1:4:2]:
        assert tuning.cv_error(df, tasks.RbfSvm(**o), 4) == e
    model = tuning.GridSearch(tasks.RbfSvm(), params, 4, annotate=True).fit(df)
    assert model.options == min(errors, key=lambda x: x[1])[0]
    knn = tuning.grid_errors(df, pairwise.KNN(), {"k": [1, 5]}, 4)
    assert knn[1][1] == tuning.cv_error(df, pairwise.KNN(5), 4)
    with pytest.raises(ValueError):
        tuning.default_learner("quick")


def test_default_pipeline(spark):
    x, y = blobs(7, 60, 4, 3, 3.0)
    df = frame(spark, np.concatenate([x, np.zeros((60, 1))], axis=1), y)
    model = tuning.default_learner("fast", nfolds=3).fit(df)
    assert share(model.transform(df)) > 0.9
    constant = frame(spark, np.ones((20, 1)), np.repeat([1, 0], 10))
    tuning.default_learner("fast", nfolds=3).fit(constant).transform(constant).count()


def test_task_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(tasks, "MOST_ROWS", 10)
    x, y = blobs()
    with pytest.raises(Exception, match="rows"):
        tasks.Svm().fit(frame(spark, x, y).withColumn("features", F.col("features")))


# -- unsupervised -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bytes", "band"), [(2_000_000, 64), (200, 64), (200, 2)])
def test_nearest_goes_in_blocks(spark, monkeypatch, bytes, band):
    x, y = blobs(8, 50, 4)
    df = frame(spark, x, y)
    want = {k: [int(i) for i in np.lexsort((np.arange(50), ((x - x[k]) ** 2).sum(1)))[:4]] for k in range(50)}
    monkeypatch.setattr(pairwise, "BASE_BYTES", bytes)
    monkeypatch.setattr(pairwise, "QUERY_BYTES", bytes)
    monkeypatch.setattr(pairwise, "BAND", band)
    got = {}
    for r in pairwise.nearest(df, df, 4).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == want


def test_neighbours_keep_rows_of_equal_and_null_ids(spark):
    """Every row of the query stays with all its columns; equal features get equal answers; without features there is none."""
    base = spark.createDataFrame([("b", [0.0, 0.0], "x"), (None, [0.0, 0.0], "y"), ("a", [5.0, 5.0], "z"), (None, None, "w")], "id string, features array<double>, label string")
    asked = spark.createDataFrame([(None, [0.0, -0.0], 1), (None, [0.1, 0.0], 2), ("q", [4.0, 5.0], 3), ("q", [0.0, 0.0], 4), ("q", None, 5), ("r", [float("nan"), 0.0], 6)], "id string, features array<double>, n int")
    got = {r.n: (r.id, r.prediction) for r in pairwise.KNN(1).fit(base).transform(asked).collect()}
    assert {n: v for n, v in got.items() if n < 6} == {1: (None, "y"), 2: (None, "y"), 3: ("q", "z"), 4: ("q", "y"), 5: ("q", None)} and 6 in got
    assert pairwise.ApproximateKNN(1, matrix=[[1.0], [1.0]]).fit(base).transform(asked).count() == 6
    near = pairwise.nearest(asked.filter("n = 3"), base, 5).orderBy("rank").collect()
    assert [(r.id, r.label, r.d) for r in near] == [("a", "z", 1.0), (None, "y", 41.0), ("b", "x", 41.0)]
    empty = pairwise.KNN(3).fit(base.limit(0)).transform(asked)
    assert empty.count() == 6 and empty.filter("prediction is not null").count() == 0


def test_votes(spark):
    """The commonest label wins, of equally common ones that of the nearest."""
    base = spark.createDataFrame([(1, [1.0], 7), (2, [2.0], 5), (3, [3.0], 5), (4, [4.0], 7), (5, [9.0], 3)], "id long, features array<double>, label long")
    asked = spark.createDataFrame([(1, [0.0]), (2, [3.2])], "id long, features array<double>")
    at = lambda k: [r.prediction for r in pairwise.KNN(k).fit(base).transform(asked).orderBy("id").collect()]
    assert at(1) == [7, 5] and at(2) == [7, 5] and at(3) == [5, 5] and at(4) == [7, 5] and at(9) == [7, 5]


def test_pairs_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0]), (1, [0.0, 0.0]), (2, None)], "id long, features array<double>")
    got = sorted((str(r.i), str(r.j), r.d) for r in pairwise.pdist(df).collect())
    one = [(None, (1, 2)), (1, (1, 0)), (1, (0, 0))]
    assert got == sorted((str(i), str(j), float((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)) for i, a in one for j, b in one)


@pytest.mark.parametrize("distance", ["euclidean", "seuclidean", "mahalanobis"])
def test_kmeans_two_cubes(spark, distance):
    rng = np.random.default_rng(132)
    x = np.concatenate([rng.random((20, 3)) - 0.5, rng.random((20, 3)) + 0.5])
    got, centroids = cluster.kmeans(frame(spark, x), 2, distance, seed=1)
    labels = np.array([r.cluster for r in got.orderBy("id").collect()])
    right = (labels == np.repeat([0, 1], 20)).sum()
    assert distance == "mahalanobis" or max(right, 40 - right) >= 38  # whitened by the covariance of all rows, the gap between the cubes is what shrinks most
    for k, c in enumerate(centroids):
        assert np.allclose(x[labels == k].mean(axis=0), c)


def test_kmeans_drops_empty_clusters(spark):
    df = frame(spark, [[0.0], [1.0], [10.0]])
    got, centroids = cluster.kmeans(df, 3, centroids=[[0.0], [10.0], [500.0]])
    assert np.allclose(centroids, [[0.5], [10.0]]) and {r.cluster for r in got.collect()} == {0, 1}
    many, best = cluster.select_best_kmeans(frame(spark, np.repeat([[0.0], [9.0]], 20, axis=0) + np.random.default_rng(0).normal(size=(40, 1))), [1, 2], 2, "BIC")
    assert len(best) == 2


def test_likelihoods(spark):
    rng = np.random.default_rng(22)
    x = np.concatenate([rng.normal(size=(3, 4)) + k for k in range(4)])
    df = frame(spark, x).withColumn("cluster", F.floor(F.col("id") / 3).cast("int"))
    c = [x[3 * k : 3 * k + 3].mean(axis=0).tolist() for k in range(4)]
    rss = sum(((x[3 * k : 3 * k + 3] - c[k]) ** 2).sum() for k in range(4))
    assert cluster.residual_sum_squares(df, c) == pytest.approx(rss, rel=1e-12)
    assert cluster.log_likelihood(df, c) == pytest.approx(-6 * np.log(2 * np.pi * rss / 12) - 6)
    assert [cluster.nr_parameters(4, 4, m) for m in ("one_variance", "diagonal_covariance", "full_covariance")] == [17, 20, 64]


def test_pca_and_scaling(spark):
    rng = np.random.default_rng(123)
    x = rng.random((30, 4)) @ rng.random((4, 6))
    model = factor.Pca(zscore=False).fit(frame(spark, x))
    y = np.array([r.features for r in model.transform(frame(spark, x)).orderBy("id").collect()])
    assert np.allclose(y @ np.array(model.components).T + model.mean, x) and np.all(np.diff(model.variances) <= 1e-12)
    z = np.array([r.features for r in factor.mds(frame(spark, x[:12]), 4).orderBy("id").collect()])
    d = lambda m: ((m[:, None] - m[None]) ** 2).sum(2)
    assert np.allclose(d(z), d(x[:12]), atol=1e-6)


def test_nonnegative_factors(spark):
    rng = np.random.default_rng(8)
    v = rng.random((30, 3)) @ rng.random((3, 7))
    w, h, errors = factor.lee_seung(frame(spark, v), 3, max_iter=60)
    got = np.array([r.w for r in w.orderBy("id").collect()])
    assert errors[-1] < 0.05 * errors[0] and all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:], strict=False)) and (got >= 0).all()
    _, hs = factor.sparse_nnmf(v, 3, sparse_h=0.6, max_iter=50)
    assert np.allclose([factor.sparseness(r) for r in hs], 0.6, atol=0.02)
    with pytest.raises(ValueError):
        factor.lee_seung(frame(spark, v), 3, cost="i-div")


@pytest.mark.parametrize("sparse_h", [None, 0.4])
def test_sparse_factors_of_a_frame_are_those_of_its_matrix(spark, sparse_h):
    rng = np.random.default_rng(8)
    v = rng.random((50, 3)) @ rng.random((3, 9))
    w, h = factor.sparse_nnmf(v, 3, sparse_h=sparse_h, max_iter=19)
    table, found = factor.sparse_nnmf_frame(frame(spark, v).repartition(3), 3, sparse_h=sparse_h, max_iter=19)
    assert np.allclose(found, h, atol=1e-8) and np.allclose([x.w for x in table.orderBy("id").collect()], w, atol=1e-8)


def test_sparse_factors_of_more_rows_than_one_place_takes(spark):
    v = spark.range(20_050).select("id", F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)).cast("double") for k in range(3))).alias("features"))
    w, h = factor.sparse_nnmf_frame(v, 2, sparse_h=0.4, max_iter=2)
    assert w.count() == 20_050 and np.allclose([factor.sparseness(x) for x in h], 0.4, atol=0.02)


def test_affinity_and_map(spark):
    x = np.concatenate([np.random.default_rng(k).normal(size=(15, 2)) * 0.2 + 5 * k for k in range(3)])
    got = graph.affinity_frame(frame(spark, x), damping=0.8).orderBy("id").collect()
    assert len({r.exemplar for r in got}) == 3 and all(r.exemplar // 15 == r.id // 15 for r in got)
    cells = graph.som_closest(frame(spark, x), graph.som(frame(spark, x), (3, 3), 200)).count()
    assert cells == 45


# -- selection, preprocessing, active learning --------------------------------------------------------


def test_selection(spark):
    rng = np.random.default_rng(9)
    y = np.arange(120) % 2
    x = np.stack([rng.normal(size=120), y + 0.3 * rng.normal(size=120), np.zeros(120), rng.normal(size=120)], axis=1)
    df = frame(spark, np.concatenate([x, x[:, [1]] * 2], axis=1), y)
    assert select.linear_independent_features(df) == [0, 1, 3]
    assert select.sda(frame(spark, x, y))[0] == 1
    assert select.select_n_best(1).fit(frame(spark, x, y)).indices == [1]
    kept, basis = select.linearly_independent_subset(np.array([[1.0, 0], [2, 0], [1, 1]]), basis=True)
    assert kept == [0, 2] and np.allclose(basis @ basis.T, np.diag(np.diag(basis @ basis.T)))
    model = preprocess.FeatureSelector(select=lambda *a: [])
    with pytest.warns(UserWarning):
        assert model.fit(df).indices == [0, 1, 2, 3, 4]


def test_preprocessing_invariants(spark):
    rng = np.random.default_rng(1234)
    x = rng.normal(size=(50, 4)) * 3 + 1
    x[:, 3] = 2
    df = frame(spark, x)
    z = np.array([r.features for r in preprocess.zscore(df).collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z[:, :3].std(0), 1) and np.allclose(z[:, 3], 0)
    i = np.array([r.features for r in preprocess.IntervalNormalise().fit(df).transform(df).collect()])
    assert np.allclose(i[:, :3].min(0), -1) and np.allclose(i[:, :3].max(0), 1) and np.allclose(i[:, 3], 0)
    letters = spark.createDataFrame([(k, c) for k, c in enumerate("A" * 8 + "B" * 12 + "C" * 16 + "D" * 24 + "E" * 1000)], "id long, label string")
    counts = {r[0]: r[1] for r in preprocess.sample_to_2min(letters).groupBy("label").count().collect()}
    assert counts == {"A": 8, "B": 12, "C": 16, "D": 16, "E": 16}
    pipe = preprocess.ctransforms(preprocess.ChkFinite(), preprocess.ZScoreNormalise(), pairwise.NearestExemplar())
    assert pipe.fit(df).transform(df).count() == 50


def test_fisher_and_parzen(spark):
    x, y = blobs(11, 24, 2, 2, 1.5)
    df = frame(spark, x, y)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for r in pairwise.fisher_criterion(df, [0.5, 2.0]).collect():
        k = np.exp(-d / r.sigma)
        n1 = n2 = np.sqrt((y == 0).sum() ** 2)
        c1, c2, c12 = k[y == 0][:, y == 0].sum() / n1, k[y == 1][:, y == 1].sum() / n2, k[y == 0][:, y == 1].sum() / (n1 * n2)
        assert r.f == pytest.approx((n1 + n2 - c1 - c2) / (c1 / n1 + c2 / n2 - 2 * c12))
    for r in pairwise.parzen_loocv(df, 0.7).collect():
        w = np.exp(-d[r.id] / 0.7) * (2 * y - 1)
        assert r.prediction == int(np.delete(w, r.id).sum() > 0)


def test_expected_impacts(spark):
    x, y = blobs(12, 12, 2, 2, 4.0)
    df = frame(spark, x, y)
    p = spark.createDataFrame([(k, c, 0.5) for k in (10, 11) for c in (0, 1)], "id long, label int, p double")
    got = graph.expected_impacts(df.filter("id < 10"), df.filter("id >= 10"), pairwise.KNN(1), p).collect()
    assert len(got) == 2 and all(r.impact >= 0.5 for r in got)


def test_stream_scoring_and_model_files(spark, tmp_path):
    from fernwerk.sources.tables import load_model, save_model
    from fernwerk.streaming.scoring import score_stream

    x, y = blobs()
    df = frame(spark, x, y)
    model = trees.StumpLearner().fit(df)
    save_model(model, spark, str(tmp_path / "model"))
    again = load_model(spark, str(tmp_path / "model"))
    df.write.parquet(str(tmp_path / "in"))
    score_stream(spark, again, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 40 and share(out) > 0.9


def test_sums_are_made_side_by_side(spark):
    import time

    from fernwerk.operators.sums import summed

    def part(batch):
        from pyspark import TaskContext

        k, out, began = TaskContext.get().partitionId(), np.zeros(8), time.time()
        time.sleep(1.5)
        out[2 * k], out[2 * k + 1] = began, time.time()
        return out

    df = spark.range(0, 40, 1, 4).select(F.array(F.col("id").cast("double")).alias("v"))
    summed(df, part, 8)  # workers are started
    got = summed(df, part, 8)
    assert max(got[::2]) < min(got[1::2])


def test_sda_against_determinants(spark):
    """Each step's lambda as a ratio of determinants of the scatters with and without the feature."""
    from fernwerk.operators import select

    rng = np.random.default_rng(8)
    y = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 6))
    x[:, 4] += 2 * y
    x[:, 1] += 1.5 * (y == 1)
    x[:, 2] = x[:, 4] + 0.01 * rng.normal(size=120)
    n, q, w, t = select.within_total(frame(spark, x, y))
    for inside in ([], [4], [4, 1], [0, 5, 3]):
        enter, leave = select.partial_lambdas(w, t, inside)
        det = lambda m, s: np.linalg.det(m[np.ix_(s, s)]) if s else 1.0
        wilks = lambda s: det(w, s) / det(t, s)
        for k in set(range(6)) - set(inside):
            assert np.isclose(enter[k], wilks([*inside, k]) / wilks(inside))
        for at, k in enumerate(inside):
            rest = [i for i in inside if i != k]
            assert np.isclose(leave[at], wilks(inside) / wilks(rest))
    chosen = select.sda(frame(spark, x, y))
    assert set(chosen) in ({4, 1}, {2, 1}) and len(chosen) == 2


def test_affinity_messages_by_their_equations():
    rng = np.random.default_rng(2)
    s, a, r = rng.normal(size=(3, 7, 7))
    got = graph.responsibilities(s, a)
    for i in range(7):
        for k in range(7):
            assert np.isclose(got[i, k], s[i, k] - max(a[i, j] + s[i, j] for j in range(7) if j != k))
    got = graph.availabilities(r)
    for i in range(7):
        for k in range(7):
            others = sum(max(0, r[j, k]) for j in range(7) if j not in (i, k))
            assert np.isclose(got[i, k], others if i == k else min(0, r[k, k] + others))


def test_sigmoid_is_the_maximum():
    rng = np.random.default_rng(4)
    for size in (1.0, 1e4):
        f = rng.normal(size=300) * size
        y = (rng.random(300) < 1 / (1 + np.exp(-1.3 * f / size + 0.4))).astype(float)
        a, b = solvers.fit_sigmoid(f, y)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        p = 1 / (1 + np.exp(f * a + b))
        assert abs(((t - p) * f).sum()) < 1e-3 * size and abs((t - p).sum()) < 1e-3 and a < 0


def test_predictions_of_no_real_class_are_counted(spark):
    from fernwerk.operators import measures

    df = spark.createDataFrame([(1, 1), (1, 2), (2, 7), (None, 1)], "real int, predicted int")
    got = {(r.real, r.predicted): r.n for r in measures.confusion_matrix(df, whole=True).collect()}
    assert sum(got.values()) == 4 and got[2, 7] == 1 and got[7, 7] == 0 and got[None, 1] == 1 and len(got) == 10
    assert measures.confusion_matrix(df, whole=True, labels=[1, 2, 7, 9]).count() == 17


def test_string_ids_and_multi_label_folds(spark):
    from fernwerk.operators import folds
    from fernwerk.operators.base import Fitted, Learner

    df = spark.createDataFrame([(f"id{k:03}", [float(k)], k % 2) for k in range(60)], "id string, features array<double>, label int")
    got = folds.fold_assign(df, 5).groupBy("label", "fold").count().collect()
    assert len(got) == 10 and all(r["count"] == 6 for r in got)

    class Same(Learner):
        def _fit(self, dataset):
            return SameModel(**self._columns())

    class SameModel(Fitted):
        def _transform(self, dataset):
            return dataset.withColumn(self.prediction, F.array(F.lit(1)))

    rows = spark.createDataFrame([(k, [float(k)], [1] if k % 3 else [1, 2]) for k in range(30)], "id long, features array<double>, labels array<int>")
    counts, predictions = folds.nfold_crossvalidation(rows, Same(label="labels"), 5, multi_label=True)
    assert predictions.count() == 30
    assert sorted(map(tuple, counts.collect())) == [(1, True, True, 30), (2, True, False, 10)]


def test_sums_over_pairs_are_taken_in_tiles(spark):
    """No pair becomes a row: what a tile of pairs hands on is a row of sums, or one for each of its rows."""
    x, y = blobs(12, 30, 2, 3, 1.5)
    df = frame(spark, x, y)
    for got in (pairwise.fisher_criterion(df, [0.5]), pairwise.parzen_1class(df, 0.5), pairwise.parzen_density(df, df, 0.5), pairwise.parzen_loocv(df, 0.5)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "aggregate(" not in plan
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    got = {r.i: r.density for r in pairwise.parzen_density(df, df, 0.5).collect()}
    assert np.allclose([got[k] for k in range(len(x))], np.exp(-d).mean(axis=1) / np.pi ** (x.shape[1] / 2))
    one = pairwise.parzen_1class(df, 0.5).first()
    k = np.exp(-d) / np.sqrt(np.pi)
    np.fill_diagonal(k, 0)
    assert one.f == pytest.approx(k.sum()) and one.fprime == pytest.approx((k * (2 * d - 1)).sum())


def test_votes_within_rounding_are_exact(spark):
    """Two voters of either label in equal places: no vote, whatever products round to. Null features have no prediction, equal ids no vote on each other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 7))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(100 + k, v.tolist(), 1) for k, v in enumerate(x)] + [(500, rng.normal(size=7).tolist(), 1), (501, None, 1)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    got = {r.id: r.prediction for r in pairwise.parzen_loocv(df.filter("id <> 501"), 5.0).collect()}
    alone = spark.createDataFrame([*rows[:18], (500, rows[18][1], None)], df.schema)
    assert {r.id: r.prediction for r in pairwise.parzen_loocv(alone, 5.0).collect()}[500] == 0
    assert len(got) == 19 and {r.id: r.prediction for r in pairwise.parzen_loocv(df, 5.0).collect()} == got | {501: None}


def test_median_distance(spark, monkeypatch):
    """Counted by ranges that are looked at closer: exact, also of many equal distances."""
    rng = np.random.default_rng(4)
    for x, sizes in ((rng.normal(size=(40, 3)), (256, 3)), (np.repeat(np.eye(2), 6, axis=0), (65_536, 20)), (np.ones((1, 2)), (65_536, 500_000))):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
        monkeypatch.setattr(pairwise, "MEDIAN_RANGES", sizes[0])
        monkeypatch.setattr(pairwise, "MEDIAN_HELD", sizes[1])
        assert pairwise.median_distance(rows) == pytest.approx(np.median(d), abs=1e-12)
    assert pairwise.median_distance(rows.limit(0)) is None
