"""Cuts and trees against every cut tried one by one."""

import math

import numpy as np
import pytest

from fernwerk.operators import cuts, trees


def xlogx(p):
    return p * math.log(p) if p > 0 else 0.0


def gain(pl, nl, pt, nt):
    side = lambda p, n: n / nt * (xlogx(p / n) + xlogx((n - p) / n))
    return side(pl, nl) + side(pt - pl, nt - nl)


def loss(pl, nl, pt, nt):
    return -(min(pl, nl - pl) + min(pt - pl, nt - nl - pt + pl))


def plain_best(x, y, w, worth, features=None):
    """(gain, feature, cutoff) of the best of all cuts at values, of equals the lowest feature and cutoff."""
    found = []
    for f in features if features is not None else range(x.shape[1]):
        for c in np.unique(x[:, f]):
            left = x[:, f] < c
            if left.any():
                found.append((-round(worth((w * y)[left].sum(), w[left].sum(), (w * y).sum(), w.sum()), 12), f, c))
    return min(found) if found else None


def table(spark, x, y, w):
    return trees.table_of(spark.createDataFrame([(i, v, float(a), float(b)) for i, (v, a, b) in enumerate(zip(x.tolist(), y, w, strict=True))], "id long, features array<double>, y double, w double").repartition(3), w="w", id="id")


def data(kind):
    r = np.random.default_rng(len(kind))
    n = 300
    x = r.normal(size=(n, 4))
    y = (x[:, 2] + r.normal(size=n) * 0.5 > 0.3).astype(float)
    w = r.random(n) + 0.1
    if kind == "ties":
        x, w = np.round(x), np.ones(n)
    if kind == "hot":
        x[:100] = x[0]
    if kind == "noise":
        y = (r.random(n) < 0.5).astype(float)
    if kind == "wide":
        x = np.exp(8 * x)
    if kind == "constant":
        x[:, :3] = 1.0
    return x, y, w


@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "noise", "wide", "constant"])
@pytest.mark.parametrize(("criterion", "worth"), [(trees.information_gain, gain), (trees.neg_z1_loss, loss)])
def test_the_best_cut_is_that_of_all_values(spark, kind, criterion, worth):
    x, y, w = data(kind)
    df = table(spark, x, y, w)
    search = cuts.CutSearch(df, cuts.quantile_edges(df, "x", 8), criterion)
    (got,) = search.best([cuts.Tree()], [(0, 0, np.arange(4))])
    want = plain_best(x, y, w, worth)
    assert (round(got["gain"], 9), got["feature"], got["cutoff"]) == (round(-want[0], 9), want[1], want[2])


def test_few_ranges_are_opened(spark, monkeypatch):
    """The second pass sums up the values of ranges that can hold the best cut, a few of those there are."""
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y, w = (x[:, 1] > 0.37).astype(float), np.ones(4000)
    df, asked = table(spark, x, y, w), []
    search = cuts.CutSearch(df, cuts.quantile_edges(df, "x", 64, 0.001), trees.information_gain)
    real = search.value_sums
    monkeypatch.setattr(search, "value_sums", lambda grown, wanted: asked.extend(wanted) or real(grown, wanted))
    (got,) = search.best([cuts.Tree()], [(0, 0, np.arange(3))])
    assert got["feature"] == 1 and got["cutoff"] == x[x[:, 1] > 0.37, 1].min() and 0 < len(asked) <= 4


def plain_tree(x, y, w, depth):
    if depth == 0 or len(x) < 4 or y.min() == y.max():
        return (w * y).sum() / w.sum()
    best = plain_best(x, y, w, gain)
    if best is None:
        return (w * y).sum() / w.sum()
    left = x[:, best[1]] < best[2]
    return best[1], best[2], plain_tree(x[left], y[left], w[left], depth - 1), plain_tree(x[~left], y[~left], w[~left], depth - 1)


def same(root, plain):
    if not isinstance(root, trees.Split):
        return abs(root - plain) < 1e-9
    return (root.feature, root.cutoff) == plain[:2] and same(root.left, plain[2]) and same(root.right, plain[3])


@pytest.mark.parametrize("cells", [1_000_000, 100])
def test_a_tree_is_the_greedy_one(spark, monkeypatch, cells):
    """Also where a level goes in several jobs."""
    monkeypatch.setattr(cuts, "CELLS", cells)
    x, y, w = data("plain")
    df = table(spark, x, y, w)
    (root,) = trees.grow(cuts.CutSearch(df, cuts.quantile_edges(df, "x", 8), trees.information_gain), max_depth=3)
    assert same(root, plain_tree(x, y, w, 3))


def test_rows_without_a_value(spark):
    """NaN and null components go right and are no cut; rows without features take no part; one class and no rows give a leaf."""
    rows = [(0, [float("nan")], 1.0), (1, [None], 1.0), (2, [1.0], 0.0), (3, [2.0], 0.0), (4, None, 1.0), (5, [3.0], 1.0), (6, [4.0], 1.0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y double")
    search = cuts.CutSearch(trees.table_of(df), [np.array([2.0])], trees.information_gain)
    (root,) = trees.grow(search, min_split=2)
    assert (root.cutoff, root.left, root.right) == (3.0, 0.0, 1.0)
    assert trees.grow(cuts.CutSearch(trees.table_of(df.filter("y = 1")), [np.array([2.0])], trees.information_gain)) == [1.0]
    assert trees.grow(cuts.CutSearch(trees.table_of(df.limit(0)), [np.array([2.0])], trees.information_gain)) == [0.0]


def test_forest_sums_are_those_of_its_draws(spark):
    """Range sums of every tree against numpy on the same counts; the counts have the mean they should."""
    x, y, _ = data("plain")
    df = table(spark, x, y, np.ones(len(x)))
    drawn, edges = cuts.Drawn(0.7, 3), [np.array([-0.5, 0.5])] * 4
    search = cuts.CutSearch(df, edges, trees.information_gain, True, drawn)
    got = {(r["tree"], r["feature"], r["r"]): (r["p"], r["n"], r["c"]) for r in search.range_sums([cuts.Tree()] * 5, [(t, 0, np.arange(4)) for t in range(5)]).collect()}
    rows = df.toPandas()
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    want, counts = {}, []
    for t in range(5):
        n = drawn(np.ones(len(x)), rows["key"].to_numpy(), t)
        counts.append(n)
        for f in range(4):
            at = np.searchsorted(edges[f], x[:, f], side="right")
            want |= {(t, f, r): ((n * y)[at == r].sum(), n[at == r].sum(), (n[at == r] > 0).sum()) for r in range(3)}
    assert got == want
    assert abs(np.mean(counts) - 0.7) < 0.05 and not (counts[0] == counts[1]).all()
    large = drawn(np.ones(200_000), np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 200_000), 1)
    assert abs(large.mean() - 0.7) < 0.01 and abs(large.var() - 0.7) < 0.02


def test_a_node_tries_its_own_features(spark):
    x, y, w = data("plain")
    df = table(spark, x, y, w)
    search = cuts.CutSearch(df, cuts.quantile_edges(df, "x", 8), trees.information_gain)
    got = search.best([cuts.Tree(), cuts.Tree()], [(0, 0, np.array([0, 3])), (1, 0, np.array([1]))])
    for r, features in zip(sorted(got, key=lambda r: r["tree"]), ([0, 3], [1]), strict=True):
        assert (r["feature"], r["cutoff"]) == plain_best(x, y, w, gain, features)[1:]


def test_boosting_writes_its_weights_and_gives_the_same(spark, monkeypatch):
    x, y, _ = data("plain")
    df = spark.createDataFrame([(i, v, int(a)) for i, (v, a) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, label int")
    models = []
    for keep in (1, 8):
        monkeypatch.setattr(trees, "KEEP", keep)
        models.append(trees.BoostLearner(trees.StumpLearner(), 4).fit(df))
    w, coefs = np.full(len(x), 1 / len(x)), []
    for m in models[1].models:
        _, f, c = plain_best(x, y, w, loss)
        assert (m.feature, m.cutoff) == (f, c)
        wrong = (x[:, f] >= c) != (y > 0.5) if not m.flipped else (x[:, f] < c) != (y > 0.5)
        e = w[wrong].sum()
        coefs.append(0.5 * math.log((1 - e) / e))
        w = w * np.exp(np.where(wrong, coefs[-1], -coefs[-1]))
        w /= w.sum()
    for model in models:
        assert np.allclose(model.coefs, coefs)
