import random

import numpy as np
import pytest

from fernwerk.operators import folds, measures
from fernwerk.operators.pairwise import KNN, NearestExemplar


def frame(spark, real, predicted):
    return spark.createDataFrame(list(zip(real, predicted, strict=True)), "real int, predicted int")


def test_confusion_accuracy(spark):
    rng = random.Random(323)
    real = [k % 3 for k in range(101)]
    predicted = [r if rng.random() < 0.7 else (r + 1) % 3 for r in real]
    df = frame(spark, real, predicted)
    cells = {(r.real, r.predicted): r.n for r in measures.confusion_matrix(df, whole=True).collect()}
    assert len(cells) == 9 and all(cells[i, j] == sum(a == i and b == j for a, b in zip(real, predicted, strict=True)) for i in range(3) for j in range(3))
    right = sum(a == b for a, b in zip(real, predicted, strict=True))
    assert measures.accuracy(df).first()[0] == pytest.approx(right / 101)
    assert measures.accuracy_of_matrix(measures.confusion_matrix(df)).first()[0] == pytest.approx(right / 101)
    assert measures.zero_one_loss(df).first()[0] == 101 - right


def test_bayes_is_symmetric_and_even_at_equality(spark):
    assert measures.bayesian_significance(spark, 100, 60, 60).first()[0] == pytest.approx(0.5, abs=1e-9)
    a, b = (measures.bayesian_significance(spark, 100, *c).first()[0] for c in ((60, 55), (55, 60)))
    assert a == pytest.approx(b)


def test_curves_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    score = np.round(np.concatenate([rng.random(50), rng.random(50) + 0.4]), 2)
    label = np.repeat([False, True], 50)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist(), strict=True)), "score double, label boolean")
    got = {r.threshold: (r.fpr, r.tpr) for r in measures.roc(df).collect()}
    pr = {r.threshold: (r.precision, r.recall) for r in measures.precision_recall(df).collect()}
    assert set(got) == set(score.tolist())
    for t in got:
        chosen = score >= t
        assert got[t] == pytest.approx(((chosen & ~label).sum() / 50, (chosen & label).sum() / 50))
        assert pr[t] == pytest.approx((label[chosen].mean(), (chosen & label).sum() / 50))
    steps = measures.precision_recall(df, mode="steps", steps=10).collect()
    assert len(steps) == 10 and all(0 <= r.precision <= 1 for r in steps)
    with pytest.raises(ValueError):
        measures.precision_recall(df, mode="step")


def test_rand_of_equal_clusterings_is_one(spark):
    df = spark.createDataFrame([(k // 10, 3 - k // 10) for k in range(40)], "recovered int, label int")
    assert tuple(measures.rand_arand_jaccard(df).first()) == pytest.approx((1, 1, 1))


@pytest.mark.parametrize("n", [2, 3, 10])
def test_folds_deal_each_class_in_turn(spark, n):
    labels = [1] * 20 + [2] * 30 + [3] * 20
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label int")
    rows = folds.fold_assign(df, n).orderBy("id").collect()
    seen = {}
    for r in rows:
        assert r.fold == seen.get(r.label, 0) % n
        seen[r.label] = seen.get(r.label, 0) + 1
    train, test = folds.get_fold(folds.fold_assign(df, n), 1)
    assert train.count() + test.count() == 70


def test_fold_count(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(8)], "id long, label int")
    assert folds.fold_count(df, None, "label") == 4
    with pytest.warns(UserWarning):
        assert folds.fold_count(df, 9, "label") == 4
    with pytest.raises(ValueError):
        folds.fold_count(df.limit(1), None, "label")


def test_origins_stay_together(spark):
    rows = [(k, k // 39 if k < 117 else 2, k // 3) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, origin int")
    got = folds.fold_origins(df, 3).select("origin", "fold").distinct().collect()
    assert len(got) == len({r.origin for r in got}) == 40
    weights = spark.createDataFrame([(k, 0, o) for k, o in enumerate([0] * 5 + [1] * 3 + [2] * 2 + [3])], "id long, label int, origin int")
    placed = {r.origin: r.fold for r in folds.fold_origins(weights, 2).collect()}
    assert placed == {3: 0, 2: 1, 1: 0, 0: 1}
    with pytest.raises(ValueError):
        folds.fold_origins(df.withColumn("label", df.id % 2), 3)


def test_multi_label_folds_balance(spark):
    rng = random.Random(30)
    rows = [(k, [x for x, p in enumerate((0.24, 0.5, 0.1, 0.44)) if rng.random() < p]) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, labels array<int>")
    got = folds.fold_multi_label(df, 3).collect()
    assert len(got) == 100
    for x in range(4):
        n = [sum(x in r.labels for r in got if r.fold == f) for f in range(3)]
        assert max(n) - min(n) <= 6


def test_cross_validation_covers_all_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(size=3) + 3 * (k % 3)).tolist(), f"c{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label string")
    for learner in (NearestExemplar(), KNN(k=3)):
        cells, predictions = folds.nfold_crossvalidation(df, learner, 3)
        assert predictions.count() == 60
        assert sum(r.n for r in cells.collect() if r.real == r.predicted) > 50
