"""Queries that made more than their result needs: what they read or rank is counted, and their rows are as before."""

import numpy as np
from pyspark.sql import functions as F

from fernwerk.operators import factor, folds, pairwise, preprocess, select, trees
from fernwerk.plans import catalogue


def vectors(spark, n=60, d=4, seed=2):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(x.tolist())], "id long, features array<double>, label long")


def test_ranges_are_found_by_halving(spark):
    cuts = sorted({float(c) for c in np.random.default_rng(1).integers(0, 500, 150)})
    values = [None, -1.0, *map(float, range(0, 501, 3)), *cuts]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(folds.range_of(F.col("v"), cuts)).collect()]
    assert got == [0 if v is None else int(np.searchsorted(cuts, v, side="right")) for v in values]


def test_rank_correlation_ranks_its_rows_once(spark):
    plan = select.rank_corr(vectors(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def test_scaling_of_rows_measures_them_to_drawn_ids_only(spark, monkeypatch):
    rows, sizes, pdist = vectors(spark), [], pairwise.pdist
    monkeypatch.setattr(factor, "CANDIDATES", 12)
    want = {r.id: r.features for r in factor.mds_dists(pdist(rows), 3, landmarks=8, exact=10).collect()}

    def spy(x, y=None, *rest, **columns):
        sizes.append((y or x).count())
        return pdist(x, y, *rest, **columns)

    monkeypatch.setattr(factor, "pdist", spy)
    got = {r.id: r.features for r in factor.mds_rows(rows, 3, landmarks=8, exact=10).collect()}
    assert sorted(sizes) == [8, 12] and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_the_kernel_query_makes_its_own_pairs_only(spark, sf_dir, monkeypatch):
    made, dot = [], pairwise.dot_kernel

    def spy(x, y=None):
        made.append(dot(x, y).count())
        return dot(x, y)

    monkeypatch.setattr(pairwise, "dot_kernel", spy)
    got = catalogue.QUERIES["precomputed_kernel"](spark, sf_dir).count()
    assert made == [got]


def in_places(df):
    return sorted((r.id, r.p) for r in df.select("*", F.spark_partition_id().alias("p")).collect())


def test_rows_stay_where_they_are_when_labels_are_numbered(spark):
    """A join by label puts each class into one task."""
    rows = vectors(spark).repartition(8, "id").persist()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered, names = preprocess.normalise_labels(rows)
        two, found = trees.two_names(rows.withColumn("label", F.when(F.col("label") < 2, F.col("label").cast("string"))), "label")
        assert in_places(numbered) == in_places(rows) == in_places(two)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        rows.unpersist()
    assert [r.number for r in numbered.orderBy("id").limit(4).collect()] == [0, 1, 2, 0] and names.count() == 3
    assert found == ["0", "1"] and [r.y for r in two.orderBy("id").limit(4).collect()] == [0.0, 1.0, None, 0.0]


def test_windows_of_doubled_widths_are_squares(monkeypatch):
    made, window = [], pairwise.window
    monkeypatch.setattr(pairwise, "window", lambda d, scale: made.append(scale) or window(d, scale))
    d = np.random.default_rng(4).uniform(0, 4, (5, 7))
    scales = [0.25, 2.0, 0.5, 0.5, 0.3, 1.0]
    got = {k: w.copy() for k, w in pairwise.windows(d, scales)}
    assert all(np.allclose(got[k], np.exp(-d / v), rtol=1e-13, atol=0) for k, v in enumerate(scales)) and len(got) == 6
    assert made == [2.0, 0.3, 0.25]
