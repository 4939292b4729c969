"""The library's operators as queries over the tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import base, cluster, compose, cuts, factor, folds, graph, linear, measures, pairwise, preprocess, select, tasks, trees, tuning
from ..sources.scratch import stored
from ..sources.tables import assemble, embeddings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EMB = "e as (select vec_id id, cast(embedding as double[]) v, cast(label as bigint) label from embeddings)"
LINE = "l as (select l_orderkey * 10 + l_linenumber id, l_quantity q, l_extendedprice p, l_discount d, l_tax t, l_returnflag rf from lineitem)"
SCORED = "v as (select cast(l.quality as double) y, cast(d.n_chars as double) s from labels l join documents d on l.doc_id = d.doc_id)"
NAN = "cast('nan' as double)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return assemble(rows, columns or ("l_quantity", "l_extendedprice", "l_discount")).select("id", "features", F.col("l_returnflag").alias("label"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")


def r6(c):
    return F.round(c, 6) + 0.0


def spread(df: DataFrame, *keys: str, names: str = "abcdefgh", n: int = 3) -> DataFrame:
    return df.select(*keys, *(r6(F.col("features")[k]).alias(names[k]) for k in range(n)))


# -- preprocessing ----------------------------------------------------------------------------------


@query("select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as bigint) number from customer")
def normalise_labels(spark, sf):
    got, _ = preprocess.normalise_labels(table(spark, sf, "customer"), "c_mktsegment")
    return got.select("c_custkey", "number")


Z = "coalesce((%s - avg(%s) over ()) / coalesce(nullif(stddev_pop(%s) over (), 0), 1), null)"


@query(f"with {LINE} select id, round({Z % ('q', 'q', 'q')}, 6) + 0.0 a, round({Z % ('p', 'p', 'p')}, 6) + 0.0 b, round({Z % ('d', 'd', 'd')}, 6) + 0.0 c from l")
def zscore(spark, sf):
    return spread(preprocess.zscore(lines(spark, sf)), "id")


@query(f"with {LINE}, n as (select id, case when cast(q as int) % 7 = 0 then null else q end q from l) select id, round({Z % ('q', 'q', 'q')}, 6) + 0.0 a from n")
def zscore_nan(spark, sf):
    rows = lines(spark, sf, "l_quantity").withColumn("features", F.transform("features", lambda x: F.when(x.cast("int") % 7 == 0, float("nan")).otherwise(x)))
    return preprocess.zscore(rows).select("id", r6(V.known(F.col("features")[0])).alias("a"))


@query(f"with {EMB}, m as (select id, v, list_avg(v) m, sqrt(list_avg(list_transform(v, lambda x: (x - list_avg(v)) ** 2))) s from e) select id, round((v[1] - m) / s, 6) + 0.0 a, round((v[64] - m) / s, 6) + 0.0 b from m")
def zscore_rows(spark, sf):
    got = preprocess.zscore(embeddings(spark, sf), axis=1)
    return got.select("id", r6(F.col("features")[0]).alias("a"), r6(F.col("features")[63]).alias("b"))


@query(f"with {LINE} select id, round(q - avg(q) over (), 8) + 0.0 a, round(p - avg(p) over (), 8) + 0.0 b, round(d - avg(d) over (), 8) + 0.0 c from l")
def center(spark, sf):
    got, _ = preprocess.center(lines(spark, sf))
    return got.select("id", *((F.round(F.col("features")[k], 8) + 0.0).alias(n) for k, n in enumerate("abc")))


I = "(%s - (min(%s) over () + (max(%s) over () - min(%s) over ()) / 2)) / ((max(%s) over () - min(%s) over ()) / 2)"  # noqa: E741


@query(f"with {LINE} select id, round({I.replace('%s', 'q')}, 6) + 0.0 a, round({I.replace('%s', 'p')}, 6) + 0.0 b, round({I.replace('%s', 'd')}, 6) + 0.0 c from l")
def interval_normalise(spark, sf):
    rows = lines(spark, sf)
    return spread(preprocess.IntervalNormalise().fit(rows).transform(rows), "id")


@query(f"with {LINE} select id, case when cast(q as int) % 5 = 0 or cast(q as int) % 7 = 0 then 0.0 else q end a from l")
def chkfinite(spark, sf):
    broken = lambda x: F.when(x.cast("int") % 5 == 0, float("inf")).when(x.cast("int") % 7 == 0, float("nan")).otherwise(x)
    rows = lines(spark, sf, "l_quantity").withColumn("features", F.transform("features", broken))
    return preprocess.ChkFinite().transform(rows).select("id", F.col("features")[0].alias("a"))


@query(f"with {LINE}, r as (select id, rf, row_number() over (partition by rf order by id) k from l), m as (select min(n) n from (select count(*) n from l group by rf)) select id, rf as label from r, m where k <= 2 * n")
def sample_to_2min(spark, sf):
    return preprocess.sample_to_2min(lines(spark, sf)).select("id", "label")


@query("""
with v as (select event_id, user_id, value x from events where value is not null),
z as (select *, pow((x - avg(x) over (partition by user_id)) / coalesce(nullif(stddev_pop(x) over (partition by user_id), 0), 1), 2) s, count(*) over (partition by user_id) n from v),
r as (select *, row_number() over (partition by user_id order by s, event_id) - 1 k, floor(n * 0.9::double) w from z),
w as (select *, max(case when k = w then s end) over (partition by user_id) edge from r)
select event_id, user_id from w where w < 3 or s < edge
""")
def filter_outliers(spark, sf):
    rows = assemble(table(spark, sf, "events").filter("value is not null"), ["value"])
    return preprocess.filter_outliers(rows, "user_id", id="event_id", dims=1).select("event_id", "user_id")


@query("""
with u as (select distinct event_type t from events where props like '%1%'), a as (select list(t order by t) ts from u),
g as (select user_id, list(distinct event_type) s from events group by user_id)
select user_id, array_to_string(list_concat(list_transform(ts, lambda t: case when list_contains(s, t) then '1' else '0' end), [case when len(list_filter(s, lambda x: not list_contains(ts, x))) > 0 then '1' else '0' end]), '') flags from g, a
""")
def set2binary(spark, sf):
    events = table(spark, sf, "events")
    train = events.filter("props like '%1%'").groupBy("user_id").agg(F.collect_set("event_type").alias("features"))
    every = events.groupBy("user_id").agg(F.collect_set("event_type").alias("features"))
    got = preprocess.Set2Binary().fit(train).transform(every)
    return got.select("user_id", F.array_join(F.transform("features", lambda x: F.when(x, "1").otherwise("0")), "").alias("flags"))


@query("with g as (select c_custkey, c_acctbal from customer) select c_custkey, c_acctbal >= 5000 as prediction from g")
def fixed_threshold(spark, sf):
    return preprocess.Threshold(features="c_acctbal", threshold=5000.0).transform(table(spark, sf, "customer")).select("c_custkey", "prediction")


@query(f"with {LINE} select id, p a, q b from l")
def filter_features(spark, sf):
    return preprocess.FilterFeatures(indices=[1, 0]).transform(lines(spark, sf)).select("id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


# -- folds and measures -----------------------------------------------------------------------------


@query(f"with {EMB} select id, label, cast((row_number() over (partition by label order by id) - 1) % 10 as int) fold from e")
def fold_assign(spark, sf):
    return folds.fold_assign(embeddings(spark, sf), 10).select("id", "label", "fold")


@query("""
with o as (select user_id, user_id % 3 label, count(*) n from events group by user_id),
one as (select user_id, label from o),
f as (select user_id, cast((row_number() over (partition by label order by user_id) - 1) % 5 as int) fold from one)
select user_id, fold from f
""")
def fold_origins(spark, sf):
    users = table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).alias("label")).distinct()
    return folds.fold_origins(users, 5, origin="user_id").select("user_id", "fold")


PREDICTED = "p as (select label as real, (label + case when vec_id % 3 = 0 then 1 else 0 end) % 10 as predicted from embeddings)"


def predicted(spark, sf):
    shift = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    return embeddings(spark, sf).select(F.col("label").alias("real"), ((F.col("label") + shift) % 10).alias("predicted"))


@query(f"with {PREDICTED}, n as (select distinct real from p), x as (select a.real, b.real predicted from n a, n b) select cast(x.real as bigint) as real, cast(x.predicted as bigint) predicted, count(p.real) n from x left join p on p.real = x.real and p.predicted = x.predicted group by 1, 2")
def confusion(spark, sf):
    return measures.confusion_matrix(predicted(spark, sf), whole=True)


@query(f"with {PREDICTED} select round(avg(cast(real = predicted as int)), 6) accuracy from p")
def accuracy(spark, sf):
    return measures.accuracy(predicted(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"with {PREDICTED}, c as (select avg(cast(real = predicted as int)) r from p group by real) select round(avg(r), 6) waccuracy from c")
def waccuracy(spark, sf):
    return measures.waccuracy(predicted(spark, sf)).select(F.round("waccuracy", 6).alias("waccuracy"))


@query(f"with {PREDICTED} select cast(sum(cast(real <> predicted as int)) as bigint) loss from p")
def zero_one_loss(spark, sf):
    return measures.zero_one_loss(predicted(spark, sf))


@query("""
with r as (select .0001::double + k * (.9998::double / 99) r, k from range(100) t(k)),
m as (select a.k i, b.k j, 60 * ln(a.r) + 40 * ln(1 - a.r) + 55 * ln(b.r) + 45 * ln(1 - b.r) lp from r a cross join r b),
z as (select i, j, exp(lp - max(lp) over ()) e from m),
s as (select sum(case when i > j then e when i = j then e / 2 end) / sum(e) s from z)
select round(least(s, 1 - s), 6) significance from s
""")
def bayes_significance(spark, sf):
    return measures.bayesian_significance(spark, 100, 60, 55).select(F.round("significance", 6).alias("significance"))


CURVE = f"with {SCORED}, g as (select s, sum(y) p, sum(1 - y) n from v group by s), c as (select s, sum(p) over (order by s desc) p, sum(n) over (order by s desc) n, sum(p) over () pt, sum(n) over () nt from g)"


@query(f"{CURVE} select s threshold, round(n / nt, 6) fpr, round(p / pt, 6) tpr from c")
def roc(spark, sf):
    got = measures.roc(scored(spark, sf))
    return got.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"{CURVE} select s threshold, round(p / (p + n), 6) as precision, round(p / pt, 6) recall from c")
def precision_recall(spark, sf):
    got = measures.precision_recall(scored(spark, sf))
    return got.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"with {SCORED}, x as (select min(s) lo, max(s) hi, sum(y) pt from v), g as (select lo + k * ((hi - lo) / 49) t, pt, k from x, range(50) r(k)) select round(t, 6) threshold, round(sum(y) / count(*), 6) as precision, round(sum(y) / pt, 6) recall from g join v on s >= t group by t, pt")
def pr_steps(spark, sf):
    got = measures.precision_recall(scored(spark, sf), mode="steps", steps=50)
    return got.select(F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
with v as (select cast(vec_id % 7 as bigint) a, cast(label as bigint) b from embeddings),
c as (select a, b, cast(count(*) as double) n, grouping(a) ga, grouping(b) gb from v group by grouping sets ((a, b), (a), (b), ())),
s as (select sum(case when ga = 0 and gb = 0 then n * (n - 1) / 2 end) ij, sum(case when ga = 0 and gb = 1 then n * (n - 1) / 2 end) i,
             sum(case when ga = 1 and gb = 0 then n * (n - 1) / 2 end) j, sum(case when ga = 1 and gb = 1 then n * (n - 1) / 2 end) t from c)
select round((t + 2 * ij - i - j) / t, 6) rand, round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) arand, round(ij / (i + j - ij), 6) jaccard from s
""")
def rand_index(spark, sf):
    got = measures.rand_arand_jaccard(embeddings(spark, sf).select((F.col("id") % 7).alias("recovered"), "label"))
    return got.select(*(F.round(c, 6).alias(c) for c in ("rand", "arand", "jaccard")))


# -- pairs ------------------------------------------------------------------------------------------


@query(f"with {EMB} select a.id i, b.id j, round(list_distance(a.v, b.v) ** 2, 6) + 0.0 d from e a, e b")
def pdist(spark, sf):
    return pairwise.pdist(embeddings(spark, sf)).select("i", "j", r6(F.col("d")).alias("d"))


@query(f"with {EMB} select a.id i, b.id j, round(list_distance(a.v, b.v), 6) + 0.0 d from e a, e b where b.label = 0")
def pdist_xy(spark, sf):
    e = embeddings(spark, sf)
    return pairwise.pdist(e, e.filter("label = 0"), "euclidean").select("i", "j", r6(F.col("d")).alias("d"))


@query(f"with {EMB}, d as (select a.id i, b.id j, list_distance(a.v, b.v) ** 2 d from e a, e b), m as (select median(d) m from d) select i, j, round(exp(-d / m), 6) s from d, m")
def plike(spark, sf):
    return pairwise.plike(embeddings(spark, sf)).select("i", "j", F.round("s", 6).alias("s"))


KNN = """
d as (select q.id q, b.id id, b.label label, row_number() over (partition by q.id order by round(list_distance(q.{v}, b.{v}) ** 2, 14), b.id) k from {t} q, {t} b),
c as (select q, label, count(*) n, min(k) f from d where k <= 5 group by q, label)
select q id, arg_max(label, (n, -f)) prediction from c group by q
"""


@query(f"with {EMB}, {KNN.format(v='v', t='e')}")
def knn_classify(spark, sf):
    e = embeddings(spark, sf)
    return pairwise.KNN(k=5).fit(e).transform(e).select("id", "prediction")


MATRIX = [[((7 * i + 3 * j) % 11) / 11 for j in range(8)] for i in range(64)]
PROJECT = "x as (select id, label, [" + ", ".join(f"list_dot_product(v, list_transform(range(64), lambda i: ((7 * i + 3 * {j}) % 11) / 11.0::double))" for j in range(8)) + "] w from e)"


@query(f"with {EMB}, {PROJECT}, {KNN.format(v='w', t='x')}")
def approx_knn(spark, sf):
    e = embeddings(spark, sf)
    return pairwise.ApproximateKNN(k=5, matrix=MATRIX).fit(e).transform(e).select("id", "prediction")


@query(f"with {EMB} select a.id i, b.id j, round(2 * exp(-(list_distance(a.v, b.v) ** 2) / 0.7), 6) k from e a, e b")
def rbf_kernel(spark, sf):
    return pairwise.rbf_kernel(embeddings(spark, sf), None, 0.7, 2.0).select("i", "j", F.round("k", 6).alias("k"))


@query(f"with {EMB} select a.id i, b.id j, round(pow(list_dot_product(a.v, b.v) + 1, 3), 6) + 0.0 k from e a, e b")
def poly_kernel(spark, sf):
    return pairwise.polynomial_kernel(embeddings(spark, sf), None, 3).select("i", "j", r6(F.col("k")).alias("k"))


@query(f"with {EMB} select a.id i, b.id j, round(list_dot_product(a.v, b.v), 6) + 0.0 k from e a, e b")
def dot_kernel(spark, sf):
    return pairwise.dot_kernel(embeddings(spark, sf)).select("i", "j", r6(F.col("k")).alias("k"))


@query(f"with {EMB} select a.id i, b.id j, round(list_dot_product(a.v, b.v), 6) + 0.0 k from e a, e b where a.label = 1 and b.label = 2")
def precomputed_kernel(spark, sf):
    e = embeddings(spark, sf)
    return pairwise.precomputed_kernel(e.filter("label = 1"), e.filter("label = 2"), pairwise.dot_kernel(e.filter("label = 1"), e.filter("label = 2"))).select("i", "j", r6(F.col("k")).alias("k"))


SIGMAS = [0.25, 0.5, 1.0, 2.0]
FISHER = f"with {EMB}, y as (select id, v, cast(label < 5 as int) y from e), d as (select a.y ya, b.y yb, list_distance(a.v, b.v) ** 2 d from y a, y b), n as (select cast(sum(1 - y) as double) n1, cast(sum(y) as double) n2 from y), s as (select sg, ya, yb, sum(exp(-d / sg)) s from d, (select unnest({SIGMAS}::double[]) sg) group by sg, ya, yb), c as (select sg, max(case when ya = 0 and yb = 0 then s end) / any_value(n1) c1, max(case when ya = 1 and yb = 1 then s end) / any_value(n2) c2, max(case when ya = 0 and yb = 1 then s end) / any_value(n1 * n2) c12, any_value(n1) n1, any_value(n2) n2 from s, n group by sg) select sg sigma, round((n1 + n2 - c1 - c2) / (c1 / n1 + c2 / n2 - 2 * c12), 5) f from c"


@query(FISHER)
def fisher_sigma(spark, sf):
    e = embeddings(spark, sf).withColumn("label", (F.col("label") < 5).cast("int"))
    return pairwise.fisher_criterion(e, SIGMAS).select("sigma", F.round("f", 5).alias("f"))


@query(f"with {EMB}, y as (select id, v, cast(label < 5 as int) y from e) select a.id id, a.y as label, cast(sum(exp(-(list_distance(a.v, b.v) ** 2) / 0.5) * (2 * b.y - 1)) > 0 as int) prediction from y a join y b on a.id <> b.id group by a.id, a.y")
def parzen_loocv(spark, sf):
    return pairwise.parzen_loocv(embeddings(spark, sf).withColumn("label", (F.col("label") < 5).cast("int")), 0.5)


@query(f"with {EMB}, d as (select list_distance(a.v, b.v) ** 2 d from e a join e b on a.id <> b.id), k as (select d, exp(-d / 1.0) / sqrt(pi()) k from d) select round(sum(k), 4) f, round(sum(k * (d / 0.5 - 1.0)), 4) fprime from k")
def parzen_1class(spark, sf):
    return pairwise.parzen_1class(embeddings(spark, sf), 0.5).select(F.round("f", 4).alias("f"), F.round("fprime", 4).alias("fprime"))


@query(f"with {EMB} select a.id i, round(avg(exp(-(list_distance(a.v, b.v) ** 2))), 6) density from e a, e b group by a.id")
def parzen_density(spark, sf):
    import math

    e = embeddings(spark, sf)
    return pairwise.parzen_density(e, e, 0.5).select("i", F.round(F.col("density") * math.pi**32, 6).alias("density"))


# -- clusters ---------------------------------------------------------------------------------------


def first_rows(spark, sf, n):
    return [r["features"] for r in embeddings(spark, sf).filter(F.col("id") < n).orderBy("id").collect()]


def lloyd_sql(source: str, steps: int, k: int = 4) -> str:
    """CTEs a{s} (id, v, k) and c{s} (k, c) of Lloyd's iteration over source (id, v)."""
    out = [f"c0 as (select id k, v c from {source} where id < {k})"]
    for s in range(steps + 1):
        out.append(f"a{s} as (select x.id, any_value(x.v) v, arg_min(c.k, (round(list_distance(x.v, c.c) ** 2, 13), c.k)) k from {source} x, c{s} c group by x.id)")
        if s < steps:
            out.append(f"u{s} as (select k, unnest(v) x, unnest(range(len(v))) j from a{s}), m{s} as (select k, j, avg(x) x from u{s} group by k, j), c{s + 1} as (select k, list(x order by j) c from m{s} group by k)")
    return ", ".join(out)


@query(f"with {EMB}, {lloyd_sql('e', 3)} select k as cluster, count(*) n, round(sum(list_distance(a3.v, c3.c) ** 2), 6) error from a3 join c3 using (k) group by k")
def kmeans_iter3(spark, sf):
    got, centroids = cluster.kmeans(embeddings(spark, sf), 4, max_iter=3, centroids=first_rows(spark, sf, 4))
    sizes = got.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(cluster.centroid_errors(got, centroids).withColumn("cluster", F.col("cluster").cast("long")), "cluster").select("cluster", "n", F.round("error", 6).alias("error"))


@query(f"with {EMB}, u as (select id, unnest(v) x, unnest(range(64)) j from e), s as (select j, avg(x) m, stddev_pop(x) s from u group by j), z as (select id, list((x - m) / s order by j) v from u join s using (j) group by id), {lloyd_sql('z', 3)} select k as cluster, count(*) n from a3 group by k")
def kmeans_seuclidean(spark, sf):
    got, _ = cluster.kmeans(embeddings(spark, sf), 4, "seuclidean", max_iter=3, centroids=first_rows(spark, sf, 4))
    return got.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans_mahalanobis(spark, sf):
    got, _ = cluster.kmeans(embeddings(spark, sf), 4, "mahalanobis", max_iter=20, seed=1)
    return got.select("id", "cluster")


@query()
def kmeans_best(spark, sf):
    got, _ = cluster.select_best_kmeans(embeddings(spark, sf), [2, 10], 1, "AIC", max_iter=20)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


NEAR = "c as (select id k, v c from e where id < 6), a as (select x.id, any_value(x.label) label, any_value(x.v) v, arg_min(c.k, (round(list_distance(x.v, c.c) ** 2, 13), c.k)) k from e x, c group by x.id)"


@query(f"with {EMB}, {NEAR} select cast(c.k as int) as cluster, count(a.k) n from c left join a on a.k = c.k group by c.k")
def assign_histogram(spark, sf):
    return cluster.histogram(embeddings(spark, sf), first_rows(spark, sf, 6))


@query(f"with {EMB}, {NEAR} select round(sum(list_distance(a.v, c.c) ** 2), 6) rss from a join c on a.k = c.k")
def rss(spark, sf):
    c = first_rows(spark, sf, 6)
    return spark.range(1).select(F.round(F.lit(cluster.residual_sum_squares(cluster.assign_centroids(embeddings(spark, sf), c), c)), 6).alias("rss"))


@query(f"with {EMB}, {NEAR}, s as (select c.k, count(*) n, sum(list_distance(a.v, c.c) ** 2) r from a join c on a.k = c.k group by c.k), t as (select sum(n) n, sum(r) r, sum(n * ln(r / n)) g from s), x as (select n, -n / 2.0::double * ln(2 * pi() * r / n) - n / 2.0::double l1, -n / 2.0::double * ln(2 * pi()) - n / 2.0::double - g / 2 l2 from t) select round(-2 * l1 + 2 * (6 * 64 + 1), 4) aic, round(-2 * l1 + (6 * 64 + 1) * ln(n), 4) bic, round(-2 * l2 + 2 * (6 * 65), 4) aic_diagonal from x")
def aic_bic(spark, sf):
    c = first_rows(spark, sf, 6)
    got = cluster.assign_centroids(embeddings(spark, sf), c).cache()
    one = [cluster.information_criterion(got, c, "AIC"), cluster.information_criterion(got, c, "BIC"), cluster.information_criterion(got, c, "AIC", "diagonal_covariance")]
    return spark.createDataFrame([tuple(one)], "aic double, bic double, aic_diagonal double").select(*(F.round(x, 4).alias(x) for x in ("aic", "bic", "aic_diagonal")))


@query(f"with {EMB}, {NEAR}, t as (select label, count(*) n from a group by label), h as (select t.label, c.k, t.n, count(a.k) m from t cross join c left join a on a.k = c.k and a.label = t.label group by t.label, c.k, t.n) select label as group_id, cast(k as int) as cluster, round(cast(m as double) / n, 6) n from h")
def precluster_hist(spark, sf):
    e = embeddings(spark, sf).withColumnRenamed("label", "group_id")
    return cluster.histogram(e, first_rows(spark, sf, 6), "group_id", True).select("group_id", "cluster", F.round("n", 6).alias("n"))


@query(f"with {EMB}, {NEAR} select id, cast(k // 3 as int) y, cast(k % 3 as int) x from a")
def som_closest(spark, sf):
    import numpy as np

    return graph.som_closest(embeddings(spark, sf), np.array(first_rows(spark, sf, 6)).reshape(2, 3, -1)).select("id", "y", "x")


# -- trees and boosting -----------------------------------------------------------------------------


@query("with c as (select c_mktsegment, cast(count(*) as double) n from customer group by 1), t as (select sum(n) t from c) select round(-sum(n / t * ln(n / t)), 6) entropy from c, t")
def entropy(spark, sf):
    return trees.set_entropy(table(spark, sf, "customer"), "c_mktsegment").select(F.round("entropy", 6).alias("entropy"))


def xlx(p: str) -> str:
    return f"(case when {p} > 0 then ({p}) * ln({p}) else 0.0 end)"


def side(p: str, n: str) -> str:
    return f"(({n}) / nt * ({xlx(f'({p}) / ({n})')} + {xlx(f'(({n}) - ({p})) / ({n})')}))"


GAIN = f"({side('pl', 'nl')} + {side('pt - pl', 'nt - nl')})"
LOSS = "-(least(pl, nl - pl) + least(pt - pl, nt - nl - pt + pl))"


def split_sql(name: str, source: str, gain: str) -> str:
    """CTEs {name}_w (f, x, pl, nl, pt, nt, gain) and {name} (its best row) over source (x0, x1, y, w)."""
    return f"""
{name}_g as (select f, x, sum(y * w) p, sum(w) n from (select 0 f, x0 x, y, w from {source} union all select 1, x1, y, w from {source}) group by f, x),
{name}_r as (select f, x, sum(p) over (partition by f order by x rows between unbounded preceding and 1 preceding) pl, sum(n) over (partition by f order by x rows between unbounded preceding and 1 preceding) nl,
       sum(p) over (partition by f) pt, sum(n) over (partition by f) nt from {name}_g),
{name}_w as (select *, {gain} gain from {name}_r where nl > 0),
{name} as (select * from {name}_w order by round(gain, 12) desc, f, x limit 1)"""


DATA = "d as (select l_orderkey * 10 + l_linenumber id, l_quantity x0, l_discount x1, case when l_returnflag = 'R' then 1.0 else 0.0 end y, 1.0::double w from lineitem)"


def binary_lines(spark, sf):
    return lines(spark, sf, "l_quantity", "l_discount").withColumn("label", (F.col("label") == "R").cast("int"))


@query(f"with {DATA}, {split_sql('s', 'd', GAIN)} select f as feature, x cutoff, round(gain, 6) + 0.0 gain from s_w")
def info_gain_split(spark, sf):
    return trees.splits(binary_lines(spark, sf), trees.information_gain, y="label").select("feature", "cutoff", r6(F.col("gain")).alias("gain"))


@query(f"with {DATA}, {split_sql('s', 'd', LOSS)} select f as feature, x cutoff, round(-gain, 6) loss from s_w")
def z1_loss_split(spark, sf):
    return trees.splits(binary_lines(spark, sf), trees.neg_z1_loss, y="label").select("feature", "cutoff", F.round(-F.col("gain"), 6).alias("loss"))


DEAR = "d as (select l_orderkey * 10 + l_linenumber id, l_quantity x0, l_extendedprice x1, case when l_extendedprice * (1 - l_discount) > 30000 then 1.0 else 0.0 end y, 1.0::double w from lineitem)"


def dear_lines(spark, sf):
    rows = table(spark, sf, "lineitem")
    dear = (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000).cast("int")
    return assemble(rows, ["l_quantity", "l_extendedprice"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "features", dear.alias("label"))


@query(f"with {DEAR}, {split_sql('s', 'd', LOSS)} select id, cast(case when (case when f = 0 then x0 else x1 end >= x) <> ((pt - pl) / (nt - nl) < pl / nl) then 1 else 0 end as bigint) prediction from d, s")
def stump(spark, sf):
    rows = dear_lines(spark, sf)
    return trees.StumpLearner().fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("prediction"))


def tree2_sql() -> str:
    parts = [DEAR, split_sql("s", "d", GAIN), "m as (select d.*, (case when s.f = 0 then x0 else x1 end < s.x) lft from d, s)", "a as (select * from m where lft)", "b as (select * from m where not lft)"]
    parts += [split_sql("sa", "a", GAIN), split_sql("sb", "b", GAIN)]
    leaf = "case when (case when q.f = 0 then x0 else x1 end) < q.x then q.pl / q.nl else (q.pt - q.pl) / (q.nt - q.nl) end"
    return "with " + ", ".join(parts) + f" select id, round({leaf}, 6) prediction from a, sa q union all select id, round({leaf}, 6) from b, sb q"


@query(tree2_sql())
def tree_depth2(spark, sf):
    rows = dear_lines(spark, sf)
    return trees.TreeLearner(max_depth=2, return_label=False).fit(rows).transform(rows).select("id", F.round("prediction", 6).alias("prediction"))


def boost_sql(rounds: int = 2) -> str:
    parts = [DEAR, "n as (select cast(count(*) as double) n from d)", "d0 as (select id, x0, x1, y, 1 / n w, 0.0::double v, 0.0::double total from d, n)"]
    for r in range(rounds):
        parts.append(split_sql(f"s{r}", f"d{r}", LOSS))
        parts.append(f"p{r} as (select d.*, case when (case when f = 0 then x0 else x1 end >= x) <> ((pt - pl) / (nt - nl) < pl / nl) then 1.0 else 0.0 end h from d{r} d, s{r})")
        parts.append(f"a{r} as (select 0.5 * ln((1 - e) / e) a from (select sum(case when h <> y then w else 0.0 end) e from p{r}))")
        parts.append(f"t{r} as (select id, x0, x1, y, w * exp(case when h <> y then a else -a end) w, v + a * h v, total + a total from p{r}, a{r})")
        parts.append(f"d{r + 1} as (select id, x0, x1, y, w / sum(w) over () w, v, total from t{r})")
    return "with " + ", ".join(parts) + f" select id, cast(case when v > total / 2 then 1 else 0 end as bigint) prediction from d{rounds}"


@query(boost_sql())
def adaboost_rounds(spark, sf):
    rows = dear_lines(spark, sf)
    return trees.BoostLearner(trees.StumpLearner(), max_iters=2).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("prediction"))


def vote_sql(rounds: int = 3) -> str:
    parts = [DEAR, "n as (select cast(count(*) as double) n from d)", "d0 as (select id, x0, x1, y, 1 / n w, 0.0::double v0, 0.0::double v1 from d, n)"]
    for r in range(rounds):
        parts.append(split_sql(f"s{r}", f"d{r}", LOSS))
        parts.append(f"p{r} as (select d.*, case when (case when f = 0 then x0 else x1 end >= x) <> ((pt - pl) / (nt - nl) < pl / nl) then 1.0 else 0.0 end h from d{r} d, s{r})")
        parts.append(f"a{r} as (select 0.5 * ln((1 - e) / e) a from (select sum(case when h <> y then w else 0.0 end) e from p{r}))")
        parts.append(f"t{r} as (select id, x0, x1, y, w * case when h <> y then exp(a) else 1.0 end w, v0 + a * (1 - h) v0, v1 + a * h v1 from p{r}, a{r})")
        parts.append(f"d{r + 1} as (select id, x0, x1, y, w / sum(w) over () w, v0, v1 from t{r})")
    return "with " + ", ".join(parts) + f" select id, cast(case when v1 > v0 then 1 else 0 end as int) prediction from d{rounds}"


@query(vote_sql())
def weighted_vote(spark, sf):
    rows = dear_lines(spark, sf)
    return trees.WeightedVotingBoost(trees.StumpLearner(), 3).fit(rows).transform(rows).select("id", "prediction")


PRICES = [float(p) for p in range(5_000, 100_000, 5_000)]


@query(f"""
with {DEAR}, k as (select case when x0 < 24 then 1 else 2 end node, x0, x1, y from d), p as (select unnest({PRICES}::double[]) e),
r as (select k.node, 1 feature, (select count(*) from p where p.e <= k.x1) r, y from k union all select node, 0, cast(floor(x0 / 8) as bigint), y from k)
select cast(node as int) node, cast(feature as int) feature, cast(r as int) r, sum(y) p, cast(count(*) as double) n from r group by node, feature, r
""")
def range_sums(spark, sf):
    """What a level of a tree is grown from: rows and positives of each node, feature and range."""
    tree = cuts.Tree()
    left, right = tree.cut(0, 0, 24.0)
    search = cuts.CutSearch(trees.table_of(dear_lines(spark, sf), y="label"), [np.arange(8.0, 51.0, 8.0), np.array(PRICES)], trees.information_gain)
    return search.range_sums([tree], [(0, left, np.arange(2)), (0, right, np.arange(2))]).select("node", "feature", "r", "p", "n")


@query()
def random_forest(spark, sf):
    rows = dear_lines(spark, sf)
    return trees.ForestLearner(rf=5, max_depth=4, bins=32, return_label=False).fit(rows).transform(rows).select("id", "prediction")


# -- composition ------------------------------------------------------------------------------------


@query(f"""
with {EMB}, f as (select *, (row_number() over (partition by label order by id) - 1) % 10 fold from e), k as (select unnest(range(10)) fold),
x as (select k.fold, f.label, arg_min(f.v, f.id) c from f join k on f.fold <> k.fold group by k.fold, f.label),
p as (select f.id, any_value(f.label) as real, arg_min(x.label, (round(list_distance(f.v, x.c) ** 2, 14), x.label)) predicted from f join x on f.fold = x.fold group by f.id)
select real, predicted, count(*) n from p group by real, predicted
""")
def cv_nearest_exemplar(spark, sf):
    cells, _ = folds.nfold_crossvalidation(embeddings(spark, sf), pairwise.NearestExemplar(), 10)
    return cells


FOUR = "g as (select id, v, label % 4 label from e)"
ONE = "arg_min(v, id)"


def four(spark, sf):
    return embeddings(spark, sf).withColumn("label", F.col("label") % 4)


def exemplar_sql(problems: list[tuple[str, str, str]]) -> str:
    """x (id, k, yes): whether the exemplar of problem k's positive rows is nearer than that of the others (equal: not)."""
    parts = [f"select {k} k, (select {ONE} from g where {rows} and {pos}) p, (select {ONE} from g where {rows} and not ({pos})) n" for k, rows, pos in problems]
    return f"c as ({' union all '.join(parts)}), x as (select g.id, c.k, round(list_distance(g.v, c.p) ** 2, 14) < round(list_distance(g.v, c.n) ** 2, 14) yes from g, c)"


PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


@query(f"with {EMB}, {FOUR}, {exemplar_sql([(str(10 * a + b), f'label in ({a}, {b})', f'label = {a}') for a, b in PAIRS])}, w as (select id, case when yes then k // 10 else k % 10 end l from x), n as (select id, l, count(*) n from w group by id, l) select id, cast(arg_max(l, (n, -l)) as bigint) prediction from n group by id")
def one_vs_one_exemplar(spark, sf):
    rows = four(spark, sf)
    return compose.OneAgainstOne(pairwise.NearestExemplar()).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("prediction"))


@query(f"with {EMB}, {FOUR}, {exemplar_sql([(str(a), 'true', f'label = {a}') for a in range(4)])} select id, cast(coalesce(min(case when yes then k end), 0) as bigint) prediction from x group by id")
def one_vs_rest_exemplar(spark, sf):
    rows = four(spark, sf)
    return compose.OneAgainstRest(pairwise.NearestExemplar()).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("prediction"))


def ecoc_sql() -> str:
    codes = compose.ecoc_codes(4)
    problems = [(str(j), "true", "label in (" + ", ".join(str(c) for c in range(4) if codes[c, j]) + ")") for j in range(codes.shape[1])]
    table_rows = ", ".join(f"({c}, {j}, {str(bool(codes[c, j])).lower()})" for c in range(4) for j in range(codes.shape[1]))
    return f"with {EMB}, {FOUR}, {exemplar_sql(problems)}, t as (select * from (values {table_rows}) t(c, j, on_)), m as (select id, c, sum(cast(yes <> on_ as int)) d from x join t on x.k = t.j group by id, c) select id, cast(arg_min(c, (d, c)) as bigint) prediction from m group by id"


@query(ecoc_sql())
def ecoc_hamming(spark, sf):
    rows = four(spark, sf)
    return compose.Ecoc(pairwise.NearestExemplar()).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("prediction"))


@query(f"""
with {EMB}, f as (select *, (row_number() over (partition by label order by id) - 1) % 3 fold from e),
d as (select q.id q, q.label y, b.label label, row_number() over (partition by q.id order by round(list_distance(q.v, b.v) ** 2, 14), b.id) r from f q join f b on q.fold <> b.fold),
c as (select k, q, any_value(y) y, label, count(*) n, min(r) f from d, (select unnest([1, 3, 7]) k) where r <= k group by k, q, label),
p as (select k, q, any_value(y) y, arg_max(label, (n, -f)) p from c group by k, q)
select k, cast(sum(cast(y <> p as int)) as bigint) errors from p group by k
""")
def grid_search_knn_k(spark, sf):
    got = tuning.grid_errors(embeddings(spark, sf), pairwise.KNN(), {"k": [1, 3, 7]}, 3)
    return spark.createDataFrame([(o["k"], int(e)) for o, e in got], "k int, errors long")


ITEMS = "m as (select l_orderkey o, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey id, row_number() over () r, [round(l_quantity), round(l_discount * 100), round(l_tax * 100)]::double[] v, %s y from lineitem), x as (select y, arg_min(v, id) c from m group by y), p as (select r, any_value(o) o, any_value(id) n, arg_min(x.y, (round(list_distance(v, c) ** 2, 9), x.y)) p from m, x group by r)"


def items(spark: SparkSession, sf: str, label) -> DataFrame:
    """Order lines as members of their orders."""
    rows = table(spark, sf, "lineitem").withColumn("id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey"))
    v = F.array(*(F.round(F.col(c).cast("double") * k) for c, k in (("l_quantity", 1), ("l_discount", 100), ("l_tax", 100))))
    return rows.select("id", F.col("l_orderkey").alias("group_id"), F.col("id").alias("member_id"), v.alias("features"), label.alias("label"))


@query(f"with {ITEMS % 'l_returnflag'}, c as (select o, p, count(*) k, min(n) f from p group by o, p) select o as group_id, arg_max(p, (k, -f)) prediction from c group by o")
def group_voting(spark, sf):
    rows = items(spark, sf, F.col("l_returnflag"))
    return compose.Grouped(pairwise.NearestExemplar()).fit(rows).transform(rows)


@query(f"with {ITEMS % 'cast(l_returnflag = chr(82) as int)'} select o as group_id, round(avg(p), 6) prediction from p group by o")
def group_mean(spark, sf):
    rows = items(spark, sf, (F.col("l_returnflag") == "R").cast("int"))
    return compose.Grouped(pairwise.NearestExemplar(), how="mean").fit(rows).transform(rows).select("group_id", F.round("prediction", 6).alias("prediction"))


class Odds(base.Learner):
    """A caller's own probabilistic learner: the distances to the means of label 0 and 1, as a share."""

    def _fit(self, dataset):
        v = V.doubles(self.features)
        width = dataset.select(F.size(v)).first()[0]
        means = dataset.groupBy(self.label).agg(F.array(*(F.avg(v[k]) for k in range(width))).alias("m"))
        return OddsModel(**self._columns(), means={r[0]: r[1] for r in means.collect()})


class OddsModel(base.Fitted):
    def _transform(self, dataset):
        no, yes = (V.sqdist(V.doubles(self.features), V.lit_vector(self.means[k])) for k in (0, 1))
        return dataset.withColumn(self.prediction, no / (no + yes))


@query(f"""
with {EMB}, h as (select id, v, cast(label < 5 as int) y from e), w as (select 1 k, id, y, v[1:32] v from h union all select 2, id, y, v[33:64] from h),
u as (select k, y, unnest(v) x, generate_subscripts(v, 1) i from w), a as (select k, y, i, avg(x) x from u group by k, y, i), m as (select k, y, list(x order by i) c from a group by k, y),
o as (select w.id, ln(list_distance(w.v, n.c) ** 2 / list_distance(w.v, p.c) ** 2) o from w join m n on n.k = w.k and n.y = 0 join m p on p.k = w.k and p.y = 1)
select id, sum(o) > 0 prediction from o group by id
""")
def multi_view(spark, sf):
    """Halves of an embedding as views."""
    rows = halves(spark, sf).select("id", "label", F.slice("features", 1, 32).alias("first"), F.slice("features", 33, 32).alias("second"))
    return compose.MultiView([Odds(), Odds()], ["first", "second"]).fit(rows).transform(rows).select("id", "prediction")


# -- selection, scatter, uncertainty ----------------------------------------------------------------

RANKS = f"{EMB}, u as (select id, label, unnest(v) x, unnest(range(64)) f from e), r as (select f, label, cast(row_number() over (partition by f order by x, id) as double) r from u), s as (select f, label, count(*) m, sum(r) sy from r group by f, label), w as (select f, count(*) n, sum(r) s, sum(r * r) ss from r group by f), c as (select f, pow(sy / n - s / n * m / n, 2) / ((ss / n - pow(s / n, 2)) * (cast(m as double) / n) * (1 - cast(m as double) / n)) r from s join w using (f)), k as (select cast(f as int) feature, max(r) score from c group by f)"


@query(f"with {RANKS} select feature, round(score, 6) score from k")
def rank_corr(spark, sf):
    return select.rank_corr(embeddings(spark, sf)).select("feature", F.round("score", 6).alias("score"))


@query(f"with {RANKS}, b as (select feature, row_number() over (order by score desc, feature) k from k) select feature, cast(k as int) place from b where k <= 5")
def select_n_best(spark, sf):
    chosen = select.select_n_best(5).fit(embeddings(spark, sf)).indices
    return spark.createDataFrame([(f, k + 1) for k, f in enumerate(chosen)], "feature int, place int")


def long_matrix(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "i int, j int, x double").select("i", "j", r6(F.col("x")).alias("x"))


LONG = f"{EMB}, u as (select id, label, unnest(v) x, cast(unnest(range(64)) as int) f from e)"


@query(f"with {LONG} select a.f i, b.f j, round(sum(a.x * b.x), 6) + 0.0 x from u a join u b on a.id = b.id group by a.f, b.f")
def gram_matrix(spark, sf):
    return long_matrix(spark, cluster.scatter(embeddings(spark, sf), "features")[2])


@query(f"with {LONG}, c as (select id, f, x - avg(x) over (partition by label, f) x from u) select a.f i, b.f j, round(sum(a.x * b.x), 6) + 0.0 x from c a join c b on a.id = b.id group by a.f, b.f")
def scatter_within(spark, sf):
    return long_matrix(spark, select.within_total(embeddings(spark, sf))[2])


SHARES = "s as (select user_id, event_type, count(*) * 1.0::double / sum(count(*)) over (partition by user_id) p from events group by user_id, event_type)"


def shares(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: x["n"]).alias("c"))
    return p.select("user_id", F.transform("c", lambda x: x / V.total(F.col("c"))).alias("p"))


@query(f"with {SHARES} select user_id, round(-sum(p * ln(p)), 6) + 0.0 u from s group by user_id")
def entropy_uncertainty(spark, sf):
    return shares(spark, sf).select("user_id", r6(graph.entropy(F.col("p"))).alias("u"))


@query(f"with {SHARES} select user_id, round(1 - max(p), 6) u from s group by user_id")
def one_minus_max(spark, sf):
    return shares(spark, sf).select("user_id", F.round(graph.one_minus_max(F.col("p")), 6).alias("u"))


# -- without SQL: held by tests ---------------------------------------------------------------------


@query()
def linear_independence(spark, sf):
    return spark.createDataFrame([(k,) for k in select.linear_independent_features(embeddings(spark, sf))], "feature int")


@query()
def sda(spark, sf):
    """Which columns of an order line tell how large the order is."""
    rows = lines(spark, sf, "l_discount", "l_extendedprice", "l_tax", "l_quantity").withColumn("label", F.floor(F.col("features")[3] / 10).cast("int"))
    return spark.createDataFrame([(f, k) for k, f in enumerate(select.sda(rows))], "feature int, place int")


@query()
def pca(spark, sf):
    e = embeddings(spark, sf)
    return spread(factor.Pca(3).fit(e).transform(e), "id")


@query()
def mds(spark, sf):
    return spread(factor.mds(embeddings(spark, sf), 2), "id", n=2)


NEXT = f"with {EMB} select a.id, round(list_distance(a.v, b.v) ** 2, 4) + 0.0 d from e a join e b on b.id = a.id + 1"


def next_distances(rows: DataFrame) -> DataFrame:
    """(id, d): of each row the squared distance to the row of the next id."""
    after = rows.select((F.col("id") - 1).alias("id"), F.col("features").alias("after"))
    return rows.join(after, "id").select("id", (F.round(V.sqdist(F.col("features"), F.col("after")), 4) + 0.0).alias("d"))


@query(NEXT)
def mds_keeps_distances(spark, sf):
    return next_distances(factor.mds(embeddings(spark, sf), 64))


@query(NEXT)
def mds_landmarks(spark, sf):
    """Placed by distances to 100 of the rows alone."""
    return next_distances(factor.mds_rows(embeddings(spark, sf), 64, landmarks=100, exact=100))


@query()
def nnmf(spark, sf):
    w, _, _ = factor.lee_seung(lines(spark, sf), 2, max_iter=5)
    return w


@query()
def sparse_nnmf(spark, sf):
    positive = embeddings(spark, sf).withColumn("features", F.transform("features", F.abs))
    return factor.sparse_nnmf_frame(positive, 4, sparse_h=0.4, max_iter=20)[0]


def regression(spark, sf):
    return embeddings(spark, sf).select("id", F.slice("features", 1, 16).alias("x"), F.slice("features", 17, 2).alias("y"))


@query()
def lasso_path(spark, sf):
    lams, path = linear.lasso_walk(regression(spark, sf), 16)
    return spark.createDataFrame([(k, float(lam), int((b != 0).sum())) for k, (lam, b) in enumerate(zip(lams, path, strict=True))], "step int, lam double, nonzero int")


@query()
def lasso(spark, sf):
    rows = regression(spark, sf)
    return linear.LassoLearner(lam=0.001).fit(rows).transform(rows).select("id", "prediction")


def halves(spark, sf):
    return embeddings(spark, sf).withColumn("label", (F.col("label") < 5).cast("int"))


@query()
def logistic(spark, sf):
    rows = halves(spark, sf)
    return linear.Logistic(alpha=0.01).fit(rows).transform(rows).select("id", "prediction")


@query()
def perceptron(spark, sf):
    rows = halves(spark, sf)
    return tasks.Perceptron(max_iters=20).fit(rows).transform(rows).select("id", "prediction")


@query()
def svm_raw(spark, sf):
    rows = halves(spark, sf)
    return tasks.RbfSvm(1.0, 1.0, raw=True).fit(rows).transform(rows).select("id", "prediction")


@query()
def platt(spark, sf):
    rows = scored(spark, sf)
    return tasks.SigmoidCorrection(features="score").fit(rows).transform(rows).select("doc_id", "prediction")


@query(f"""
with {EMB}, t as (select label, unnest(v) x, generate_subscripts(v, 1) i from e where label < 2), m as (select label, i, avg(x) x from t group by label, i),
c as (select list(x order by i) filter (where label = 0) z, list(x order by i) filter (where label = 1) p from m),
s as (select id, v, z, p, list_distance(z, p) ** 2 d2 from e, c)
select id, a.algorithm, round((list_dot_product(v, p) - list_dot_product(v, z)) * 2 / d2 - (list_dot_product(p, p) - list_dot_product(z, z)) / d2, 4) + 0.0 score from s, (values ('pairs'), ('smo')) a(algorithm)
""")
def svm_of_means(spark, sf):
    """The machine between the means of two labels, whose optimum is known: weight 2 / d^2 on both. By either solver."""
    e = embeddings(spark, sf)
    long = e.filter("label < 2").select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("features")).withColumn("id", F.col("label"))
    parts = [tasks.Svm(C=1e6, eps=1e-7, raw=True, algorithm=a).fit(means).transform(e).select("id", F.lit(a).alias("algorithm"), (F.round("prediction", 4) + 0.0).alias("score")) for a in ("pairs", "smo")]
    return parts[0].union(parts[1])


@query()
def svm_cascade(spark, sf):
    rows = preprocess.zscore(dear_lines(spark, sf))
    return tasks.CascadeSvm(C=1.0, raw=True).fit(rows).transform(rows).select("id", "prediction")


@query()
def svm_ovo(spark, sf):
    rows = embeddings(spark, sf)
    return tuning.svm_simple(1.0, None).fit(rows).transform(rows).select("id", "prediction")


@query()
def multi_tree(spark, sf):
    rows = four(spark, sf)
    return compose.MultiTree(tasks.Svm()).fit(rows).transform(rows).select("id", "prediction")


@query()
def affinity(spark, sf):
    return graph.affinity_frame(embeddings(spark, sf))


@query("select vec_id id, true chooses_itself, true is_nearest from embeddings")
def affinity_sparse(spark, sf):
    """Of each row, whether its exemplar is its own exemplar and no other exemplar is nearer."""
    e = embeddings(spark, sf).select("id", "features")
    got = stored(e.join(graph.sparse_affinity(e, k=20, convit=10, maxit=60, damping=0.7), "id"), "affinity")
    of = got.select(F.col("id").alias("exemplar"), F.col("exemplar").alias("its"), F.col("features").alias("centre"))
    exemplars = got.filter("id = exemplar").select("id", "features")
    near = pairwise.nearest(got.withColumn("label", F.lit(0)), exemplars.withColumn("label", F.lit(0)), 1).select(F.col("q").alias("id"), F.col("d").alias("least"))
    both = got.join(of, "exemplar").join(near, "id")
    return both.select("id", (F.col("its") == F.col("exemplar")).alias("chooses_itself"), (V.sqdist(F.col("features"), F.col("centre")) <= F.col("least") + 1e-9).alias("is_nearest"))


class Means(tasks.SumLearner):
    """A caller's own learner: the label whose mean is nearer."""

    def sums(self, x, y):
        return np.concatenate([np.append((y == c).sum(), x[y == c].sum(axis=0)) for c in (0, 1)])

    def solved(self, sums):
        return MeansModel(*(v[1:] / v[0] for v in np.split(sums, 2)))


class MeansModel:
    def __init__(self, no, yes):
        self.no, self.yes = no, yes

    def decide(self, x):
        return ((x - self.no) ** 2).sum(axis=1) - ((x - self.yes) ** 2).sum(axis=1)


@query(f"""
with {EMB}, h as (select id, v, cast(label < 5 as int) y, (label + 0.5) / 10 p1 from e), t as (select * from h where id % 2 = 0), q as (select * from h where id % 2 = 1),
u as (select y, unnest(v) x, generate_subscripts(v, 1) i from t), z as (select y, i, sum(x) s, count(*) n from u group by y, i), s as (select y, list(s order by i) s, any_value(n) n from z group by y),
b as (select a.s s0, a.n n0, b.s s1, b.n n1 from s a join s b on a.y = 0 and b.y = 1),
w as (select 0 c, id, p1, v, s0, n0, s1, n1 from q, b union all select 1, id, p1, v, s0, n0, s1, n1 from q, b),
m as (select id, c, p1, list_transform(list_zip(s0, v), lambda k: (k[1] + case when c = 0 then k[2] else 0 end) / (n0 + 1 - c)) m0, list_transform(list_zip(s1, v), lambda k: (k[1] + case when c = 1 then k[2] else 0 end) / (n1 + c)) m1 from w),
o as (select q.id, list_distance(q.v, list_transform(s0, lambda x: x / n0)) >= list_distance(q.v, list_transform(s1, lambda x: x / n1)) was from q, b),
r as (select m.id, m.c, any_value(case when m.c = 1 then m.p1 else 1 - m.p1 end) p, sum(cast((list_distance(q.v, m.m0) >= list_distance(q.v, m.m1)) <> o.was as int)) n from m, q join o on o.id = q.id group by m.id, m.c)
select id, round(sum(n * p), 6) + 0.0 impact from r group by id
""")
def impacts(spark, sf):
    """How far each row without a label would change the others' predictions if its label were known; every other row has one."""
    rows = embeddings(spark, sf).withColumn("p", (F.col("label") + 0.5) / 10).withColumn("label", (F.col("label") < 5).cast("int"))
    train, pool = (rows.filter(F.col("id") % 2 == k) for k in (0, 1))
    p = pool.select("id", F.inline(F.array(*(F.struct(F.lit(c).alias("label"), (F.col("p") if c else 1 - F.col("p")).alias("p")) for c in (0, 1)))))
    return graph.expected_impacts(train.drop("p"), pool.drop("p"), Means(), p).select("id", (F.round("impact", 6) + 0.0).alias("impact"))


@query()
def som(spark, sf):
    e = embeddings(spark, sf)
    return graph.som_closest(e, graph.som(e, (4, 4), 500)).select("id", "y", "x")


@query()
def default_pipeline(spark, sf):
    rows = halves(spark, sf)
    return tuning.default_learner("fast", nfolds=3).fit(rows).transform(rows).select("id", "prediction")


@query()
def multi_label(spark, sf):
    rows = embeddings(spark, sf).withColumn("label", F.array_distinct(F.array(F.col("label") % 3, F.col("label") % 2)))
    return compose.OneAgainstRestMulti(tasks.Svm()).fit(rows).transform(rows).select("id", "prediction")
