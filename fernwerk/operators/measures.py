"""Measures of predictions, curves, and agreement of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, real: str = "real", predicted: str = "predicted", whole: bool = False, labels: list | None = None) -> DataFrame:
    """(real, predicted, n); whole adds the cells of 0 between all classes that are real or predicted (or those of `labels`, a larger set)."""
    cells = df.groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if not whole:
        return cells
    names = cells.select("real").union(cells.select("predicted"))
    if labels is not None:
        names = names.union(df.sparkSession.createDataFrame([(x,) for x in labels], names.schema))
    names = names.filter(F.col("real").isNotNull()).distinct()
    every = names.join(F.broadcast(names.select(F.col("real").alias("predicted"))), F.lit(True))
    grid = every.join(cells, ["real", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.union(cells.filter(F.col("real").isNull() | F.col("predicted").isNull()))


def accuracy(df: DataFrame, real: str = "real", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(real) == F.col(predicted)).cast("double")).alias("accuracy"))


def accuracy_of_matrix(cells: DataFrame) -> DataFrame:
    return cells.agg((F.sum(F.when(F.col("real") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def zero_one_loss(df: DataFrame, real: str = "real", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.sum((F.col(real) != F.col(predicted)).cast("long")).alias("loss"))


def waccuracy(df: DataFrame, real: str = "real", predicted: str = "predicted") -> DataFrame:
    """The mean over classes of the share that is right."""
    by = df.groupBy(real).agg(F.avg((F.col(real) == F.col(predicted)).cast("double")).alias("r"))
    return by.agg(F.avg("r").alias("waccuracy"))


def bayesian_significance(spark: SparkSession, n: int, c0: int, c1: int, steps: int = 100) -> DataFrame:
    """How probable it is that the worse of two classifiers, right c0 and c1 times of n, is the better one."""
    r = spark.range(steps).select((F.lit(0.0001) + F.col("id") * F.lit(0.9998 / (steps - 1))).alias("r"), F.col("id").alias("k"))
    a, b = r.toDF("r0", "i"), r.toDF("r1", "j")
    lp = c0 * F.log("r0") + (n - c0) * F.log(1 - F.col("r0")) + c1 * F.log("r1") + (n - c1) * F.log(1 - F.col("r1"))
    grid = a.join(F.broadcast(b), F.lit(True)).select("i", "j", lp.alias("lp"))
    top = grid.agg(F.max("lp").alias("top"))
    e = grid.join(F.broadcast(top), F.lit(True)).select("i", "j", F.exp(F.col("lp") - F.col("top")).alias("e"))
    won = F.sum(F.when(F.col("i") > F.col("j"), F.col("e")).when(F.col("i") == F.col("j"), F.col("e") / 2).otherwise(0.0)) / F.sum("e")
    return e.agg(won.alias("s")).select(F.least("s", 1 - F.col("s")).alias("significance"))


def _cumulated(df: DataFrame, score: str, label: str) -> DataFrame:
    """Each distinct score with the positives and negatives at or above it.

    Scores are first summed up by value. The running sums are taken within ranges of scores and shifted by the
    totals of the ranges above, so no task sorts all scores.
    """
    y = F.col(label).cast("boolean")
    g = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.when(y, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(~y, 1.0).otherwise(0.0)).alias("n"))
    cuts = g.approxQuantile("threshold", [k / 64 for k in range(1, 64)], 0.01)
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(F.col("threshold") >= c, 1).otherwise(0)
    g = g.withColumn("part", part)
    sums = g.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0.0)).alias("n0"))
    totals = sums.agg(F.sum("pp").alias("p_all"), F.sum("nn").alias("n_all"))
    w = Window.partitionBy("part").orderBy(F.desc("threshold"))
    run = g.withColumn("p", F.sum("p").over(w)).withColumn("n", F.sum("n").over(w)).join(F.broadcast(shift), "part")
    return run.join(F.broadcast(totals), F.lit(True)).select("threshold", (F.col("p") + F.col("p0")).alias("p"), (F.col("n") + F.col("n0")).alias("n"), "p_all", "n_all")


def roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score."""
    return _cumulated(df, score, label).select("threshold", (F.col("n") / F.col("n_all")).alias("fpr"), (F.col("p") / F.col("p_all")).alias("tpr"))


def precision_recall(df: DataFrame, score: str = "score", label: str = "label", mode: str = "all", steps: int = 100) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, or at `steps` even thresholds between the extremes."""
    if mode == "all":
        return _cumulated(df, score, label).select("threshold", (F.col("p") / (F.col("p") + F.col("n"))).alias("precision"), (F.col("p") / F.col("p_all")).alias("recall"))
    if mode != "steps":
        raise ValueError(f"mode is 'all' or 'steps', not {mode!r}")
    s, y = F.col(score).cast("double"), F.col(label).cast("boolean").cast("double")
    ends = df.agg(F.min(s).alias("low"), F.max(s).alias("high"), F.sum(y).alias("p_all"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
    grid = grid.select((F.col("low") + F.col("k") * ((F.col("high") - F.col("low")) / (steps - 1))).alias("threshold"), "p_all", "k")
    hits = df.select(s.alias("s"), y.alias("y")).groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    got = hits.join(F.broadcast(grid), F.col("s") >= F.col("threshold")).groupBy("k", "threshold", "p_all").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return got.select("threshold", (F.col("p") / F.col("n")).alias("precision"), (F.col("p") / F.col("p_all")).alias("recall"))


def rand_arand_jaccard(df: DataFrame, recovered: str = "recovered", label: str = "label") -> DataFrame:
    """Rand, adjusted Rand and Jaccard index of two clusterings, from their contingency table's margins."""
    a, b = F.col(recovered).alias("a"), F.col(label).alias("b")
    c = df.select(a, b).groupingSets([[F.col("a"), F.col("b")], [F.col("a")], [F.col("b")], []], "a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb")
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    pick = lambda ga, gb: F.sum(F.when((F.col("ga") == ga) & (F.col("gb") == gb), pairs).otherwise(0.0))
    s = c.agg(pick(0, 0).alias("ij"), pick(0, 1).alias("i"), pick(1, 0).alias("j"), pick(1, 1).alias("t"))
    i, j, ij, t = (F.col(x) for x in ("i", "j", "ij", "t"))
    return s.select(((t + 2 * ij - i - j) / t).alias("rand"), ((ij - i * j / t) / ((i + j) / 2 - i * j / t)).alias("arand"), (ij / (i + j - ij)).alias("jaccard"))
