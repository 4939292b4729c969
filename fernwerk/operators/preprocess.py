"""Preprocessing: affine normalisation, finite values, label numbers, balanced samples, outliers in groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import affine, doubles, known, pick
from .base import Fitted, Learner

#: Distinct labels that are sent to all tasks.
SENT = 100_000


def width(df: DataFrame, features: str) -> int:
    row = df.select(F.size(features).alias("n")).first()
    return row["n"] if row else 0


def by_column(df: DataFrame, features: str, *measures: Callable[[Column], Column]) -> list[list[float]]:
    """Each measure of each element of features, all in one aggregate without exploding rows; NaN counts as missing."""
    n = width(df, features)
    if not n:
        return [[] for _ in measures]
    v = doubles(features)
    row = df.agg(*(m(known(v[k])).alias(f"m{i}_{k}") for i, m in enumerate(measures) for k in range(n))).first()
    return [[row[f"m{i}_{k}"] for k in range(n)] for i in range(len(measures))]


class Affine(Fitted):
    """(features - shift) / factor."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.features, affine(doubles(self.features), self.shift, self.factor))


class ZScoreNormalise(Learner):
    """Mean 0 and population deviation 1 for each feature; a constant one is only shifted."""

    def _fit(self, dataset: DataFrame) -> Affine:
        mean, std = by_column(dataset, self.features, F.avg, F.stddev_pop)
        return Affine(**self._columns(), shift=[m or 0.0 for m in mean], factor=[s or 1.0 for s in std])


class IntervalNormalise(Learner):
    """Each feature to [-1, 1]; a constant one to 0."""

    def _fit(self, dataset: DataFrame) -> Affine:
        low, high = by_column(dataset, self.features, F.min, F.max)
        return Affine(**self._columns(), shift=[a + (b - a) / 2 for a, b in zip(low, high, strict=True)], factor=[(b - a) / 2 or 1.0 for a, b in zip(low, high, strict=True)])


class ChkFinite(Fitted):
    """NaN and infinities become 0; needs no fit."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
        return dataset.withColumn(self.features, F.transform(doubles(self.features), lambda x: F.when(bad(x), 0.0).otherwise(x)))


def zscore(df: DataFrame, features: str = "features", axis: int = 0, nans: bool = True) -> DataFrame:
    """df with z-scores along axis: 0 for each feature over all rows, 1 over each row's features. With nans NaN is passed over, and stays."""
    if axis == 0:
        return ZScoreNormalise(features=features).fit(df).transform(df)
    v = doubles(features)
    good = F.filter(v, lambda x: ~F.isnan(x)) if nans else v
    n = F.size(good)
    mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumn("__m", mean)
    var = F.aggregate(good, F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))) / n
    out = out.withColumn("__s", F.when(var > 0, F.sqrt(var)).otherwise(1.0))
    return out.withColumn(features, F.transform(v, lambda x: (x - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def center(df: DataFrame, features: str = "features", axis: int = 0) -> tuple[DataFrame, list[float] | None]:
    """(df less its means, the means); means of each row (axis 1) are in column `mean`."""
    if axis == 0:
        (mean,) = by_column(df, features, F.avg)
        return Affine(features=features, shift=[m or 0.0 for m in mean], factor=[1.0] * len(mean)).transform(df), mean
    v = doubles(features)
    good = F.filter(v, lambda x: ~F.isnan(x))
    out = df.withColumn("mean", F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good))
    return out.withColumn(features, F.transform(v, lambda x: x - F.col("mean"))), None


def normalise_labels(df: DataFrame, label: str = "label", out: str = "number") -> tuple[DataFrame, DataFrame]:
    """(df with numbers from 0 in label order, the names); the distinct labels alone are ranked, never all rows. Up to SENT labels go to the rows: a join by label would put each into one task."""
    names = df.select(F.col(label).alias("name")).filter(F.col("name").isNotNull()).distinct()
    few = names.limit(SENT + 1).count() <= SENT
    names = names.withColumn(out, F.dense_rank().over(Window.orderBy("name")).cast("long") - 1)
    marks = names.toDF("__name", "__number")
    marks = F.broadcast(marks) if few else marks
    numbered = df.join(marks, F.col(label) == F.col("__name"), "left").withColumn(out, F.col("__number"))
    return numbered.drop("__name", "__number"), names


def multi_label_matrix(df: DataFrame, labels: str = "labels", out: str = "flags") -> tuple[DataFrame, list]:
    """df with a flag for each label there is, in label order, from a column of label arrays."""
    names = [r[0] for r in df.select(F.explode(labels).alias("l")).distinct().orderBy("l").collect()]
    return df.withColumn(out, F.array(*(F.array_contains(labels, F.lit(n)) for n in names))), names


def sample_to_2min(df: DataFrame, label: str = "label", id: str = "id") -> DataFrame:
    """Of every class the first rows by id, at most twice as many as the smallest class has."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((2 * F.min("n")).alias("__most"))
    from .folds import rank_within

    ranked = rank_within(df, [label], [id], "__nth")
    return ranked.join(F.broadcast(sizes), F.col("__nth") < F.col("__most")).drop("__nth", "__most")


class FilterFeatures(Fitted):
    """The features at the given indices, or where a flag is set; all of empty input passes."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        at = [k for k, x in enumerate(self.indices) if x] if self.indices and all(isinstance(x, bool) for x in self.indices) else self.indices
        return dataset.withColumn(self.features, pick(doubles(self.features), at))


class FeatureSelector(Learner):
    """Keeps the features that `select(df, features, label)` names; all, with a warning, if it names none."""

    def _fit(self, dataset: DataFrame) -> FilterFeatures:
        chosen = list(self.select(dataset, self.features, self.label))
        if not chosen:
            import warnings

            warnings.warn("no feature was selected; all are kept", stacklevel=2)
            chosen = list(range(width(dataset, self.features)))
        return FilterFeatures(**self._columns(), indices=[int(k) for k in chosen])


class Set2Binary(Learner):
    """Arrays of elements to a flag for each element seen in training, in order, and a last one for any other."""

    def _fit(self, dataset: DataFrame) -> Fitted:
        seen = [r[0] for r in dataset.select(F.explode(self.features).alias("e")).distinct().orderBy("e").collect()]
        return SetFlags(**self._columns(), universe=seen)


class SetFlags(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        known_ones = F.array(*map(F.lit, self.universe))
        flags = [F.array_contains(self.features, F.lit(u)) for u in self.universe]
        return dataset.withColumn(self.features, F.array(*flags, F.size(F.array_except(self.features, known_ones)) > 0))


class Threshold(Fitted):
    """prediction: score >= threshold."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.prediction, F.col(self.features) >= F.lit(float(getattr(self, "threshold", 0.5))))


def ctransforms(*stages) -> Pipeline:
    """Stages one after another, each fitted on what those before it made."""
    return Pipeline(stages=list(stages))


def filter_outliers(df: DataFrame, group: str = "group_id", features: str = "features", id: str = "id", limit: float = 0.9, min_size: int = 3, dims: int | None = None) -> DataFrame:
    """In each group, rows whose mean squared z-score is below that of the row at sorted place int(limit * n).

    A group where that place is under min_size stays whole. Ties with the limit go.
    """
    n = dims or width(df, features)
    v, own = doubles(features), Window.partitionBy(group)
    z = []
    for k in range(n):
        std = F.stddev_pop(v[k]).over(own)
        z.append(F.pow((v[k] - F.avg(v[k]).over(own)) / F.when(std == 0, 1.0).otherwise(std), F.lit(2.0)))
    scored = df.withColumn("__score", sum(z[1:], z[0]) / n).withColumn("__size", F.count(F.lit(1)).over(own))
    scored = scored.withColumn("__rank", F.row_number().over(own.orderBy("__score", id)) - 1).withColumn("__at", F.floor(F.col("__size") * limit))
    scored = scored.withColumn("__edge", F.max(F.when(F.col("__rank") == F.col("__at"), F.col("__score"))).over(own))
    return scored.filter((F.col("__at") < min_size) | (F.col("__score") < F.col("__edge"))).drop("__score", "__size", "__rank", "__at", "__edge")


def indices(flags: Sequence[bool]) -> list[int]:
    return [k for k, x in enumerate(flags) if x]
