"""Logistic and lasso regression: gradients and Gram matrices are Spark aggregates, the small algebra is the driver's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, lit_vector
from ..kernels.solvers import lasso_gram
from .base import Fitted, Learner
from .sums import summed


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -300, 300)))


def minimise(f, start: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Quasi-Newton descent; f gives value and gradient, each call one pass over the data."""
    x, h = start.copy(), np.eye(len(start))
    value, g = f(x)
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        t = 1.0
        for _ in range(40):
            new, ng = f(x + t * d)
            if new <= value + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, ng - g
        if s @ y > 1e-14:
            rho = 1 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            h = left @ h @ left.T + rho * np.outer(s, s)
        done = abs(value - new) <= tol * max(1e-12, abs(value)) * 1e-2
        x, value, g = x + s, new, ng
        if done:
            break
    return x


class Logistic(Learner):
    """Weights of least squared error of the sigmoid plus alpha times their squared norm, intercept included; labels 0 and 1. loss 'log' takes the log loss."""

    def __init__(self, alpha: float = 0.0, loss: str = "squared", **columns):
        super().__init__(**columns, alpha=alpha, loss=loss)

    def _fit(self, dataset: DataFrame) -> LogisticModel:
        data = dataset.select(doubles(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).cache()
        size = len(data.first()["x"]) + 1
        squared, alpha = self.loss == "squared", self.alpha

        def f(b: np.ndarray):
            def part(batch):
                x, y = matrix(batch.column(0)), batch.column(1).to_numpy()
                p = sigmoid(x @ b[1:] + b[0])
                r = p - y
                loss = (r * r).sum() if squared else -(y * np.log(np.maximum(p, 1e-300)) + (1 - y) * np.log(np.maximum(1 - p, 1e-300))).sum()
                d = 2 * r * p * (1 - p) if squared else r
                return np.concatenate([[loss, d.sum()], x.T @ d])

            got = summed(data, part, size + 1)
            return got[0] + alpha * b @ b, got[1:] + 2 * alpha * b

        b = minimise(f, np.zeros(size))
        data.unpersist()
        return LogisticModel(**self._columns(), weights=b.tolist())


class LogisticModel(Fitted):
    """prediction: the probability of 1."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = dot(doubles(self.features), lit_vector(self.weights[1:])) + F.lit(self.weights[0])
        p = F.when(z > 300, 1.0).when(z < -300, 0.0).otherwise(1 / (1 + F.exp(-z)))
        return dataset.withColumn(self.prediction, p)


def masked_grams(df: DataFrame, x: str = "x", y: str = "y") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, Gram, x y) for each output of y, over the rows where that output is known (neither null nor NaN)."""
    first = df.select(x, y).first()
    p, q = len(first[x]), len(first[y])
    filled = F.transform(doubles(y), lambda v: F.coalesce(v, F.lit(float("nan"))))

    def part(batch):
        a, b = matrix(batch.column(0)), matrix(batch.column(1))
        out = []
        for k in range(q):
            ok = ~np.isnan(b[:, k])
            out.append(np.concatenate([[ok.sum()], (a[ok].T @ a[ok]).ravel(), a[ok].T @ b[ok, k]]))
        return np.concatenate(out)

    got = summed(df.select(doubles(x).alias("x"), filled.alias("y")), part, q * (1 + p * p + p)).reshape(q, -1)
    return got[:, 0], got[:, 1 : 1 + p * p].reshape(q, p, p), got[:, 1 + p * p :]


def lasso(df: DataFrame, lam: float = 1.0, b=None, max_iter: int = 1024, tol: float = 1e-5, x: str = "x", y: str = "y", grams=None) -> np.ndarray:
    """Outputs x features: argmin |Y - B X|^2 / 2n + lam |B|_1, each output over its own known rows."""
    n, gram, xy = grams or masked_grams(df, x, y)
    return np.stack([lasso_gram(gram[k] / max(n[k], 1), xy[k] / max(n[k], 1), lam, None if b is None else b[k], max_iter, tol) for k in range(len(n))])


def lasso_walk(df: DataFrame, steps: int = 64, start: float | None = None, step: float = 0.9, tol: float = 1e-5, x: str = "x", y: str = "y") -> tuple[list[float], list[np.ndarray]]:
    """Penalties start * step^i and their solutions, each from the one before; one pass over the data for all. start: where all weights are 0."""
    grams = masked_grams(df, x, y)
    if start is None:
        start = max(float(np.abs(xy / max(n, 1)).max()) for n, _, xy in zip(*grams, strict=True))
    lams, out, b = [], [], None
    for k in range(steps):
        lams.append(start * step**k)
        b = lasso(df, lams[-1], b, tol=tol, grams=grams)
        out.append(b)
    return lams, out


class LassoLearner(Learner):
    """Arrays of outputs, centred for the fit, by lasso; features: x, label: y."""

    def __init__(self, lam: float = 1.0, **columns):
        super().__init__(**({"features": "x", "label": "y"} | columns), lam=lam)

    def _fit(self, dataset: DataFrame) -> LassoModel:
        from .preprocess import by_column

        (mean,) = by_column(dataset.withColumn(self.label, F.transform(doubles(self.label), lambda v: F.coalesce(v, F.lit(float("nan"))))), self.label, F.avg)
        mean = [m or 0.0 for m in mean]
        centred = dataset.withColumn(self.label, F.zip_with(doubles(self.label), lit_vector(mean), lambda a, m: a - m))
        return LassoModel(**self._columns(), weights=lasso(centred, self.lam, x=self.features, y=self.label).tolist(), mean=mean)


class LassoModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = doubles(self.features)
        return dataset.withColumn(self.prediction, F.array(*(dot(v, lit_vector(w)) + F.lit(m) for w, m in zip(self.weights, self.mean, strict=True))))

    def retrain(self, dataset: DataFrame, **options) -> LassoModel:
        """Fitted again on other rows, from these weights."""
        centred = dataset.withColumn(self.label, F.zip_with(doubles(self.label), lit_vector(self.mean), lambda a, m: a - m))
        b = lasso(centred, options.pop("lam", 1.0), np.array(self.weights), x=self.features, y=self.label, **options)
        return LassoModel(**self._columns(), weights=b.tolist(), mean=self.mean)
