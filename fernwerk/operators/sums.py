"""Sums of vectors over a table: added up in its tasks, then in a few more, and only then sent to the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks in which the sums of all others meet.
MEET = 8


def sums_by(df: DataFrame, part: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each key, the sum of part(batch)[key] over all batches; vectors of one key are of one size.

    All partitions are worked on side by side; the driver gets MEET rows a key at most, however many partitions there are.
    """

    def row(totals: dict[int, np.ndarray]):
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), pa.array([np.asarray(v, np.float64).tobytes() for v in totals.values()], pa.binary())], names=["k", "v"])

    def work(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for k, v in part(batch).items():
                    totals[k] = totals[k] + v if k in totals else v
        yield from row(totals)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v)
                totals[k] = totals[k] + v if k in totals else v
        yield from row(totals)

    kind = "k long, v binary"
    out: dict[int, np.ndarray] = {}
    for r in df.mapInArrow(work, kind).repartition(MEET).mapInArrow(add, kind).collect():
        v = np.frombuffer(r.v)
        out[r.k] = out[r.k] + v if r.k in out else v
    return out


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), vectors of `size`."""
    return sums_by(df, lambda batch: {0: part(batch)}).get(0, np.zeros(size))


def moments(x: np.ndarray) -> np.ndarray:
    """Rows of x, their sum, and the sum of their outer products, in one vector."""
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def unpacked_moments(v: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    d = int(round((np.sqrt(4 * len(v) - 3) - 1) / 2))
    return int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)
