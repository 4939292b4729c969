"""Rows packed into blocks of bounded size, and the best of many rows for each row of a block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Entries that merged() holds before it drops all but the best.
HELD = 500_000


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def rows_of(batch: pa.RecordBatch, at: int, name: str = "x") -> np.ndarray:
    """The matrix of a record that packed() made."""
    width = batch.column(name + "_width")[at].as_py()
    return np.frombuffer(batch.column(name)[at].as_buffer(), np.float64).reshape(-1, width) if width else np.zeros((len(batch.column(name)[at].as_buffer()), 0))


def packed(df: DataFrame, size: int, group: Sequence[str] = (), x: str = "x") -> DataFrame:
    """(block, group.., x, x_width, the other columns as arrays): `size` rows at most that follow one another in a task and agree in group.

    x, lists of numbers, become one matrix of doubles as bytes. Block numbers differ, with gaps. Sort df within its partitions by what
    tells its rows apart, so that a task that runs again makes the same blocks. Group columns are integers, not null.
    """
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in (*group, x)]
    schema = ", ".join(["block long", *(f"`{c}` {kinds[c]}" for c in group), f"`{x}` binary", f"`{x}_width` int", *(f"`{c}` array<{kinds[c]}>" for c in rest)])

    def record(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        n, one = table.num_rows, lambda c: table.column(c).chunk(0)
        m = matrix_of(one(x))
        # a matrix without columns still has rows: a byte each
        cells = [pa.array([m.tobytes() if m.shape[1] else bytes(n)], pa.binary()), pa.array([m.shape[1]], pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), one(c)) for c in rest]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(one(c).slice(0, 1) for c in group), *cells, *lists], names=["block", *group, x, f"{x}_width", *rest])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, last = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            changed = np.zeros(len(batch), bool)
            for v in keys:
                changed[1:] |= v[1:] != v[:-1]
            changed[0] = last is not None and last != [v[0] for v in keys]
            last = [v[-1] for v in keys]
            starts = [0, *(np.flatnonzero(changed[1:]) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                if held and changed[start]:
                    yield record(number, held)
                    number, held, n = number + 1, [], 0
                while start < end:
                    held.append(batch.slice(start, min(size - n, end - start)))
                    n += len(held[-1])
                    start += len(held[-1])
                    if n == size:
                        yield record(number, held)
                        number, held, n = number + 1, [], 0
        if held:
            yield record(number, held)

    return df.mapInArrow(work, schema)


def numbers(column: pa.Array) -> np.ndarray:
    """A column's values, or numbers in the same order where it has nulls (which come first) or isn't numeric."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return column.to_numpy(zero_copy_only=False)


def best(q: np.ndarray, order: Sequence[np.ndarray], k: int, unique: bool = False) -> np.ndarray:
    """Places of the first k entries of each q by the arrays in order, the first of them most weighty. unique: entries equal in all of them count once."""
    if not len(q):
        return np.zeros(0, int)
    at = np.lexsort((*reversed(order), q))
    if unique:
        same = np.ones(len(at), bool)
        same[0] = False
        for v in (q, *order):
            v = v[at]
            same[1:] &= v[1:] == v[:-1]
        at = at[~same]
    mine, places = q[at], np.arange(len(at))
    first = np.ones(len(at), bool)
    first[1:] = mine[1:] != mine[:-1]
    return at[places - np.maximum.accumulate(np.where(first, places, 0)) < k]


def least(rough: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries that can be among the k least of their row if each is off by slack of its row at most."""
    if rough.shape[1] <= k:
        return np.indices(rough.shape).reshape(2, -1)
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
    return np.nonzero(rough <= (edge + 2 * slack)[:, None])


def merged(df: DataFrame, by: Sequence[str], k: int, order: Sequence[str], descending: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Of the records (by.., q and other arrays of one length) that agree in by, one with the first k entries of each q in order.

    A task reads its records in order of by and holds HELD entries and the best so far, however many records a key has.
    """
    arrays = [c for c in df.columns if c not in by]

    def cut(parts: list[dict[str, pa.Array]]) -> dict[str, pa.Array]:
        whole = {c: pa.concat_arrays([p[c] for p in parts]) for c in arrays}
        number = lambda c: numbers(whole[c])
        at = pa.array(best(number("q"), [-number(c) if c in descending else number(c) for c in order], k, unique))
        return {c: v.take(at) for c, v in whole.items()}

    def record(key: tuple, parts: list, kinds: pa.Schema) -> pa.RecordBatch:
        whole = cut(parts)
        n = len(whole["q"])
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), whole[c]) for c in arrays]
        return pa.RecordBatch.from_arrays([*(pa.array([v], kinds.field(c).type) for c, v in zip(by, key, strict=True)), *lists], names=[*by, *arrays])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, kinds = None, [], 0, None
        for batch in batches:
            kinds = batch.schema
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                if held and key != now:
                    yield record(now, held, kinds)
                    held, n = [], 0
                now = key
                held.append({c: batch.column(c)[r].values for c in arrays})
                n += len(held[-1]["q"])
                if n > HELD:
                    held = [cut(held)]
                    n = len(held[0]["q"])
        if held:
            yield record(now, held, kinds)

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, *arrays])
    return df.select(*by, *arrays).repartition(*by).sortWithinPartitions(*by).mapInArrow(work, schema)


def opened(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., rank from 1 within q, the other columns): the entries of records of merged() as rows."""
    kinds = dict(df.dtypes)
    arrays = [c for c in df.columns if c not in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                q = batch.column("q")[r].values.to_numpy(zero_copy_only=False)
                places = np.arange(len(q))
                first = np.ones(len(q), bool)
                first[1:] = q[1:] != q[:-1]
                rank = places - np.maximum.accumulate(np.where(first, places, 0)) + 1 if len(q) else places
                same = pa.array(np.zeros(len(q), np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1).take(same) for c in keep), pa.array(rank, pa.int32()), *(batch.column(c)[r].values for c in arrays)], names=[*keep, "rank", *arrays])

    inner = {c: kinds[c].removeprefix("array<")[:-1] for c in arrays}
    return df.select(*keep, *arrays).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "rank int", *(f"`{c}` {inner[c]}" for c in arrays)]))
