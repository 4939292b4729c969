"""Hard negatives by a block matrix product: score tiles are added up over chunks of dimensions, and each tile leaves its best rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import best, merged, opened, packed, rows_of
from .common import written

#: Rows and anchors of a tile (512 KB of scores), and dimensions of a chunk.
ROWS, ANCHORS, CHUNK = 1024, 64, 32
#: Row blocks whose results a task merges before it hands them on.
BAND = 64
#: Scores stay below this, so that a hundred times a score is a long.
MOST_SCORE = 2**56


def finite(vector: Column) -> Column:
    """Whether an array of numbers is there and has neither null nor non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vectors: DataFrame, scale: int = 256, shift: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, x): floor(scale * component) as whole doubles of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id").cast("long") % shift == 0, (label + 1) % labels).otherwise(label)
    kept = vectors.filter(finite(v) & label.isNotNull() & F.col("vec_id").isNotNull())
    return kept.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("x"))


def laid(rows: DataFrame, size: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(records, blocks): rows in order of label and id in blocks of `size`, each cut into chunks of dimensions; and (block, lo, hi) with its labels' range.

    A block has few labels, so that most pairs of blocks have either only equal labels or only different ones. Ranges are cut by label
    and id, so a label of many rows has many blocks.
    """
    order = ["label", "id", "x"]
    one = packed(rows.repartitionByRange("label", "id").sortWithinPartitions(*order), size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x = rows_of(batch, r)
                starts = range(0, max(x.shape[1], 1), chunk)
                parts = [np.ascontiguousarray(x[:, c : c + chunk]).tobytes() if x.shape[1] else bytes(len(x)) for c in starts]
                ids, labels = batch.column("id")[r].values, batch.column("label")[r].values
                tag = [pa.ListArray.from_arrays(pa.array([0] + [len(x)] * len(parts), pa.int32()), v) for v in (ids, labels)]  # ids and labels travel with the first chunk
                low, high = labels[0].as_py(), labels[-1].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(parts), pa.int64()) for v in (batch.column("block")[r].as_py(), low, high)]
                    + [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([min(chunk, x.shape[1] - c) for c in starts], pa.int32()), *tag],
                    names=["block", "lo", "hi", "chunk", "x", "x_width", "ids", "labels"],
                )

    records = written(one.mapInArrow(work, "block long, lo long, hi long, chunk int, x binary, x_width int, ids array<long>, labels array<long>"), "chunks")
    return records, records.filter("chunk = 0").select("block", "lo", "hi")


def tiles(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """(a, band, b, chunk, tile, tags): for each pair of blocks and each chunk of dimensions the product, int64 scores as bytes.

    Tags are arrays of the anchors' records and those of ids and labels; they are there with the first chunk and empty with the others.
    """
    tags = ["a_ids", "a_labels", *tags, "ids", "labels"]
    left = anchors.withColumnsRenamed({"block": "a", "x": "p", "x_width": "p_width", "ids": "a_ids", "labels": "a_labels"}).drop("lo", "hi")
    both = pairs.join(left, "a").join(rows.withColumnRenamed("block", "b").drop("lo", "hi"), ["b", "chunk"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                p, x = rows_of(batch, r, "p"), rows_of(batch, r)
                width = min(p.shape[1], x.shape[1])  # the narrower block's components beyond are zeros
                p, x = p[:, :width], x[:, :width]
                top = width * np.abs(p).max(initial=0) * np.abs(x).max(initial=0)
                if top < 2**52:  # products of whole doubles are exact
                    scores = (p @ x.T).astype(np.int64)
                elif top < MOST_SCORE:
                    scores = p.astype(np.int64) @ x.T.astype(np.int64)
                else:
                    raise ValueError(f"components are too large: scores could reach {MOST_SCORE}")
                own = batch.slice(r, 1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("a", "band", "b", "chunk")), pa.array([scores.tobytes()], pa.binary()), *(own.column(c) for c in tags)], names=["a", "band", "b", "chunk", "tile", *tags])

    return both.mapInArrow(work, ", ".join(["a long, band int, b long, chunk int, tile binary", *(f"{c} array<long>" for c in tags)]))


def reduced(parts: DataFrame, keep: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """(a, band, q, score, ..): what keep(scores, *tags) gives for each whole tile. A tile's chunks come one after the other and are added as they come."""
    tags = parts.columns[5:]
    names = list(keep(np.zeros((0, 0), np.int64), *([np.zeros(0, np.int64)] * len(tags))))

    def record(key: tuple, total: np.ndarray, tag: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = keep(total.reshape(len(tag[0]), len(tag[-1])), *tag)
        if len(found["q"]):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(key[:1], pa.int64()), pa.array(key[1:2], pa.int32()), *lists], names=["a", "band", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, tag = None, None, []
        for batch in batches:
            for r in range(len(batch)):
                key = tuple(batch.column(c)[r].as_py() for c in ("a", "band", "b"))
                part = np.frombuffer(batch.column("tile")[r].as_buffer(), np.int64)
                if key == now:
                    total += part
                    continue
                if now is not None:
                    yield from record(now, total, tag)
                now, total = key, part.copy()
                tag = [batch.column(c)[r].values.to_numpy(zero_copy_only=False).copy() for c in tags]
        if now is not None:
            yield from record(now, total, tag)

    schema = ", ".join(["a long, band int", *(f"{c} array<long>" for c in names)])
    return parts.repartition("a", "band", "b").sortWithinPartitions("a", "band", "b", "chunk").mapInArrow(work, schema)


def top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each q of an anchor block, first within each band of row blocks, then over all."""
    order = {"order": ["score", "id"], "descending": ["score"]}
    return merged(merged(found, ["a", "band"], k, **order).drop("band"), ["a"], k, **order)


def nearest_of(positives: int) -> Callable[..., dict[str, np.ndarray]]:
    def keep(scores, a_ids, a_labels, ids, labels):
        q, j = np.nonzero((a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :]))
        at = best(q, [-scores[q, j], ids[j]], positives)
        q, j = q[at], j[at]
        return {"q": q, "score": scores[q, j], "id": ids[j], "anchor_id": a_ids[q]}

    return keep


def within(low: int, high: int, negatives: int) -> Callable[..., dict[str, np.ndarray]]:
    """q counts the windows, an anchor with a positive each."""

    def keep(scores, a_ids, a_labels, w_q, w_score, w_id, ids, labels):
        mine, p = scores[w_q] if len(w_q) else np.zeros((0, len(ids)), np.int64), w_score[:, None]
        w, j = np.nonzero((a_labels[w_q][:, None] != labels[None, :]) & (low * p <= 100 * mine) & (100 * mine <= high * p))
        at = best(w, [-mine[w, j], ids[j]], negatives)
        w, j = w[at], j[at]
        return {"q": w, "score": mine[w, j], "id": ids[j], "anchor_id": a_ids[w_q[w]], "positive_id": w_id[w], "positive_score": w_score[w]}

    return keep


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, rows: int = ROWS, anchors: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`; positives an anchor's first `positives` other rows of its label, by score and
    vec_id; negatives of a positive the first `negatives` rows of other labels whose score is between low and high percent of the positive's.

    Rows and anchors lie in blocks, cut into chunks of dimensions. For each pair of blocks and each chunk a task makes a partial tile of int64
    scores; the tiles of a pair are shuffled together and added, and a whole tile leaves the best of each anchor or window. Blocks are in order of
    label: pairs that share a label give the positives, all pairs but those of one and the same label the negatives, so that few are multiplied twice.
    All rows are scored against all anchors; no tile, group or table sent to all grows with the data but the numbers of the blocks.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part. A shorter vector ends in zeros. Rows of an anchor's own
    vec_id are never its candidates; an anchor that is there twice gives its rows twice; candidates that are there twice count twice. No rows: no result.
    Scores that could reach 2 ** 56 raise an error. Columns besides these three are not read.
    """
    kept = quantised(vectors.select("vec_id", "embedding", "label"))
    all_rows, blocks = laid(kept, rows, chunk)
    chosen, anchor_blocks = laid(kept.filter(F.col("id") % every == 0), anchors, chunk)
    bands = blocks.count() // BAND + 1
    pairs = anchor_blocks.toDF("a", "a_lo", "a_hi").join(blocks.toDF("b", "lo", "hi"), F.lit(True)).withColumn("band", F.pmod(F.xxhash64("b"), F.lit(bands)).cast("int"))
    alike = (F.col("a_lo") <= F.col("hi")) & (F.col("lo") <= F.col("a_hi"))
    of_one = (F.col("a_lo") == F.col("hi")) & (F.col("lo") == F.col("a_hi"))

    near = written(top(reduced(tiles(pairs.filter(alike).select("a", "b", "band"), chosen, all_rows), nearest_of(positives)), positives), "positives")
    windows = near.select(F.col("a").alias("block"), F.lit(0).alias("chunk"), F.col("q").alias("w_q"), F.col("score").alias("w_score"), F.col("id").alias("w_id"))
    asked = chosen.join(windows, ["block", "chunk"], "left")
    hard = top(reduced(tiles(pairs.filter(~of_one).select("a", "b", "band"), asked, all_rows, ["w_q", "w_score", "w_id"]), within(low, high, negatives)), negatives)
    return opened(hard, ["a"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


HARD_NEGATIVES_SQL = """
with e as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor, b.vec_id as other, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
p as (select * from s where alike qualify row_number() over (partition by anchor order by score desc, other) <= 5),
n as (
  select p.anchor, p.other as positive, p.score as ps, s.other as negative, s.score as ns, row_number() over (partition by p.anchor, p.other order by s.score desc, s.other) as k
  from p join s on s.anchor = p.anchor and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor as anchor_id, positive as positive_id, cast(k as int) as rank, negative as negative_id, ps as positive_score, ns as negative_score from n where k <= 10
"""
