"""Shards balanced in several sizes at once by vector bin packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, sliced, text_of, written
from .tokens import vocabulary, word_bpe

#: A group of over 1/GRAIN of a shard in any size is placed by itself; smaller ones are joined, by a hash of the text, to about that much.
GRAIN = 512


def sized(docs: DataFrame, tokenizer: str | None) -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2, tokens) for each row: tokens as the library of the vocabulary counts them, g1 and g2 hashes of the text."""
    path = tokenizer or vocabulary()
    fields = [("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("tokens", pa.int64())]
    schema = pa.schema(fields)

    def work(batches):
        bpe = word_bpe(path)
        for batch in sliced(batches):
            tokens = [len(bpe.ids(t)) // 4 for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(tokens, pa.int64())], schema=schema)

    text = text_of()
    read = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("other"), text).alias("g2"), text.alias("text"),
    )
    return read.mapInArrow(work, "doc_id long, size long, text_crc32 long, g1 long, g2 long, tokens long")


def place(items: np.ndarray, shards: int, rigid: int = 0) -> np.ndarray:
    """A shard for each item (a row of sizes), the largest first, where the dot product with what room is left is highest.

    Sizes count in shares of a shard. Room may fall below zero; shards that already hold their share of
    the rigid size are tried only after all others. Of equal products the first shard wins.
    """
    share = items.sum(axis=0) / shards
    sizes = items / np.where(share > 0, share, 1)
    room = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    order = np.lexsort((np.arange(len(items)), -sizes.max(axis=1)))
    for k in order:
        worth = room @ sizes[k]
        full = room[:, rigid] < sizes[k, rigid]
        worth = np.where(full & ~full.all(), -np.inf, room[:, rigid] if full.all() else worth)
        out[k] = best = int(worth.argmax())
        room[best] -= sizes[k]
    return out


def level(items: np.ndarray, where: np.ndarray, shards: int, rigid: int = 0, rounds: int = 4000) -> np.ndarray:
    """where with items moved or swapped between the fullest and the emptiest shard while that narrows their gap in the rigid size."""
    size, where = items[:, rigid], where.copy()
    load = np.bincount(where, size, shards)
    for _ in range(rounds):
        full, thin = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[thin]
        mine, theirs = np.flatnonzero(where == full), np.append(np.flatnonzero(where == thin), -1)
        theirs = theirs[np.argsort(np.where(theirs < 0, 0, size[theirs]), kind="stable")]
        other = np.where(theirs < 0, 0, size[theirs])
        at = np.clip(np.searchsorted(other, size[mine] - gap / 2), 1, len(other)) - 1
        near = np.stack([at, np.minimum(at + 1, len(other) - 1)])
        moved = size[mine] - other[near]
        rest = np.where((moved > 0) & (moved < gap), np.abs(gap - 2 * moved), np.inf)
        side, k = np.unravel_index(rest.argmin(), rest.shape)
        if not np.isfinite(rest[side, k]) or rest[side, k] >= gap:
            break
        step, back = moved[side, k], theirs[near[side, k]]
        where[mine[k]] = thin
        if back >= 0:
            where[back] = full
        load[full] -= step
        load[thin] += step
    return where


def shard_documents(docs: DataFrame, shards: int = 40, tokenizer: str | None = None, grain: int = GRAIN) -> DataFrame:
    """Documents in shards of nearly equal bytes, tokens and rows; law `bytes`: of these, bytes are evened out last.

    A group is all documents of equal text. Groups are never torn, but for one whose bytes alone exceed a shard's share: that is
    dealt by rank into as few parts as fit one. Groups of less than 1/grain of a shard in every size
    are first joined by a hash of the text. So at most 4 * grain * shards items and the torn parts (2 * shards at most)
    with their three sums reach the driver, which places them, however many documents there are: the largest first, where
    the dot product with residual capacity is highest. level() then moves or swaps whole items while that evens out bytes, a step that
    vector bin packing itself does not have. Tokens are those of the tokenizer.
    A text's size is its UTF-8 bytes plus 16; null text has none but counts as the empty text. Repeated rows and null
    doc_id take places of their own. Equal products go to the first shard, equal items are placed in order of their hash. An empty table gives an empty result.
    """
    rows = written(sized(docs, tokenizer), "sizes")
    sums: Sequence[Column] = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    shares = {c: max(1.0, total[c] / shards) for c in ("size", "tokens", "rows")}
    groups = rows.groupBy("g1", "g2").agg(*sums)
    share = F.greatest(*(F.col(c) / F.lit(m) for c, m in shares.items()))
    large = groups.filter(share * grain > 1).select("g1", "g2", F.ceil(F.col("size") / F.lit(shares["size"])).cast("int").alias("parts"), "rows")
    large = written(large, "groups")
    split = large.filter((F.col("parts") > 1) & (F.col("rows") > 1)).select("g1", "g2", F.least("parts", F.col("rows").cast("int")).alias("parts"))

    bins = grain * shards
    # large groups: at most grain * shards for each of three sizes; marked rows carry the item's key
    kept = large.select("g1", "g2", F.lit(True).alias("alone"))
    marked = rows.join(F.broadcast(kept), ["g1", "g2"], "left").join(F.broadcast(split), ["g1", "g2"], "left")  # 3 * grain * shards and 2 * shards rows at most
    hot = ranked(marked.filter(F.col("parts").isNotNull()), ["g1", "g2"], ["doc_id"], "nth").withColumn("part", F.pmod(F.col("nth"), F.col("parts")).cast("int")).drop("nth")
    rest = marked.filter(F.col("parts").isNull()).withColumn("part", F.lit(0))
    alone = F.coalesce(F.col("alone"), F.lit(False))
    item = rest.unionByName(hot).select(
        "doc_id", "size", "tokens", "text_crc32", F.when(alone, F.col("g1")).otherwise(F.pmod("g1", F.lit(bins))).alias("k1"), F.when(alone, F.col("g2")).otherwise(F.lit(0)).alias("k2"), "part"
    )
    item = written(item, "items")
    keys = ["k1", "k2", "part"]
    placing = item.groupBy(*keys).agg(*sums).orderBy(*keys).toPandas()
    sizes = placing[["size", "tokens", "rows"]].to_numpy(np.float64)
    placing["shard"] = level(sizes, place(sizes, shards), shards).astype("int32")
    plan = docs.sparkSession.createDataFrame(placing[[*keys, "shard"]], "k1 long, k2 long, part int, shard int")
    placed = item.join(F.broadcast(plan), keys).select("doc_id", "size", "text_crc32", "shard", F.col("k1").alias("__k1"))
    numbered = ranked(placed, ["shard"], ["doc_id", "__k1"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
