"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ended, ranked, sliced, text_of, written
from .tokens import vocabulary, word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Ids of each document with end_id after them, in pieces of at most capacity ids; with_ids adds them as array `ids`."""
    path = tokenizer or vocabulary()
    end = end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def pieces(batches):
        bpe, width = word_bpe(path), 4 * capacity
        for batch in sliced(batches):
            out = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.ids(text) + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    row = (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] * with_ids))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def plan_best_fit(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for all pieces of a histogram (length to count), the longest first, each into the fullest sequence that takes it.

    Sequences of equal content are kept as one group, so that a step places many pieces at once and
    the work follows the lengths there are, not the pieces. A run (length, first rank, copies in each
    sequence, first sequence, offset) says: the piece of this length with rank r goes to sequence
    first + (r - rank) // copies, at offset + length * ((r - rank) % copies). A length leaves at most
    three groups more than it found, and a sequence holds fewer than sqrt(2 * capacity) different
    lengths, hence at most 3 * sqrt(2) * capacity ** 1.5 runs, however many pieces there are.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            copies = min(room // length, left)
            used = min(n, left // copies)
            runs.append((length, rank, copies, first, capacity - room))
            leave(room - copies * length, first, used)
            leave(room, first + used, n - used)
            rank += used * copies
            left -= used * copies
    return runs


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset.

    The histogram of lengths is counted in Spark: at most `capacity` rows reach the driver, which plans
    on them. A piece then finds its slot by its rank within its length. Pieces must be a written table,
    for they are read twice.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan_best_fit(histogram, capacity))
    plan = np.array(runs, np.int64).reshape(-1, 5)
    key = (plan[:, 0] << 44) + plan[:, 1]
    rows = ranked(pieces, ["length"], ["doc_id", "piece"], "rank")
    names = pieces.columns
    where, at_rank = names.index("length"), len(names)

    def slots(batches):
        for batch in ended(batches):
            length = batch.column(where).to_numpy(zero_copy_only=False)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False)
            run = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            nth, copy = np.divmod(rank - run[:, 1], run[:, 2])
            columns = [*batch.columns[:at_rank], pa.array(run[:, 3] + nth), pa.array(run[:, 4] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return rows.select(*names, "rank").mapInArrow(slots, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` token ids, packed into few sequences.

    A null or empty text is the end id alone. Only texts of more than `capacity` ids are cut. Rows that
    repeat, or whose doc_id is null, are packed as rows of their own. Equal lengths take their slots in
    an order that a hash of doc_id and piece and the number of shuffle partitions give. Other columns of docs are not read. An empty table gives an empty result.
    """
    return pack(written(token_pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces"), capacity)
