"""SimHash fingerprints, and links between them by pivot distance tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ended, free_name, looked_up, scratch, sliced, text_of, written
from .components import components

#: Fingerprints of a bucket that are compared in one task at once; larger buckets are dealt out.
BUCKET = 1024
#: Rows of keys that are broadcast at most (24 bytes each); beyond, tables are joined by shuffling.
BROADCAST_KEYS = 500_000
#: Hashes of a text's shingles that are kept to discard pairs of texts that are far apart.
SKETCH = 128
#: Words of 64 bits in the fingerprint that near_dedup samples bits from; two of them are compared.
WIDTH = 8
#: One text in so many shows which buckets are too large for a task; that decides how rows are dealt, never which are compared.
SHOWN = 64


def references(n: int, words: int) -> np.ndarray:
    """n fixed reference fingerprints of `words` 64-bit words, the multiples of an odd constant mixed."""
    x = np.arange(1, n * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).reshape(n, words)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints a and b, rows of 64-bit words, broadcast against each other."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle: lower-cased ASCII letters, words without ASCII white space, joined by a space."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that more than half of the hashes have; 0 if there are none."""
    if not len(hashes):
        return np.uint64(0)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` words of 64 bits, each bit as in fingerprint(), of the hashes mixed anew for each word."""
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255):  # so many are counted in one byte
        x = hashes[k : k + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, f: long) for each row; null text counts as empty, and empty text has fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])

    def work(batches):
        for batch in sliced(batches):
            got = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, f long")


def forest(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of edges (a, b) among nodes, in this order, those that join what was not joined; part: each node's number (0, 1, ...), alike for those that are joined from the start."""
    up = list(range(int(part.max()) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y, p, q in zip(a.tolist(), b.tolist(), part[a].tolist(), part[b].tolist(), strict=True):
        p, q = top(p), top(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            yield x, y


def close_pairs(f: np.ndarray, pivots: np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that differ in at most `most` bits, the closest first.

    Distances to a reference differ by no more than the fingerprints do. So rows are sorted by the first
    pivot's distance, only rows near in it are paired, pairs are discarded at the first pivot whose
    distances differ by more, and survivors are verified. side: only pairs across its two values.
    """
    order = np.argsort(pivots[:, 0], kind="stable")
    first = pivots[order, 0]
    stop = np.searchsorted(first, first + most, side="right")
    reach = stop - np.arange(len(f)) - 1
    a = np.repeat(np.arange(len(f)), reach)
    b = np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach) + a + 1
    a, b = order[a], order[b]
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    for k in range(1, pivots.shape[1]):
        near = np.abs(pivots[a, k] - pivots[b, k]) <= most
        a, b = a[near], b[near]
    d = distances(f[a], f[b])
    keep = np.flatnonzero(d <= most)
    keep = keep[np.argsort(d[keep], kind="stable")]
    return a[keep], b[keep]


def bucket_links(rows: DataFrame, words: int, most: int) -> DataFrame:
    """Links (a, b) that hold together what differs by at most `most` bits within each bucket.

    rows: bucket (long), side (0; or 1 and 2, then only pairs across are compared), node (long), f0 to
    f{words-1}, pivots, and root, if it is known what is joined already: nodes of one root are not linked again. A bucket has about 2 * BUCKET rows at most. Of its
    links a spanning forest is given, the closest first, so a bucket of n rows (of n roots) gives fewer than n.
    """
    stored, rooted = "pivots" in rows.columns, "root" in rows.columns
    names = ["bucket", "side", "node", *(f"f{k}" for k in range(words)), *(["pivots"] if stored else []), *(["root"] if rooted else [])]
    refs = references(8, words)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(part, out) -> None:
        node, root, side, f, pivots = part
        known = np.unique(root, return_inverse=True)[1]
        if not known.any():  # one root
            return
        a, b = close_pairs(f, pivots.astype(np.int16), most, side if side.max() > 0 else None)
        for x, y in forest(a, b, known):
            out[0].append(node[x])
            out[1].append(node[y])

    def work(batches):
        rest = None
        for batch in ended(batches):
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys[::-1] != keys[-1], True)) if len(keys) else 0
            whole, rest = table.slice(0, len(keys) - cut), table.slice(len(keys) - cut)
            yield from links(whole)
        if rest is not None:
            yield from links(rest)

    def links(table):
        keys = table.column("bucket").to_numpy()
        if not len(keys):
            return
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        node = table.column("node").to_numpy()
        root = table.column("root").to_numpy() if rooted else node
        side = table.column("side").to_numpy()
        f = np.stack([table.column(f"f{k}").to_numpy() for k in range(words)], axis=1).view(np.uint64)
        if stored:
            pivots = np.frombuffer(b"".join(table.column("pivots").to_pylist()), np.uint8).reshape(len(keys), -1)
        else:
            some = np.repeat(sizes > 1, sizes)
            pivots = np.zeros((len(keys), len(refs)), np.uint8)
            pivots[some] = distances(f[some][:, None, :], refs[None])
        out: tuple[list, list] = ([], [])
        two = starts[sizes == 2]
        near = np.abs(pivots[two].astype(np.int16) - pivots[two + 1].astype(np.int16)).max(axis=1, initial=0) <= most
        two = two[near & (root[two] != root[two + 1]) & ((side[two] == 0) | (side[two] != side[two + 1]))]
        two = two[distances(f[two], f[two + 1]) <= most]
        out[0].extend(node[two])
        out[1].extend(node[two + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            bucket((node[s : s + n], root[s : s + n], side[s : s + n], f[s : s + n], pivots[s : s + n]), out)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return rows.select(*names).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long")


def pigeon_masks(blocks: int = 4, most: int = 2) -> list[tuple[int, ...]]:
    """Masks of 64 bits: fingerprints that differ in at most `most` bits agree under at least one of them."""
    size = 64 // blocks
    part = [((1 << size) - 1) << (k * size) for k in range(blocks)]
    return [(sum(part[k] for k in chosen),) for chosen in combinations(range(blocks), blocks - most)]


def sampled_bits(tables: int, bits: int, width: int = 64 * WIDTH, seed: int = 7) -> np.ndarray:
    """For each table the numbers of the fingerprint's bits that it samples."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(width, bits, replace=False) for _ in range(tables)])


def with_pivots(prints: DataFrame, words: int, pivots: int) -> DataFrame:
    """prints with the table of distances to the reference fingerprints, a byte each."""
    refs = references(pivots, words)
    rows = [F.array(*(F.bit_count(F.col(f"f{k}").bitwiseXOR(F.lit(int(ref[k].astype(np.int64))))) for k in range(words))) for ref in refs]
    hexes = [F.lpad(F.hex(F.aggregate(r, F.lit(0), lambda a, x: a + x).cast("long")), 2, "0") for r in rows] if words > 1 else [F.lpad(F.hex(r[0].cast("long")), 2, "0") for r in rows]
    return prints.withColumn("pivots", F.unhex(F.concat(*hexes)))


def links(prints: DataFrame, masks: list[tuple[int, ...]], most: int, words: int = 1) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most `most` bits and agree under a mask.

    prints: node, f0.., pivots; a written table, one row for each node. Bits that agree under a mask make a
    bucket. Buckets of more than BUCKET rows are dealt by a hash into blocks of about that size, and each
    pair of blocks is a bucket of its own, so that no task holds more and no link is lost.
    """
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    keys = [F.xxhash64(F.lit(t), *(F.col(f"f{k}").bitwiseAND(signed(m)) for k, m in enumerate(mask))) for t, mask in enumerate(masks)]
    rows = prints.select(F.explode(F.array(*keys)).alias("bucket"), "node", *(f"f{k}" for k in range(words)), "pivots")
    large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
    return bucket_links(dealt(rows, large), words, most)


def dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows with side; those of the large buckets (bucket, n rows) dealt by a hash of their node into blocks, each pair of blocks a bucket."""
    rows = rows.withColumn("side", F.lit(0))
    large = written(large.select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return rows
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    rows = rows.join(large, "bucket", "left")
    i, j = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("j")
    rows = rows.withColumn("i", i).withColumn("j", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    side = F.when(j.isNull() | (F.col("i") == j), 0).when(F.col("i") < j, 1).otherwise(2)
    bucket = F.when(j.isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")))
    return rows.withColumn("side", side).withColumn("bucket", bucket)


def sampled_rows(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(bucket, node, root, f0, f1) for each table of chosen bits; nodes: node, root, f (the wide fingerprint's bytes)."""
    tables, bits = chosen.shape
    powers = (1 << np.arange(bits)).astype(np.float64)
    first = np.arange(tables, dtype=np.int64) << 48

    def work(batches):
        for batch in ended(batches):
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                node, root = part.column(0).to_numpy(), part.column(1).to_numpy()
                f = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                bit = np.unpackbits(f, axis=1, bitorder="little")
                keys = (bit[:, chosen.ravel()].reshape(-1, bits) @ powers).astype(np.int64).reshape(len(part), tables) + first
                two = f.view(np.int64)[:, :2]
                columns = [keys.ravel(), *(np.repeat(c, tables) for c in (node, root, two[:, 0], two[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "node", "root", "f0", "f1"])

    return nodes.select("node", "root", "f").mapInArrow(work, "bucket long, node long, root long, f0 long, f1 long")


def sampled_links(nodes: DataFrame, chosen: np.ndarray, most: int) -> DataFrame:
    """Links between nodes of different root that agree in the chosen bits of a table and differ in at most `most` of 128 bits.

    Buckets that one text in SHOWN lets expect to be larger than BUCKET are dealt into blocks, as links() does.
    """
    shown = sampled_rows(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SHOWN)) == 0), chosen)
    large = shown.groupBy("bucket").agg((F.count(F.lit(1)) * SHOWN).alias("n")).filter(F.col("n") > BUCKET)
    return bucket_links(dealt(sampled_rows(nodes, chosen), large), 2, most)


def simhash_components(docs: DataFrame, words: int = 3, most: int = 2, pivots: int = 32) -> DataFrame:
    """Each row's fingerprint and its class under links of at most `most` (1 to 3) differing bits.

    Candidates agree in all but `most` of most + 2 blocks of the fingerprint, which no link can fail to;
    pivot distances discard, and the fingerprints themselves verify. Equal fingerprints are one node.
    component_id is the smallest doc_id of the class; null doc_ids are passed over, and null if there
    are no others. Null text counts as empty, and empty texts, with fingerprint 0, are linked like
    any others. Repeated rows are kept. Other columns of docs aren't read.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    nodes = rows.groupBy("f").agg(F.min("doc_id").alias("least"))
    prints = written(with_pivots(nodes.select(F.col("f").alias("node"), F.col("f").alias("f0")), 1, pivots), "prints")
    roots = components(links(prints, pigeon_masks(most + 2, most), most))
    by_print = nodes.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    by_print = written(by_print, "roots")
    classes = by_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(looked_up(by_print.filter(F.col("root").isNotNull()).select("root", "f"), classes, "root", "inner").select("f", "component_id"), "named")
    return looked_up(rows, named, "f", "inner").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, words: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, t1, t2, f, sketch): hashes of the text, a fingerprint of 64 * WIDTH bits, and the text's `size` smallest shingle hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("f", pa.binary()), ("sketch", pa.binary())])

    def work(batches):
        for batch in sliced(batches):
            prints, kept = [], []
            for text in batch.column(3).to_pylist():
                h = shingle_hashes(text, words)
                prints.append(wide_fingerprint(h, WIDTH).tobytes())
                kept.append(np.unique(h)[:size].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.binary()), pa.array(kept, pa.binary())], schema=schema)

    text = text_of()
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("other"), text).alias("t2"), text.alias("text"))
    return read.mapInArrow(work, "doc_id long, t1 long, t2 long, f binary, sketch binary")


def alike(pairs: DataFrame, similarity: float, size: int = SKETCH) -> DataFrame:
    """Of pairs (a, b, sketch_a, sketch_b), those (a, b, sure) that can have at least this Jaccard similarity.

    Sure, and exact, if neither text has `size` shingles. Else it is estimated on the `size` smallest of all, and
    pairs that are not five standard errors below the similarity are given, not sure.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
    margin = 5 * math.sqrt(similarity * (1 - similarity) / size)

    def work(batches):
        for batch in ended(batches):
            keep, sure = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.sort(np.concatenate([x, y]))
                twin = z[1:] == z[:-1]
                union = z[np.append(True, ~twin)] if len(z) else z
                both = z[1:][twin]
                exact = max(len(x), len(y)) < size
                if not exact:
                    union = union[:size]
                    both = both[both <= union[-1]]
                keep.append(len(both) >= (similarity - (0 if exact else margin)) * len(union))
                sure.append(exact)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(mask) for x in (batch.column(0), batch.column(1), pa.array(sure, pa.bool_()))], schema=schema)

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(work, "a long, b long, sure boolean")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles: array of the different hashes) of the wanted texts (node, t1, t2, least), each from the row of doc_id least."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def work(batches):
        for batch in ended(batches):
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), whole], schema=schema)

    text = text_of()
    read = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("other"), text).alias("h2"), text.alias("text"))
    same = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & F.col("d").eqNullSafe(F.col("least"))
    return read.join(wanted, same).select("node", "text").mapInArrow(work, "node long, shingles array<long>").dropDuplicates(["node"])


def sent(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if its rows are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def tables_for(p: float, bits: int, most: int, recall: float, width: int = 64 * WIDTH) -> int:
    """How many tables of `bits` sampled bits find a pair with this recall, if each of `width` bits differs with probability p.

    All tables sample the same bits, so the chance 1 - (1 - C(width - d, bits) / C(width, bits)) ^ tables is averaged over
    the number d of bits that do differ; and of the 128 compared at most `most` may.
    """
    d = np.arange(width + 1 - bits)
    share = np.array([math.comb(width, int(k)) * p**int(k) * (1 - p) ** (width - int(k)) for k in d])
    agree = np.array([math.comb(width - int(k), bits) / math.comb(width, bits) for k in d])
    passes = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(most + 1))
    if recall >= passes * share.sum():
        raise ValueError(f"recall {recall} is out of reach with at most {most} differing bits")
    tables = 1
    while passes * (share * (1 - (1 - agree) ** tables)).sum() < recall:
        tables += 1
    return tables


def rounds_of(tables: int) -> list[tuple[int, int]]:
    """All tables in three rounds: the first, up to the square root of all, and the others."""
    ends = sorted({0, 1, math.isqrt(tables), tables})
    return list(zip(ends, ends[1:], strict=False))


def one_link_each(links: DataFrame) -> DataFrame:
    """Of links (a, b), a < b, the one of each b to its least a, a written table: fewer than there are nodes, however many tables link a group."""
    return written(links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")


def linked(nodes: DataFrame, chosen: np.ndarray, most: int) -> DataFrame:
    """The different links of nodes, a written table, a < b."""
    return written(sampled_links(nodes, chosen, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")


def confirmed(found: DataFrame, docs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of links (a, b) between nodes, those with at least this similarity, exactly; a written table.

    The sketches in rows discard; what they leave open is decided on all shingles of the two texts.
    """
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = sent(written(nodes.join(ends(found), "node").select("node", "t1", "t2"), "ends"))
    known = rows.select("t1", "t2", "sketch").join(wanted, ["t1", "t2"]).groupBy("node").agg(F.first("sketch").alias("sketch"))
    known = written(known, "known")
    pairs = found.join(known.toDF("a", "sketch_a"), "a").join(known.toDF("b", "sketch_b"), "b")
    judged = written(alike(pairs, similarity), "alike")
    sure, open_ = judged.filter("sure").select("a", "b"), judged.filter(~F.col("sure")).select("a", "b")
    if open_.isEmpty():
        return sure
    wanted = sent(written(nodes.join(ends(open_), "node").select("node", "t1", "t2", "least"), "ends"))
    sets = written(shingle_sets(docs, wanted, words), "shingles")
    both = open_.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("n"), (F.size("of_a") + F.size("of_b")).alias("all"))
    exact = sizes.filter(F.col("n") >= similarity * (F.col("all") - F.col("n"))).select("a", "b")
    return sure.union(written(exact, "exact"))


def verified_links(rows: DataFrame, most: int, similarity: float) -> DataFrame:
    """Links (a, b) with at least this similarity that join what is joined by such links within each bucket.

    rows: bucket, side, node, root, f and shingles. Pairs of different roots that differ in at most `most` of 128 bits are tested on all their shingles, the
    closest first, unless links found before have joined them; so a bucket of n rows gives fewer than n links.
    """
    refs = references(8, 2)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(table) -> tuple[list[int], list[int]]:
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        f = np.frombuffer(b"".join(table.column("f").to_pylist()), np.uint64).reshape(len(node), -1)[:, :2]
        a, b = close_pairs(f, distances(f[:, None, :], refs[None]), most, side if side.max() > 0 else None)
        apart = root[a] != root[b]
        if not apart.any():
            return [], []
        column = table.column("shingles").combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = column[k].values.to_numpy()
            return sets[k]

        _, start = np.unique(root, return_inverse=True)
        up = list(range(int(start.max()) + 1))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        one, two = [], []
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = top(int(start[x])), top(int(start[y]))
            if p == q:
                continue
            v, w = shingles(x), shingles(y)
            if min(len(v), len(w)) < similarity * max(len(v), len(w)):
                continue
            n = len(np.intersect1d(v, w, assume_unique=True))
            if n >= similarity * (len(v) + len(w) - n):
                up[max(p, q)] = min(p, q)
                one.append(int(node[x]))
                two.append(int(node[y]))
        return one, two

    def work(batches):
        rest = None
        for batch in ended(batches):
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = table.column("bucket").to_numpy()
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            for s, t in zip(starts, starts[1:], strict=False):
                yield links_of(table.slice(s, t - s))
            rest = table.slice(starts[-1])
        if rest is not None and len(rest):
            yield links_of(rest)

    def links_of(table):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in bucket(table)], schema=schema)

    return rows.select("bucket", "side", "node", "root", "f", "shingles").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """docs without all but one document of each group of near copies; columns unchanged.

    Near copies share at least `similarity` of their shingles of `words` words. At that similarity a bit of a
    SimHash differs with probability p = acos(2s / (1 + s)) / pi. Tables sample as many bits of a fingerprint of 512 as
    keep buckets of unrelated texts small: 20, and beyond 8 million texts so many that a bucket has eight on average. There are as
    many tables as find a pair at the very limit with about the given recall (closer pairs are found more surely; pairs
    linked through others need not be). In a bucket, pivots and then 128 of the bits discard what differs by more than p plus three standard deviations;
    shingle sketches discard, and all shingles decide. Tables are searched in three rounds, one of them, then up to the square root of all, then the others: a round searches only for
    links between different classes of those before, so a large group is not linked anew by each table. Of a round's candidates one link a text is tested, so that a group linked by every table costs what its texts do; where others are left, or one is refused, the classes that candidates join are
    taken together, in blocks of BUCKET texts, and their pairs that are not yet joined are tested there, so none is lost to the forest. Null text counts as empty. Equal texts are near copies, thus of all empty
    texts one stays. The row with the smallest doc_id stays (null last).
    """
    with scratch(docs.sparkSession) as keep:
        stays, repeated = representatives(docs, words, similarity, recall)
        keep.append(stays)
    k1, k2, doc, other = (free_name(n, docs) for n in ("__t1", "__t2", "__doc", "__other"))
    text = text_of()
    keyed = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit("other"), text))
    drop = sent(stays.toDF(doc, f"{other}1", f"{other}2"))
    same = (F.col(k1) == F.col(f"{other}1")) & (F.col(k2) == F.col(f"{other}2")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    kept = keyed.join(drop, same, "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", k1, k2])
    return kept.drop(k1, k2)


def representatives(docs: DataFrame, words: int, similarity: float, recall: float) -> tuple[DataFrame, bool]:
    """For near_dedup: (doc_id, t1, t2) of the rows that go, as a written table, and whether rows repeat."""
    rows = written(sketches(docs, words), "sketches")
    texts = written(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.first("f").alias("f")), "texts")
    nodes = written(texts.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    n = max(2, nodes.count())
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(20, math.ceil(math.log2(n)) - 3)
    most = round(128 * p + 3 * math.sqrt(128 * p * (1 - p)))
    tables = tables_for(p, bits, most, recall)
    chosen = sampled_bits(tables, bits)
    roots = refused = candidates = None
    for start, end in rounds_of(tables):
        classed = nodes.withColumn("root", F.col("node"))
        if roots is not None:
            classed = nodes.select("node", "f").join(sent(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
            classed = written(classed, "classed")
        found = linked(classed, chosen[start:end], most)
        edges = confirmed(one_link_each(found), docs, nodes, rows, words, similarity)
        refused = refused or edges.count() < found.count()
        candidates = found if candidates is None else candidates.union(roots.select("node", "root")).union(found)
        roots = written(components(edges if roots is None else roots.toDF("a", "b").union(edges)), "classes")
    if refused:
        # a link refused or left out may have stood in for others: what candidates join but edges don't is compared in all pairs
        torn = components(candidates).toDF("node", "whole").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        torn = written(torn, "torn")
        wholes = torn.groupBy("whole").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("whole")
        again = written(nodes.join(torn.join(wholes, "whole"), "node"), "again")
        sets = shingle_sets(docs, sent(written(again.select("node", "t1", "t2", "least"), "ends")), words)
        held = written(again.join(sets, "node").select(F.col("whole").alias("bucket"), "node", "root", "f", "shingles"), "held")
        large = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
        more = written(verified_links(dealt(held, large), most, similarity), "more")
        if not more.isEmpty():
            roots = components(roots.toDF("a", "b").union(more))
    group = nodes.select("node", "t1", "t2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = group.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "t1", "t2")).alias("best"))
    stays = written(best.select("best.least", "best.t1", "best.t2"), "stays")
    gone = rows.select("doc_id", "t1", "t2").join(
        stays, (rows["t1"] == stays["t1"]) & (rows["t2"] == stays["t2"]) & rows["doc_id"].eqNullSafe(stays["least"]), "left_anti"
    )
    gone = written(gone.distinct(), "gone")
    repeated = not rows.groupBy("doc_id", "t1", "t2").count().filter("count > 1").isEmpty()
    return gone, repeated
