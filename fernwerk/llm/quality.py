"""Quality rules, with a linear-chain conditional random field that tells content lines from boilerplate."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of, written
from .lines import line_hash

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Buckets of each line feature, by upper ends: words, symbols a word, share of capitals, of different words, of digits, mean word length.
EDGES = [(2, 4, 8, 16, 32), (0.02, 0.1, 0.3), (0.1, 0.3, 0.6), (0.3, 0.6, 0.9), (0.02, 0.1, 0.3), (2.5, 4, 7, 12)]
#: After them: whether the line repeats, how it ends, and whether it is the text's first, an inner or its last one.
WIDTHS = [*(len(e) + 1 for e in EDGES), 2, 2, 3]
FIRST = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
N = sum(WIDTHS)
#: Lines of a training sequence; longer texts are several sequences.
LONGEST = 64
#: Different lines of the training texts, 8 bytes each, that are broadcast to be counted; beyond, lines are shuffled.
BROADCAST_LINES = 1_000_000


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of N-valued feature numbers and the characters of each line that has a word."""
    rows, chars, seen = [], [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        low = line.lower()
        letters = sum(map(str.isupper, line)) if low != line else 0
        rows.append((n, sum(map(line.count, SYMBOLS)) / n, letters / size, len(set(words)) / n, sum(map(str.isdigit, line)) / size if any(map(line.__contains__, "0123456789")) else 0.0, size / n - 1, line in seen, line.rstrip()[-1] in ".!?:;…\"”»"))
        seen.add(line)
        chars.append(size)
    values = np.array(rows, np.float64).reshape(-1, len(WIDTHS) - 1)
    out = np.ones((len(rows), len(WIDTHS)), np.int64)
    out[:1, -1], out[1:][-1:, -1] = 0, 2
    for k, edges in enumerate(EDGES):
        out[:, k] = np.searchsorted(edges, values[:, k], side="right")
    out[:, len(EDGES) : -1] = values[:, len(EDGES) :]
    return out + FIRST, np.array(chars, np.int64)


class LineCrf:
    """Two labels, 0 boilerplate and 1 content: weights of the features for content, and of the four steps between labels."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros(N) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels; of equally likely ones content."""
        score = self.weights[features].sum(axis=1).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back = 0.0, 0.0, []
        for k, e in enumerate(score):
            if not k:
                a, b = 0.0, e
                continue
            to0, to1 = (b + s10 >= a + s00), (b + s11 >= a + s01)
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + e
        out = np.zeros(len(score), np.int64)
        if score:
            now = int(b >= a)
            out[-1] = now
            for k in range(len(back) - 1, -1, -1):
                now = int(back[k][now])
                out[k] = now
        return out

    def rise(self, batch: Sequences, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood a line of the whole label sequences, less the penalty, and its gradient in weights and steps."""
        there, feature, label = batch.there, batch.feature, batch.label
        size, most = there.shape
        lines, pair = there.sum(), there[:, 1:]
        e = np.stack([np.zeros((size, most)), self.weights[feature].sum(axis=2)], axis=2)
        fore, back = np.zeros((size, most, 2)), np.zeros((size, most, 2))
        fore[:, 0] = e[:, 0]
        for t in range(1, most):
            step = np.logaddexp.reduce(fore[:, t - 1, :, None] + self.steps, axis=1) + e[:, t]
            fore[:, t] = np.where(there[:, t, None] > 0, step, fore[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = np.logaddexp.reduce(self.steps + (e[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(there[:, t + 1, None] > 0, step, 0)
        whole = np.logaddexp.reduce(fore[:, -1], axis=1)
        is_content = np.exp(fore[:, :, 1] + back[:, :, 1] - whole[:, None]) * there
        gap = (label - is_content) * there
        gw = np.bincount(feature.ravel(), np.repeat(gap.ravel(), len(WIDTHS)), N) / lines - penalty * self.weights
        joint = fore[:, :-1, :, None] + self.steps + (e[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        gs = (batch.steps - (np.exp(np.minimum(joint, 0)) * pair[:, :, None, None]).sum(axis=(0, 1))) / lines - penalty * self.steps
        said = (e[:, :, 1] * label * there).sum() + (batch.steps * self.steps).sum() - whole.sum()
        return said / lines - penalty / 2 * ((self.weights**2).sum() + (self.steps**2).sum()), gw, gs

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> LineCrf:
        """By gradient ascent; texts: features and labels of their lines."""
        self, batch = cls(), Sequences(texts)
        if not len(batch.there):
            return self
        g2w, g2s = np.full(N, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(rounds):
            _, gw, gs = self.rise(batch, penalty)
            g2w, g2s = g2w + gw**2, g2s + gs**2
            self.weights = self.weights + rate * gw / np.sqrt(g2w)
            self.steps = self.steps + rate * gs / np.sqrt(g2s)
        return self


class Sequences:
    """Texts' lines as sequences of at most LONGEST: which places are lines, their features and labels, and the counts of label steps."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        parts = [(f[k : k + LONGEST], y[k : k + LONGEST]) for f, y in texts for k in range(0, len(y), LONGEST)]
        size, most = len(parts), max((len(y) for _, y in parts), default=0)
        self.there = np.zeros((size, most))
        self.feature = np.zeros((size, most, len(WIDTHS)), np.int64)
        self.label = np.zeros((size, most), np.int64)
        for k, (f, y) in enumerate(parts):
            self.there[k, : len(y)], self.feature[k, : len(y)], self.label[k, : len(y)] = 1, f, y
        pair, before, after = self.there[:, 1:], self.label[:, :-1], self.label[:, 1:]
        self.steps = np.array([[(pair * (before == p) * (after == q)).sum() for q in (0, 1)] for p in (0, 1)])


def first_labels(texts: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Labels of the lines of (features, boilerplate anyhow, quality): weak labels before any sequence is looked at.

    Lines that repeat or are shared are boilerplate. Other lines of good texts are content; those of bad texts are boilerplate if their
    features are likelier in bad texts than in good ones, each feature counted by itself.
    """
    seen = np.ones((2, N))
    for f, anyhow, q in texts:
        seen[q] += np.bincount(f[~anyhow].ravel(), minlength=N)
    for first, width in zip(FIRST, WIDTHS, strict=True):
        seen[:, first : first + width] /= seen[:, first : first + width].sum(axis=1, keepdims=True)
    odds = np.log(seen[1] / seen[0])
    return [np.where(anyhow, 0, 1 if q else odds[f].sum(axis=1) >= 0).astype(np.int64) for f, anyhow, q in texts]


def train_crf(docs: DataFrame, labels: DataFrame, sample: int = 1000, shared: int = 5, turns: int = 3) -> LineCrf:
    """Fits the field on the lines of at most `sample` labelled texts of either quality (those with the smallest hashes).

    No line has a label, so they are weak ones: first_labels(), where a line is boilerplate anyhow if it repeats within its text or
    stands in at least `shared` different texts of docs, all of which are counted (a good text of which over half the lines are shared is itself
    what others copy, and keeps them). Then `turns` times the field is fitted, and each line of a bad text that isn't
    boilerplate anyhow is labelled anew by the field. Repeated and null rows of labels change nothing; a doc_id of both
    qualities counts as bad. Without labelled texts all weights are 0, and every line is content.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("q"))
    known = written(known, "labelled")
    chosen = None
    for q in (0, 1):
        some = known.filter(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    every = docs.select(F.col("doc_id").cast("long").alias("id_"), text_of().alias("text"))
    rows = every.join(F.broadcast(chosen), F.col("id_") == F.col("id")).select("q", "text").dropDuplicates(["q", "text"])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    mine = written(rows.select(F.explode(F.transform(F.split("text", "\n"), line_hash)).alias("line")).distinct(), "known")
    if mine.count() <= BROADCAST_LINES:
        mine = F.broadcast(mine)
    each = every.select(F.xxhash64("text").alias("t"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_hash))).alias("line"))
    often = each.join(mine, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shared).select(F.col("line").alias("often"))
    often = written(often, "often")
    flags = rows.select("row", F.posexplode(F.split("text", "\n")).alias("at", "x")).select("row", "at", line_hash(F.col("x")).alias("line"))
    flags = flags.join(often, F.col("line") == F.col("often")).groupBy("row").agg(F.collect_list("at").alias("common"))
    rows = rows.join(flags, "row", "left").select("text", "q", F.coalesce("common", F.array().cast("array<int>")).alias("common"))

    def work(batches):
        for batch in sliced(batches):
            found, anyhow = [], []
            for text, q, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                f, _ = line_features(lines)
                there = [k for k, x in enumerate(lines) if x.split()]
                also = np.isin(there, common)
                flagged = (also & (q == 0 or 2 * also.sum() <= len(there))) | (f[:, len(EDGES)] - FIRST[len(EDGES)] == 1)
                found.append(f.astype(np.uint8).tobytes())
                anyhow.append(flagged.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(anyhow, pa.binary()), batch.column(1)], names=["features", "anyhow", "q"])

    texts = []
    for r in sorted(rows.mapInArrow(work, "features binary, anyhow binary, q int").collect(), key=lambda r: (r.q, bytes(r.features), bytes(r.anyhow))):
        if r.anyhow:
            texts.append((np.frombuffer(r.features, np.uint8).reshape(-1, len(WIDTHS)).astype(np.int64), np.frombuffer(r.anyhow, bool), r.q))
    said = first_labels(texts)
    crf = LineCrf.fit([(f, y) for (f, _, _), y in zip(texts, said, strict=True)])
    for _ in range(turns - 1):
        said = [y if q else np.where(anyhow, 0, crf.viterbi(f)) for (f, anyhow, q), y in zip(texts, said, strict=True)]
        crf = LineCrf.fit([(f, y) for (f, _, _), y in zip(texts, said, strict=True)])
    return crf


def n_repeated(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    end = total = 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            total += k + 3 - max(end, k)
            end = k + 3
    return total


def quality(docs: DataFrame, crf: LineCrf, min_words: int = 50, most_repeated: int = 50, content: float = 0.5) -> DataFrame:
    """Counts of each whole text, the base rules' verdict and, by the share of content lines' characters, kept.

    Null text counts as empty: no words, base rules failed, not kept. Lines without a word are no part of
    the sequence. Repeated rows and null doc_id are judged as they come.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]
    schema = pa.schema(fields)

    def judge(doc, text):
        words = text.encode().split()
        n = len(words)
        lines = text.split("\n")
        seen: set[str] = set()
        again = 0
        for line in lines:
            if line.strip(SPACES):
                again += line in seen
                seen.add(line)
        repeated = n_repeated(words)
        failed = n < min_words or 100 * repeated > most_repeated * n
        features, chars = line_features(lines)
        share = float((chars * crf.viterbi(features)).sum() / chars.sum()) if len(chars) else 0.0
        return doc, n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated, failed, not failed and share >= content, share

    def work(batches):
        for batch in sliced(batches):
            rows = [judge(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, kinds)
