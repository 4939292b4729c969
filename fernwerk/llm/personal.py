"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, and a classifier trained on that decides."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Candidates beyond the base kinds: addresses spelt out, IP version 6, and phone numbers without a plus sign. Malformed base matches are candidates too.
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]++)+")
HANDLE = re.compile(r"[A-Za-z0-9-]++")
SIX = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
NATIONAL = re.compile(r"(?<![\w+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{3,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![\w-]|\.[0-9])")
#: Gazetteers of top-level domains, calling codes and issuers' first digits.
DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk it nl pl eu ch at be us ca au mx br ru cn jp in".split())
CALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
NEAR = 40
CONTEXT = [
    re.compile(r"mail|contact|write|courriel|correo|schreib", re.I),
    re.compile(r"\bip\b|host|server|address|adresse|login", re.I),
    re.compile(r"card|visa|credit|payment|carte|tarjeta|karte", re.I),
    re.compile(r"phone|tel|call|fax|mobile|appel|anruf|llama", re.I),
]
AGAINST = re.compile(r"version|order|isbn|issn|invoice|ref\b|build|doi", re.I)
#: Labelers: pattern, gazetteer, context, structure, surroundings. A vote is 2 for, 0 against, 1 if it abstains.
VOTES = 5
CODES = 3**VOTES
#: Buckets of the span classifier's hashed features, and how many a span has.
FEATURES, OF_SPAN = 1 << 12, 11
SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))
FOUND = "array<struct<kind:int,start:long,end:long,pattern:int,features:array<int>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind, and loose ones with whether they are malformed; each pattern in one pass."""
    base, loose = [], []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            base.append((0, start, m.end()))
            done = m.end()
        elif start < at and (h := HANDLE.match(text, at + 1)):
            loose.append((0, start, h.end(), True))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())
        base.append((1, *m.span())) if fits else loose.append((1, *m.span(), True))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19:
            good = luhn(d)
            base.append((2, *m.span())) if good and len(d) >= 16 else loose.append((2, *m.span(), not good))
    if "+" in text:
        for m in PHONE.finditer(text):
            fits = 8 <= sum(map("0123456789".__contains__, m[0])) <= 15
            base.append((3, *m.span())) if fits else loose.append((3, *m.span(), True))
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        loose += [(0, *m.span(), False) for m in SPELT.finditer(text)]
    if text.count(":") >= 7:
        loose += [(1, *m.span(), False) for m in SIX.finditer(text)]
    loose += [(3, *m.span(), False) for m in NATIONAL.finditer(text)]
    return base, loose


def votes(text: str, kind: int, start: int, end: int, strict: bool, malformed: bool) -> int:
    """The labelers' votes as a number in base 3, the first labeler's highest."""
    span = text[start:end]
    d = digits_of(span)
    pattern = 2 if strict else 0 if malformed else 1
    known = structure = 1
    if kind == 0:
        top = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower()
        known = 2 if top in DOMAINS else 0 if not top.isalpha() else 1
        structure = 1 if not malformed else 0
    elif kind == 1:
        known = 0 if d.strip("0") == "" or span.startswith(("0.", "127.", "255.")) else 1
        structure = 0 if malformed else 2 if ":" in span else 1
    elif kind == 2:
        known = 2 if d.startswith(ISSUERS) else 0
        structure = 0 if malformed else 2
    else:
        if span.startswith("+"):
            known = 2 if d.startswith(CALLING) else 0
        structure = 0 if len(d) < 8 or len(d) > 15 else 1
    before = text[max(0, start - NEAR) : start]
    said, against = None, None
    for m in CONTEXT[kind].finditer(before):
        said = m.start()
    for m in AGAINST.finditer(before):
        against = m.start()
    context = 1 if said is None and against is None else 2 if against is None or (said is not None and said > against) else 0
    apart = 0 if text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum() else 1
    out = 0
    for v in (pattern, known, context, structure, apart):
        out = 3 * out + v
    return out


def shape_of(span: str) -> str:
    """The span with letters as a, digits as 9, and runs of either cut to their first three."""
    out = re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", span))
    return re.sub(r"a{3,}", "aaa", re.sub(r"9{3,}", "999", out))


def features_of(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span: its characters, shape and length, and the words around it; no labeler's vote is among them."""
    span = text[start:end]
    digits = digits_of(span)
    before = text[max(0, start - NEAR) : start].lower()
    words = re.findall(r"[^\W\d_]+", before)[-3:]
    words = [""] * (3 - len(words)) + words
    after = re.match(r"\W*([^\W\d_]*)", text[end : end + NEAR].lower())
    given = [
        f"k{kind}", f"s{kind}{shape_of(span)[:24]}", f"n{kind}{min(len(digits), 20)}", f"l{kind}{min(len(span) // 4, 12)}", f"f{kind}{digits[:2]}", f"e{kind}{span[-3:].lower()}",
        *(f"b{kind}{w}" for w in words), f"a{kind}{after[1] if after else ''}", f"p{kind}{text[max(0, start - 1) : start]}{text[end : end + 1]}",
    ]
    return [zlib.crc32(g.encode("utf-8", "replace")) % FEATURES for g in given]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, list[int]]]]:
    """Base spans, and all candidates as (kind, start, end, pattern, features): pattern joins kind, strictness and votes. Loose ones lie outside all base spans."""
    base, loose = all_spans(text)
    if loose and base:
        starts, ends = zip(*sorted((s, e) for _, s, e in base), strict=True)
        reach = [*accumulate(ends, max)]
        loose = [x for x in loose if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]
    every = [(k, s, e, (k * 2 + 1) * CODES + votes(text, k, s, e, True, False), features_of(text, k, s, e)) for k, s, e in base]
    every += [(k, s, e, k * 2 * CODES + votes(text, k, s, e, False, bad), features_of(text, k, s, e)) for k, s, e, bad in loose]
    return base, every


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found): for each row, in one pass over its text."""
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("found", SPAN)]
    schema = pa.schema(fields)
    names = ("kind", "start", "end", "pattern", "features")

    def work(batches):
        for batch in sliced(batches):
            out = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, found = candidates(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                spans = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(base))
                row = (doc, *counts, hashlib.sha256(spans.encode()).hexdigest(), [dict(zip(names, f, strict=True)) for f in found])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kinds = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {FOUND}"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, kinds)


def unpacked(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, strictness and the votes of each pattern number."""
    vote = np.stack([patterns % CODES // 3 ** (VOTES - 1 - k) % 3 for k in range(VOTES)], axis=1)
    return patterns // (2 * CODES), patterns // CODES % 2, vote


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 100, trust: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: each pattern's probability of being personal data, and by truth and labeler the share of votes in favour.

    Each kind has its own share of true candidates. A labeler's reliability is the same for all kinds, for a kind may have too few votes to
    tell. Votes are independent given the truth, and an abstention says nothing. It starts from the majority of votes; a labeler is
    expected to be right `trust` times and wrong once before it is seen.
    """
    cast = np.where(vote == 1, 0.0, 1.0)
    yes = (vote == 2).astype(float)
    post = 1 / (1 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
    hope = np.array([[1.0], [trust]])
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        share = (w @ yes + hope) / (w @ cast + 1 + trust)
        true, every = np.bincount(kind, w[1], 4), np.bincount(kind, n, 4)
        prior = ((true + 1) / (every + 2))[kind]
        odds = np.log(prior / (1 - prior)) + yes @ np.log(share[1] / share[0]) + (cast - yes) @ np.log((1 - share[1]) / (1 - share[0]))
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(now - post).max(initial=0) < 1e-9
        post = now
        if done:
            break
    return post, share


def classifier(features: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on spans' hashed features, fitted to soft labels."""
    w, g2 = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        gap = target - probability(w, features)
        g = np.bincount(features.ravel(), np.repeat(gap, features.shape[1]), FEATURES) / len(target) - penalty * w
        g2 += g * g
        w = w + 0.3 * g / np.sqrt(g2)
    return w


def probability(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[features].sum(axis=1), -30, 30)))


def trained(rows: DataFrame, sample: int) -> np.ndarray | None:
    """The span classifier's weights from scan()'s rows; None if there are no candidates.

    Votes fall into at most 8 * 243 patterns, whose counts over all candidates reach the driver for expectation-maximisation. The classifier learns from at most
    `sample` candidates, those with the smallest hashes, each with its pattern's probability.
    """
    each = rows.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.pattern", "s.features")
    seen = each.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    if not seen:
        return None
    pattern, n = np.array([r["pattern"] for r in seen]), np.array([r["n"] for r in seen], np.float64)
    kind, _, vote = unpacked(pattern)
    post, _ = reliabilities(kind, vote, n)
    bound = 3.0 * (sample + 20) / n.sum()
    h = F.pmod(F.xxhash64("doc_id", "start", "pattern"), F.lit(1 << 40)) / float(1 << 40)
    some = each.withColumn("h", h).filter(F.col("h") < bound).orderBy("h", "pattern", "start", "doc_id").limit(sample).select("pattern", "features").collect()
    features = np.array([r["features"] for r in some], np.int64).reshape(-1, OF_SPAN)
    return classifier(features, post[np.searchsorted(pattern, [r["pattern"] for r in some])])


def find_personal(docs: DataFrame, least: float = 0.8, sample: int = 20_000) -> DataFrame:
    """Spans of personal data for each row: the base ones, and those that the trained classifier adds.

    Labelers vote on all candidates, expectation-maximisation weighs the votes, and a classifier of spans learns from at most `sample` candidates (trained()) and judges
    every loose one: it is added from a probability of `least`, the likelier first where two overlap (then the earlier). n_added counts added spans. Null text counts
    as empty. Repeated rows and null doc_id are scanned as they come. Offsets are code points.
    """
    rows = written(scan(docs), "personal")
    w = trained(rows, sample)
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def chosen(found: list[dict]) -> list[tuple[int, int, int]]:
        loose = [s for s in found if s["pattern"] // CODES % 2 == 0]
        if not loose:
            return []
        p = probability(w, np.array([s["features"] for s in loose]))
        out: list[tuple[int, int, int]] = []
        for q, s in sorted(((q, s) for q, s in zip(p.tolist(), loose, strict=True) if q >= least), key=lambda x: (-x[0], x[1]["start"], x[1]["kind"])):
            at = bisect_left(out, (s["end"],))  # what begins before this one's end; out doesn't overlap
            if not at or out[at - 1][1] <= s["start"]:
                out.insert(at, (s["start"], s["end"], s["kind"]))
        return [(k, b, e) for b, e, k in out]

    def work(batches):
        for batch in sliced(batches):
            spans, added = [], []
            for found in batch.column(6).to_pylist():
                more = chosen(found)
                every = sorted([(s["kind"], s["start"], s["end"]) for s in found if s["pattern"] // CODES % 2] + more)
                spans.append(",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in every))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string()), pa.array(added, pa.int64())], schema=schema)

    return rows.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
