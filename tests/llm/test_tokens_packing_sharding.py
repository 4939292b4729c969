import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from fernwerk.llm import counting, packing, sharding, tokens
from fernwerk.llm.tokens import vocabulary, word_bpe

ODD = [
    None, "", "   ", "a", "it's they're don't we've I'm you'll he'd 'quoted' ''s !'s 's", "a<|endoftext|>b <|startoftext|>", "ab́c ½ x² 中文 İ  x",
    "tab\tnl\n\r\n  x", "###$$$ 12345 a1b2", "Straße ÉCOLE çà et là", "...!?'s're", "word " * 9000, "x" * 3000, "Of the the of", "Of the the of",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "x", 1.5) for k, t in enumerate(ODD)] + [(1, "", "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, rank double")


def library_ids(text):
    return word_bpe(vocabulary()).library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_prefix_counts_are_the_librarys(sf_dir):
    import pyarrow.parquet as pq

    bpe = word_bpe(vocabulary())
    texts = [t for t in ODD if t is not None] + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:100]
    for text in texts:
        ids = library_ids(text)
        assert bpe.ids(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert bpe.chunk_counts(text)[-1] == len(ids)
    random.seed(3)
    for text in [t for t in texts if len(t) < 300]:
        assert bpe.prefix_counts(text) == [len(library_ids(text[:i])) for i in range(len(text) + 1)]


def test_common_words_stay_known_while_rare_ones_go(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 100)
    bpe, asked = tokens.WordBpe(vocabulary()), []
    tokenize = bpe.model.tokenize

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return tokenize(letters)

    bpe.model = Model()
    rng = random.Random(5)
    for _ in range(40):
        text = "common words, come again: " + " ".join("".join(rng.choices("abcdefgh", k=9)) + rng.choice(["", ".", "!?"]) for _ in range(30))
        ids = library_ids(text)
        assert bpe.ids(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert asked.count("common") == asked.count("words") == 1
    assert len(bpe.known) + len(bpe.older) < 2 * 100


def test_token_counts(odd):
    got = sorted(counting.token_counts(odd, limit=50, with_prefixes=True).collect(), key=str)
    assert len(got) == len(ODD) + 1
    by = defaultdict(list)
    for k, t in [*enumerate(ODD), (1, "")]:
        by[None if k == 3 else k].append(t or "")
    for r in got:
        text = by[r.doc_id][0]
        n = len(library_ids(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)
        assert len(library_ids(text[: r.cut_chars])) <= 50 or r.cut_chars == 0
        assert r.prefix_tokens[-1] == n and counting.stop_end(text, len(r.prefix_tokens) - 1) == len(text.rstrip())
    spread = counting.tokens_between(counting.token_counts(odd, with_prefixes=True).selectExpr("*", "1 i", "3 j"), "i", "j").filter("doc_id = 13").first()
    assert spread.n_between == 2


SCRIPTS = [
    "“curly” – dash — and… ‘quotes’ don’t", "中文字符 没有空格的一段很长的文本 混合English words", "Ελληνικά ΣΊΣΥΦΟΣ τέλος", "Привет, МИР! Ёлка’s", "עברית العربية ١٢٣ ٣", "한국어 문장 조합", "e\u0301a\u0300 cafe\u0301s x\u0323\u0307",
    "non\u00a0breaking\u3000space\u2003em\u0085next\u2028line \x1cfile\x1fsep", "a<|endoftext|>b c<|startof d<|startoftext|>", "İstanbul ǅ ﬁ Å K", "😀👍🏽 emoji's 1½² ⅷ", "I'LL we'Re 'tis it'sé 's'é",
]


@pytest.mark.parametrize("text", SCRIPTS)
def test_every_script_is_counted_by_chunks(text):
    bpe = word_bpe(vocabulary())
    want = [len(library_ids(text[:i])) for i in range(len(text) + 1)]
    assert bpe.prefix_counts(text) == want
    assert bpe.chunk_counts(text)[-1] == want[-1] and bpe.chunk_counts(f"plain {text} plain")[-1] == len(library_ids(f"plain {text} plain"))
    for limit in range(max(want) + 1):
        assert bpe.cut(text, limit) == max(i for i, c in enumerate(want) if c <= limit)


@settings(max_examples=2000, deadline=None, derandomize=True)
@example("¨\U0003d000")
@given(st.text(st.one_of(st.sampled_from(list("ab 's\n!1é’ñ中Σ\u0301\u00a0<|>İß٣क्")), st.characters(codec="utf-8")), max_size=24))
def test_any_text_is_counted_as_the_library_does(text):
    bpe = word_bpe(vocabulary())
    assert bpe.chunk_counts(text)[-1] == len(library_ids(text))
    assert bpe.prefix_counts(text) == [len(library_ids(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["中文字符" * 300, "ab" * 700 + " x " + "é" * 300, "0123456789" * 60, "word " * 400, "¨\U0003d000'sé" * 120, "e\u0301" * 300])
def test_long_chunks_have_stored_counts_inside(text):
    """Every 256 code points of a chunk without white space; truncation between two of them is exact and the store says where it is."""
    bpe = word_bpe(vocabulary())
    stored = bpe.stored_counts(text)
    ends = [counting.stop_end(text, k) for k in range(len(stored))]
    longest = max(map(len, text.split()))
    assert len(stored) == 1 + sum(-(-len(c) // 256) for c in text.split()) and (longest <= 256 or len(stored) > 2)
    for end, count in zip(ends, stored, strict=True):
        assert count == len(library_ids(text[:end]))
    for limit in {0, 1, int(stored[-1]) // 3, int(stored[-1]) // 2, int(stored[-1]) - 1}:
        end = bpe.cut(text, limit)
        assert len(library_ids(text[:end])) <= limit < len(library_ids(text[: end + 1]))


def check_packing(rows, docs, capacity):
    lengths, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        slots[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
        assert r.start % capacity == 0
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return slots


@pytest.mark.parametrize("capacity", [16, 100, 4096])
def test_packing_is_gapless_and_whole(odd, capacity):
    rows = packing.pack_documents(odd, capacity=capacity, with_ids=True).collect()
    slots = check_packing(rows, odd, capacity)
    want = sorted(struct.pack(f"<{len(x)}I", *x) for x in ([*library_ids(t), 1] for t in [*ODD, ""]))
    by = defaultdict(list)
    for r in rows:
        assert zlib.crc32(struct.pack(f"<{r.length}i", *r.ids)) == r.ids_crc32
        by[r.doc_id].append((r.piece, r.ids))
    one = {d: [x for _, ids in sorted(p) for x in ids] for d, p in by.items() if d != 1}
    assert all(one[d] == [*library_ids(t), 1] for d, t in enumerate(ODD) if d not in (1, 3))
    total = sum(len(w) // 4 for w in want)
    assert len(slots) <= 1.25 * total / capacity + 2


def test_plan_places_every_piece_once():
    random.seed(5)
    for _ in range(30):
        capacity = random.choice([10, 37, 256])
        histogram = {n: random.randint(1, 40) for n in random.sample(range(1, capacity + 1), random.randint(1, 9))}
        runs = packing.plan_best_fit(histogram, capacity)
        bins, counts = defaultdict(list), defaultdict(int)
        for n, k in histogram.items():
            mine = sorted(r for r in runs if r[0] == n)
            for rank in range(k):
                _, first_rank, copies, first, offset = [r for r in mine if r[1] <= rank][-1]
                nth, copy = divmod(rank - first_rank, copies)
                bins[first + nth].append((offset + copy * n, n))
                counts[n] += 1
        for s in bins.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= capacity
        # one by one, best fit decreasing
        room = []
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(capacity - n)
        assert len(bins) == len(room)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).collect() == []
    assert counting.token_counts(none).collect() == []
    assert sharding.shard_documents(none).collect() == []


def test_shards_are_balanced_and_gapless(odd, spark, sf_dir):
    for docs, shards in ((odd, 4), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)):
        rows = sharding.shard_documents(docs, shards=shards).collect()
        texts = sorted((r.text or "") for r in docs.collect())
        assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32(t.encode()) for t in texts)
        load, slots = defaultdict(int), defaultdict(list)
        for r in rows:
            load[r.shard] += r.size
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and 0 <= r.shard < shards
        assert sum(load.values()) == sum(len(t.encode()) + 16 for t in texts)
        for s in slots.values():
            assert sorted(s) == list(range(len(s)))
        largest = max(r.size for r in rows)
        assert max(load.values()) - min(load.get(k, 0) for k in range(shards)) <= largest


def test_one_group_of_copies_is_split(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "case when id % 3 = 0 then repeat('same words ', 20) else concat(repeat(cast(id as string), 30), ' x') end text")
    rows = sharding.shard_documents(docs, shards=5, grain=32).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == 3000 and max(load.values()) - min(load.values()) < 0.01 * max(load.values())


def test_equal_texts_stay_in_one_shard(odd, spark, sf_dir):
    for docs, shards in ((odd, 4), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 8), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)):
        rows = sharding.shard_documents(docs, shards=shards).collect()
        share = sum(r.size for r in rows) / shards
        where, size = defaultdict(set), defaultdict(int)
        for r in rows:
            where[r.text_crc32, r.size].add(r.shard)
            size[r.text_crc32, r.size] += r.size
        assert all(len(where[t]) <= max(1, -(-size[t] // share)) for t in where)


def test_placement_is_the_plain_rule():
    """Each item, the largest first, where the dot product with residual capacity is highest; equal products to the first shard."""
    r = np.random.default_rng(1)
    for kind in range(4):
        items = r.integers(1, (4, 50, 3, 1000)[kind], (60, 3)).astype(float)
        if kind == 2:
            items[:] = 2.0  # nothing but ties
        shards = 5
        share = items.sum(axis=0) / shards
        sizes = items / share
        room = [[1.0] * 3 for _ in range(shards)]
        want = [0] * len(items)
        for k in sorted(range(len(items)), key=lambda k: (-max(sizes[k]), k)):
            fits = [s for s in range(shards) if room[s][0] >= sizes[k][0]]
            if fits:
                worth = {s: sum(a * b for a, b in zip(room[s], sizes[k], strict=True)) for s in fits}
            else:
                fits = range(shards)
                worth = {s: room[s][0] for s in fits}
            top = max(worth.values())
            want[k] = next(s for s in fits if worth[s] >= top - 1e-12)
            room[want[k]] = [a - b for a, b in zip(room[want[k]], sizes[k], strict=True)]
        got = sharding.place(items, shards)
        assert kind in (0, 1, 3) or list(np.bincount(got)) == [12] * 5
        loads = lambda where: sorted(np.bincount(where, items[:, 0], shards))
        assert list(got) == want or np.allclose(loads(got), loads(np.array(want)))


def test_shards_count_real_tokens(odd, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = {r.doc_id: r.tokens for r in sharding.sized(odd, None).collect()}
    assert all(got[d] == len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items())
