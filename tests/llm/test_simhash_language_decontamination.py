import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fernwerk.llm import components, decontamination, language, queries, simhash

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(w, n, seed):
    r, w = random.Random(seed), list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return w


def plain_fingerprint(text, n=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id reachable over pairs within 2 bits, by comparing all pairs."""
    up = {k: k for k in prints}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {k: top(k) for k in ids}


@pytest.fixture(scope="module")
def texts():
    base = [words(120, s) for s in range(12)]
    out = [" ".join(b) for b in base] + [" ".join(edited(b, e, 100 + e)) for b in base[:6] for e in (1, 1, 2, 3)]
    return [*out, None, "", "  ", "One", "ONE two", "one TWO", "a b c", out[0], out[0].upper(), "É x y z", "word " * 5000]


def test_components_match_all_pairs(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(3 * k + 1, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string, node int")
    prints = {3 * k + 1: plain_fingerprint(t or "") for k, t in enumerate(texts)}
    want = classes(prints)
    for bucket in (1024, 3):  # the second deals nearly all buckets into blocks
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs).collect()}
        assert {k: v[0] for k, v in got.items()} == prints
        assert {k: v[1] for k, v in got.items()} == want


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u v w")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]


def test_random_links_in_blocks(spark):
    r = np.random.default_rng(4)
    f = r.integers(0, 1 << 63, 40, dtype=np.int64)
    near = np.concatenate([f] + [f ^ (np.int64(1) << r.integers(0, 63, 40)) ^ (np.int64(1) << r.integers(0, 63, 40)) for _ in range(6)])
    pivots = simhash.distances(near.view(np.uint64)[:, None, None], simhash.references(8, 1)[None, :, :])
    a, b = simhash.close_pairs(near.view(np.uint64)[:, None], pivots, 2)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    u = near.view(np.uint64)
    assert got == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if bin(int(u[i] ^ u[j])).count("1") <= 2}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    r = random.Random(1)
    edges = {"chain": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 40)], "random": [(r.randrange(80), r.randrange(80)) for _ in range(50)], "none": []}[kind]
    up = {x: x for e in edges for x in e}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == top(k) for k in up)


def test_near_dedup_keeps_one_of_each_group(spark):
    base = {s: words(200, s) for s in range(15)}
    rows = [(k, " ".join(base[k])) for k in base]
    rows += [(100 + k, " ".join(edited(base[k], 2, k))) for k in range(8)] + [(200, rows[3][1]), (3, rows[3][1]), (300, None), (301, ""), (None, "only me here"), (302, "short text"), (303, "short text")]
    docs = spark.createDataFrame([(d, t, "en", "root", 1) for d, t in rows], "doc_id long, text string, lang string, root string, sketch int")
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [*range(15), 300, 302]
    assert got.filter("doc_id is null").count() == 1


def plain_groups(texts, n=5, s=0.8):
    """Number of classes over pairs that share s of their shingles, by comparing all pairs."""
    sets = [set(zip(*(x.split()[k:] for k in range(n)), strict=False)) for x in texts]
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= s * (len(sets[i]) + len(sets[j]) - both):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return len({top(k) for k in range(len(texts))})


def test_recall_at_the_limit(spark):
    texts, near = [], 0
    for k in range(400):
        base = words(200, 20000 + k)
        pair = [" ".join(base), " ".join(edited(base, 4, 21000 + k))]
        sets = [set(zip(*(x.split()[j:] for j in range(5)), strict=False)) for x in pair]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if 0.8 <= similarity <= 0.85:
            near += 1
            texts += pair
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    print("recall", near, (2 * near - got) / near)
    assert near > 200 and (2 * near - got) / near >= 0.93


def test_refused_links_do_not_hide_others(spark):
    base = words(200, 77)
    texts = [" ".join(edited(base, 2 + k % 3, 4000 + k)) for k in range(150)]
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    want = plain_groups(texts)
    assert want <= got <= want + 3  # a spanning forest of unverified pairs alone leaves about ten more


def test_a_group_linked_by_every_table_is_tested_once_a_text(spark, monkeypatch):
    base = words(200, 78)
    texts = [" ".join(edited(base, 3, 6000 + k)) for k in range(120)]
    tested, confirmed = [], simhash.confirmed

    def spy(found, *rest):
        tested.append(found.count())
        return confirmed(found, *rest)

    monkeypatch.setattr(simhash, "confirmed", spy)
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    want = plain_groups(texts)
    assert want <= got <= want + 3
    assert max(tested) < len(texts)


def test_similarity_is_exact_on_short_texts(spark):
    a, b = " ".join(words(60, 1)), " ".join(edited(words(60, 1), 2, 5))
    docs = spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")
    s = [set(zip(*(x.split()[k:] for k in range(5)), strict=False)) for x in (a, b)]
    j = len(s[0] & s[1]) / len(s[0] | s[1])
    rows = simhash.sketches(docs, 5).orderBy("doc_id").collect()
    pair = spark.createDataFrame([(0, 1, rows[0].sketch, rows[1].sketch)], "a long, b long, sketch_a binary, sketch_b binary")
    assert simhash.alike(pair, j - 1e-9).count() == 1 and simhash.alike(pair, j + 1e-9).count() == 0


def test_similarity_of_long_texts_is_exact(spark):
    docs, want = [], []
    for k in range(24):
        base = words(1200, 8000 + k)
        texts = [" ".join(base), " ".join(edited(base, 24 + k % 5, 8100 + k))]
        want += [2 * k] if plain_groups(texts) == 1 else [2 * k, 2 * k + 1]
        docs += [(2 * k + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.sketches(docs, 5).withColumn("node", F.col("doc_id"))
    nodes = rows.select("node", "t1", "t2", F.col("doc_id").alias("least"))
    found = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(24)], "a long, b long")
    joined = {r.a for r in simhash.confirmed(found, docs, nodes, rows, 5, 0.8).collect()}
    assert 4 <= len(joined) <= 20 and joined == {d for d in range(0, 48, 2) if d + 1 not in want}


# -- language -----------------------------------------------------------------------------------------

LANGUAGES = {"aa": "the and of thing with her", "bb": "der und nicht eine schule über", "cc": "què lès où étrange façon"}


def sentence(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(LANGUAGES[lang].split()) for _ in range(n))


def test_language_evidence(spark):
    rows = [(k, sentence(x, k), x, f"site{k % 5}.{x}.example") for k in range(30) for x in LANGUAGES for k in [k * 3 + list(LANGUAGES).index(x)]]
    rows += [(900, sentence("bb", 1), "aa", "site1.aa.example"), (901, sentence("cc", 2), None, None), (902, None, "aa", "h"), (903, "", "aa", None), (904, "123 456 !!!", "aa", "h"), (905, "の方が東京都" * 30, None, None), (900, sentence("bb", 1), "aa", "site1.aa.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' language", "1.0 prior", "2 best")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    want = {d: x for d, t, x, _ in rows if d < 900} | {900: "bb", 901: "cc"}
    assert all(got[d].language == x and got[d].kept for d, x in want.items())
    assert all(got[d].language == language.UNKNOWN and not got[d].kept for d in (902, 903, 904, 905))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


def test_host_prior_decides_what_a_text_cannot(spark):
    rows = [(k, sentence("aa", k), "aa", "a.example") for k in range(20)] + [(50 + k, sentence("bb", k), "bb", "b.example") for k in range(20)] + [(100, "x", None, "a.example"), (101, "x", None, "b.example")]
    got = {r.doc_id: r.language for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[100], got[101]) == ("aa", "bb")


def test_every_declared_language_is_trained(spark):
    letter = lambda seed: random.Random(seed).choice("abcdefghijklmnopqrstuvwxyz")
    made = {f"l{k:02}": ["".join(letter(10000 * k + 100 * i + j) for j in range(6)) for i in range(12)] for k in range(70)}
    text = lambda x, i: " ".join(random.Random(i).choices(made[x], k=30))
    rows = [(100 * k + i, text(x, i), x, f"{x}.example") for k, x in enumerate(made) for i in range(4 if k < 64 else 3)]
    got = {r.doc_id: r.language for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[d] == x for d, _, x, _ in rows)


def test_junk_declarations_are_no_languages(spark):
    rows = [(k, sentence(x, k), x, "h.example") for x in ("aa", "bb") for k in range(20 if x == "aa" else 30)]
    rows += [(100 + k, sentence("aa" if k % 2 else "bb", 500 + k), f"junk{k}", "h.example") for k in range(60)] + [(200, sentence("bb", 7) * 3000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, logs = language.train(docs, languages=2)
    assert names == ["aa", "bb", language.UNKNOWN] and logs.shape == (3, language.BUCKETS)
    got = {r.doc_id: r for r in language.identify(docs, languages=2).collect()}
    assert all(got[100 + k].language == ("aa" if k % 2 else "bb") and got[100 + k].kept for k in range(60)) and got[200].language == "bb"


def posterior(names, rows, smoothing=10.0):
    """(language, confidence) of each (declared, host, suffix, n, said, best) by the formula, row by row."""
    size = len(names)

    def counted(key):
        out = defaultdict(lambda: [0.0] * size)
        for r in rows:
            if r.n > 0:
                out[key(r)][r.best] += 1
            else:
                out[key(r)]
        return out

    total = counted(lambda r: 0)[0]
    base = [(total[k] + (0.01 if names[k] == language.UNKNOWN else 1.0)) / (sum(total) + size) for k in range(size)]
    base = [b / sum(base) for b in base]
    suffixes, hosts = counted(lambda r: r.suffix), counted(lambda r: r.host)
    tags = counted(lambda r: r.declared if r.n > 0 else None)
    tags.pop(None, None)
    for k, name in enumerate(names):
        tags[name][k] += 5 if name != language.UNKNOWN else 0
    sums = [sum(t[k] + 0.5 for t in tags.values()) for k in range(size)]
    out = []
    for r in rows:
        c = suffixes[r.suffix]
        mass = [c[k] + smoothing * base[k] + (5.0 if language.COUNTRIES.get(r.suffix) == names[k] else 0.0) for k in range(size)]
        h = hosts[r.host]
        score = []
        for k in range(size):
            s = r.said[k] + np.log((h[k] + smoothing * mass[k] / sum(mass)) / (sum(h) + smoothing))
            score.append(s + (np.log((tags[r.declared][k] + 0.5) / sums[k]) if r.declared in tags else 0.0))
        top = max(score)
        out.append((names[score.index(top)], 1 / sum(np.exp(s - top) for s in score)))
    return out


def wrongly_declared():
    """Short and long texts of three languages on hosts with suffixes; a quarter declares another language, a fifth none."""
    r, rows = random.Random(6), []
    for k in range(900):
        x = r.choice(list(LANGUAGES))
        text = sentence(x, k, r.choice((1, 1, 2, 8, 30))) if r.random() > 0.25 else r.choice(("on", "te", "nu"))
        said = r.choice([y for y in LANGUAGES if y != x]) if r.random() < 0.25 else None if r.random() < 0.2 else x
        rows.append((k, text, said, f"site{list(LANGUAGES).index(x)}{k % 4}.{dict(aa='uk', bb='de', cc='fr')[x]}", x))
    return rows


def test_posterior_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "COUNTRIES", {"uk": "aa", "de": "bb", "fr": "cc"})
    rows = wrongly_declared() + [(2000, "", "aa", None, "aa"), (2001, None, None, "x", "aa"), (2002, "the thing", "zz-unheard", None, "aa"), (2003, sentence("bb", 1, 30000), None, "a.uk:80", "bb")]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    names, logs = language.train(docs)
    said = language.likelihoods(docs, logs, "lang", "source").cache()
    want = dict(zip([r.doc_id for r in said.collect()], posterior(names, said.collect()), strict=True))
    got = {r.doc_id: r for r in language.fused(said, names).collect()}
    assert all(got[d].language == w and abs(got[d].confidence - c) < 1e-9 for d, (w, c) in want.items())
    assert got[2003].language == "bb"


def test_evidence_together_beats_each_alone(spark, monkeypatch):
    monkeypatch.setattr(language, "COUNTRIES", {"uk": "aa", "de": "bb", "fr": "cc"})
    rows = wrongly_declared()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    names, logs = language.train(docs)
    said = {r.doc_id: names[int(np.argmax(r.said))] for r in language.likelihoods(docs, logs, "lang", "source").collect()}
    fused = {r.doc_id: r.language for r in language.identify(docs).collect()}
    right = lambda got: sum(got[d] == x for d, _, _, _, x in rows) / len(rows)
    declared = {d: x for d, _, x, _, _ in rows}
    print("text", right(said), "declared", right(declared), "together", right(fused))
    assert right(fused) >= right(said) + 0.03 and right(fused) >= right(declared) + 0.2 and right(fused) > 0.9


def test_ties_go_to_the_first_language(spark):
    both = [(k, "abcd efgh ijkl", x, "h") for k, x in enumerate(("bb", "aa", "bb", "aa"))]
    got = language.identify(spark.createDataFrame([*both, (9, "abcd efgh", None, None)], "doc_id long, text string, lang string, source string"))
    assert {r.language for r in got.collect() if r.doc_id == 9} == {"aa"}


def test_raw_pages_give_their_declarations_and_hosts(spark, sf_dir):
    made = spark.createDataFrame([(1, "https://u@www.A.example.de:80/x?y", '<!doctype html><HTML class=x lang="de-AT"><head><title>no</title></head><body>Der <b>Text</b>&amp;<script>no()</script><!-- no --></body></html>'), (2, None, None)], "page_id long, url string, html string")
    one, none = language.page_documents(made).orderBy("doc_id").collect()
    assert (one.lang, one.source, one.text.split()) == ("de", "www.a.example.de", ["Der", "Text"]) and (none.text, none.lang, none.source) == ("", None, None)
    pages = language.page_documents(spark.read.parquet(f"{sf_dir}/pages.parquet")).cache()
    got = {r.doc_id: r.language for r in language.identify(pages).collect()}
    real = pages.collect()
    assert len(got) == len(real) and sum(got[r.doc_id] == r.lang for r in real) >= 0.9 * len(real)
    assert pages.select(language.suffix_of(F.col("source")).alias("s")).distinct().count() > 1


def test_hot_keys_are_dealt(spark):
    from fernwerk.llm.common import looked_up

    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}" if k % 2 else None) for k in range(600)], "doc_id long, host string")
    table = rows.select("host").distinct().filter("host is null or host <> 'k3'").withColumn("v", F.length("host"))
    want = sorted(looked_up(rows, table, "host").collect(), key=lambda r: r.doc_id)
    got = sorted(looked_up(rows, table, "host", small=False, often=20).collect(), key=lambda r: r.doc_id)
    assert got == want and len(got) == 600


def test_copies_do_not_thin_the_training_texts(spark):
    rows = [(sentence("aa", k), "aa") for k in range(12)]
    frame = lambda r: spark.createDataFrame(r, "text string, lang string")
    want, got = language.train(frame(rows)), language.train(frame(rows + rows[:1] * 20000))
    assert want[0] == got[0] and np.allclose(want[1], got[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language.identify(none).collect() == [] and language.keep_identified(none).collect() == []
    assert simhash.simhash_components(none).collect() == [] and simhash.near_dedup(none).collect() == []
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontamination.contaminated(none, benchmark).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontamination.contaminated(some, benchmark.limit(0)).collect() == []
    assert decontamination.drop_contaminated(some, benchmark.limit(0)).count() == 1


# -- decontamination ----------------------------------------------------------------------------------


def test_benchmark_passages_are_found(spark, monkeypatch):
    items = [(k, " ".join(words(20 + k, 500 + k)) + ".") for k in range(12)]
    rows = [(k, " ".join(words(150, k))) for k in range(30)]
    for k, text in items:
        host = words(150, 900 + k)
        body = text if k % 3 == 0 else text.upper() if k % 3 == 1 else " ".join(w if i % 9 else "zzz" for i, w in enumerate(text.split()))
        rows.append((100 + k, " ".join([*host[: 10 * k], body, *host[10 * k :]])))
    rows += [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1]), (None, items[1][1]), (303, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as items", "'y' as item_id")
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (0, items[0][1])], "item_id long, text string")
    for block in (4096, 20):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        got = [(r.doc_id, [i.item_id for i in r["items"]]) for r in decontamination.contaminated(docs, benchmark, rank=32).collect()]
        by = defaultdict(list)
        for d, found in got:
            by[d].append(found)
        assert set(by) == {302, None, *(100 + k for k, _ in items)}
        assert all(by[100 + k] == [[k]] for k, _ in items)
        assert by[302] == [[0], [0]] and by[None] == [[1]]
    kept = decontamination.drop_contaminated(docs, benchmark, rank=32)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(30), 300, 301, 303]


def test_items_in_a_third_of_the_rows_are_found(spark):
    item = " ".join(words(30, 7001))
    rows = [(k, " ".join(words(150, 7100 + k))) for k in range(40)]
    rows += [(100 + k, rows[0][1] + " " + item) for k in range(14)] + [(200 + k, " ".join([*words(90, 7300 + k), item, *words(40, 7400 + k)])) for k in range(6)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), rank=32).collect()
    assert sorted(r.doc_id for r in got if r["items"]) == [*range(100, 114), *range(200, 206)]


def test_lcs_against_the_table():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(a, b) == t[-1][-1]


def test_verification_compares_words_not_buckets():
    seen, pair = {}, None
    for k in range(4000):
        a = f"{k * k * 7919:x}{"qrstuv"[k % 6]}".encode()
        if (b := seen.setdefault(decontamination.ids_of([a])[0], a)) != a:
            pair = a.decode(), b.decode()
            break
    item = " ".join([pair[0]] * 6 + words(6, 3))
    block = decontamination.Block([(1, item, np.zeros((1, 4), np.float16).tobytes())], 4, 8)
    other = decontamination.words_of(" ".join([pair[1]] * 6 + words(6, 3)))
    assert block.possible(decontamination.ids_of(other).tolist(), 0, 0, 8, 0.6)
    assert block.judged(other, 0, 0, 8, 0.8, 0.6, 2.0) is None and block.judged(decontamination.words_of(item), 0, 0, 8, 0.8, 0.6, 2.0) == (1.0, 1.0)


def test_repeated_words_and_short_items(spark):
    items = [(1, "a " * 16 + "b c"), (2, "quince marmalade forever"), (3, "quince marmalade forever jam"), (4, "walrus")]
    rows = [(1, " ".join(words(60, 1)) + " a" * 16), (2, " ".join([*words(40, 2), "Quince marmalade, forever jam!", *words(9, 3)])), (3, "quince marmalade jam forever"), (4, "walrus " * 20), (5, "quince marmalade forever jam")]
    docs = spark.createDataFrame(rows + [(k, " ".join(words(50, k))) for k in range(20, 60)], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), rank=32).collect()
    assert sorted((r.doc_id, i.item_id) for r in got for i in r["items"]) == [(1, 1), (2, 3), (5, 3)]


def test_the_query_and_the_pipeline_search_for_short_items(spark, tmp_path):
    items = [(1, "quince marmalade forever"), (2, "walrus"), (3, "..."), (4, "quince forever")]
    rows = [(1, "Some quince marmalade, forever!"), (2, "the walrus " * 40), (3, "quince marmalade for ever, walruses"), (4, " ".join(words(60, 4)) + " Walrus."), *((k, " ".join(words(50, k))) for k in range(20, 40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op8_decontamination"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (4, 2, 1.0)]
    kept = corpus_pipeline.without_benchmark(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, *range(20, 40)]


def test_all_known_words_are_summed_where_unknown_ones_end_the_text():
    table, row = decontamination.unfolded(np.array([5], np.int32), np.ones((1, 4), np.float16))
    for n in (1, 16, 17, 700, 1100):
        ids = np.full(n + 40, 9, np.uint16)
        ids[:n] = 5
        assert decontamination.step_sums(ids, table, row).sum() == 4 * n


def test_recall_of_paraphrases_against_all_passages(spark, sf_dir):
    """Items with up to 35 % of their words replaced, by the latent search and by judging every passage for every item."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:150]
    pool = [w for _, t in docs for w in t.split()]
    rows, r = list(docs), random.Random(4)
    for k in range(300):
        text = [w if r.random() > (0, 0.1, 0.2, 0.3, 0.35)[k % 5] else r.choice(pool) for w in items[k % len(items)][1].split()]
        host = docs[k % len(docs)][1].split()[:200]
        at = r.randrange(len(host) + 1)
        rows.append((10000 + k, " ".join([*host[:at], *text, *host[at:]])))
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, i.item_id) for x in got for i in x["items"]}
    block = decontamination.Block([(i, t, np.zeros((1, 1), np.float16).tobytes()) for i, t in items], 1, 8)
    want = set()
    for d, t in rows:
        own = decontamination.words_of(t)
        ids = decontamination.ids_of(own).tolist()
        for k, (i, _) in enumerate(items):
            if any(block.possible(ids, k, s, 8, 0.6) and block.judged(own, k, s, 8, 0.8, 0.6, 0.8) for s in range(0, max(1, len(own) - decontamination.STEP), decontamination.STEP)):
                want.add((d, i))
    print("recall", len(want), len(got & want) / len(want))
    assert len(want) > 150 and got <= want and len(got) >= 0.95 * len(want)


def test_clashing_names_and_long_texts(spark):
    item = " ".join(words(30, 7001))
    long = " ".join(words(70000, 5))
    rows = [(1, item), (2, long + " " + item), (3, long), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "k", 7, "h", 1.0) for d, t in rows], "doc_id long, text string, __key string, __gone_hash int, __T1 string, __key_ double")
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), rank=16)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__key"], r["__gone_hash"]) for r in kept.collect()) == [(3, "k", 7), (4, "k", 7), (5, "k", 7)]
    one = simhash.near_dedup(docs)
    assert one.columns == docs.columns and sorted((r.doc_id, r["__T1"]) for r in one.collect()) == [(1, "h"), (2, "h"), (4, "h")]


def test_basis_spans_a_small_matrix(spark):
    text = [" ".join(words(64, s)) for s in range(3)]
    weight = np.ones(decontamination.FEATURES, np.float32)
    known, vectors = decontamination.latent_vectors(spark.createDataFrame([(bytearray(decontamination.word_ids(t).tobytes()),) for t in text], "ids binary"), weight, 9)
    table, row = decontamination.unfolded(known, vectors)
    basis = table[row]
    rows = [v for t in text for v in decontamination.sparse_rows(decontamination.passages(decontamination.word_ids(t)), weight)]
    a = np.zeros((len(rows), decontamination.FEATURES))
    for k, (b, v) in enumerate(rows):
        a[k, b] = v
    gram = (a @ basis).T @ (a @ basis)
    assert np.allclose(gram / gram.trace() * 9, np.eye(9), atol=5e-3)  # each direction divided by its singular value, all to one scale


def test_known_classes_are_not_linked_again(spark):
    rows = [(1, 0, k, 0, 0, r) for k, r in enumerate([0, 0, 0, 3, 3, 5])] + [(2, 0, 0, 0, 0, 0), (2, 0, 1, 0, 0, 0), (3, 0, 2, 0, 0, 0), (3, 0, 3, 0, 0, 3)]
    got = simhash.bucket_links(spark.createDataFrame(rows, "bucket long, side int, node long, f0 long, f1 long, root long"), 2, 40).collect()
    root = [0, 0, 0, 3, 3, 5]
    assert len(got) == 3 and all(root[r.a] != root[r.b] for r in got)  # two that join the three classes of bucket 1, one of bucket 3
    assert {root[x] for r in got for x in (r.a, r.b)} == {0, 3, 5}
