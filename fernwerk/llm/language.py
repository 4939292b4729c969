"""Language identification: text likelihoods, declared language, address suffix and host priors in one posterior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, scratch, sliced, text_of, without_rows, written

#: Buckets of hashed letter triples.
BUCKETS = 1 << 14
#: A text says no more than so many of its triples would: neighbouring triples aren't independent.
SAYS = 80
UNKNOWN = "und"
#: Languages of country suffixes, each worth COUNTRY pages of evidence.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
COUNTRY = 5.0
#: Bytes of a looked-up table of one array a row up to which it is broadcast.
BROADCAST_BYTES = 64_000_000
#: A language's own name as a declaration is worth so many pages of it.
DECLARED = 5.0

LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def triples(text: str) -> np.ndarray:
    """Buckets of the letter triples of a text in lower case; all that isn't a letter is a single space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(c < len(LETTER), LETTER[np.minimum(c, len(LETTER) - 1)], True)
    keep = letter | np.append(True, letter[:-1])
    c = np.where(letter, c, 32)[keep].astype(np.uint64)
    if len(c) < 3 or not letter.any():
        c = np.append(np.append(np.uint64(32), c), np.uint64(32)) if letter.any() else c[:0]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    x = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(50)).astype(np.int64)


def suffix_of(host: Column) -> Column:
    """The last label of a host name without port; none if it has only one."""
    return F.lower(F.regexp_extract(host, r"\.([A-Za-z]+)(?::\d+)?$", 1))


def train(docs: DataFrame, declared: str = "lang", sample: int = 400, languages: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (one row each) of triples, from at most `sample` declared texts of every declared language.

    Declared languages are the `languages` declarations with the most different texts (of equals the first in alphabetical order), so that junk in the declared column
    can't grow the table; other declarations are no languages, but evidence like all declarations. The texts are different ones with the smallest hashes. The last row, of UNKNOWN, gives every bucket the same.
    """
    l = F.col(declared).cast("string")  # noqa: E741
    known = docs.filter(F.col(declared).isNotNull() & F.col("text").isNotNull()).select(l.alias("l"), "text").filter(F.col("l") != UNKNOWN)
    # hashes below a bound that leaves some more than needed, by the number of different texts; of these the smallest
    sizes = known.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("text"), 0.05).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "l").limit(languages)
    bounds = written(sizes.select("l", F.least(F.lit(1.0), 3.0 * (sample + 20) / F.greatest("n", F.lit(1))).alias("bound")), "bounds")
    names = sorted(r["l"] for r in bounds.select("l").collect())
    if not names:
        return [UNKNOWN], np.full((1, BUCKETS), -np.log(BUCKETS))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    few = known.withColumn("h", place).join(F.broadcast(bounds), "l").filter(F.col("h") < F.col("bound")).select("l", "text", "h").dropDuplicates(["l", "h"])
    rows = few.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("k") <= sample)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[name] = found.get(name, 0) + np.bincount(triples(text), minlength=BUCKETS)
        for name, n in found.items():
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.tobytes()], pa.binary())], names=["l", "n"])

    counts = {n: np.zeros(BUCKETS, np.int64) for n in names}
    for r in rows.select("l", "text").coalesce(8).mapInArrow(count, "l string, n binary").collect():
        counts[r.l] = counts[r.l] + np.frombuffer(r.n, np.int64)
    table = np.stack([*(counts[n] + 0.05 for n in names), np.ones(BUCKETS)])
    return [*names, UNKNOWN], np.log(table / table.sum(axis=1, keepdims=True))


def likelihoods(docs: DataFrame, logs: np.ndarray, declared: str, host: str) -> DataFrame:
    """(doc_id, text_hash, declared, host, suffix, n triples, said: log likelihood of each language, and its best language's number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("n", pa.int64()), ("said", pa.list_(pa.float64())), ("best", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))

    def work(batches):
        by_bucket = shared.value
        for batch in sliced(batches):
            sizes, said, best = [], [], []
            for text in batch.column(5).to_pylist():
                t = triples(text)
                n = len(t)
                whole = np.bincount(t, minlength=BUCKETS) @ by_bucket if n > 3000 else by_bucket[t].sum(axis=0)
                one = whole * (min(n, SAYS) / max(n, 1))
                sizes.append(n)
                said.append(one)
                best.append(int(one.argmax()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int64()), pa.array(said, pa.list_(pa.float64())), pa.array(best, pa.int32())], schema=schema)

    h = F.col(host).cast("string")
    suffix = F.coalesce(suffix_of(h), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), F.col(declared).cast("string").alias("declared"), h.alias("host"), suffix.alias("suffix"), text_of().alias("text"))
    return read.mapInArrow(work, "doc_id long, text_hash long, declared string, host string, suffix string, n long, said array<double>, best int")


def fused(said: DataFrame, names: list[str], smoothing: float = 10.0) -> DataFrame:
    """said with language and confidence.

    What a language's pages declare, and the priors of host, suffix and all pages, are grouped counts of the
    texts' own best languages. A host's prior is smoothed towards its suffix's, that one, with what a
    country suffix suggests, towards that of all pages, each by `smoothing` pages.
    """
    size = len(names)
    counts = lambda: [F.sum(F.when((F.col("best") == k) & (F.col("n") > 0), 1.0).otherwise(0.0)).alias(f"c{k}") for k in range(size)]
    every = said.agg(*counts()).first()
    total = np.array([every[k] or 0.0 for k in range(size)])
    base = (total + np.where(np.array(names) == UNKNOWN, 0.01, 1.0)) / (total.sum() + size)
    base = base / base.sum()
    own = lambda key: said.groupBy(key).agg(*counts())
    by_host = said.groupBy("host", "suffix").agg(*counts())
    by_suffix = own("suffix")
    codes = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv)) if COUNTRIES else None
    hint = F.element_at(codes, F.col("suffix"))
    mass = [F.col(f"c{k}") + smoothing * float(base[k]) + F.when(hint == name, COUNTRY).otherwise(0.0) for k, name in enumerate(names)]
    total_of = lambda each: F.aggregate(F.array(*each), F.lit(0.0), lambda a, x: a + x)
    whole = total_of(mass)
    by_suffix = by_suffix.withColumn("whole", whole).select(F.col("suffix").alias("__s"), F.array(*(m / F.col("whole") for m in mass)).alias("of_suffix"))
    joined = by_host.join(by_suffix, F.col("suffix") == F.col("__s"))
    seen = total_of([F.col(f"c{k}") for k in range(size)])
    joined = joined.withColumn("seen", seen)
    prior = F.array(*(F.log((F.col(f"c{k}") + smoothing * F.col("of_suffix")[k]) / (F.col("seen") + smoothing)) for k in range(size)))
    hosts = written(joined.select("host", prior.alias("prior")), "hosts")

    marks = said.filter(F.col("declared").isNotNull() & (F.col("n") > 0)).groupBy("declared").agg(*counts())
    spark = said.sparkSession
    own_tags = spark.createDataFrame([(n, *(DECLARED if j == k and n != UNKNOWN else 0.0 for j in range(size))) for k, n in enumerate(names)], ["declared", *(f"c{k}" for k in range(size))])
    marks = written(marks.unionByName(own_tags).groupBy("declared").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(size))), "declared")
    sums = marks.agg(F.count(F.lit(1)), *(F.sum(f"c{k}") for k in range(size))).first()
    says = F.array(*(F.log((F.col(f"c{k}") + 0.5) / F.lit(float(sums[k + 1] + 0.5 * sums[0]))) for k in range(size)))
    says = marks.select("declared", says.alias("says"))
    none = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("said"), F.coalesce(F.col("prior"), none)), F.coalesce(F.col("says"), none))
    most = BROADCAST_BYTES // (8 * size + 100)
    out = looked_up(looked_up(said, hosts, "host", most=most), says, "declared", most=most).withColumn("score", score)
    top = F.array_max("score")
    out = out.withColumn("confidence", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return out.withColumn("language", F.element_at(F.array(*map(F.lit, names)), F.array_position("score", top).cast("int")))


def identify(docs: DataFrame, declared: str = "lang", host: str = "source", least: float = 0.5, sample: int = 400, languages: int = 200) -> DataFrame:
    """Language of each row, its posterior, and kept: whether it is a known language with at least that posterior.

    Languages are the `languages` commonest declarations. Null and empty texts, and texts without a letter, are UNKNOWN with confidence 1 and not kept. Null or
    unseen declarations and null hosts say nothing of their own (a null host is a host like others).
    Ties go to the language first in alphabetical order. Repeated rows are judged as they come.
    """
    names, logs = train(docs, declared, sample, languages)
    said = written(likelihoods(docs, logs, declared, host), "said")
    empty = F.col("n") == 0
    out = fused(said, names)
    language = F.when(empty, F.lit(UNKNOWN)).otherwise(F.col("language"))
    confidence = F.when(empty, F.lit(1.0)).otherwise(F.col("confidence"))
    return out.select("doc_id", "text_hash", language.alias("language"), confidence.alias("confidence"), ((language != UNKNOWN) & (confidence >= least)).alias("kept"))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that identify() does not keep; columns unchanged.

    Rows of the same doc_id and text stay or go together: they stay if one of them is kept.
    """
    with scratch(docs.sparkSession) as keep:
        judged = identify(docs, **options).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"))
        gone = written(judged.filter(~F.col("kept")).select("doc_id", "text_hash"), "rejected")
        keep.append(gone)
    return without_rows(docs, gone)


def page_documents(pages: DataFrame, url: str = "url", html: str = "html", id: str = "page_id") -> DataFrame:
    """(doc_id, text, lang, source) of raw pages: the markup's declared language, the address's host, and the text without markup.

    Null or empty markup: empty text without a declaration; an address without a host: null.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    lang = F.lower(F.regexp_extract(page, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    bare = F.regexp_replace(page, "(?is)<!--.*?-->|<(script|style|head|nav)\\b.*?</\\1\\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "&[a-zA-Z]+;|&#[0-9]+;", " ")
    given = lambda c: F.when(c != "", c)
    return pages.select(F.col(id).cast("long").alias("doc_id"), F.trim(bare).alias("text"), given(lang).alias("lang"), given(host).alias("source"))
