"""What the text operators share: written intermediate tables and ranks that no hot key can overload."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, the warehouse."""
    setting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (setting or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: Paths of the tables written in each open scratch(), the innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: it is computed once, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fernwerk-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put into the list it gives, which an outer scratch() then holds.

    To be left only when nothing is read from the others any more.
    """
    keep: list[DataFrame] = []
    _open.append([])
    try:
        yield keep
    finally:
        mine = _open.pop()
        stays = [f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()]
        for path in mine:
            name = path.rsplit("/", 1)[1]
            if any(s.endswith(name) for s in stays):
                if _open:
                    _open[-1].append(path)
                continue
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        removed(table.sparkSession, folder)


def free_name(name: str, *tables: DataFrame) -> str:
    """name, or name with underscores after it until no table has such a column, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs less the rows whose doc_id and text hash are in gone (doc_id, text_hash: a written table of distinct rows); columns unchanged.

    gone is broadcast up to `most` rows (16 bytes each); beyond, both sides are shuffled by doc_id and text together.
    """
    key, doc, other = (free_name(n, docs) for n in ("__key", "__gone_doc", "__gone_hash"))
    gone = gone.select(F.col("doc_id").cast("long").alias(doc), F.col("text_hash").alias(other))
    if gone.count() <= most:
        gone = F.broadcast(gone)
    marked = docs.withColumn(key, F.xxhash64(text_of()))
    same = (F.col(key) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    return marked.join(gone, same, "left_anti").drop(key)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left", small: bool | None = None, most: int = 500_000, often: int = 100_000) -> DataFrame:
    """rows joined with table, which has each value of key (null is a value) once; no other column may be in both.

    The table is broadcast if it is small: up to `most` rows, unless the caller knows better. Beyond, both are shuffled, and a key of over `often` rows (at
    most rows / often keys) is dealt into parts of about that many: its row of the table is copied to each, so that
    no hot key is one task's work. rows is read twice then.
    """
    if small is None:
        small = table.count() <= most
    other, salt, parts = (free_name(n, rows, table) for n in ("__other", "__salt", "__parts"))
    named = table.withColumnRenamed(key, other)
    if small:
        return rows.join(F.broadcast(named), rows[key].eqNullSafe(named[other]), how).drop(other)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > often)
    hot = F.broadcast(written(hot.select(F.col(key).alias(f"{other}_"), F.ceil(F.col("n") / often).cast("int").alias(parts)), "hot"))
    n = F.coalesce(F.col(parts), F.lit(1))
    dealt = rows.join(hot, rows[key].eqNullSafe(hot[f"{other}_"]), "left").withColumn(salt, F.pmod(F.monotonically_increasing_id(), n).cast("int")).drop(f"{other}_", parts)
    copied = named.join(hot, named[other].eqNullSafe(hot[f"{other}_"]), "left").withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), n - 1))).drop(f"{other}_", parts)
    same = F.col(f"`{key}`").eqNullSafe(F.col(other)) & (F.col(salt) == F.col(f"{salt}_"))
    return dealt.join(copied, same, how).drop(other, salt, f"{salt}_")


def salts(spark: SparkSession) -> int:
    """Into how many parts a key's rows are dealt before they are ranked: it grows with the shuffle partitions."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """df with a rank from 0, gapless within keys, as long column `name`.

    Rows of a key are dealt by a hash of `by` into salted parts. Each part is numbered by itself and
    then shifted by the rows of the parts before it, so that a key with a third of all rows is no one
    task's work. Rows that agree in keys and `by` get neighbouring ranks in any order.
    """
    part, first = free_name(f"__{name}_part", df), free_name(f"__{name}_first", df)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*by), F.lit(salts(df.sparkSession))).cast("int"))
    whole = [*keys, part]
    firsts = dealt.groupBy(*whole).agg(F.count(F.lit(1)).alias(first))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    inside = Window.partitionBy(*whole).orderBy(*by)
    numbered = dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(firsts, whole).withColumn(name, F.col(name) + F.col(first)).drop(part, first)


def sliced(batches, rows: int = 1024):
    """Arrow batches in slices of at most so many rows: what a worker holds of them as Python objects stays small.

    At their end the worker hands freed memory back, which its allocators would keep from task to task and stage to stage.
    """
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
    handed_back()


def ended(batches):
    """The batches as they come; at their end freed memory is handed back."""
    yield from batches
    handed_back()


def handed_back() -> None:
    """Gives memory that this process has freed back to the system, where the system has a way for it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
