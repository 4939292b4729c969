"""Line dedup by how frequent a line is on its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, looked_up, written

#: Broadcast the boilerplate lines of all hosts up to so many hashes (8 bytes each); beyond, they are joined by host, hot hosts in parts.
BROADCAST_LINES = 1_000_000


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines: the hashes of its boilerplate), for hosts that have any.

    A line counts once for each page that has it, counts are summed before they are shuffled, and a
    host's total is a grouped count. Lines over the ratio are fewer than a host's mean number of
    lines per page divided by the ratio, which bounds the array.
    """
    pages = docs.select(F.col(host).cast("string").alias("host"), F.split("text", "\n").alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), line_hash))
    seen = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.filter(F.col("n") >= min_pages).withColumnRenamed("host", "of")
    often = seen.join(totals, F.col("of").eqNullSafe(F.col("host"))).filter(F.col("n").cast("double") / F.col("pages").cast("double") > ratio)
    return often.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = 0.05, min_pages: int = 4, counts: bool = False) -> DataFrame:
    """docs with `text` less the lines that more than `ratio` of their host's pages have, on min_pages pages at least.

    Each row is a page; rows of null host make a host of their own. Lines end at \\n and are compared without
    blanks around; empty lines are neither counted nor dropped. Null text stays null; a text of
    which all lines go becomes empty. Repeated rows count as pages. counts adds n_lines and n_dropped (0 for null text),
    in place of such columns that docs may have.
    """
    found = written(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    size = found.agg(F.sum(F.size("boilerplate"))).first()[0] or 0
    of, marks, own = (free_name(n, docs) for n in ("__host", "__lines", "__mine"))
    rows = docs.withColumn(of, F.col(f"`{host}`").cast("string"))
    rows = looked_up(rows, found.toDF(of, marks), of, small=size <= BROADCAST_LINES)
    lines = F.split("text", "\n")
    mine = F.array_intersect(F.transform(lines, line_hash), F.col(marks))
    rows = rows.withColumn(own, F.when(F.col(marks).isNotNull(), mine))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(own, line_hash(x)))
    some = F.coalesce(F.size(own) > 0, F.lit(False))
    out = [F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if counts:
        whole = F.coalesce(F.size(lines), F.lit(0))
        out += [F.when(F.col("text").isNull(), 0).otherwise(whole).cast("long").alias("n_lines"), F.when(some, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_dropped")]
    return rows.select(*out)


DROP_LINES_SQL = """
with d as (select doc_id, source, text, string_split(text, chr(10)) ls from documents),
t as (select source, count(*) n from d group by source),
e as (select doc_id, source, unnest(ls) x, unnest(range(1, len(ls) + 1)) p from d),
u as (select distinct doc_id, source, trim(x, ' ') l from e where trim(x, ' ') <> ''),
b as (select u.source, u.l from u join t on u.source = t.source group by u.source, u.l, t.n
      having count(*) >= 4 and cast(count(*) as double) / cast(t.n as double) > cast(0.05 as double)),
k as (select e.doc_id, count(*) n_lines, count(b.l) n_dropped, string_agg(e.x, chr(10) order by e.p) filter (where b.l is null) kept
      from e left join b on e.source = b.source and trim(e.x, ' ') = b.l group by e.doc_id)
select d.doc_id, case when k.n_dropped > 0 then coalesce(k.kept, '') else d.text end as text,
       cast(coalesce(k.n_lines, 0) as bigint) as n_lines, cast(coalesce(k.n_dropped, 0) as bigint) as n_dropped
from d left join k on d.doc_id = k.doc_id
"""
