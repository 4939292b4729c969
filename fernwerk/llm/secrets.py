"""Secret scans, judged by who owns what else looks the same across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, text_of, written

#: Kinds in their order, each pattern with the secret as group 1. Shorter runs of the last three are no match.
PATTERNS = [
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "(AKIA[A-Z0-9]{14,})"),
    ("hex", "([0-9a-f]{16,})"),
    ("live", "(?<![A-Za-z0-9+_=-])((?=[A-Za-z+_=-]*[0-9])(?=[a-z0-9+_=-]*[A-Z])(?=[A-Z0-9+_=-]*[a-z])[A-Za-z0-9+_=-]{24,})"),
]
KINDS = [k for k, _ in PATTERNS]
ASSIGNED = 12
#: Private-use characters that mark matches; a text's own are first replaced by a third, which no pattern tells from them.
OPEN, CLOSE, OTHER = "", "", ""
#: Matches whose lengths are added up in one array.
GROUP = 256
MEASURED = "array<struct<long:bigint,whole:bigint,secret:bigint,counts:boolean>>"
SPAN = "array<struct<start:bigint,kind:int,end:bigint,secret:bigint>>"


def spans_of(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, hash of the secret), in code points.

    Matches are set off by marks, the text is split at them, and lengths are added up.
    """
    pattern = PATTERNS[kind][1]
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}$1{CLOSE}"), OPEN)
    measured = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.transform(F.array(F.split(part, CLOSE)), lambda x: F.struct(
            F.length(x[0]).cast("long").alias("long"), (F.length(x[0]) + F.length(x[2])).cast("long").alias("whole"), F.xxhash64(x[1]).alias("secret"), (F.length(x[1]) >= (ASSIGNED if kind == 0 else 0)).alias("counts"),
        ))[0],
    )
    # lengths are added up within groups, and over groups: appending to one array for each match would take the square of their number
    last = F.ceil(F.size(measured) / GROUP).cast("int") - 1
    groups = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: F.slice(measured, g * GROUP + 1, F.lit(GROUP)))

    def before(state: Column, group: Column) -> Column:
        size = F.aggregate(group, F.lit(0).cast("long"), lambda a, x: a + x["whole"])
        return F.struct((state["at"] + size).alias("at"), F.concat(state["found"], F.array(F.struct(state["at"].alias("at"), group.alias("group")))).alias("found"))

    def step(state: Column, x: Column) -> Column:
        span = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), (state["at"] + x["long"]).alias("end"), x["secret"].alias("secret"))
        here = F.when(x["counts"], F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct((state["at"] + x["whole"]).alias("at"), F.concat(state["found"], here).alias("found"))

    empty = F.array().cast(f"array<struct<at:bigint,group:{MEASURED}>>")
    placed = F.aggregate(groups, F.struct(F.length(parts[0]).cast("long").alias("at"), empty.alias("found")), before, lambda s: s["found"])
    found = F.flatten(F.transform(placed, lambda g: F.aggregate(g["group"], F.struct(g["at"].alias("at"), F.array().cast(SPAN).alias("found")), step, lambda s: s["found"])))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """(secret, owners, repositories): in how many distinct ones each candidate's hash occurs; summed up step by step, so a secret that is everywhere is no one task's."""
    each = spans.select("secret", "owner", "repository").distinct()
    by_owner = each.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("secret").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_repositories: int | None = None) -> DataFrame:
    """Spans of secrets for each row, and how many of them only one owner has.

    Candidates of the base kinds always stay. A candidate is live-looking if one owner alone has it, in
    however many repositories (at most most_repositories, if that is given); what several owners have is a copied example (n_copied). The
    kind `live`, long mixed-case strings with digits outside base spans, is added only where live-looking. Null text counts as empty; a null owner or
    repository is one of its own. Repeated rows are scanned as they come.
    """
    clean = F.translate(text_of(), OPEN + CLOSE, OTHER + OTHER)
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(owner).cast("string")), F.lit(0)).alias("owner"),
        F.coalesce(F.xxhash64(F.col(repository).cast("string")), F.lit(0)).alias("repository"), clean.alias("text"),
    )
    base = F.concat(*(spans_of(F.col("text"), k) for k in range(3)))
    found = read.select("doc_id", "owner", "repository", base.alias("base"), spans_of(F.col("text"), 3).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.array_sort(F.concat("base", apart)).alias("all")), "secrets")

    each = rows.select("row", "doc_id", "owner", "repository", F.explode("all").alias("s")).select("row", "doc_id", "owner", "repository", "s", F.col("s.secret").alias("secret"))
    owned = written(ownership(each), "ownership")
    judged = looked_up(each, owned, "secret", "inner").withColumn("alone", (F.col("owners") == 1) & (F.lit(True) if most_repositories is None else F.col("repositories") <= most_repositories))
    judged = judged.filter((F.col("s.kind") < 3) | F.col("alone"))
    some = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("all"),
        F.sum(F.when(F.col("alone"), 1).otherwise(0)).alias("n_live"), F.sum(F.when(F.col("owners") > 1, 1).otherwise(0)).alias("n_copied"),
    )
    lost = rows.filter(F.size("all") > 0).select("row", "doc_id").join(some.select("row"), "row", "left_anti")
    none = rows.filter(F.size("all") == 0).select("row", "doc_id").union(lost)
    none = none.select("row", "doc_id", F.array().cast(SPAN).alias("all"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    whole = some.union(none)
    n = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    own = F.filter("all", lambda s: s["kind"] < 3)
    return whole.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_live", "n_copied"
    )
