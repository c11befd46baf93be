"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found with regular expressions in the JVM; a text's pieces
between matches give the matches' places. Each candidate's hash is then
counted by distinct repositories and by distinct owners over the whole corpus,
made distinct by (hash, owner, repository) before it is counted so that a value
that a third of all rows hold is summed where it lies. A repository of two
owners counts once. Verdicts:

``copied``  held by ``copied_owners`` owners or ``copied_repositories``
            repositories or more: a widely copied example;
``live``    not copied, held by one owner and looking like a real credential;
``unclear`` the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: fixed values: the base kinds, in order
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex"]
#: words of values that are placeholders
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567|password"

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,hash:string,likely:boolean>>"


#: matches whose places are summed at once: a running sum copies what it has at each step
RUN = 256


def _running(sizes: Column) -> Column:
    """Sums of the elements before each element, and after the last (long)."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(sizes, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _matches(text: Column, rank: int, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def sized(found: Column) -> Column:
        """Matches with what they add to the end of the match before."""
        return F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), (F.length(b) + F.length(m)).cast("long").alias("size")))

    def runs(pairs: Column) -> Column:
        """The matches in runs, with their ends counted from the run's start."""
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
        return F.transform(cut, lambda r: F.struct(r.alias("run"), F.slice(_running(F.transform(r, lambda x: x["size"])), F.lit(2), F.size(r)).alias("ends")))

    def placed(summed: Column) -> Column:
        before = _running(F.transform(summed, lambda x: F.element_at(x["ends"], -1)))
        return F.zip_with(
            summed,
            F.slice(before, F.lit(1), F.size(summed)),
            lambda x, at: F.zip_with(x["run"], x["ends"], lambda p, end: F.struct(p["m"].alias("m"), (at + end - F.length(p["m"])).alias("start"))),
        )

    at = F.flatten(_let(_let(_let(found, sized), runs), placed))

    def row(x: Column) -> Column:
        value = F.regexp_extract(x["m"], pattern, 2) if rank == 0 else x["m"]
        likely = (F.length(value) >= 16) & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(PLACEHOLDER) & value.rlike("[0-9]")
        return F.struct(x["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), F.sha2(value, 256).alias("hash"), likely.alias("likely"))

    if rank == 0:
        at = F.filter(at, lambda x: F.length(F.regexp_extract(x["m"], pattern, 2)) >= 8)
    # most texts have no match: their places are never computed
    return F.when(text.rlike(pattern), F.transform(at, row)).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def _names(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    copied_owners: int = 3,
    copied_repositories: int = 8,
) -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans, verdicts' counts.

    owner defaults to ``source`` and repository to ``source`` and ``lang``.
    Null texts count as empty, null owners as the empty owner. Rows with equal
    id and text are kept each, with equal results. Other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = common.text_or_empty(text_col)
    spans = F.array_sort(F.concat(*[_matches(F.col("t"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX))]))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("t"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    # Rows without their texts, written once: both passes over the candidates read them.
    base = common.saved(base.select("doc_id", "owner", "repository", F.xxhash64("t").alias("text_hash"), spans.alias("spans")))
    each = base.where(F.size("spans") > 0).select("doc_id", "text_hash", "owner", "repository", F.explode("spans").alias("s"))
    pairs = each.select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    count_of = lambda c: pairs.select("hash", c).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    frequency = count_of("owner").join(count_of("repository"), "hash").select("hash", F.col("n_owner").alias("n_owners"), F.col("n_repository").alias("n_repositories"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(copied, "copied").when((F.col("n_owners") == 1) & F.col("s.likely"), "live").otherwise("unclear")
    judged = each.select("doc_id", "text_hash", "s", F.col("s.hash").alias("hash")).join(frequency, "hash").select("doc_id", "text_hash", F.struct(F.col("s.start").alias("start"), (F.col("s.rank") + len(KINDS)).alias("rank"), verdict.alias("kind"), F.col("s.end").alias("end"), F.col("n_owners"), F.col("n_repositories")).alias("v"))
    per_doc = judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("v")).alias("verdicts")).withColumnRenamed("doc_id", "id2").withColumnRenamed("text_hash", "hash2")
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["id2"]) & (base["text_hash"] == per_doc["hash2"]), "left")
    added = F.coalesce(F.transform("verdicts", lambda v: F.struct(v["start"].alias("start"), v["rank"].alias("rank"), v["kind"].alias("kind"), v["end"].alias("end"))), F.array())
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    verdicts = F.coalesce(F.col("verdicts"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,n_owners:bigint,n_repositories:bigint>>"))
    return joined.select(
        "doc_id",
        *[count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_names(F.col("spans")), 256).alias("base_sha256"),
        _names(F.array_sort(F.concat(plain, added))).alias("spans"),
        count(verdicts, "live").alias("n_live"),
        count(verdicts, "copied").alias("n_copied"),
        F.coalesce(F.array_max(F.transform(verdicts, lambda v: v["n_owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform(verdicts, lambda v: v["n_repositories"])), F.lit(0)).alias("most_repositories"),
    )


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and verdicts of every document."""
    return scan(common.read_docs(spark, sf_dir))
