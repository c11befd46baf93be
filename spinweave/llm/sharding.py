"""Extendible hashing of documents into shards under a byte limit.

A bucket is a prefix of the key's hash bits. A bucket over the limit splits on
its next bit, others stay, so a document's shard is its shortest prefix whose
documents fit. Bucket sizes fall along a path, so this is the first depth that
fits; it is found for a few bits at a time from pre-aggregated cells, never
from one row per document and depth, and only what is still too large goes on
to further bits. The directory is a table; none of it passes through the
driver.

A bucket of one document is not split, even over the limit. Rows whose whole
hash is equal can't be parted by bits; their bucket at the last depth is
divided into pages of as many rows as surely fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 32
#: hash bits examined in one round
STEP = 8


def key_hash(key: Column) -> Column:
    """The first 32 bits of the key's md5; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    shift = F.lit(BITS) - depth if not isinstance(depth, int) else F.lit(BITS - depth)
    return F.floor(h / F.pow(F.lit(2.0), shift)).cast("long")


def shards(docs: DataFrame, *, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, hash_bits, depth, bucket, page, bucket_bytes, bucket_docs.

    (depth, bucket, page) names the shard. Null texts have 0 bytes; null ids
    hash as the empty string; repeated rows stay and share a bucket, whose
    pages then part them. An empty table gives no rows. Other columns are
    ignored.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = common.saved(docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(common.text_or_empty(text_col)).cast("long").alias("n_bytes"), key_hash(docs[id_col]).alias("hash_bits")))
    cells = rows.groupBy("hash_bits").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    left, found = cells, None
    for low in range(0, BITS, STEP):
        high = low + STEP
        first = 0 if low == 0 else low + 1
        coarse = left.groupBy(_prefix(F.col("hash_bits"), high).alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        paths = coarse.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(high)))).withColumn("bucket", F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(high) - F.col("depth"))).cast("long"))
        sums = paths.groupBy("depth", "bucket").agg(F.sum("b").alias("bucket_bytes"), F.sum("n").alias("bucket_docs"))
        fits = (F.col("bucket_bytes") <= limit_bytes) | (F.col("bucket_docs") == 1)
        # A cell of this round gets its shallowest fitting depth; leaves are few, one for each limit's worth of bytes or so.
        leaf = paths.select("cell", "depth", "bucket").join(sums.where(fits), ["depth", "bucket"]).groupBy("cell").agg(F.min_by(F.struct("depth", "bucket", "bucket_bytes", "bucket_docs"), F.col("depth")).alias("leaf"))
        if high == BITS:
            whole = sums.where((F.col("depth") == BITS) & ~fits).select(F.col("bucket").alias("cell"), F.struct("depth", "bucket", "bucket_bytes", "bucket_docs").alias("leaf"))
            leaf = leaf.unionByName(whole)
        leaf = common.saved(leaf.select(F.lit(high).alias("bits"), "cell", "leaf"))
        found = leaf if found is None else found.unionByName(leaf)
        if high < BITS:
            left = common.saved(left.withColumn("cell", _prefix(F.col("hash_bits"), high)).join(leaf.select("cell"), "cell", "left_anti").drop("cell"))
            if left.isEmpty():
                break
    # Rows meet their leaf by the depth of the round that found it: one narrow copy of a row for each round run.
    rounds = list(range(STEP, high + 1, STEP))
    by_hash = rows.select("hash_bits").distinct().withColumn("bits", F.explode(F.array(*[F.lit(r) for r in rounds]))).withColumn("cell", F.floor(F.col("hash_bits") / F.pow(F.lit(2.0), F.lit(BITS) - F.col("bits"))).cast("long"))
    known = by_hash.join(found, ["bits", "cell"]).select("hash_bits", "leaf.*")
    out = rows.join(known, "hash_bits")
    # Only buckets of one hash that are still too large have pages.
    page = F.expr(f"IF(depth = {BITS} AND bucket_bytes > {limit_bytes} AND bucket_docs > 1, 1, 0)") == 1
    plain = out.where(~page).withColumn("page", F.lit("0"))
    return plain.unionByName(_pages(out.where(page), limit_bytes)).select("doc_id", "n_bytes", "hash_bits", "depth", "bucket", "page", "bucket_bytes", "bucket_docs")


def _pages(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Pages of buckets of equal hashes: of as many equal rows (same id and size) as fit, by their number.

    Equal rows are counted, wherever they lie, and given out again page by
    page, so pages don't depend on how rows are dealt over tasks.
    """
    columns = ["doc_id", "n_bytes", "hash_bits", "depth", "bucket", "bucket_bytes", "bucket_docs"]
    same = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.lit(1), F.col("n_bytes")))).cast("long")
    pages = same.withColumn("most", most).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most")))))
    here = F.least(F.col("most"), F.col("n") - F.col("k") * F.col("most"))
    name = F.concat_ws(".", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "n_bytes", F.col("k") + 1)
    return pages.select(*columns, name.alias("page"), F.explode(F.sequence(F.lit(1).cast("long"), here)).alias("row")).drop("row")


LIMIT = 1 << 20


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, at 1 MiB a shard."""
    return shards(common.read_docs(spark, sf_dir), limit_bytes=LIMIT)


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash_bits
  FROM documents),
p AS (
  SELECT d.*, CAST(g.depth AS INTEGER) AS depth, CAST(floor(hash_bits / pow(2, {BITS} - g.depth)) AS BIGINT) AS bucket
  FROM d CROSS JOIN range(0, {BITS + 1}) AS g(depth)),
s AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS bucket_bytes, count(*) AS bucket_docs FROM p GROUP BY ALL),
l AS (
  SELECT p.doc_id, p.n_bytes, p.hash_bits, p.depth, p.bucket, s.bucket_bytes, s.bucket_docs,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
  FROM p JOIN s ON p.depth = s.depth AND p.bucket = s.bucket
  WHERE s.bucket_bytes <= {LIMIT} OR s.bucket_docs = 1)
SELECT doc_id, n_bytes, hash_bits, depth, bucket, '0' AS page, bucket_bytes, bucket_docs FROM l WHERE k = 1
"""
