"""Line dedup in DataFrame functions only.

Lines become (key hash, document, position) rows, which are dealt by range of
the key hash and sorted by document, the largest first, and position. Each task
streams its rows once: a key's first row is the occurrence that stays, the
others are numbered by document as they come, and a key that gets to
``min_docs`` documents loses them. Nothing meets by hash after that.

Keys that may hold a share of ``SUPPORT`` of all lines or more are found
beforehand (frequent items with bounded counters, which miss none; at most
1 / SUPPORT of them) and dealt out by ``SALTS`` parts of their documents; their
parts' counts and largest documents, one row a part, are added up afterwards.

Documents get back a compressed bitmap: words of 32 lines, of those only that
lose a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: fixed value: what is stripped at a line's ends
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NONE = -(1 << 63)
#: share of all lines from which a key is dealt out in parts, and the number of parts
SUPPORT, SALTS = 1e-3, 256


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends with A-Z lower-cased; other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def dropped(lines: DataFrame, min_docs: int) -> DataFrame:
    """lines(key, doc, pos, text_hash) -> (doc, text_hash, pos) of those that go."""
    short = lines.select("*", F.xxhash64("key").alias("short"))
    hot = short.stat.freqItems(["short"], SUPPORT).first()[0]
    part = F.when(F.col("short").isin(hot), 1 + F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    rows = short.select("key", part.cast("int").alias("part"), "doc", "pos", "text_hash")
    ranged = rows.repartitionByRange("key", "part").sortWithinPartitions("key", "part", F.desc("doc"), "pos")
    own = Window.partitionBy("key", "part")
    numbered = ranged.withColumn("nth", F.dense_rank().over(own.orderBy(F.desc("doc"))))
    counted = numbered.select("*", F.max("nth").over(own).alias("n_docs"), F.max("doc").over(own).alias("keeper"))
    left = common.saved(counted.where((F.col("part") > 0) | ((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))))
    out = left.where(F.col("part") == 0).select("doc", "text_hash", "pos")
    if not hot:
        return out
    parts = left.where(F.col("part") > 0)
    each = parts.groupBy("key", "part").agg(F.max("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    whole = each.groupBy("key").agg(F.sum("n_docs").alias("all_docs"), F.max("keeper").alias("last"))
    # at most 1 / SUPPORT keys
    merged = parts.join(F.broadcast(whole), "key").where((F.col("all_docs") >= min_docs) & (F.col("doc") != F.col("last")))
    return out.unionByName(merged.select("doc", "text_hash", "pos"))


def bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents that lose lines: doc, text_hash, n_dropped, words array<struct<word,bits>>.

    Line i goes if bit i % 32 of word i / 32 is set. ``doc`` is the id, or the
    least long for a null id: rows with a null id count as one document before
    all others. Rows with equal ids count as one document.
    """
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NONE)).alias("doc"), common.text_or_empty(text_col).alias("t"))
    each = base.select("doc", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    keyed = each.where(F.length("line") >= min_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("k"))
    keyed = keyed.where(F.length("k") >= min_chars)
    lines = common.saved(keyed.select(F.unhex(F.md5(F.col("k").cast("binary"))).alias("key"), "doc", "pos", "text_hash"))
    gone = dropped(lines, min_docs)
    bits = F.bit_or(F.expr("shiftleft(1L, pos % 32)")).alias("bits")
    by_word = gone.groupBy("doc", "text_hash", F.expr("pos div 32").cast("int").alias("word")).agg(bits)
    words = F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")
    return by_word.groupBy("doc", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), words)


def _joined(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(row, lines, n_dropped, words, kept): a document as it was, its lines, its bitmap, and its text without the lines that go."""
    marks = bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(_NONE)).alias("doc")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key, F.xxhash64(common.text_or_empty(text_col)).alias("text_hash"))
    both = rows.join(marks, ["doc", "text_hash"], "left")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    both = both.select("row", "n_dropped", "words", F.split(text, "\n", -1).alias("lines"), text.alias("text"))
    by_word = F.map_from_entries("words")
    dense = F.transform(F.sequence(F.lit(0), F.element_at("words", -1)["word"]), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("long")))
    both = both.withColumn("dense", F.when(F.col("n_dropped").isNotNull(), dense))

    def stays(i: Column) -> Column:
        return F.getbit(F.coalesce(F.get("dense", F.floor(i / 32).cast("int")), F.lit(0).cast("long")), i % 32) == 0

    kept = F.array_join(F.filter("lines", lambda _, i: stays(i)), "\n")
    return both.select("row", "lines", "n_dropped", "words", F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with their texts' repeated lines dropped; a document that loses all lines stays, with an empty text.

    Keys of at least min_chars code points in at least min_docs documents lose
    all their lines except those in the largest id. Null texts stay null; other
    columns, of any name, pass through.
    """
    both = _joined(docs, id_col, text_col, min_chars, min_docs)
    own = F.col("row")
    return both.select(*[F.when(own[c].isNotNull(), F.col("kept")).alias(c) if c == text_col else own[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap. Null text: one empty line.

    keep_bitmap is ``word:bits`` of each word of 32 lines that loses a line,
    comma-joined; set bits are lines that stay, and all lines of other words stay.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    both = _joined(own, "doc_id", "text", min_chars, min_docs).withColumn("n_lines", F.size("lines"))

    bitmap = F.expr("array_join(transform(coalesce(words, array()), w -> concat_ws(':', w.word, shiftleft(1L, least(32, n_lines - 32 * w.word)) - 1 - w.bits)), ',')")
    return both.select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
        bitmap.alias("keep_bitmap"),
    )


def op9_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, with its keep bitmap."""
    return report(common.read_docs(spark, sf_dir))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key),
r AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id),
w AS (SELECT doc_id, pos // 32 AS word, CAST(sum(CAST(1 AS BIGINT) << (pos % 32)) AS BIGINT) AS bits FROM m WHERE gone GROUP BY doc_id, pos // 32),
b AS (SELECT w.doc_id, string_agg(word || ':' || ((CAST(1 AS BIGINT) << least(32, n_lines - 32 * word)) - 1 - bits), ',' ORDER BY word) AS keep_bitmap
        FROM w JOIN r ON w.doc_id = r.doc_id GROUP BY w.doc_id)
SELECT r.*, coalesce(keep_bitmap, '') AS keep_bitmap FROM r LEFT JOIN b ON r.doc_id = b.doc_id
"""
