"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the raw one over all
documents, the target one over labelled good documents. A model says how likely
a text is to hold an n-gram at all. N-grams are words, the first 4, 5 and 6
bytes of words (stems), what stands between two words, and that with the next
word's shape; the last two kinds go by themselves and with the share that the n-gram
has of its text (halves, quarters, ...), so that a text which is one thing over
and over differs from one that holds it once.

A document's log importance weight is the sum, over its distinct n-grams, of
log p_target - log p_raw. A log ratio is first shrunk towards 0, to 0 within
``STANDARD_ERRORS`` of its own, so that n-grams too rare to tell don't add up
to noise in long texts. Gumbel top-k then samples k documents without
replacement, in proportion to the weights to the power ``sharpness``: those of
the greatest ``sharpness * log weight + Gumbel noise``. k is ``share`` of all
documents, by default the share of good rows among the labelled ones.

Labels are taken from a bounded sample, ``max_labelled`` rows of low hashes;
the sample (ids and labels) and the two models, whose size is fixed, are all
that reaches the driver. Counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import text as tx

U64 = np.uint64
BITS = 16
#: bytes of a word that make its stems
STEMS = (4, 5, 6)
#: words, stems, gaps, gaps with shares, gaps with shapes, these with shares
KINDS = 1 + len(STEMS) + 4
BUCKETS = KINDS << BITS
#: share classes of gaps and shapes: from a half up, from a quarter, ...
SHARES = 8
#: documents added to both models' counts in a ratio
SMOOTH = 0.5
#: standard errors within which a log ratio is taken for 0
STANDARD_ERRORS = 3.0
MAX_LABELLED, SHARPNESS = 20_000, 1.0
#: bytes of text whose n-grams are in memory at once, or one text
CHUNK = 1 << 18

_CLASSES = []
for _a, _b in ((65, 91), (97, 123), (48, 58)):
    _t = np.zeros(256, bool)
    _t[_a:_b] = True
    _CLASSES.append(_t)


def _top(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count), by text and bucket."""
    key, count = np.unique((doc << BITS) | bucket, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def _shared(doc: np.ndarray, bucket: np.ndarray, n: int, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, bucket) of an n-gram, then of the n-gram and its share class."""
    total = np.bincount(doc, minlength=n)
    doc, bucket, count = _distinct(doc, bucket)
    yield doc, bucket + (kind << BITS)
    share = sum((count << j) <= total[doc] for j in range(1, SHARES))
    doc, bucket, _ = _distinct(doc, _top(tx.mix((bucket * SHARES + share).astype(U64) + U64(1))))
    yield doc, bucket + ((kind + 1) << BITS)


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each kind's distinct n-grams, ascending; one kind at a time."""
    n = len(offs) - 1
    s, e, at = tx.word_table(data, offs)
    if not len(s):
        return
    doc = np.repeat(np.arange(n), np.diff(at))
    low = tx.lowered(data)
    h = tx.span_hashes(low, s, e)
    d, b, _ = _distinct(doc, _top(h))
    yield d, b
    for k, size in enumerate(STEMS, 1):
        d, b, _ = _distinct(doc, _top(tx.span_hashes(low, s, np.minimum(e, s + size))))
        yield d, b + (k << BITS)
    del low
    # what stands between a word and the one before it; a text's first word has none
    same = doc[1:] == doc[:-1]
    if not same.any():
        return
    inner = doc[1:][same]
    gap = tx.span_hashes(data, e[:-1], s[1:])[same]
    yield from _shared(inner, _top(gap), n, KINDS - 4)
    # shape of the word after: several capitals, small letters, digits, equal to the word before
    edges = np.stack([s, e], 1).ravel()
    bytes_ = np.append(data, np.uint8(0))
    caps, smalls, digits = (np.add.reduceat(t[bytes_], edges, dtype=np.int32)[::2] for t in _CLASSES)
    shape = (caps > 1) * 1 + (smalls > 0) * 2 + (digits > 0) * 4
    shape[1:] += ((h[1:] == h[:-1]) & same) * 8
    marked = tx.mix(gap ^ (shape[1:][same].astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    yield from _shared(inner, _top(marked), n, KINDS - 2)


def count_grams(docs: DataFrame, good: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How many of all documents hold each bucket, and how many of those whose ids are in good (sorted).

    The last entry of either counts the documents themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = shared.value
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for part in tx.chunks(b, "text", CHUNK):
                ids = part.column(0).fill_null(-1 << 63).to_numpy(zero_copy_only=False)
                mine = np.zeros(len(ids), bool)
                if len(good):
                    at = np.minimum(np.searchsorted(good, ids), len(good) - 1)
                    mine = (good[at] == ids) & ~part.column(0).is_null().to_numpy(zero_copy_only=False)
                raw[BUCKETS] += len(ids)
                target[BUCKETS] += mine.sum()
                for doc, bucket in grams(*tx.buffers(part.column(1))):
                    np.add.at(raw, bucket, 1)
                    np.add.at(target, bucket[mine[doc]], 1)
        some = np.flatnonzero(raw)
        for a in range(0, len(some), 20000):
            x = some[a : a + 20000]
            columns = [pa.array(x.astype(np.int32)), pa.array(raw[x]), pa.array(target[x])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "raw", "target"])

    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    counts = cols.mapInArrow(work, "bucket int, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    shared.unpersist()
    raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    at = sums["bucket"].to_numpy()
    raw[at], target[at] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, shrunk towards 0.

    The deviance of the documents seen from those expected is the square of
    the ratio's standard errors; a ratio of r of them loses (STANDARD_ERRORS / r) ** 2 of itself.
    """
    expected = raw[:BUCKETS] * (target[BUCKETS] / max(1, raw[BUCKETS]))
    seen = target[:BUCKETS].astype(float)
    ratio = np.log((seen + SMOOTH) / (expected + SMOOTH))
    held = np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    deviance = 2 * (held - seen + expected)
    kept = deviance > STANDARD_ERRORS**2
    return np.where(kept, ratio * (1 - STANDARD_ERRORS**2 / np.where(kept, deviance, 1.0)), 0.0)


def weights(data: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Each text's log weight. Sums run in each text's order, so they don't depend on how texts are batched."""
    out = np.zeros(len(offs) - 1)
    for doc, bucket in grams(data, offs):
        out += np.bincount(doc, weights=ratio[bucket], minlength=len(out))
    return out


@dataclass
class Selection:
    """ratio: of each bucket, None if nothing can be told; scored: doc_id, log_weight, key; those with a key from threshold on are sampled."""

    ratio: np.ndarray | None
    scored: DataFrame
    threshold: float


def log_weight(spark: SparkSession, text: Column, ratio: np.ndarray) -> Column:
    """A text's log weight. Only the text goes to Python, and a number comes back."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        got = [weights(*tx.buffers(part.column(0)), shared.value) for part in tx.chunks(batch, "text", CHUNK)]
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    return weigh(text.cast("string"))


def gumbel(id_col: str, seed: int = 7) -> Column:
    """Gumbel noise of a row's id; a null id has noise of its own."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, small: int = 10_000) -> float:
    """The exact k-th largest value (k from 1) by narrowing histograms; at most ``small`` values reach the driver."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    left = k
    while True:
        inside = df.where(F.col(column).between(lo, hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return hi
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width)).cast("int")
        rows = inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if n >= left:
                break
            left -= n
        if lo == hi:
            return lo
        if n <= small:
            got = df.where(F.col(column).between(lo, hi)).select(column).collect()
            return sorted((r[0] for r in got), reverse=True)[left - 1]


def labelled(labels: DataFrame, max_labelled: int) -> dict[int, bool]:
    """Whether a document is good, for at most max_labelled labelled ids (those of the lowest hashes).

    Only ids under a hash bound compete, so that tasks send few of them to the
    driver however many tasks there are. Rows with a null are left out; of a
    repeated id all rows must be good.
    """
    good = F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    share = min(1.0, 4 * max_labelled / max(1, labels.count()))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    near = known.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = near.groupBy("doc_id").agg(good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    return {r["doc_id"]: r["good"] for r in rows}


def select(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, share: float | None = None, sharpness: float = SHARPNESS) -> Selection:
    """Counts both models, weighs all documents and finds the k-th key. labels(doc_id, quality, toxic): good is quality 1 and toxic 0.

    Null texts count as empty; a text without a word has log weight 0. Rows
    with equal ids are weighed each, with the same noise. Without labels of both
    kinds, or without a good document among docs, nothing can be told and all
    documents are kept. An empty table gives no rows.
    """
    label = labelled(labels, max_labelled)
    counted = np.array(sorted(i for i, good in label.items() if good), np.int64)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    none = Selection(None, own.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key")), 0.0)
    if not 0 < len(counted) < len(label):
        return none
    raw, target = count_grams(own, counted)
    if not target[BUCKETS]:
        return none
    ratio = log_ratios(raw, target)
    scored = own.select("doc_id", log_weight(docs.sparkSession, F.col("text"), ratio).alias("log_weight"))
    keyed = common.saved(scored.withColumn("key", sharpness * F.col("log_weight") + gumbel("doc_id")))
    k = round((len(counted) / len(label) if share is None else share) * int(raw[BUCKETS]))
    return Selection(ratio, keyed, kth_largest(keyed, "key", k) if k else float("inf"))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, share: float | None = None, sharpness: float = SHARPNESS) -> DataFrame:
    """The sampled documents' rows, all columns as they were, whatever their names; nothing is shuffled.

    Keys that tie with the k-th are kept. For the cases of labels and texts see select().
    """
    s = select(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled, share=share, sharpness=sharpness)
    if s.ratio is None:
        return docs
    return docs.where(sharpness * log_weight(docs.sparkSession, F.col(text_col), s.ratio) + gumbel(id_col) >= s.threshold)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, key (weight and noise) and keep of the documents that are sampled."""
    s = select(common.read_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return s.scored.where(F.col("key") >= s.threshold).select("doc_id", "log_weight", "key", F.lit(True).alias("keep"))
