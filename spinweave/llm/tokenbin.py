"""Token-id files with a shared zstandard dictionary.

File format: Parquet files (so that Spark's committers write them to any
store and a lost executor's attempt leaves nothing behind), one row per block
of documents in ascending doc_id order:

``part, block``  place in the order; ``before``  ids of this part before the block;
``dict_hash``  sha256 of the dictionary; ``width``  bytes of a stored id (2 or 4);
``doc_ids``; ``n_tokens`` of each; ``offsets``  n + 1 byte offsets into ``data``;
``data``  each document's ids (little endian), compressed by itself.

The dictionary lies beside the blocks as one row (dict_hash, dictionary). A
document is read by its offsets alone, without the rest of its block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from . import text as tx

BLOCKS = "part int, block int, before long, dict_hash string, width int, doc_ids array<long>, n_tokens array<long>, offsets array<long>, data binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, dict_hash string"


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, *, tokenizer: str | None = None, sample_docs: int = 512, max_sample_chars: int = 16384, dict_bytes: int = 32768, width: int = 2) -> bytes:
    """A dictionary from the serialized ids of sample_docs documents of 1 to max_sample_chars characters.

    The sample (low hashes) and so what reaches the driver is bounded,
    sample_docs * max_sample_chars characters; the documents that it serves
    are the short ones. Too small a sample gives the empty dictionary.
    """
    import zstandard

    # only rows under a hash bound compete, so that tasks send few of them to the driver however many tasks there are
    share = min(1.0, 8 * sample_docs / max(1, docs.count()))
    near = docs.where((F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.length("text").between(1, max_sample_chars))
    rows = near.select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(sample_docs).collect()
    if len(rows) < 16:
        return b""
    ids, at = bpe.shared(tokenizer).encode([r["text"] for r in rows])
    samples = [serialize(ids[a:b], width) for a, b in zip(at, at[1:], strict=False) if b > a]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, level: int = 3, block_tokens: int = 1 << 18, sample_docs: int = 512) -> None:
    """Writes all documents (null text: the end id only) in ascending doc_id order.

    Null ids come first; rows with equal ids are ordered by a hash of their
    text. Extra columns are ignored. An empty table writes no blocks.
    """
    import zstandard

    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    width = 2 if bpe.shared(tokenizer).tk.get_vocab_size() <= 65536 and end_id < 65536 else 4
    dictionary = train_dictionary(cols, tokenizer=tokenizer, sample_docs=sample_docs, width=width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.shared(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zc = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        part, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        counts: list[int] = []
        blobs: list[bytes] = []
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).tolist()
            row = {"part": part, "block": block, "before": before, "dict_hash": digest, "width": width, "doc_ids": keys, "n_tokens": counts, "offsets": offsets, "data": b"".join(blobs)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for piece in tx.chunks(b, "text", bpe.CHUNK):
                ids, at = enc.encode(piece.column(1).to_pylist())
                for k, key in enumerate(piece.column(0).to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end])
                    keys.append(key)
                    counts.append(len(own))
                    blobs.append(zc.compress(serialize(own, width)))
                    held += len(own)
                    if held >= block_tokens:
                        yield flush()
                        block, before, held = block + 1, before + held, 0
                        keys, counts, blobs = [], [], []
        if keys:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]
    cols.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, BLOCKS).write.parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary doesn't match its hash")
    return dictionary


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, dict_hash (and ids).

    Only a number for each part, the ids before it, passes through the driver.
    """
    import zstandard

    dictionary = _opened(spark, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r["part"]], at = at, at + r["n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zd = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block names another dictionary")
                counts = np.array(r["n_tokens"], np.int64)
                starts = base[r["part"]] + r["before"] + np.cumsum(counts) - counts
                raw, offs, crc, ids = memoryview(r["data"]), r["offsets"], [], []
                for k in range(len(counts)):
                    own = np.frombuffer(zd.decompress(raw[offs[k] : offs[k + 1]]), "<u2" if r["width"] == 2 else "<u4").astype("<u4")
                    if len(own) != counts[k]:
                        raise ValueError("a document has another number of ids than its index says")
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own.tolist())
                arrays = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64()), pa.array([digest] * len(crc), pa.string())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "dict_hash"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return blocks.mapInArrow(work, ROWS + (", ids array<long>" if with_ids else ""))


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of a document (a list for each row that has this id), decompressing only its own bytes."""
    import zstandard

    dictionary = _opened(spark, path)
    zd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    one = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    out = []
    each = one.select("part", "block", "width", F.posexplode(F.arrays_zip("doc_ids", "n_tokens")).alias("k", "x"), "offsets", "data").where(F.col("x.doc_ids") == doc_id)
    cut = each.select("part", "block", "k", "width", F.expr("substring(data, cast(offsets[k] + 1 as int), cast(offsets[k + 1] - offsets[k] as int))").alias("raw")).orderBy("part", "block", "k")
    for r in cut.collect():
        out.append(np.frombuffer(zd.decompress(bytes(r["raw"])), "<u2" if r["width"] == 2 else "<u4").tolist())
    return out


def op7_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    write(common.read_docs(spark, sf_dir), path)
    return read(spark, path)
