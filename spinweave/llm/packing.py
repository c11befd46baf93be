"""Harmonic packing of token ids into fixed-capacity sequences.

Lengths fall into reciprocal-capacity classes: class j holds the lengths in
(capacity/(j+1), capacity/j] and each of its sequences takes exactly j pieces.
Documents may be cut freely, so a document is cut into whole sequences and
then into pieces of exactly capacity/2, capacity/4, ... down to ``smallest``
(classes that fill a sequence without a gap); what is left, under
``smallest``, goes by its length to class capacity // length. Each worker
fills its own sequences with no shuffle and no shared state. What its open
sequences hold at the end is laid one after another into full sequences, so a
worker pads at most one of them besides the short classes' rests (under
``smallest`` ids each).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common
from . import text as tx

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def piece_lengths(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of n ids, in order: whole sequences, halvings, the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= smallest and n:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Harmonic:
    """One worker's open sequences: for each class the pieces waiting for their sequence to fill."""

    def __init__(self, worker: int, capacity: int, smallest: int):
        self.capacity, self.smallest = capacity, smallest
        self.open: dict[int, list[tuple]] = {}
        self.next = worker << 40

    def add(self, piece: tuple, ids: np.ndarray) -> Iterator[tuple]:
        """piece: (doc_id, start, length, doc_tokens). Gives the pieces of a sequence when it is full."""
        number = self.capacity // piece[2]
        rows = self.open.setdefault(number, [])
        rows.append((piece, ids))
        if len(rows) == number:
            at = 0
            for p, x in rows:
                yield (*p, x, self.next, at)
                at += p[2]
            self.next += 1
            self.open[number] = []

    def close(self) -> Iterator[tuple]:
        """The waiting pieces, longest class first, laid into sequences and cut at their ends."""
        at = 0
        for number in sorted(self.open):
            for (doc, start, length, total), ids in self.open[number]:
                done = 0
                while done < length:
                    take = min(length - done, self.capacity - at)
                    yield doc, start + done, take, total, ids[done : done + take], self.next, at
                    done, at = done + take, at + take
                    if at == self.capacity:
                        self.next, at = self.next + 1, 0
        self.open = {}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, smallest: int = 32, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null or empty texts have the end id only. A null doc_id stays null; rows
    with equal ids are packed each. An empty table gives no rows. Other columns
    are ignored. Sequence ids are unique, not dense. capacity must be a power
    of two times smallest.
    """
    if capacity % smallest or (capacity // smallest) & (capacity // smallest - 1):
        raise ValueError("capacity must be smallest times a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.shared(tokenizer)
        bins = Harmonic(TaskContext.get().partitionId(), capacity, smallest)
        cuts: dict[int, list[int]] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            crc = [zlib.crc32(x.tobytes()) for x in cols[4]]
            out = [cols[0], cols[1], cols[2], crc, cols[3], cols[5], cols[6]]
            arrays = [pa.array(list(c), pa.int64()) for c in out]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in cols[4]], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for part in tx.chunks(b, "text", bpe.CHUNK):
                keys = part.column(0).to_pylist()
                ids, at = enc.encode([t or "" for t in part.column(1).to_pylist()])
                rows: list[tuple] = []
                for k, doc in enumerate(keys):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    n, start = len(own), 0
                    rest = n % capacity
                    if rest not in cuts:
                        cuts[rest] = piece_lengths(rest, capacity, smallest)
                    for length in [capacity] * (n // capacity) + cuts[rest]:
                        # a copy, so that a waiting piece doesn't hold its whole chunk
                        x = own[start : start + length]
                        rows.extend(bins.add((doc, start, length, n), x.copy() if length < n else x))
                        start += length
                if rows:
                    yield batch(rows)
        rows = list(bins.close())
        if rows:
            yield batch(rows)

    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(work, SCHEMA + (", ids array<long>" if with_ids else ""))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1,024 ids."""
    return pack(common.read_docs(spark, sf_dir))
