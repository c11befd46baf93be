"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (the symbols). The CGK random walk reads a
sequence x with a pointer that starts at 0: step j emits x[pointer] and moves
the pointer by a random bit of (j, x[pointer]). Two sequences at edit distance
k give emissions at a Hamming distance of O(k^2), so sampling a few of the
steps is a locality-sensitive hash for edit distance. The walk over a longer
window continues that over a shorter one; therefore one walk from a place
serves the windows of items of every size. Walks start at content-defined
places (words whose hash is less than both neighbours'), the same ones in an
item and in a document that holds it, and are repeated with other bits and
samples until recall is near one; an item of 40 words has about 13 such
places. A place whose samples agree with an item's and whose emissions are
near is verified exactly: the word edit distance between the item and the best
window of the document, by bit-parallel dynamic programming.

The benchmark is taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import text as tx

U64 = np.uint64
THRESHOLD = 0.8
STEPS, SAMPLES, REPEATS = 12, 4, 8
#: items of fewer words are looked for from every word: they have too few places to choose from
DENSE_WORDS = 30
#: share of the words that an item's walk visits that must agree before a place is verified
AGREE = 0.6
#: bytes of benchmark text in a block
BLOCK_BYTES = 8 << 20


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return tx.words(raw, np.array([0, len(raw)], np.int64))[2]


def anchors(h: np.ndarray) -> np.ndarray:
    """Places whose word's hash is less than the word's before and not more than the word's after."""
    if len(h) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])) + 1


def edit_end(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """(distance, end) of the window of text nearest to the pattern of n words (Myers' bit-parallel method)."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Index:
    """Sampled walks of a block of items, for one way of choosing places."""

    every: bool
    items: list[np.ndarray]
    ids: list
    threshold: float
    steps: int = STEPS
    keys: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    walks: list[np.ndarray] = field(default_factory=list)
    fresh: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        place, item, joined, at = [], [], [], 0
        for k, h in enumerate(self.items):
            p = np.arange(len(h)) if self.every else anchors(h)
            far = p[p + self.steps <= len(h)]
            p = far if len(far) >= 3 else p
            place.append(p + at)
            item.append(np.full(len(p), k))
            joined += [h, np.zeros(self.steps, U64)]
            at += len(h) + self.steps
        self.place = np.concatenate(place).astype(np.int64) if place else np.zeros(0, np.int64)
        self.item = np.concatenate(item).astype(np.int64) if item else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum([len(h) + self.steps for h in self.items])])[:-1].astype(np.int64)
        self.offset = self.place - first[self.item]
        # one place in sixteen of a table is taken at most
        self.table_bits = max(12, (16 * len(self.place)).bit_length())
        h = np.concatenate(joined) if joined else np.zeros(0, U64)
        rng = np.random.default_rng(20240611)
        self.bits = (rng.integers(1, 1 << 63, (REPEATS, self.steps), dtype=np.uint64) << U64(1)) | U64(1)
        # one step of each stretch of the walk, so that a pointer that stays for some steps isn't sampled over and over
        edges = np.linspace(0, self.steps, min(SAMPLES, self.steps) + 1).astype(int)
        self.sample = np.array([[rng.integers(a, b) for a, b in zip(edges, edges[1:], strict=False)] for _ in range(REPEATS)])
        for r in range(REPEATS):
            emitted, key = self.walk(h, self.place, r)
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << self.table_bits, bool)
            table[(key >> U64(64 - self.table_bits)).astype(np.int64)] = True
            self.keys.append(key[order])
            self.owner.append(order)
            self.tables.append(table)
            self.walks.append(emitted)
            self.fresh.append(self.moves(h, self.place, r))
        self.masks: list[dict[int, int]] = []
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for h in self.items]
        for h in self.items:
            m: dict[int, int] = {}
            for i, c in enumerate(h.tolist()):
                m[c] = m.get(c, 0) | (1 << i)
            self.masks.append(m)

    def walk(self, h: np.ndarray, start: np.ndarray, r: int, keep: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (16 bits of each) and sampled keys of the walks from start; h has steps words after each start."""
        at = start.copy()
        key = np.full(len(start), U64(r + 1))
        out = np.zeros((len(start), self.steps), np.uint16) if keep else np.zeros((0, 0), np.uint16)
        chosen = set(self.sample[r].tolist())
        last = self.steps if keep else max(chosen) + 1
        for j in range(last):
            x = h[at]
            if keep:
                out[:, j] = (x >> U64(48)).astype(np.uint16)
            if j in chosen:
                key = (key ^ x) * U64(0x9E3779B97F4A7C15)
                key ^= key >> U64(29)
            at += ((x * self.bits[r, j]) >> U64(63)).astype(np.int64)
        return out, key * U64(0xBF58476D1CE4E5B9)

    def moves(self, h: np.ndarray, start: np.ndarray, r: int) -> np.ndarray:
        """Which steps of the walks from start read a word for the first time."""
        at, out = start.copy(), np.ones((len(start), self.steps), bool)
        for j in range(self.steps - 1):
            bit = ((h[at] * self.bits[r, j]) >> U64(63)).astype(np.int64)
            out[:, j + 1] = bit == 1
            at += bit
        return out

    def find(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end word) of every text and item within the threshold; h: words of all texts, at: their ranges."""
        start = np.arange(len(h)) if self.every else anchors(h)
        if not len(start) or not len(self.place):
            return
        ext = np.concatenate([h, np.zeros(self.steps + 1, U64)])
        where, which = [], []
        for r in range(REPEATS):
            _, key = self.walk(ext, start, r, keep=False)
            near = np.flatnonzero(self.tables[r][(key >> U64(64 - self.table_bits)).astype(np.int64)])
            if not len(near):
                continue
            lo, hi = np.searchsorted(self.keys[r], key[near], "left"), np.searchsorted(self.keys[r], key[near], "right")
            count = hi - lo
            s = np.repeat(start[near], count)
            first = np.cumsum(count) - count
            k = self.owner[r][np.repeat(lo - first, count) + np.arange(count.sum())]
            emitted, _ = self.walk(ext, s, r)
            fresh = self.fresh[r][k]
            ok = ((emitted == self.walks[r][k]) & fresh).sum(1) >= AGREE * fresh.sum(1)
            where.append(s[ok])
            which.append(k[ok])
        if not where:
            return
        s, k = np.concatenate(where), np.concatenate(which)
        doc = np.searchsorted(at, s, "right") - 1
        # one verification for each text, item and alignment
        rows = np.unique(np.stack([doc, self.item[k], s - self.offset[k]], 1), axis=0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for d, i, line in rows.tolist():
            n = len(self.items[i])
            allowed = int((1 - self.threshold) * n + 1e-9)
            if (known := best.get((d, i))) and known[0] == 0:
                continue
            # an alignment inside the window verified last needs no other
            if (d, i) in done and line <= done[d, i]:
                continue
            lo, hi = max(int(at[d]), line - 2 * allowed), min(int(at[d + 1]), line + n + 2 * allowed)
            done[d, i] = line + allowed
            window = h[lo:hi].tolist()
            # each of the item's words that the window lacks costs an edit at least
            if n - sum(map(self.counts[i].get, self.counts[i].keys() & set(window))) > allowed:
                continue
            distance, end = edit_end(self.masks[i], n, window)
            if distance <= allowed and (known is None or distance < known[0]):
                best[d, i] = (distance, lo - int(at[d]) + end)
        for (d, i), (distance, end) in best.items():
            yield d, i, distance, end


def indexes(ids: list, texts: list[str], threshold: float = THRESHOLD) -> list[Index]:
    """Items of DENSE_WORDS with at least three places are found by those, shorter and odd ones from every word.

    Walks are no longer than the shortest item that they serve, by classes of
    lengths. Items without a word are left out: nothing contains them.
    """
    groups: dict[tuple[bool, int], tuple[list, list]] = {}
    for i, t in zip(ids, texts, strict=True):
        h = word_hashes(t)
        if not len(h):
            continue
        every = len(h) < DENSE_WORDS or len(anchors(h)) < 3
        # short items' walks leave room for several places before the item ends
        steps = STEPS if len(h) >= 20 else 8 if len(h) >= STEPS else min(6, len(h))
        g = groups.setdefault((every, steps), ([], []))
        g[0].append(i)
        g[1].append(h)
    return [Index(every, g[1], g[0], threshold, steps) for (every, steps), g in sorted(groups.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark's distinct rows in blocks of about block_bytes at most."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), common.text_or_empty(text_col).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in got], [r["text"] for r in got]


MATCHES = "doc_id long, item_id long, distance long, item_words long, similarity double, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_words, similarity, end_word) of documents that hold an item nearly.

    similarity = 1 - distance / item_words, at least threshold; distance is
    the word edit distance from the item to the best window of the document,
    which ends before word end_word. Null or wordless texts and items match
    nothing. Rows with equal ids are matched each. Empty tables give no rows.
    """
    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for ids, texts in blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ixs = indexes(*shared.value, threshold)
            for b in batches:
                for part in tx.chunks(b, "text"):
                    _, _, h, at = tx.words(*tx.buffers(part.column(1)))
                    keys = part.column(0).to_pylist()
                    rows = [(keys[d], ix.ids[i], distance, len(ix.items[i]), 1 - distance / len(ix.items[i]), end) for ix in ixs for d, i, distance, end in ix.find(h, at)]
                    if rows:
                        kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

        one = cols.mapInArrow(work, MATCHES)
        out = one if out is None else out.unionByName(one)
    return out


def _holds(shared: Broadcast, threshold: float) -> Callable[[Column], Column]:
    """Whether a text holds an item of a block nearly."""

    @F.arrow_udf("boolean")
    def holds(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ixs = indexes(*shared.value, threshold)
        for t in text:
            out = [np.zeros(0, bool)]
            for part in tx.chunks(pa.RecordBatch.from_arrays([t], ["text"]), "text"):
                _, _, h, at = tx.words(*tx.buffers(part.column(0)))
                dirty = np.zeros(part.num_rows, bool)
                for ix in ixs:
                    for d, _, _, _ in ix.find(h, at):
                        dirty[d] = True
                out.append(dirty)
            yield pa.array(np.concatenate(out))

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold an item nearly; all columns stay, nothing is shuffled, only texts go to Python."""
    for ids, texts in blocks(benchmark, item_id_col, item_text_col, block_bytes):
        holds = _holds(docs.sparkSession.sparkContext.broadcast((ids, texts)), threshold)
        docs = docs.where(~holds(docs[text_col].cast("string")))
    return docs


def op5_cgk_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, each with the items."""
    return matches(common.read_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
