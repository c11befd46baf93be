"""Vectorised text primitives over Arrow string buffers (numpy only, no Spark).

Word rule used by every word-based operator of this subpackage: A-Z are
lower-cased, a word is a maximal run of ``0-9``, ``a-z`` and bytes >= 0x80
(so any non-ASCII character), everything else separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: bytes hashed at once, or one span; bounds the temporary arrays and the powers that a worker keeps
BLOCK = 1 << 17

_WORD = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _WORD[_b] = _b
    elif 65 <= _b <= 90:
        _WORD[_b] = _b + 32

_pows: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to n; kept up to 2 * BLOCK."""
    if "p" in _pows and len(_pows["p"]) > n:
        return _pows["p"], _pows["i"]
    size = max(2 * BLOCK, n + 1)
    got = []
    for base in (_BASE, _INV):
        a = np.full(size, base & MASK, U64)
        a[0] = 1
        got.append(np.cumprod(a, dtype=U64))
    if size == 2 * BLOCK:
        _pows["p"], _pows["i"] = got
    return got[0], got[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64's constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        stop = int(ends[b - 1])
        p, inv = _powers(stop - base + 1)
        c = np.zeros(stop - base + 1, U64)
        np.cumsum((values[base:stop].astype(U64) + U64(1)) * p[: stop - base], dtype=U64, out=c[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = mix((c[e] - c[s]) * inv[s] + (ends[a:b] - starts[a:b]).astype(U64) * U64(0xD6E8FEB86659FD93))
        a = b
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if pa.types.is_string_view(col.type):
        col, wide = col.cast(pa.large_string()), True
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(offs) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most max_bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < n:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max_bytes, "right"))
        b = min(n, max(a + 1, b))
        yield batch.slice(a, b - a)
        a = b


def word_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte start, byte end) of every word, and each text's range in them (n + 1 offsets)."""
    low = _WORD[data] if len(data) else data
    inside = low != 0
    full = np.flatnonzero(np.diff(offs))
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    prev[offs[full]] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = inside[1:]
    nxt[offs[full + 1] - 1] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of every word and each text's range in them."""
    starts, ends, at = word_table(data, offs)
    return starts, ends, span_hashes(_WORD[data], starts, ends) if len(starts) else np.zeros(0, U64), at


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every k-word shingle; a text of 1 to k-1 words has one, of all its words."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return h, doc
    ext = np.concatenate([h, np.zeros(k, U64)])
    place = np.arange(len(h)) - at[doc]
    left = n[doc] - place
    s = np.zeros(len(h), U64)
    for j in range(k):
        s += np.where(left > j, ext[j : j + len(h)], U64(0)) * U64((0xC2B2AE3D27D4EB4F * (2 * j + 3)) & MASK)
    keep = (left >= k) | ((place == 0) & (n[doc] < k))
    return mix(s[keep]), doc[keep]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and separators as 0."""
    return _WORD[data]


def runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first k values, list of the others) of each run of rows with equal first k values."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:k] != now:
                if held:
                    yield now, held
                now, held = row[:k], []
            held.append(row[k:])
    if held:
        yield now, held
