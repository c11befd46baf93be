"""TIFF: a writer for grayscale pages and a reader that walks image directories.

The reader takes either byte order, strips or tiles, no compression, PackBits,
LZW or deflate, horizontal (2) and floating-point (3) predictors, 8, 16, 32
and 64 bits a sample and any number of chunky samples, and gives one row per
page. It is written against the public TIFF 6.0 specification.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import text as tx

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_OLD_DEFLATE = 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}


class TiffError(ValueError):
    """The bytes aren't a TIFF file that the reader takes."""


# --- PackBits -------------------------------------------------------------


def packbits_encode(raw: bytes) -> bytes:
    """Runs of 3 and more as repeats, everything else as literals."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    sizes = np.diff(edges)
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        nonlocal at
        while at < stop:
            n = min(128, stop - at)
            out.append(n - 1)
            out.extend(raw[at : at + n])
            at += n

    for k in np.flatnonzero(sizes >= 3).tolist():
        literal(int(edges[k]))
        left, value = int(sizes[k]), raw[int(edges[k])]
        while left >= 2:
            n = min(128, left)
            out += bytes((257 - n, value))
            at, left = at + n, left - n
    literal(len(a))
    return bytes(out)


def packbits_rows(a: np.ndarray) -> bytes:
    """Each row packed by itself, as the format asks; rows without a run are copied at once."""
    h, w = a.shape
    if w > 128 or w < 3:
        return b"".join(packbits_encode(r.tobytes()) for r in a)
    run = ((a[:, 2:] == a[:, 1:-1]) & (a[:, 1:-1] == a[:, :-2])).any(1)
    plain = np.empty((h, w + 1), np.uint8)
    plain[:, 0] = w - 1
    plain[:, 1:] = a
    if not run.any():
        return plain.tobytes()
    return b"".join(packbits_encode(a[i].tobytes()) if run[i] else plain[i].tobytes() for i in range(h))


def packbits_decode(raw: bytes, size: int) -> bytes:
    parts, at, got = [], 0, 0
    while got < size and at < len(raw):
        n = raw[at]
        if n < 128:
            parts.append(raw[at + 1 : at + 2 + n])
            at += n + 2
            got += n + 1
        elif n > 128:
            parts.append(raw[at + 1 : at + 2] * (257 - n))
            at += 2
            got += 257 - n
        else:
            at += 1
    return b"".join(parts)


# --- LZW (most significant bit first, early change) -------------------------

#: codes between two clears until the table's last entry (4093) would be used
_FULL = 4093 - 258 + 1
_WIDTHS = np.array([9 + (k + 258 > 511) + (k + 258 > 1023) + (k + 258 > 2047) for k in range(_FULL + 3)], np.int64)
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def _bits(segments: list[list[int]]) -> bytes:
    """Each segment starts with a clear code and is followed by codes whose widths grow."""
    codes = np.array([c for s in segments for c in s], np.int64)
    # the clear code's width belongs to the table that it ends
    widths = []
    for k, s in enumerate(segments):
        widths.append(np.concatenate([[9 if k == 0 else _WIDTHS[len(segments[k - 1]) - 1]], _WIDTHS[: len(s) - 1]]))
    w = np.concatenate(widths)
    first = np.cumsum(w) - w
    out = np.zeros((int(w.sum()) + 7) // 8 + 4, np.int64)
    word = codes << (24 - (first & 7) - w)
    for j in range(3):
        out[: len(out)] += np.bincount(first // 8 + j, (word >> (16 - 8 * j)) & 255, minlength=len(out)).astype(np.int64)[: len(out)]
    return out[: (int(w.sum()) + 7) // 8].astype(np.uint8).tobytes()


def lzw_encode(raw: bytes) -> bytes:
    segments, codes, table, free = [], [256], {}, 258
    if raw:
        w = raw[0]
        get = table.get
        for b in raw[1:]:
            key = (w << 8) | b
            c = get(key)
            if c is not None:
                w = c
            else:
                codes.append(w)
                table[key] = free
                free += 1
                w = b
                if free > 4093:
                    segments.append(codes)
                    codes, free = [256], 258
                    table.clear()
        codes.append(w)
    codes.append(257)
    segments.append(codes)
    return _bits(segments)


def lzw_decode(raw: bytes, size: int) -> bytes:
    """Up to size bytes; codes between two clears are cut out at once, as their widths are known."""
    a = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    total, bit, out, got = len(raw) * 8, 0, [], 0
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    if total >= 9 and (int(a[0]) << 1 | int(a[1]) >> 7) != 256:
        raise TiffError("LZW data must begin with a clear code")
    while got < size and bit < total:
        # at a table's start: leading clear codes are 9 bits wide here
        n = int(np.searchsorted(_STARTS, total - bit, "right")) - 1
        n = min(n, len(_WIDTHS))
        if n <= 0:
            break
        p, w = bit + _STARTS[:n], _WIDTHS[:n]
        q = p >> 3
        codes = (((a[q] << 16) | (a[q + 1] << 8) | a[q + 2]) >> (24 - (p & 7) - w)) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        table, prev, free, put = base.copy(), None, 258, out.append
        add = table.append
        for c in codes[:stop].tolist():
            if prev is None:
                if c > 255:
                    raise TiffError("LZW code before its entry")
                s = base[c]
            else:
                if c < free:
                    s = table[c]
                elif c == free:
                    s = prev + prev[:1]
                else:
                    raise TiffError("LZW code before its entry")
                add(prev + s[:1])
                free += 1
            put(s)
            prev = s
        got = sum(map(len, out))
        if stop == n or codes[stop] == 257:
            break
        bit += int(_STARTS[stop + 1])
    return b"".join(out)


# --- predictors -------------------------------------------------------------


def _predict(a: np.ndarray) -> np.ndarray:
    """Horizontal differences of rows of samples (height, width, samples)."""
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out


def _undo(raw: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    h, w, s = shape
    need = h * w * s * kind.itemsize
    if len(raw) < need:
        raise TiffError("a strip or tile is too short")
    raw = raw[:need]
    if predictor == 3:
        if kind.kind != "f":
            raise TiffError("predictor 3 is for floating point")
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(h, w * kind.itemsize, s), axis=1, dtype=np.uint8)
        flat = planes.reshape(h, kind.itemsize, w * s)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, s).astype(kind.newbyteorder("="))
    a = np.frombuffer(raw, kind).reshape(h, w, s)
    if predictor == 2:
        whole = a.astype(kind.newbyteorder("="))
        view = whole.view(f"u{kind.itemsize}")
        return np.cumsum(view, axis=1, dtype=view.dtype).view(whole.dtype)
    if predictor != 1:
        raise TiffError(f"predictor {predictor} isn't known")
    return a.astype(kind.newbyteorder("="))


# --- writer -------------------------------------------------------------


def _compress(raw: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(raw)
    if compression == DEFLATE:
        return zlib.compress(raw)
    if compression == PACKBITS:
        return packbits_encode(raw)
    return raw


def encode(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit pages, each (height, width); tile: (height, width), multiples of 16."""
    out, last = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        h, w = page.shape
        blocks = []
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw), np.uint8)
            padded[:h, :w] = page
            cells = [padded[i : i + th, j : j + tw] for i in range(0, h, th) for j in range(0, w, tw)]
        else:
            cells = [page[i : i + rows_per_strip] for i in range(0, h, rows_per_strip)]
        for cell in cells:
            # rows are packed apart only in PackBits; runs may cross them in the others
            a = _predict(cell[:, :, None])[:, :, 0] if predictor == 2 else cell
            raw = packbits_rows(a) if compression == PACKBITS else _compress(a.tobytes(), compression)
            blocks.append((len(out), len(raw)))
            out += raw
        if len(out) % 2:
            out.append(0)

        def longs(values: list[int]) -> tuple[int, int, bytes]:
            if len(values) == 1:
                return 4, 1, struct.pack("<I", values[0])
            at = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return 4, len(values), struct.pack("<I", at)

        def short(v: int) -> tuple[int, int, bytes]:
            return 3, 1, struct.pack("<HH", v, 0)

        tags = {256: longs([w]), 257: longs([h]), 258: short(8), 259: short(compression), 262: short(1), 277: short(1), 317: short(predictor)}
        if tile:
            tags |= {322: short(tile[1]), 323: short(tile[0]), 324: longs([b[0] for b in blocks]), 325: longs([b[1] for b in blocks])}
        else:
            tags |= {278: longs([min(rows_per_strip, h)]), 273: longs([b[0] for b in blocks]), 279: longs([b[1] for b in blocks])}
        struct.pack_into("<I", out, last, len(out))
        out += struct.pack("<H", len(tags))
        for tag, (kind, count, value) in sorted(tags.items()):
            out += struct.pack("<HHI", tag, kind, count) + value
        last = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- reader -------------------------------------------------------------


@dataclass
class Page:
    page: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    layout: str
    pixels: np.ndarray


def directories(raw: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of their chain; files with 4-byte and with 8-byte offsets."""
    if raw[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        raise TiffError("no TIFF header")
    o, big = "<" if raw[:1] == b"I" else ">", b"+" in raw[2:4]
    # codes of a directory's count, of an entry's count and of a place; their sizes; bytes of an entry
    many, place_code, head, inline, entry = ("Q", "Q", 8, 8, 20) if big else ("H", "I", 2, 4, 12)
    try:
        (at,) = struct.unpack_from(f"{o}{place_code}", raw, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(f"{o}{many}", raw, at)
            if at + head + entry * n > len(raw):
                raise TiffError("the file is cut short")
            tags: dict[int, tuple] = {0: (o,)}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{o}HH{place_code}", raw, at + head + entry * k)
                if kind not in _SIZES:
                    continue
                size = _SIZES[kind] * count
                place = at + head + entry * k + entry - inline
                if size > inline:
                    (place,) = struct.unpack_from(f"{o}{place_code}", raw, place)
                if place + size > len(raw):
                    raise TiffError("a tag's values lie outside the file")
                if kind in (1, 3, 4, 16):
                    code = {1: "B", 3: "H", 4: "I", 16: "Q"}[kind]
                    tags[tag] = struct.unpack_from(f"{o}{count}{code}", raw, place)
                else:
                    tags[tag] = (raw[place : place + size],)
            yield tags
            (at,) = struct.unpack_from(f"{o}{place_code}", raw, at + head + entry * n)
    except struct.error as e:
        raise TiffError("the file is cut short") from e


#: bytes that one stored byte can stand for at most: an LZW code of 9 to 12 bits gives 4,096 at most, deflate about 1,030
EXPANSION = 4096
_MIRRORED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def _inflate(cell: bytes, need: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(cell, need)
    except zlib.error as e:
        raise TiffError("deflate data is broken") from e


def _unpacked(cell: bytes, rows: int, columns: int, bits: int) -> np.ndarray:
    """(rows, columns) samples of 1, 2 or 4 bits; rows begin at whole bytes."""
    wide = -(-columns * bits // 8)
    if len(cell) < rows * wide:
        raise TiffError("a strip or tile is too short")
    each = np.unpackbits(np.frombuffer(cell, np.uint8, rows * wide).reshape(rows, wide), axis=1)
    each = each[:, : columns * bits].reshape(rows, columns, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def decode(raw: bytes) -> Iterator[Page]:
    """Pages of a file. Samples of 1, 2 and 4 bits come as bytes; values are as stored, whatever the photometric rule."""
    for number, tags in enumerate(directories(raw)):

        def one(tag: int, default: int = 0, tags: dict = tags) -> int:
            value = tags[tag][0] if tags.get(tag) else default
            if not isinstance(value, int):
                raise TiffError(f"tag {tag} isn't a number")
            return value

        def places(tag: int, tags: dict = tags) -> tuple[int, ...]:
            values = tags.get(tag, ())
            if not all(isinstance(x, int) for x in values):
                raise TiffError(f"tag {tag} isn't a list of numbers")
            return values

        w, h = one(256), one(257)
        if not w or not h:
            raise TiffError("a page has no size")
        bits, samples, comp, pred = one(258, 1), one(277, 1), one(259, 1), one(317, 1)
        if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(258, (bits,)))) != 1:
            raise TiffError(f"{bits} bits a sample aren't taken")
        if bits < 8 and pred != 1:
            raise TiffError("a predictor needs whole bytes")
        form = {1: "u", 2: "i", 3: "f"}.get(one(339, 1), "u")
        if form == "f" and bits <= 8:
            raise TiffError("floats of 8 bits or fewer aren't taken")
        kind = np.dtype("u1") if bits < 8 else np.dtype(f"{tags[0][0]}{form}{bits // 8}")
        tiled = 324 in tags
        th, tw = (one(323), one(322)) if tiled else (min(one(278, h), h), w)
        offs, sizes = (places(324), places(325)) if tiled else (places(273), places(279))
        if not offs or not sizes or not th or not tw:
            raise TiffError("a page has no data")
        if samples < 1:
            raise TiffError("a page has no samples")
        # planar files hold one sample after another, each in strips or tiles of its own
        planes, own = (samples, 1) if one(284, 1) == 2 else (1, samples)
        across, down = -(-w // tw), -(-h // th)
        if len(offs) != len(sizes) or len(offs) < across * down * planes:
            raise TiffError("a page has too few strips or tiles")
        for at, size in zip(offs, sizes, strict=True):
            if at + size > len(raw):
                raise TiffError("a strip or tile lies outside the file")
        # nothing is made room for that the stored bytes can't fill
        if h * w * samples * bits // 8 > sum(sizes) * (1 if comp == NONE else EXPANSION) or across * tw * th * own * bits // 8 > EXPANSION * (sum(sizes) + 1):
            raise TiffError("a page is larger than its data")
        pixels = np.zeros((h, w, samples), kind.newbyteorder("="))
        for k in range(across * down * planes):
            plane, cell_number = divmod(k, across * down)
            y, x = cell_number // across * th, cell_number % across * tw
            rows = th if tiled else min(th, h - y)
            need = rows * (-(-tw * own * bits // 8))
            cell = raw[offs[k] : offs[k] + sizes[k]]
            if one(266, 1) == 2 and bits < 8:
                cell = cell.translate(_MIRRORED)
            if comp == PACKBITS:
                cell = packbits_decode(cell, need)
            elif comp == LZW:
                cell = lzw_decode(cell, need)
            elif comp in (DEFLATE, _OLD_DEFLATE):
                cell = _inflate(cell, need)
            elif comp != NONE:
                raise TiffError(f"compression {comp} isn't taken")
            a = _undo(cell, (rows, tw, own), kind, pred) if bits >= 8 else _unpacked(cell, rows, tw * own, bits).reshape(rows, tw, own)
            pixels[y : y + rows, x : x + tw, plane : plane + own] = a[: min(rows, h - y), : min(tw, w - x)]
        yield Page(number, w, h, bits, samples, comp, pred, "tiles" if tiled else "strips", pixels)


PAGES = "page int, width int, height int, bits int, samples int, compression int, predictor int, layout string, pixels binary, mean double, error string"


def pages(df: DataFrame, *, id_col: str, content_col: str) -> DataFrame:
    """One row per page of the TIFF files in content_col: id, page, sizes, pixels (native order), mean.

    A null or broken file gives the pages before the fault, then one row with
    page null and the fault in ``error``. Other columns are ignored.
    """
    kind = df.select(df[id_col].alias("id")).schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, raw = b.column(0).slice(i, 1), b.column(1)[i].as_py()
                it = decode(raw or b"")
                while True:
                    try:
                        p = next(it)
                        row = [p.page, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.layout, p.pixels.tobytes(), float(p.pixels.mean()), None]
                    except StopIteration:
                        break
                    except TiffError as e:
                        row = [None] * 10 + [str(e)]
                    kinds = [pa.int32()] * 7 + [pa.string(), pa.binary(), pa.float64(), pa.string()]
                    names = ["id", "page", "width", "height", "bits", "samples", "compression", "predictor", "layout", "pixels", "mean", "error"]
                    yield pa.RecordBatch.from_arrays([key, *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], names)
                    if row[-1]:
                        break

    return df.select(df[id_col].alias("id"), df[content_col].cast("binary").alias("content")).mapInArrow(work, f"id {kind}, {PAGES}")


# --- texts as pages -------------------------------------------------------------

#: page width in samples and rows a page holds at most
WIDTH, ROWS = 64, 1024
#: (compression, predictor, tiles); a payload's rows modulo 4 choose
SCHEMES = [(PACKBITS, 1, None), (LZW, 1, None), (DEFLATE, 2, None), (DEFLATE, 1, (64, 64))]


def payload(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(raw: bytes) -> bytes:
    """A payload as a file of grayscale pages; equal payloads give equal files."""
    a = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    comp, pred, tile = SCHEMES[len(a) % len(SCHEMES)]
    return encode([a[i : i + ROWS] for i in range(0, len(a), ROWS)], compression=comp, predictor=pred, tile=tile)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"


def text_pages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 as a TIFF file, read back: one row per document, in no order.

    Null counts as empty; empty texts have one row of 64 zeros. Rows with equal
    ids are kept. Everything is computed from the decoded pages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.chunks(b, "text", 1 << 20):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    media = store(payload(raw))
                    got = list(decode(media))
                    back = b"".join(p.pixels.tobytes() for p in got)
                    a = np.frombuffer(back, np.uint8)
                    count = np.bincount(a, minlength=256)
                    share = count[count > 0] / len(a)
                    feature = f"pages={len(got)};mean={a.mean():.4f};std={a.std():.4f};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f};mode={int(count.argmax())}"
                    rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(got)))
                names = [x.split()[0] for x in STORED.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, STORED)


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file and read back: lengths, digests, and a feature of the pixels."""
    return text_pages(common.read_docs(spark, sf_dir))
