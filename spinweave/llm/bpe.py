"""Exact byte-level BPE ids at low cost: the tokenizers library encodes each
distinct pre-token once, and numpy places the ids.

The pre-token rule of byte-level BPE cuts a text into pieces that are encoded
independently, so encoding distinct pieces and joining their ids equals
encoding the text. Pieces are told apart by their code points; hashes only find
equal ones. Texts with a special token's string, or with a code point whose
class differs between Unicode versions, are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import repeat

import numpy as np

from . import text as tx

_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _UNSURE = range(6)
_TABLE_SIZE = 0x30000
#: bytes of text encoded at once, or one text: more share the lookups of distinct pieces, fewer need less memory
CHUNK = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself, or the next code point from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(moved)}


def _classes() -> np.ndarray:
    old = unicodedata.ucd_3_2_0.category
    new = unicodedata.category
    out = np.full(_TABLE_SIZE, _UNSURE, np.uint8)
    for cp in range(_TABLE_SIZE):
        c = chr(cp)
        a, b = old(c)[0], new(c)[0]
        if a == b and a != "C" or cp < 128:
            out[cp] = _LETTER if b == "L" else _NUMBER if b == "N" else _OTHER
        if c.isspace():
            out[cp] = _BLANK if cp in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 0x2000 <= cp <= 0x200A else _OTHER if 0x1C <= cp <= 0x1F else _UNSURE
    out[32] = _SPACE
    return out


class Encoder:
    """encode(texts) -> (ids, offsets). Its cache of pieces is bounded by max_pieces."""

    def __init__(self, path: str | None = None, max_pieces: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path or default_path())
        self.specials = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.table = _classes()
        self.visible = _visible()
        self.max_pieces = max_pieces
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _add(self, pieces: list[str]) -> None:
        one = self.tk.model.tokenize
        each = [[t.id for t in one(x.replace(" ", "\u0120") if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.visible))] for x in pieces]
        ids = np.array([i for x in each for i in x], np.uint32)
        count = np.array([len(x) for x in each], np.int64)
        at = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(pieces) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[at : at + len(pieces)] = self.used + np.cumsum(count) - count
        self.count[at : at + len(pieces)] = count
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def _distinct(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct pieces, and each piece's number among them."""
        _, where, inverse = np.unique(tx.span_hashes(cp, s, e), return_index=True, return_inverse=True)
        size, model = e - s, where[inverse]
        if (size == size[model]).all():
            # pieces follow one another without gaps: every code point against that of its piece's model
            back = np.repeat(s[model] - s, size) + np.arange(len(cp))
            if (cp[back] == cp).all():
                return where, inverse
        order: dict[bytes, int] = {}
        numbers = np.array([order.setdefault(cp[a:b].tobytes(), len(order)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        return np.unique(numbers, return_index=True)[1], numbers

    def _spans(self, cp: np.ndarray, cls: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(cp)
        blank = cls <= _BLANK
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first = edge[:n]
        change = np.ones(n, bool)
        change[1:] = cls[1:] != cls[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        after_space = np.zeros(n, bool)
        after_space[1:] = cls[:-1] == _SPACE
        last = edge[1:]
        before_word = np.zeros(n, bool)
        before_word[:-1] = ~blank[1:]
        before_word &= ~last
        start = np.where(blank, first | ~after_blank | before_word, first | (change & ~after_space))
        quote = np.flatnonzero((cp == 39) & start)
        if len(quote):
            end = offs[np.searchsorted(offs, quote, "right")]
            ext = np.concatenate([cp, np.zeros(3, cp.dtype)])
            a, b = ext[quote + 1], ext[quote + 2]
            one = (quote + 1 < end) & np.isin(a, [ord(c) for c in "stmd"])
            two = (quote + 2 < end) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for hit, size in ((one, 2), (two & ~one, 3)):
                q = quote[hit]
                for j in range(1, size):
                    start[q + j] = False
                q = q[q + size < end[hit]]
                start[q + size] = True
        s = np.flatnonzero(start)
        return s, np.append(s[1:], n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another (uint32), and each text's range (n + 1 offsets)."""
        lens = np.array([len(t) for t in texts], np.int64)
        offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = np.where(cp < _TABLE_SIZE, self.table[np.minimum(cp, _TABLE_SIZE - 1)], np.uint8(_UNSURE))
        odd = {int(i) for i in np.unique(np.searchsorted(offs, np.flatnonzero(cls == _UNSURE), "right") - 1)}
        for special in self.specials:
            if special in joined:
                odd |= {i for i, t in enumerate(texts) if special in t}
        if odd:
            even = [i for i in range(len(texts)) if i not in odd]
            ids, at = self.encode([texts[i] for i in even])
            parts: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
            for k, i in enumerate(even):
                parts[i] = ids[at[k] : at[k + 1]]
            for i in odd:
                parts[i] = np.array(self.tk.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        s, e = self._spans(cp, cls, offs)
        where, inverse = self._distinct(cp, s, e)
        pieces = [joined[a:b] for a, b in zip(s[where].tolist(), e[where].tolist(), strict=True)]
        own = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero(own < 0)
        if len(new):
            if len(self.known) + len(new) > self.max_pieces:
                self._reset()
                new = np.arange(len(pieces))
            own[new] = len(self.known) + np.arange(len(new))
            self._add([pieces[k] for k in new.tolist()])
        own = own[inverse]
        first, count = self.first[own], self.count[own]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        piece = np.searchsorted(s, offs)
        return ids, np.concatenate([[0], ends])[piece]


_shared: dict[str, Encoder] = {}


def shared(path: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    key = path or default_path()
    if key not in _shared:
        _shared[key] = Encoder(key)
    return _shared[key]
