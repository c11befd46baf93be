import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest

from spinweave.llm import licenses, tiff

from .helpers import empty_docs, odd_docs, odd_rows, words


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (64, 64), (32, 48)])
def test_pages_come_back(compression, predictor, tile):
    rng = random.Random(3)
    for n in (64, 640, 9600):
        for raw in (os.urandom(n), bytes(rng.choice(b"ab") for _ in range(n)), b"x" * n):
            a = np.frombuffer(raw, np.uint8).reshape(-1, 64)
            got = list(tiff.decode(tiff.encode([a[:1], a], compression=compression, predictor=predictor, tile=tile)))
            assert [p.page for p in got] == [0, 1]
            assert (got[1].pixels[:, :, 0] == a).all() and (got[0].pixels[:, :, 0] == a[:1]).all()


def test_lzw_and_packbits_of_any_length():
    for n in [*range(20), 4000, 70000]:
        for raw in (os.urandom(n), b"ab" * (n // 2), b"x" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw))[: len(raw)] == raw
            assert tiff.packbits_decode(tiff.packbits_encode(raw), len(raw)) == raw


def test_known_lzw_code_stream():
    # clear, 7, 258, 8, 8, 258, 6, 6, end: the example of the TIFF 6.0 specification, section 13
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_big_endian_16_bit_with_predictor():
    rows = np.array([[1, 5, 65535, 3], [9, 9, 9, 0]], np.uint16)
    diff = rows.copy()
    diff[:, 1:] -= rows[:, :-1]
    data = diff.astype(">u2").tobytes()
    tags = [(256, 3, 1, 4 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 16), (317, 3, 1, 2 << 16)]
    raw = b"MM\0*" + struct.pack(">I", 24) + data + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = tiff.decode(raw)
    assert (page.pixels[:, :, 0] == rows).all() and page.bits == 16


def test_broken_files_give_an_error_row(spark):
    good = tiff.encode([np.zeros((3, 64), np.uint8), np.ones((2, 64), np.uint8)])
    loop = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    rows = [("good", good), ("null", None), ("empty", b""), ("text", b"hello"), ("loop", bytes(loop)), ("cut", good[: len(good) - 30])]
    got = tiff.pages(spark.createDataFrame([(a, b, 1) for a, b in rows], "name string, content binary, page int"), id_col="name", content_col="content").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert [r["mean"] for r in by["good"]] == [0.0, 1.0] and by["good"][1]["height"] == 2
    assert all(by[k][-1]["error"] and by[k][-1]["page"] is None for k in ("null", "empty", "text", "loop", "cut"))


def plain_file(tags, data, order="<", big=False):
    """A file of one page: its data first, then its directory; tags: {tag: (kind, values)}."""
    code = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
    place, room = ("Q", 8) if big else ("I", 4)
    start = 16 if big else 8
    out, later = b"", data
    entries = []
    for tag, (kind, values) in sorted(tags.items()):
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{code[kind]}", *values)
        if len(raw) > room:
            entries.append((tag, kind, len(values), struct.pack(f"{order}{place}", start + len(later))))
            later += raw
        else:
            entries.append((tag, kind, len(values), raw.ljust(room, b"\0")))
    for tag, kind, count, value in entries:
        out += struct.pack(f"{order}HH{place}", tag, kind, count) + value
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42)
    head += struct.pack(f"{order}HHQ", 8, 0, start + len(later)) if big else struct.pack(f"{order}I", start + len(later))
    return head + later + struct.pack(f"{order}{'Q' if big else 'H'}", len(entries)) + out + bytes(room)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(order, big, bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << bits, (11, 37), dtype=np.uint8)
    rows = ["".join(f"{x:0{bits}b}" for x in r) for r in a.tolist()]
    raw = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
    start = 16 if big else 8
    for comp, fill in ((1, 1), (32773, 1), (1, 2), (8, 1), (5, 1)):
        data = raw if comp == 1 else tiff._compress(raw, comp)
        if fill == 2:
            data = bytes(int(f"{x:08b}"[::-1], 2) for x in data)
        tags = {256: (4, [37]), 257: (4, [11]), 258: (3, [bits]), 259: (3, [comp]), 266: (3, [fill]), 273: (4, [start]), 278: (4, [11]), 279: (4, [len(data)])}
        (page,) = tiff.decode(plain_file(tags, data, order, big))
        assert (page.pixels[:, :, 0] == a).all() and page.bits == bits


def test_planar_samples():
    a = np.random.default_rng(1).integers(0, 256, (9, 20, 3), dtype=np.uint8)
    parts = [zlib.compress(a[i : i + 4, :, s].tobytes()) for s in range(3) for i in (0, 4, 8)]
    at = [8 + sum(map(len, parts[:k])) for k in range(9)]
    tags = {256: (3, [20]), 257: (3, [9]), 258: (3, [8] * 3), 259: (3, [8]), 273: (4, at), 277: (3, [3]), 278: (3, [4]), 279: (4, [len(x) for x in parts]), 284: (3, [2])}
    (page,) = tiff.decode(plain_file(tags, b"".join(parts)))
    assert (page.pixels == a).all()


def test_malformed_pages_are_errors():
    data = bytes(64)
    good = {256: (4, [8]), 257: (4, [8]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8]), 279: (4, [64])}
    assert len(list(tiff.decode(plain_file(good, data)))) == 1
    bad = [{256: (2, b"8")}, {257: (4, [0])}, {256: (4, [2**31]), 257: (4, [2**20])}, {273: (2, b"abcdefgh")}, {279: (4, [65_000])}, {277: (3, [60000])}, {259: (3, [8])}, {258: (3, [3])}, {258: (3, [1]), 317: (3, [2])}, {259: (3, [99])}]
    bad += [{259: (3, [5]), 256: (4, [2**20]), 257: (4, [2**20])}, {322: (4, [2**30]), 323: (4, [2**30]), 324: (4, [8]), 325: (4, [64])}]
    for change in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.decode(plain_file(good | change, data)))
    rng = random.Random(6)
    whole = tiff.encode([np.zeros((30, 64), np.uint8)], compression=tiff.LZW)
    for _ in range(400):
        raw = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            list(tiff.decode(bytes(raw)))
        except tiff.TiffError:
            pass


def test_text_pages_against_the_payload(spark):
    got = sorted(map(tuple, tiff.text_pages(odd_docs(spark)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=str)
    want = []
    for i, t in odd_rows():
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=str)
    features = {r["doc_id"]: r["feature"] for r in tiff.text_pages(odd_docs(spark)).collect() if r["doc_id"] is not None}
    for i, t in odd_rows():
        if i is None:
            continue
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        mean = sum(p) / len(p)
        share = [p.count(x) / len(p) for x in set(p)]
        mode = max(sorted(set(p)), key=p.count)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
        entropy = abs(sum(x * math.log2(x) for x in share))
        assert features[i] == f"pages={-(-len(p) // 65536)};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};mode={mode}"
    by_text = {}
    for r in tiff.text_pages(odd_docs(spark)).collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert tiff.text_pages(empty_docs(spark)).count() == 0


def brute_base(text):
    w = words(text)
    places = []
    for label, phrase in licenses.BASE.items():
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_license_phrases_against_brute_force(spark):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(odd_docs(spark)).collect()}
    assert got == {(i, *brute_base(t)) for i, t in odd_rows()}
    assert licenses.scan(empty_docs(spark)).count() == 0


def all_texts(items):
    """Every word sequence that items accept, regions of any words by the word "any"."""
    out = [()]
    for x in items:
        if isinstance(x, bytes):
            ends = [(x,)]
        elif x[0] == "optional":
            ends = [(), *all_texts(x[1])]
        elif x[0] == "any":
            ends = [(b"any",) * k for k in range(x[1], x[2] + 1)]
        else:
            ends = [tuple(w) for w in x[1]]
        out = [a + b for a in out for b in ends]
    return out


def test_automata_accept_exactly_the_template_language():
    rng = random.Random(1)
    for template in ['<<beginOptional>>the <<beginOptional>>old<<endOptional>><<endOptional>> mit <<var;match=".{1,3}">> end', 'a <<var;match="b c|d">> <<beginOptional>>e<<endOptional>> f', 'x <<var;match=".{0,2}">> x']:
        a = licenses.Automaton(template)
        language = set(all_texts(a.items))
        for t in language:
            assert a.match_at(list(t), 0) == len(t) or any(len(u) > len(t) for u in language)
        vocabulary = sorted(a.vocabulary | {b"any"})
        for _ in range(3000):
            t = [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
            # other words stand in a replaceable region as "any" does
            ends = [k for k in range(len(t) + 1) if any(len(u) == k and all(v == w or v == b"any" for v, w in zip(u, t[:k], strict=True)) for u in language)]
            assert a.match_at(t, 0) == (max(ends) if ends else None)


def test_unbounded_regions_take_any_number_of_words():
    for rule, least in ((".+", 1), (".*", 0)):
        a = licenses.Automaton(f'x y <<var;match="{rule}">> z')
        for n in (0, 1, 2, 40, 41, 500):
            t = [b"x", b"y", *[b"w"] * n, b"z"]
            assert a.match_at(t, 0) == (len(t) if n >= least else None)


def test_templates_label_and_bad_markup_raises(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(odd_docs(spark)).where("doc_id >= 60").collect()}
    assert rows[60]["exact_labels"] == "mit-notice" and rows[60]["score"] == 1.0
    assert rows[61]["labels"] == "apache-2,apache-2.0-notice" and 0 < rows[61]["score"] < 1
    assert "cc-by-nc-notice" in rows[62]["labels"].split(",") and rows[62]["n_base"] == 3
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_markup_that_is_not_understood():
    assert licenses.parse('<<var;name="c";original="<y> z";match="a b|c">> d') == [("one", [[b"a", b"b"], [b"c"]]), b"d"]
    for bad in ('<<var;match="[^.]+">>', "<<var;match=\"a|\">> x", "<<unknown>> a", "a >> b", '<<var;match=".{3,1}">>', "<<beginOptional>> a", "a <<endOptional>>", '<<var;match="a(b)?">>'):
        with pytest.raises(ValueError):
            licenses.parse(bad)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_whole_texts(spark):
    """A text with all of the mandatory wording has the label; one with another condition, or two clauses for three, hasn't."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    fill = lambda t: t.replace('<<var;match=".{1,12}">>', "THE COPYRIGHT HOLDERS").replace("<<beginOptional>>", "").replace("<<endOptional>>", ". ")
    two, three = fill(licenses._BSD.format(third="")), fill(licenses._BSD.format(third=third))
    rows = [(1, MIT), (2, MIT.replace("sell\ncopies", "give away\ncopies")), (3, MIT[: MIT.index("THE SOFTWARE IS")]), (4, two), (5, three), (6, three.replace("endorse", "praise"))]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {"mit-text"}, 2: set(), 3: set(), 4: {"bsd-2-text"}, 5: {"bsd-3-text"}, 6: set()}
