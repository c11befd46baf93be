"""Token files and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spinweave.llm import bpe, common, packing, tokenbin

from .helpers import empty_docs, odd_docs, odd_rows

TK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TK.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library():
    rng = random.Random(9)
    alphabet = "abs'tredlvm  \n\t!.,1279é ß 　中漢²½'\r\x1c\x85😀İ​́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", "'s", " 's", "'re're", "x<|endoftext|>y", "  ", "\n\n a"]
    enc = bpe.Encoder(max_pieces=500)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        ids, at = enc.encode(part)
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == TK.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_come_back(spark):
    docs = odd_docs(spark)
    path = common.shared_path(spark, "test-tokens")
    tokenbin.write(docs, path, block_tokens=300)
    got = tokenbin.read(spark, path, with_ids=True).orderBy("start").collect()
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(str((i, ids_of(t))) for i, t in odd_rows())
    at, last = 0, None
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert last is None or (r["doc_id"] is not None and r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]
    assert len({r["dict_hash"] for r in got}) == 1
    assert tokenbin.lookup(spark, path, 12) == [ids_of("a b c")] and len(tokenbin.lookup(spark, path, 2)) == 2 and tokenbin.lookup(spark, path, 999) == []


def test_no_documents_no_tokens(spark):
    path = common.shared_path(spark, "test-empty")
    tokenbin.write(empty_docs(spark), path)
    assert tokenbin.read(spark, path).count() == 0
    assert packing.pack(empty_docs(spark)).count() == 0


def test_piece_lengths_cover():
    for n in range(0, 3000, 7):
        p = packing.piece_lengths(n, 1024, 32)
        assert sum(p) == n and all(x > 0 for x in p)


def test_packing_covers_every_id_once(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(1000 + i, "word " * (i % 90)) for i in range(400)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs.coalesce(2), with_ids=True).collect()
    sequences = defaultdict(list)
    parts = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    padded = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded < 0.05 * sum(r["length"] for r in got)
    want = defaultdict(list)
    for i, t in rows:
        want[i, len(ids_of(t))] += [(k, x) for k, x in enumerate(ids_of(t))]
    for k, v in parts.items():
        assert sorted((s + j, x) for s, ids in v for j, x in enumerate(ids)) == sorted(want[k])
    assert len(parts) == len(want)


def test_pieces_of_equal_hashes(monkeypatch):
    """Ids don't depend on the pieces' hashes."""
    plain = bpe.tx.span_hashes
    monkeypatch.setattr(bpe.tx, "span_hashes", lambda *a: plain(*a) & np.uint64(31))
    texts = ["some words and some more, of many kinds 12 345", "and other words: a b c d e f g", ""]
    ids, at = bpe.Encoder().encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == TK.encode(t, add_special_tokens=False).ids


def test_classes_of_other_capacities(spark):
    """With room for 256 and pieces from 64, lengths of one class share sequences and leave no gap between them."""
    docs = spark.createDataFrame([(i, "word " * (i % 71)) for i in range(500)], "doc_id long, text string").repartition(2)
    got = defaultdict(list)
    for r in packing.pack(docs, capacity=256, smallest=64).collect():
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in got.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert any(len({256 // n for _, n in p}) == 1 and len({n for _, n in p}) > 1 for p in got.values())
