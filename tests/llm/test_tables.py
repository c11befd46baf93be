"""Shards, secrets, line dedup."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spinweave.llm import linededup, secrets, sharding

from .helpers import empty_docs, odd_docs, odd_rows


def test_shards_against_splitting_one_by_one(spark):
    for limit in (1, 500, 3000, 10**9):
        got = sharding.shards(odd_docs(spark), limit_bytes=limit).collect()
        keys = [(i, len((t or "").encode()), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16)) for i, t in odd_rows()]
        want = []
        todo = [(0, 0, keys)]
        while todo:
            depth, bucket, own = todo.pop()
            if not own:
                continue
            if sum(k[1] for k in own) <= limit or len(own) == 1 or depth == sharding.BITS:
                want += [(*k, depth, bucket, sum(x[1] for x in own), len(own)) for k in own]
                continue
            for bit in (0, 1):
                todo.append((depth + 1, bucket * 2 + bit, [k for k in own if k[2] >> (sharding.BITS - depth - 1) & 1 == bit]))
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["hash_bits"], r["depth"], r["bucket"], r["bucket_bytes"], r["bucket_docs"])) for r in got)
        size = defaultdict(list)
        for r in got:
            size[r["depth"], r["bucket"], r["page"]].append(r["n_bytes"])
        assert all(sum(v) <= limit or len(v) == 1 for v in size.values())
    assert sharding.shards(empty_docs(spark), limit_bytes=5).count() == 0


def test_repeated_rows_fill_pages(spark):
    docs = spark.createDataFrame([(7, "abcd")] * 50 + [(8, "x" * 30)], "doc_id long, text string").repartition(3)
    got = sharding.shards(docs, limit_bytes=20).collect()
    size = Counter()
    for r in got:
        size[r["depth"], r["bucket"], r["page"]] += r["n_bytes"]
    assert len(got) == 51 and all(v <= 20 for k, v in size.items() if k[2] != "0")
    again = sharding.shards(docs.repartition(7), limit_bytes=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(size) == 11


PATTERNS = [("assign", re.compile(secrets.ASSIGN)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def brute_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, kind, m.end(), value))
    return sorted(out)


def test_secrets_against_brute_force(spark):
    got = secrets.scan(odd_docs(spark)).collect()
    owners = defaultdict(set)
    for i, t in odd_rows():
        for s in brute_spans(t):
            owners[s[4]].add(f"src{(i or 0) % 4}")
    want = []
    for i, t in odd_rows():
        s = brute_spans(t)
        text = ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in s)
        c = Counter(x[2] for x in s)
        want.append((i, c["assign"], c["access"], c["hex"], hashlib.sha256(text.encode()).hexdigest(), sum(len(owners[x[4]]) >= 3 for x in s), max([len(owners[x[4]]) for x in s], default=0)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["n_copied"], r["most_owners"])) for r in got)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "copied" in spans[50] and "live" in spans[40] and spans[43].startswith("assign:2:")
    assert [r["n_assign"] for r in got if r["doc_id"] == 41] == [1]
    assert secrets.scan(empty_docs(spark)).count() == 0


def test_one_repository_of_two_owners_counts_once(spark):
    rows = [(i, "token = ab12CD34ef56GH78", o, r) for i, (o, r) in enumerate([("o1", "r"), ("o2", "r"), ("o2", "q")])]
    rows += [(10 + i, "token = zz12CD34ef56GH99", "o3", f"r{i}") for i in range(8)] + [(20, "token = yy12CD34ef56GH99", "o3", "r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o string, r string")
    got = {x["doc_id"]: x for x in secrets.scan(docs, owner=F.col("o"), repository=F.col("r")).collect()}
    assert (got[0]["most_owners"], got[0]["most_repositories"]) == (2, 2)
    assert (got[10]["most_owners"], got[10]["most_repositories"]) == (1, 8)
    assert [got[i]["spans"].split(",")[1].split(":")[0] for i in (0, 10, 20)] == ["unclear", "copied", "live"]


def test_many_secrets_in_one_text(spark):
    """Places of 50,000 matches, in time that grows with them."""
    text = " ".join(f"é{k} {k:032x}" for k in range(50_000))
    got = secrets.scan(spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")).first()
    want = ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in brute_spans(text))
    assert got["n_hex"] == 50_000 and got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(linededup.BLANKS))
    holders = defaultdict(set)
    none = -(1 << 63)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(none if i is None else i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and (none if i is None else i) != max(holders[key(x)]))]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    rows = odd_rows() + [(70, "\n".join(["A line that repeats inside one document and also elsewhere.", "short", ""] * 90)), (71, "é" * 39), (72, "A line that repeats inside one document and also elsewhere.")]
    rows += [(80 + i, "A LINE that repeats inside one document and also elsewhere.É") for i in range(5)] + [(None, "A line that repeats inside one document and also elsewhere.")] * 2 + [(90 + i, "a line that REPEATS inside one document and also elsewhere. ") for i in range(3)]
    names = ["pos", "_doc", "_hash", "_n", "_words", "_dense", "row", "kept"]
    docs = spark.createDataFrame([(i, t, "a", *range(8)) for i, t in rows], "doc_id long, text string, words string, " + ", ".join(f"{x} int" for x in names)).repartition(3)
    want = brute_lines(rows)
    got = linededup.report(docs).collect()
    assert sorted(map(str, ((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want))) == sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in got)
    back = linededup.dedup(docs)
    assert back.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in back.collect()) == sorted(str((i, t)) for i, _, _, t in want)
    assert back.where("pos != 0 or _n != 3 or kept != 7").count() == 0
    assert linededup.report(empty_docs(spark)).count() == 0 and linededup.dedup(odd_docs(spark)).columns == odd_docs(spark).columns


def test_line_bitmaps_and_hot_lines(spark, monkeypatch):
    """Bitmaps give the kept lines back; a line that most documents hold is dealt out in parts."""
    hot = "This line stands in nearly every one of all the documents."
    rows = [(i, "\n".join([f"a line of its own, as long as it must be: {i}"] + [hot] * (i % 3) + [f"shared by the documents of a group: number {i // 9}"] + ["x"] * (i % 70))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: (n, d, t) for i, n, d, t in brute_lines(rows)}
    for salts in (1, 7, 256):
        monkeypatch.setattr(linededup, "SALTS", salts)
        for r in linededup.report(docs).collect():
            lines = dict(rows)[r["doc_id"]].split("\n")
            words = {int(a): int(b) for a, b in (x.split(":") for x in r["keep_bitmap"].split(",") if x)}
            kept = [x for k, x in enumerate(lines) if words.get(k // 32, -1) >> k % 32 & 1]
            assert (r["n_lines"], r["n_dropped"], "\n".join(kept)) == want[r["doc_id"]]
            assert all(b < 2 ** min(32, len(lines) - 32 * a) - 1 for a, b in words.items())
