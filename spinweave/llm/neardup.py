"""Near-duplicate documents by ProbMinHash.

A text is a set of five-word shingles weighted by their counts. Each shingle
sends arrivals of a Poisson process, at a rate of its weight, to random
registers; a register keeps the shingle of its first arrival. A shingle stops
as soon as its next arrival is later than all registers (early termination),
so a long text costs about one arrival per shingle. Two texts agree in a
register with the probability of their probability Jaccard similarity

    J_P = sum over common x of 1 / sum over y of max(p(y)/p(x), q(y)/q(x)),

which is the plain Jaccard similarity if all weights are equal.

Equal texts are first made one node. Nodes that share a band's registers meet,
and every link is verified exactly. Three steps find what joins:

1. the pairs of a maximum spanning tree of each band's group by estimated
   similarity (and the best two of each node where an estimate is near the
   threshold), in groups over ``GROUP`` nodes part by part and then among one
   node (the most central) of every part found connected;
2. in those large groups, each node that is still apart and the group's most
   central node;
3. all other pairs of a group that no verified link joins and whose estimate
   reaches ``threshold - SLACK``, by pairs of blocks. A block's task gets each
   text once, not once a pair: a matrix product of shingle weights bounds J_P
   from above (it is J_P where all weights are equal), and pairs whose bound
   reaches the threshold are verified as long as they would join two parts.

With 20 bands of 5 registers a pair at 0.8 meets with probability 0.9997.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import text as tx

U64 = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: nodes of one band's group that one task compares at once by their codes
GROUP = 512
#: bytes of text in a block whose pairs one task verifies
BLOCK_BYTES = 2 << 20
#: entries of a matrix of shingle weights
MATRIX = 1 << 22
#: estimates this far below the threshold are still verified (about four standard errors)
SLACK = 0.16


def weighted(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text index, count) of each text's distinct shingles, by text."""
    _, _, h, at = tx.words(data, offs)
    s, doc = tx.shingles(h, at, k)
    if not len(s):
        return s, doc, np.zeros(0)
    tag = tx.mix(s ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15)))
    _, first, count = np.unique(tag, return_index=True, return_counts=True)
    order = np.argsort(doc[first], kind="stable")
    return s[first][order], doc[first][order], count[order].astype(np.float64)


def signatures(elem: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) registers: the shingle of the first arrival; 0 for texts without shingles."""
    first = np.full(n * m, np.inf)
    out = np.zeros(n * m, U64)
    t, state = np.zeros(len(elem)), elem
    while len(elem):
        state = tx.mix(state + U64(0x632BE59BD9B4E019))
        t = t - np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * m + ((tx.mix(state ^ U64(0xA0761D6478BD642F)) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        hit = np.flatnonzero(t < first[slot])
        # the earliest is written last; of equal times the largest shingle, so that the order of input doesn't matter
        hit = hit[np.lexsort((elem[hit], -t[hit]))]
        first[slot[hit]] = t[hit]
        out[slot[hit]] = elem[hit]
        live = t < first.reshape(n, m).max(1)[doc]
        elem, doc, weight, t, state = elem[live], doc[live], weight[live], t[live], state[live]
    return out.reshape(n, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys, each of ROWS registers and its band's number."""
    out = np.zeros((len(sig), BANDS), U64)
    part = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        out = tx.mix(out ^ part[:, :, r])
    return tx.mix(out + np.arange(1, BANDS + 1, dtype=U64)).view(np.int64)


def similarity(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> float:
    """Exact J_P of two weighted sets of distinct elements."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    p0, q0 = p[ia], q[ib]
    only_p, only_q = p.sum() - p0.sum(), q.sum() - q0.sum()
    # common elements by q/p: those above x count q(y)/q(x), the others p(y)/p(x)
    order = np.argsort(q0 / p0, kind="stable")
    p0, q0 = p0[order], q0[order]
    ratio = q0 / p0
    below = np.cumsum(p0)
    above = q0.sum() - np.cumsum(q0)
    last = np.searchsorted(ratio, ratio, "right") - 1
    return float((1.0 / ((below[last] + only_p) / p0 + (above[last] + only_q) / q0)).sum())


def digest(text: Column) -> Column:
    """A text's node: 16 bytes of its sha256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


SKETCH = "doc_id long, node binary, codes binary, bands array<long>, size long"


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, a byte of each register, band keys (null for texts without a word), bytes of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.chunks(b, "text"):
                data, offs = tx.buffers(part.column(1))
                n = part.num_rows
                e, d, w = weighted(data, offs)
                sig = signatures(e, d, w, n)
                key = bands(sig)
                some = np.bincount(d, minlength=n) > 0
                codes = (sig >> U64(56)).astype(np.uint8)
                raw = data.tobytes()
                nodes = [hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest()[:16] for i in range(n)]
                ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel()), mask=pa.array(~some))
                held = pa.array([codes[i].tobytes() if some[i] else None for i in range(n)], pa.binary())
                columns = [part.column(0), pa.array(nodes, pa.binary()), held, lists, pa.array(np.diff(offs))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "codes", "bands", "size"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, SKETCH)


def _tree(codes: np.ndarray, least: float, sure: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Candidate pairs of a group, and the most central member of each connected part."""
    n = len(codes)
    if n == 1:
        return [], [0]
    same = np.zeros((n, n), np.int16)
    for i in range(n):
        same[i] = (codes[i] == codes).sum(1)
    # a byte of a register agrees by chance once in 256
    est = (same / codes.shape[1] - 1 / 256) * (256 / 255)
    np.fill_diagonal(est, -1.0)
    i, j = np.nonzero(np.triu(est >= least, 1))
    order = np.argsort(-est[i, j], kind="stable")
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs, left = [], n - 1
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if not left:
            break
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            pairs.append((x, y))
            left -= 1
    known = set(pairs)
    if n > 2:
        for x, best in enumerate(np.argpartition(-est, 1, axis=1)[:, :2].tolist()):
            for y in best:
                if least <= est[x, y] < sure and (min(x, y), max(x, y)) not in known:
                    known.add((min(x, y), max(x, y)))
    parts: dict[int, list[int]] = {}
    for x in range(n):
        parts.setdefault(find(x), []).append(x)
    central = est.sum(1)
    largest_first = sorted(parts.values(), key=len, reverse=True)
    return list(known), [max(members, key=lambda x: (central[x], -x)) for members in largest_first]


MEET = "key long, a binary, b binary"


def _meet(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(key, salt, node, codes, level): candidate pairs (null, a, b); heads (key, a, null) of groups that go on
    (level 1), one hub (key, a, a) of those that went on and end (level 2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, out = None, []

        def flush() -> None:
            for at in range(0, len(held), GROUP):
                part = held[at : at + GROUP]
                if len(part) == 2 and part[0][3] != 1:
                    x, y = (np.frombuffer(p[2], np.uint8) for p in part)
                    if (x == y).mean() >= threshold - SLACK:
                        out.append((None, part[0][1], part[1][1]))
                    if part[0][3]:
                        out.append((part[0][0], part[0][1], part[0][1]))
                    continue
                pairs, heads = _tree(np.array([np.frombuffer(p[2], np.uint8) for p in part]), threshold - SLACK, threshold + SLACK)
                out.extend((None, min(part[x][1], part[y][1]), max(part[x][1], part[y][1])) for x, y in pairs)
                if part[0][3] == 1:
                    out.extend((part[x][0], part[x][1], None) for x in heads)
                elif part[0][3] == 2:
                    out.append((part[heads[0]][0], part[heads[0]][1], part[heads[0]][1]))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "a", "b"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for key, salt, node, codes, level in zip(*cols, strict=True):
                if (key, salt) != now or len(held) >= 8 * GROUP:
                    flush()
                    now = (key, salt)
                held.append((key, node, codes, level))
            if len(out) > 10000:
                yield batch()
        flush()
        if out:
            yield batch()

    # one row per pair of a group of two comes in the order of nodes, so a < b
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").select("key", "salt", "node", "codes", "level").mapInArrow(work, MEET)


def groups_of(nodes: DataFrame) -> DataFrame:
    """(key, node, size, n): members of the bands' groups of two nodes or more; what comes after reads these alone."""
    rows = nodes.where(F.col("bands").isNotNull()).select("node", "size", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return common.saved(rows.join(several, "key").select("key", "node", "size", "n"))


def candidates(nodes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """nodes(node, codes) and their groups -> distinct candidate pairs (a, b), a < b, and (key, hub) of groups over GROUP nodes."""
    rows = groups.select("key", "node", "n")
    found = hubs = before = None
    while True:
        multi = rows.join(nodes.select("node", "codes"), "node")
        salt = F.when(F.col("n") > GROUP, F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / GROUP))).otherwise(0)
        level = F.when(F.col("n") > GROUP, 1).otherwise(0 if before is None else 2)
        met = common.saved(_meet(multi.select("key", "node", "codes", salt.cast("long").alias("salt"), level.alias("level")), threshold))
        pairs = met.where(F.col("key").isNull()).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        ended = met.where(F.col("a") == F.col("b")).select("key", F.col("a").alias("hub"))
        hubs = ended if hubs is None else hubs.unionByName(ended)
        heads = met.where(F.col("b").isNull()).select(F.col("a").alias("node"), "key")
        left = heads.count()
        # goes on only while groups shrink: later steps compare what is left
        if left == 0 or (before is not None and left > 0.95 * before):
            break
        before = left
        rows = heads.join(heads.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    return found.distinct(), hubs.unionByName(heads.groupBy("key").agg(F.min("node").alias("hub")))


def _involved(key: int, codes: np.ndarray, bands: np.ndarray, roots: list[bytes], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Members with a partner on the other side that has another root, an estimate of least or more and no earlier band in common."""
    _, root = np.unique(np.array(roots, object), return_inverse=True)
    need = least * 255 / 256 + 1 / 256
    out = np.zeros(len(roots), bool)
    for x in left:
        y = right[right > x] if left is right else right
        y = y[root[y] != root[x]]
        y = y[(codes[x] == codes[y]).sum(1) >= need * codes.shape[1]]
        if len(y):
            first = (bands[x] == bands[y]).argmax(1)
            y = y[bands[x, first] == key]
            out[y] = True
            out[x] |= len(y) > 0
    return out


MET = "key long, p long, q long, side long, node binary, root binary"


def _blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(key, p, q, side, node, root, codes, bands): those that a partner in their block pair makes candidates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, held in tx.runs(batches, 3):
            side, nodes, roots, codes, bands = zip(*held, strict=True)
            side = np.array(side)
            left, right = np.flatnonzero(side == now[1]), np.flatnonzero(side == now[2])
            if len(held) < 2 or not len(left) or not len(right):
                continue
            codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(nodes), -1)
            some = np.flatnonzero(_involved(now[0], codes, np.array(bands, np.int64), roots, left, left if now[1] == now[2] else right, threshold - SLACK))
            if len(some):
                columns = [pa.array([x] * len(some), pa.int64()) for x in now]
                columns += [pa.array(side[some]), pa.array([nodes[i] for i in some], pa.binary()), pa.array([roots[i] for i in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MET.split(", ")])

    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return dealt.select("key", "p", "q", "side", "node", "root", "codes", "bands").mapInArrow(work, MET)


def bounds(elem: np.ndarray, member: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, n) upper bounds of J_P; equal to it where all of two members' weights are equal.

    With c the share of a member's weight on common shingles and d that of the
    other's, J_P <= 1 / (1/c + 1/d - 1), since each term of J_P is at most a
    concave function, homogeneous of degree 1, of the two weights.
    """
    _, place, count = np.unique(elem, return_inverse=True, return_counts=True)
    total = np.bincount(member, weights=weight, minlength=n)
    several = np.flatnonzero(count > 1)
    column = np.full(len(count), -1)
    column[several] = np.arange(len(several))
    at = column[place]
    order = np.argsort(at, kind="stable")
    order = order[at[order] >= 0]
    at, member, share = at[order], member[order], (weight / np.maximum(total, 1e-300)[member])[order]
    held = np.zeros((n, n), np.float32)
    step = max(1, MATRIX // n)
    for first in range(0, len(several), step):
        a, b = np.searchsorted(at, (first, first + step))
        here = np.zeros((n, min(step, len(several) - first)), np.float32)
        here[member[a:b], at[a:b] - first] = share[a:b]
        held += here @ (here > 0).astype(np.float32).T
    with np.errstate(divide="ignore"):
        np.divide(1, held, out=held)
        held = held + held.T
        held -= 1
        return np.divide(1, held, out=held)


def joining(sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, sides: tuple[int, int], roots: list[bytes], threshold: float) -> list[tuple[int, int, float]]:
    """Verified links (i, j, similarity) of members on different sides that join all parts which such links can join."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    bound = bounds(np.concatenate([e for e, _ in sets]), member, np.concatenate([w for _, w in sets]), n)
    ok = np.triu(bound >= threshold - 1e-4, 1)
    if sides[0] != sides[1]:
        ok &= side[:, None] != side
    i, j = np.nonzero(ok)
    order = np.argsort(-bound[i, j], kind="stable")
    names: dict[bytes, int] = {}
    part = [names.setdefault(r, len(names)) for r in roots]
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = find(part[x]), find(part[y])
        if a != b and (s := similarity(*sets[x], *sets[y])) >= threshold - 1e-9:
            up[b] = a
            out.append((x, y, s))
    return out


def rest(nodes: DataFrame, groups: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """nodes(node, codes, bands), their groups, roots(node, root), texts(node, text) -> links (a, b, similarity) between parts.

    None if no group holds several roots. Of a group, nodes of its most
    frequent root (blocks below 0) meet only the others (blocks from 0), and the
    others also each other.
    """
    rows = groups.select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kinds = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = kinds.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("main"))
    groups = groups.where(F.col("n") > F.col("main.n"))

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / (2 * GROUP), size / BLOCK_BYTES))

    pm = blocks(F.col("main.n"), F.col("main.bytes"))
    po = blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    groups = common.saved(groups.select("key", F.col("main.root").alias("main"), pm.alias("pm"), po.alias("po")))
    if not groups.head(1):
        return None
    salt = F.xxhash64("node", "key")
    side = F.when(F.col("root") == F.col("main"), -1 - F.pmod(salt, "pm")).otherwise(F.pmod(salt, "po"))
    own = rows.join(groups, "key").withColumn("side", side)
    # the blocks that a node's own block meets
    to = F.explode(F.sequence(F.when(F.col("side") < 0, F.lit(0).cast("long")).otherwise(-F.col("pm")), F.col("po") - 1))
    dealt = own.select("key", "node", "root", "side", to.alias("to"))
    dealt = dealt.select("key", "node", "root", "side", F.least("side", "to").alias("p"), F.greatest("side", "to").alias("q"))
    met = common.saved(_blocks(dealt.join(nodes.select("node", "codes", "bands"), "node"), threshold))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, held in tx.runs(batches, 3):
            side, nodes, roots, text = zip(*held, strict=True)
            e, d, w = weighted(*tx.buffers(pa.array(text, pa.large_string())))
            at = np.searchsorted(d, np.arange(len(text) + 1))
            sets = [(e[x:y], w[x:y]) for x, y in zip(at, at[1:], strict=False)]
            got = joining(sets, np.array(side), now[1:], roots, threshold)
            if got:
                i, j, s = zip(*got, strict=True)
                a = [min(nodes[x], nodes[y]) for x, y in zip(i, j, strict=True)]
                b = [max(nodes[x], nodes[y]) for x, y in zip(i, j, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s)], ["a", "b", "similarity"])

    dealt = met.join(texts, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return dealt.select("key", "p", "q", "side", "node", "root", "text").mapInArrow(work, VERIFY)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(node, root) after more links (a, b): only the parts that links join are gone through again."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = roots.unionByName(ends.join(roots, "node", "left_anti").withColumn("root", F.col("node")))
    edges = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    over = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return common.saved(known.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def links(docs: DataFrame, nodes: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) that join all nodes which links can join, and (node, root) of linked nodes."""
    groups = groups_of(nodes)
    texts = texts_of(docs, groups.select("node").distinct(), text_col=text_col)
    pairs, hubs = candidates(nodes, groups, threshold)
    found = common.saved(verify(texts, pairs, threshold=threshold))
    roots = common.saved(components(found))

    def add(more: DataFrame) -> None:
        nonlocal found, roots
        more = common.saved(more)
        if more.head(1):
            roots = joined(roots, more)
            found = common.saved(found.unionByName(more).distinct())

    hubs = common.saved(hubs)
    if hubs.head(1):
        named = groups.join(hubs, "key").select("node", "hub").distinct().join(roots, "node", "left")
        tops = roots.select(F.col("node").alias("hub"), F.col("root").alias("top"))
        apart = named.join(tops, "hub", "left").where(F.coalesce("root", "node") != F.coalesce("top", "hub"))
        add(verify(texts, apart.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), threshold=threshold))
    left = rest(nodes, groups, roots, texts, threshold)
    if left is not None:
        add(left)
    return found, roots


def texts_of(docs: DataFrame, wanted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(node, text) of the nodes wanted, in the shared folder."""
    text = docs.select(common.text_or_empty(text_col).alias("text")).select(digest(F.col("text")).alias("node"), "text")
    # equal texts are one row from here on: the aggregation keeps one of a node's copies before it shuffles
    return common.saved(text.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))


VERIFY = "a binary, b binary, similarity double"


def verify(texts: DataFrame, pairs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, similarity) whose texts' exact J_P reaches the threshold; texts(node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.chunks(b, "ta", 1 << 20):
                sets = []
                for col in ("ta", "tb"):
                    e, d, w = weighted(*tx.buffers(part.column(part.schema.get_field_index(col))))
                    at = np.searchsorted(d, np.arange(part.num_rows + 1))
                    sets.append([(e[x:y], w[x:y]) for x, y in zip(at, at[1:], strict=False)])
                s = np.array([similarity(*x, *y) for x, y in zip(*sets, strict=True)])
                ok = s >= threshold - 1e-9
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok)), pa.array(s[ok])], ["a", "b", "similarity"])

    return both.select("a", "b", "ta", "tb").mapInArrow(work, VERIFY)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node of an edge, by large-star and small-star rounds.

    A round's edges are written to the shared folder; minima are taken before
    the shuffle, so a node with very many links costs a row per task.
    """
    e = common.saved(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        # large star: u's larger neighbours join the least of u and its neighbours
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: u and its smaller neighbours join the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("x"), "m").unionByName(low.select(F.col("u").alias("x"), "m"))
        e = common.saved(small.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).where(F.col("a") != F.col("b")).distinct())
    return e.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, node (its text's digest), class_id, class_node, n_verified.

    ``class_id`` is the least doc_id of the documents joined by links, equal
    texts included; ``class_node`` its node; ``n_verified`` the text's links to
    other texts that were verified, which leaves out links between texts that
    others had joined. Null texts count as empty; all texts without a
    word are near only to equal texts. Rows with equal ids are kept each; a
    null id is greater than all others. An empty table gives no rows.
    """
    own, named, _ = _classes(docs, threshold, id_col, text_col)
    return own.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id", "class_node", "n_verified")


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of each document, the class of each node, and (class_id, class_node) of each class."""
    own = common.saved(sketch(docs, id_col=id_col, text_col=text_col))
    firsts = [F.first(c).alias(c) for c in ("codes", "bands", "size")]
    nodes = common.saved(own.groupBy("node").agg(F.min("doc_id").alias("rep"), *firsts))
    found, roots = links(docs, nodes, threshold=threshold, text_col=text_col)
    ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    linked = roots.join(degree, "node", "left")
    all_nodes = nodes.select("node", "rep").join(linked, "node", "left")
    all_nodes = all_nodes.select("node", "rep", F.coalesce("root", "node").alias("root"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    least = all_nodes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("m"))
    least = least.select("root", F.col("m.rep").alias("class_id"), F.col("m.node").alias("class_node"))
    return own, all_nodes.join(least, "root").select("node", "class_id", "class_node", "n_verified"), least


def dedup(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each class: the one with the least id (of repeated rows, one).

    All columns stay as they were, whatever their names.
    """
    from pyspark.sql import Window

    _, _, least = _classes(docs, threshold, id_col, text_col)

    def name(node: Column, doc_id: Column) -> Column:
        return F.concat(node, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary")).alias("name")

    keep = least.select(name(F.col("class_node"), F.col("class_id")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), name(digest(common.text_or_empty(text_col)), docs[id_col].cast("long")))
    kept = rows.join(keep, "name", "left_semi")
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.lit(0)))
    return kept.withColumn("place", first).where(F.col("place") == 1).select("row.*")


def op6_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(common.read_docs(spark, sf_dir)).select("doc_id", "class_id", "n_verified")
