"""Near dedup and decontamination."""

import random
from collections import Counter

import numpy as np

from spinweave.llm import decontam, neardup

from .helpers import empty_docs, odd_docs, odd_rows, words


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(a, b):
    """By the definition; elements with equal weights in both are summed together."""
    kinds = Counter((a[y], b[y]) for y in {*a, *b})
    return sum(n / sum(m * max(p / x, q / y) for (p, q), m in kinds.items()) for (x, y), n in kinds.items() if x and y)


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and jp(sets[i], sets[j]) >= threshold):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(str((rows[i][0], least[find(i)])) for i in range(len(rows)))


def copies():
    """Groups of near copies: stars around a base, chains, and a large group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 200
    for size, edits in ((3, 1), (12, 2), (40, 3), (2, 30)):
        base = [word() for _ in range(150)]
        for k in range(size):
            own = list(base)
            for _ in range(edits if k else 0):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    chain = [word() for _ in range(150)]
    for _ in range(6):
        rows.append((n, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
        n += 1
    rows.append((n, "same same same " * 50))
    rows.append((n + 1, "same same same " * 55))
    return rows


def test_similarity_and_its_estimate():
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(5, 60))) for _ in range(2)]
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        sets = [neardup.weighted(r, np.array([0, len(r)])) for r in raw]
        s = neardup.similarity(sets[0][0], sets[0][2], sets[1][0], sets[1][2])
        assert abs(s - jp(*map(shingles, texts))) < 1e-9
        sig = [neardup.signatures(*x, 1, 4000)[0] for x in sets]
        assert abs((sig[0] == sig[1]).mean() - s) < 0.05


def test_classes_against_brute_force(spark, monkeypatch):
    rows = odd_rows() + copies()
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, key long, node string").repartition(3)
    want = brute_classes(rows)
    assert sorted(str((r["doc_id"], r["class_id"])) for r in neardup.classes(docs).collect()) == want
    # groups larger than a task's part go through the levels of heads
    monkeypatch.setattr(neardup, "GROUP", 8)
    assert sorted(str((r["doc_id"], r["class_id"])) for r in neardup.classes(docs).collect()) == want
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    assert len({x.split(", ")[1] for x in want if "None)" not in x}) <= kept.count() <= len(set(want))
    assert neardup.classes(empty_docs(spark)).count() == 0 and neardup.dedup(empty_docs(spark)).count() == 0


def crowd_classes(texts):
    """Least index of each text's class; all shingles of a text are distinct, so J_P is the plain Jaccard similarity."""
    sets = [shingles(t) for t in texts]
    assert all(max(s.values()) == 1 for s in sets)
    place = {x: k for k, x in enumerate(sorted({x for s in sets for x in s}))}
    m = np.zeros((len(texts), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    common, size = m @ m.T, m.sum(1)
    near = common / (size[:, None] + size - common) >= 0.8 - 1e-9
    root = np.arange(len(texts))
    while True:
        new = np.where(near, root, len(texts)).min(1)
        if (new == root).all():
            return root.tolist()
        root = new


def edited(rng, base, places, word):
    own = list(base)
    for at in places:
        own[at] = word()
    return own


def classes_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r["class_id"] for r in sorted(neardup.classes(docs).collect(), key=lambda r: r["doc_id"])]


def test_star_of_several_parts_against_brute_force(spark, monkeypatch):
    """Copies near one base only, in band groups of many parts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = [base] + [edited(rng, base, rng.sample(range(5, 395, 5), 7), word) for _ in range(900)]
    texts = [" ".join(t) for t in texts]
    want = crowd_classes(texts)
    assert want.count(0) == len(texts)
    monkeypatch.setattr(neardup, "GROUP", 32)
    assert classes_of(spark, texts) == want


def test_pairs_in_a_dense_family_against_brute_force(spark):
    """Texts of one template, nearer to each other than the estimate's slack, with a few pairs over the threshold."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = [edited(rng, base, rng.sample(range(5, 395, 5), 6), word) for _ in range(300)]
    texts += [edited(rng, texts[i], rng.sample(range(7, 395, 5), 8), word) for i in range(40)]
    texts = [" ".join(t) for t in texts]
    want = crowd_classes(texts)
    assert 30 <= sum(x != i for i, x in enumerate(want)) <= 80
    assert classes_of(spark, texts) == want


def test_one_of_each_class_stays(spark):
    rows = [(i, t) for i, t in odd_rows() + copies() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in neardup.dedup(docs).collect())
    assert kept == sorted({int(x.split(", ")[1][:-1]) for x in brute_classes(rows)})


def test_components_of_long_chains(spark):
    edges = [(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(bytes([1, 9]), bytes([1, j])) for j in range(9)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(v == bytes([k[0], 0]) for k, v in got.items()) and len(got) == 49


def edit_distance(item, text):
    """Least word edit distance from item to any window of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(300):
        item, text = [[rng.randrange(4) for _ in range(rng.randint(1, n))] for n in (12, 30)]
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontam.edit_end(masks, len(item), text)[0] == edit_distance(item, text)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([3, 5, 8, 14, 15, 20, 30, 40, 55] * 4)]
    rows = [(i, t) for i, t in odd_rows()]
    for k in range(150):
        body = [word() for _ in range(rng.randint(0, 80))]
        if k % 3:
            _, item = items[rng.randrange(len(items))]
            own = list(item)
            for _ in range(rng.randint(0, len(own) // 4)):
                at = rng.randrange(len(own))
                act = rng.randrange(3)
                own[at : at + 1] = [] if act == 0 else [word()] if act == 1 else [own[at], word()]
            body[len(body) // 2 : len(body) // 2] = own
        rows.append((300 + k, ", ".join(body).capitalize()))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "!"), (0, " ".join(items[0][1]))], "item_id long, text string")
    want = {}
    for i, t in rows:
        w = words(t)
        if len(w) > 1000:
            continue
        for k, item in items:
            d = edit_distance([x.encode() for x in item], w)
            if d <= int(0.2 * len(item) + 1e-9):
                want[i, k] = d
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.matches(docs, bench, block_bytes=2000).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 80
    assert all(want[k] <= v for k, v in got.items()) and sum(want[k] == v for k, v in got.items()) >= 0.97 * len(got)
    assert all(k in got for k, v in want.items() if v == 0)
    dirty = {i for i, _ in got}
    clean = decontam.clean(docs, bench, block_bytes=2000)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)
    assert decontam.matches(empty_docs(spark), bench).count() == 0 and decontam.clean(docs, bench.where("item_id < 0")).count() == len(rows)


def test_odd_rows_with_all_columns(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontam.clean(odd_docs(spark), bench).collect()) == sorted(str(i) for i, _ in odd_rows() if i != 12)
