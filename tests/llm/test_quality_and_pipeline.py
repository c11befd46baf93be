import functools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spinweave.llm import common, quality
from spinweave.llm import text as tx

from .helpers import WORD, empty_docs, odd_docs, odd_rows

DIR = "/root/testdata/sf0.01"


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 5.0, -1e9, 1e-9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1500, 3000):
        assert quality.kth_largest(df, "x", k, bins=16, small=20) == sorted(values, reverse=True)[k - 1]


@functools.cache
def hash_of(x):
    return int(tx.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])


def bucket_of(x):
    return hash_of(x) >> 64 - quality.BITS


@functools.cache
def mixed(x):
    return int(tx.mix(np.array([x % 2**64], np.uint64))[0])


def features(text):
    """A text's distinct n-grams, one by one: (kind, bucket)."""
    raw = (text or "").encode()
    places = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
    out, gaps, shapes = set(), Counter(), Counter()
    for k, (s, e) in enumerate(places):
        word = raw[s:e].lower()
        out.add((0, bucket_of(word)))
        out |= {(j, bucket_of(word[:size])) for j, size in enumerate(quality.STEMS, 1)}
        if k:
            gap = raw[places[k - 1][1] : s]
            own = raw[s:e]
            mark = (sum(65 <= c <= 90 for c in own) > 1) + 2 * any(97 <= c <= 122 for c in own) + 4 * any(48 <= c <= 57 for c in own)
            mark += 8 * (word == raw[slice(*places[k - 1])].lower())
            h = hash_of(gap)
            gaps[h >> 64 - quality.BITS] += 1
            shapes[mixed(h ^ mark * 0xC2B2AE3D27D4EB4F % 2**64) >> 64 - quality.BITS] += 1
    for kind, counts in ((quality.KINDS - 4, gaps), (quality.KINDS - 2, shapes)):
        for b, n in counts.items():
            out.add((kind, b))
            share = max(j for j in range(quality.SHARES) if n * 2**j <= sum(counts.values()))
            out.add((kind + 1, mixed(b * quality.SHARES + share + 1) >> 64 - quality.BITS))
    return out


def brute_weights(texts, good):
    """Log weights by dictionaries of both models."""
    sets = [features(t) for t in texts]
    raw, target = Counter(x for s in sets for x in s), Counter(x for s, g in zip(sets, good) if g for x in s)
    ratio = {}
    for x, n in raw.items():
        expected, seen = n * sum(good) / len(texts), target[x]
        deviance = 2 * ((seen * math.log(seen / expected) if seen else 0) - seen + expected)
        ratio[x] = math.log((seen + 0.5) / (expected + 0.5)) * (1 - 9 / deviance) if deviance > 9 else 0.0
    return [sum(ratio[x] for x in s) for s in sets]


def test_weights_and_sample_against_brute_force(spark):
    """Every weight, and the k documents of the greatest keys."""
    docs, labels = common.read_docs(spark, DIR), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6 + k, t) for k, (_, t) in enumerate(odd_rows())]
    label = {r["doc_id"]: (r["quality"], r["toxic"]) == (1, 0) for r in labels.collect()}
    want = brute_weights([t for _, t in rows], [label.get(i, False) for i, _ in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    s = quality.select(docs, labels)
    got = {r["doc_id"]: r for r in s.scored.collect()}
    assert len(got) == len(rows) and any(abs(w) > 1 for w in want)
    assert all(abs(got[i]["log_weight"] - w) < 1e-6 for (i, _), w in zip(rows, want))
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel("doc_id").alias("g")).collect()}
    keys = sorted(((w + noise[i], i) for (i, _), w in zip(rows, want)), reverse=True)
    k = round(len(rows) * sum(label.values()) / len(label))
    assert sorted(r["doc_id"] for r in quality.sample(docs, labels).collect()) == sorted(i for _, i in keys[:k])
    for share in (0.0, 0.3, 1.0):
        assert sorted(r["doc_id"] for r in quality.sample(docs, labels, share=share).collect()) == sorted(i for _, i in keys[: round(share * len(rows))])


def test_held_out_labels(spark):
    """With the models of half of the labels, the sample separates the other half."""
    docs, labels = common.read_docs(spark, DIR), spark.read.parquet(f"{DIR}/labels.parquet")
    half = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0)
    kept = {r["doc_id"] for r in quality.sample(docs, half).select("doc_id").collect()}
    rest = [r for r in labels.join(half, "doc_id", "left_anti").collect()]
    good = [r["doc_id"] in kept for r in rest if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["doc_id"] in kept for r in rest if r["quality"] == 0]
    assert np.mean(good) > 0.8 and np.mean(junk) < 0.5


def test_gumbel_noise_has_its_mean(spark):
    m, v = spark.range(20000).withColumn("doc_id", F.col("id")).select(quality.gumbel("doc_id").alias("g")).agg(F.avg("g"), F.var_pop("g")).first()
    assert abs(m - 0.5772) < 0.03 and abs(v - math.pi**2 / 6) < 0.08


def test_counts_are_those_of_all_documents(spark):
    docs = odd_docs(spark).select("doc_id", "text")
    raw, target = quality.count_grams(docs, np.array([1, 8], np.int64))
    rows = [(r["doc_id"], features(r["text"])) for r in docs.collect()]
    for got, sets in ((raw, [s for _, s in rows]), (target, [s for i, s in rows if i in (1, 8)])):
        want = np.zeros(quality.BUCKETS + 1)
        want[quality.BUCKETS] = len(sets)
        for s in sets:
            for kind, b in s:
                want[(kind << quality.BITS) + b] += 1
        assert (got == want).all()


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (None, 0, 0), (2, None, 0), (20, 0, 0), (21, 0, 1), (40, 1, 0), (60, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.sample(odd_docs(spark), labels)
    assert out.columns == odd_docs(spark).columns and out.count() <= odd_docs(spark).count()
    assert quality.sample(odd_docs(spark), labels.where("doc_id < 0")).count() == odd_docs(spark).count()
    assert quality.sample(empty_docs(spark), labels).count() == 0


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against a check of its own on what the stage before kept."""
    import corpus_pipeline

    from .test_similarity import edit_distance
    from .test_tables import brute_lines
    from .test_tokens import ids_of
    from .helpers import words

    sf = "/root/testdata/sf0.001"
    df = common.read_docs(spark, sf)
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        path = common.shared_path(spark, "test-stage")
        stage(spark, df, sf).write.parquet(path)
        df = spark.read.parquet(path)
        rows = df.collect()
        if name != "packing":
            assert df.columns == columns
            after = {r["doc_id"]: r["text"] for r in rows}
            assert set(after) <= set(before) and len(after) == len(rows)
        if name == "quality classifier":
            label = {r["doc_id"]: (r["quality"], r["toxic"]) == (1, 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            ids = sorted(before)
            weight = brute_weights([before[i] for i in ids], [label.get(i, False) for i in ids])
            noise = {r["doc_id"]: r["g"] for r in common.read_docs(spark, sf).select("doc_id", quality.gumbel("doc_id").alias("g")).collect()}
            keys = sorted(((w + noise[i], i) for i, w in zip(ids, weight)), reverse=True)
            assert set(after) == {i for _, i in keys[: round(len(ids) * sum(label.values()) / len(label))]}
        elif name == "line dedup":
            assert after == {i: t for i, _, _, t in brute_lines(list(before.items()))}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near dedup":
            from .test_similarity import brute_classes

            assert sorted(after) == sorted({int(x.split(", ")[1][:-1]) for x in brute_classes(list(before.items()))})
        elif name == "benchmark decontamination":
            items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            for i, t in before.items():
                w = words(t)
                known = set(w)
                near = [b for b in items if sum(x in known for x in b) >= 0.8 * len(b)]
                assert (i not in after) == any(edit_distance(b, w) <= 0.2 * len(b) for b in near)
        elif name == "packing":
            total = {}
            for r in rows:
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
            assert total == {i: len(ids_of(t)) for i, t in before.items()}
