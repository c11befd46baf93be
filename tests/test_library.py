"""Operators beyond the registered queries: invariants, formats, streams."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinweave.functions import hashing as H
from spinweave.functions import stats as S
from spinweave.operators import components as C
from spinweave.operators import dynamics as D
from spinweave.operators import graph as G
from spinweave.operators import protein as PR
from spinweave.operators import spectral as SP
from spinweave.plans import tables
from spinweave.sources import files
from spinweave.sources import lattices as L
from spinweave.streaming import events


def test_sizes_and_degrees(spark):
    for g, edges in ((L.square(spark, 6), 72), (L.triangular(spark, 6, 8), 144), (L.hexagonal(spark, 6, 8), 72), (L.octagonal(spark, 3, 4), 72), (L.cubic(spark, (3, 4, 5)), 180), (L.cubic(spark, (4, 4, 4), "fcc", nearest=True), 1536), (L.square(spark, 2), 4)):
        assert g.nodes.count() == g.n and g.edges.count() == edges
        d = {r["degree"] for r in G.degrees(g.edges, g.nodes).collect()}
        assert g.coordination is None or d == {g.coordination} or g.n == 4
    assert L.recursive_triangles(spark, 3).n == 15 and L.recursive_triangles(spark, 3).edges.count() == 27
    with pytest.raises(ValueError):
        L.triangular(spark, 3, 5)
    with pytest.raises(ValueError):
        L.square(spark, 0)


def test_flips_are_their_own_inverse(spark):
    e = G.flip_hash(L.square(spark, 8).edges, 0.3)
    links = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).limit(20).union(e.select("src", "dst").limit(20))
    back = G.flip_selected(G.flip_selected(e, links), links)
    assert sorted(back.collect()) == sorted(e.collect())
    assert G.unflip(e).where("w < 0").count() == 0
    m, v = G.random_normal(L.square(spark, 40).edges, 2.0, 0.5).agg(F.avg("w"), F.stddev_pop("w")).first()
    assert abs(m - 2) < 0.05 and abs(v - 0.5) < 0.05


def test_gauge_transform_keeps_the_spectrum(spark):
    e = G.flip_hash(L.square(spark, 6).edges, 0.3)
    turned = G.flip_selected(e, G.star_links(e, spark.range(36).where("id IN (3, 17)")))
    a, b = (np.array(sorted(r["ev"] for r in SP.spectrum(G.laplacian(x)).collect())) for x in (e, turned))
    assert np.abs(a - b).max() < 1e-9 and a[0] > 0


def test_power_iteration_finds_the_least_mode(spark):
    m = G.laplacian(G.flip_hash(L.square(spark, 4).edges, 0.3))
    value, x = SP.extreme_mode(m, 8.0, rounds=32, tolerance=1e-4, every=4)
    want = min(r["ev"] for r in SP.spectrum(m).collect())
    assert abs(value - want) < 0.05 and abs(x.agg(F.sum(F.col("x") * F.col("x"))).first()[0] - 1) < 1e-6


def test_ward_and_average_heights(spark):
    pts = [0.0, 1.0, 5.0, 6.5, 20.0]
    rows = [(i, j, abs(pts[i] - pts[j])) for i in range(5) for j in range(i + 1, 5)]
    d = spark.createDataFrame(rows, "i long, j long, d double")
    avg = [r["height"] for r in SP.linkage(d, "average").orderBy("step").collect()]
    assert np.allclose(avg, [1.0, 1.5, 5.25, np.mean([20, 19, 15, 13.5])])
    ward = [r["height"] for r in SP.linkage(d, "ward").orderBy("step").collect()]
    assert np.allclose(ward[:2], [1.0, 1.5]) and np.isclose(ward[2], np.sqrt(2 * 2 * 2 / 4) * abs(0.5 - 5.75))


def test_layout_solver_and_distance(spark):
    lay = SP.layout(SP.signed_modes(L.square(spark, 4).edges)).collect()
    assert len(lay) == 32 and max(abs(r["x"]) for r in lay) == pytest.approx(1)
    a = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0)], "i long, j long, d double")
    assert SP.upper_distance(a, a.withColumn("d", F.col("d") + 2)).first()[0] == pytest.approx(np.sqrt(8))


def test_components_of_a_long_path(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    got = C.components(e, spark.range(305)).collect()
    assert {r["root"] for r in got if r["id"] <= 300} == {0} and len(got) == 305


def test_circles_cycles_and_rewiring(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.9, 0.0), (2, 3.8, 0.0), (3, 9.0, 9.0), (4, -1.0, -1.0)], "id long, x double, y double")
    assert {r["id"]: r["root"] for r in C.circle_clusters(pts, 1.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}
    assert C.short_cycle(L.square(spark, 6).edges, 7).first()[0] == 4 and C.short_cycle(L.hexagonal(spark, 6, 8).edges, 9).first()[0] == 6
    assert C.short_cycle(L.square(spark, 4, periodic=False).edges.where("dst = src + 1"), 1).first()[0] is None
    w = L.watts_strogatz(spark, 200, 4, 0.3).edges
    assert w.count() == 400 == w.select("src", "dst").distinct().count() and w.where("src >= dst").count() == 0


def test_thresholds_choose(spark):
    e = L.square(spark, 6).edges.withColumn("w", (1 + H.edge_hash() % 100) / 100.0)
    t = C.thresholds(e, 36, 8)
    rows = t.orderBy("threshold").collect()
    assert rows[0]["giant_nodes"] == 1.0 and rows[0]["giant_edges"] == 1.0 and rows[-1]["giant_nodes"] < 1
    first = next(r["threshold"] for r in rows if r["giant_nodes"] < 0.9)
    assert C.select_threshold(t).first()[0] == first


def test_dynamics_are_reproducible_and_right(spark):
    g = L.square(spark, 8)
    a = sorted(D.ising(spark, g.edges, 64, temperature=1.0, sweeps=3, count=3).collect())
    assert a == sorted(D.ising(spark, g.edges, 64, temperature=1.0, sweeps=3, count=3).collect())
    up = D.ising(spark, g.edges, 64, temperature=0.0, sweeps=5, count=1, start="up").collect()
    assert {(r["metric"], r["value"]) for r in up} == {("energy", -1.0), ("magnetisation", 1.0)}
    one = {r["step"]: r["value"] for r in D.ising(spark, g.edges, 64, temperature=0.0, sweeps=5, count=1, start="delta", clusters=[[0, 1]]).where("metric = 'magnetisation'").collect()}
    assert one[0] == 1 - 2 / 64 and one[1] == 1.0
    par = D.ising(spark, g.edges, 64, temperature=0.5, sweeps=3, count=1, update="synchronous", field=np.full(64, 9.0)).where("metric = 'magnetisation' AND step = 3").first()
    assert par["value"] == 1.0
    assert {r["value"] for r in D.voter(spark, g.edges, 64, sweeps=3, count=2, start="up").collect()} == {1.0}
    # negative links infect nobody, so all turn inactive at once
    assert D.contact(spark, G.flip_hash(g.edges, 1.0), 64, recovery=50.0, sweeps=4, count=1).where("step = 4").first()["value"] == 0.0
    walk = D.signed_walk(spark, G.flip_hash(g.edges, 1.0), 64, steps=9, count=2).collect()
    assert all(r["sign"] == (-1) ** r["step"] for r in walk)
    open_ = L.square(spark, 9, periodic=False)
    assert D.trapped_walk(spark, open_.edges, 81, columns=9, coordination=4, count=5, start=40).where("node div 9 IN (0, 8) OR node % 9 IN (0, 8)").count() == 5
    done = spark.createDataFrame([(1, 0.1)], "replica int, p double")
    assert D.resume(done, spark.createDataFrame([(1, 0.1), (2, 0.1)], "replica int, p double"), ["replica", "p"]).collect() == [(2, 0.1)]


def test_diffusion_keeps_the_sum(spark):
    g = L.square(spark, 5)
    x = D.diffusion(g.edges, spark.range(25).select("id", F.when(F.col("id") == 12, 1.0).otherwise(0.0).alias("x")), 0.1, 12, signed=False)
    total, top = x.agg(F.sum("x"), F.max("x")).first()
    assert total == pytest.approx(1) and top < 0.3


def test_files_come_back(spark, tmp_path):
    e = G.flip_hash(L.square(spark, 6).edges, 0.3)
    files.EdgeRecords.register(spark)
    e.select("src", "dst", "w").write.format("edge_records").mode("append").save(str(tmp_path / "bin"))
    assert sorted(files.read_edges(spark, str(tmp_path / "bin")).collect()) == sorted(e.select("src", "dst", "w").collect())
    files.write_edge_text(e, str(tmp_path / "text"))
    assert sorted(files.read_edge_text(spark, str(tmp_path / "text")).collect()) == sorted(e.select("src", "dst", "w").collect())
    np.array([1, -1, -1, 1, 1, 1], "<i1").tofile(tmp_path / "s.bin")
    got = files.read_modes(spark, str(tmp_path / "s.bin"), 3, binarised=True).orderBy("k", "node").collect()
    assert [(r["k"], r["node"], r["x"]) for r in got] == [(0, 0, 1.0), (0, 1, -1.0), (0, 2, -1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    upper = [(i, j, float(10 * i + j)) for i in range(5) for j in range(i, 5)]
    (tmp_path / "m.bin").write_bytes(b"".join(struct.pack("<d", v) for _, _, v in upper))
    assert sorted(tuple(r) for r in files.read_upper_matrix(spark, str(tmp_path / "m.bin"), 5).collect()) == upper
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        files.read_edges(spark, str(tmp_path / "bad.bin")).collect()


def test_protein_files(spark, tmp_path):
    line = "ATOM  %5d  %-3s %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C"
    (tmp_path / "a.pdb").write_text("HEADER\n" + "\n".join(line % (k + 1, "CA" if k % 2 else "N", "GLY", k // 2 + 1, k * 1.5, -k, 0.25) for k in range(6)) + "\nEND\n")
    a = files.read_atoms(spark, str(tmp_path / "a.pdb"), "CA")
    assert [(r["residue"], r["resseq"], r["x"]) for r in a.orderBy("idx").collect()] == [("GLY", 1, 1.5), ("GLY", 2, 4.5), ("GLY", 3, 7.5)]
    files.structure_lines(a).select("line").coalesce(1).write.text(str(tmp_path / "out"))
    assert [r["x"] for r in files.read_atoms(spark, str(tmp_path / "out")).orderBy("idx").collect()] == [1.5, 4.5, 7.5]


def test_reconstruction_with_a_whole_basis_is_exact(spark):
    basis = SP.signed_modes(L.square(spark, 4).edges).select("k", "node", "x")
    f = spark.range(16).select(F.lit("p").alias("pdb_id"), F.col("id").alias("k"), F.sin(F.col("id") * 1.0).alias("v"))
    back = {r["k"]: r["v"] for r in PR.reconstruct(f, basis).collect()}
    assert all(abs(back[r["k"]] - r["v"]) < 1e-9 for r in f.collect())


def test_bandpass_passes_its_band(spark):
    t = np.arange(400)
    for freq, least, most in ((2.0, 0.9, 1.1), (0.1, 0.0, 0.1), (20.0, 0.0, 0.1)):
        rows = [(0, int(k), float(np.sin(2 * np.pi * freq * k / 50))) for k in t]
        out = np.array([r["v"] for r in PR.bandpass(spark.createDataFrame(rows, "id long, t long, v double"), 1.0, 5.0, 50.0).orderBy("t").collect()])
        assert least <= np.abs(out[100:300]).max() <= most


def test_clamping_and_conditions(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (-3.0,), (float("-inf"),)], "x double")
    assert sorted(r["x"] for r in S.clamp_infinite(df, "x").collect()) == [-3.0, -3.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        G.condition("~3")
    with pytest.raises(ValueError):
        G.flip_hash(df, 1.5)
    assert S.linear_histogram(df.where("x > 5 AND x < 0"), "x").count() == 0


def test_streams(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    q = events.running_moments(events.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_type"]: r for r in spark.sql("SELECT event_type, max_by(struct(n, mean, variance), n) AS m FROM moments GROUP BY 1").collect()}
    for r in e.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect():
        m = got[r["event_type"]]["m"]
        assert m["n"] == r["n"] and m["mean"] == pytest.approx(r["m"]) and m["variance"] == pytest.approx(r["v"])
    w = events.windowed(events.read_events(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == e.count()


def test_sweeps_go_on_where_they_stopped(spark, tmp_path):
    from spinweave.plans import sweep

    path, points = str(tmp_path / "sweep"), [{"side": 6, "p": 0.1, "temperature": 1.0}, {"side": 6, "p": 0.1, "temperature": 2.0}]
    assert sweep.run(spark, path, points[:1], 2, sweep.ising_kernel) == 2
    first = sorted(map(str, sweep.results(spark, path).collect()))
    assert sweep.run(spark, path, points, 3, sweep.ising_kernel) == 4 and sweep.run(spark, path, points, 3, sweep.ising_kernel) == 0
    rows = sweep.results(spark, path)
    assert set(first) <= set(map(str, rows.collect()))
    assert {r["n"] for r in sweep.averages(rows, ["temperature", "step", "metric"], "value").collect()} == {3}
    assert sweep.cached(spark, str(tmp_path / "t"), lambda: spark.range(3)).count() == 3 == sweep.cached(spark, str(tmp_path / "t"), lambda: spark.range(9)).count()
    assert sweep.run(spark, str(tmp_path / "pc"), [{"side": 5, "p": 0.2}], 2, sweep.percolation_kernel) == 2


def test_random_strings_and_products(spark):
    from spinweave.functions import scalars as SC

    got = [r["rid"] for r in SC.random_ids(spark.range(50), "id", 12).collect()]
    assert len(set(got)) == 50 and all(len(x) == 12 and x.isalnum() for x in got)
    basis = spark.range(80).select(F.expr("cast(id div 16 as int)").alias("k"), (F.col("id") % 16).alias("node"), H.spin("id").alias("s"))
    assert {r["s"] for r in SC.random_product(basis, 1).collect()} <= {-1, 1}


def test_command_line(spark, tmp_path):
    from spinweave import cli

    assert cli.values("(0,1,3); 1/4") == [0.0, 0.5, 1.0, 0.25]
    with pytest.raises(Exception):
        cli.values("(0,1")
    run = ["ising", str(tmp_path / "t"), "--side", "4", "--p", "(0.1,0.2,2)", "--temperature", "1", "--sweeps", "2", "--replicas", "2"]
    assert cli.main(run) == 4 and cli.main(run) == 0


def test_part_graph_takes_every_part(spark, tmp_path):
    """Against brute force over lines of parts with round and other keys."""
    rng = random.Random(8)
    rows = [(rng.randint(1, 25), rng.randint(1, 8), rng.choice("RAN")) for _ in range(120)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for p in {r[0] for r in rows}:
        own = {}
        for part, s, flag in rows:
            if part == p:
                own.setdefault(s, []).append(flag == "R")
        for a in own:
            for b in own:
                if a < b:
                    n, back, lines = want.get((a, b), (0, 0, 0))
                    want[a, b] = (n + 1, back + sum(own[a]) + sum(own[b]), lines + len(own[a]) + len(own[b]))
    got = {(r["src"], r["dst"]): (r["shared"], r["sign"]) for r in tables.part_graph(spark, str(tmp_path)).collect()}
    assert got == {k: (n, -1 if back * 3 > lines else 1) for k, (n, back, lines) in want.items()}


def turns(points):
    """Letters by the definition, residue by residue."""
    p = np.array(points, float)
    n, out = len(p), ["C"] * len(p)

    def angle(u, v):
        return np.degrees(np.arccos(np.clip(u @ v / ((np.linalg.norm(u) + 1e-8) * (np.linalg.norm(v) + 1e-8)), -1, 1)))

    for i in range(2, n - 2):
        steps = [p[i + k + 1] - p[i + k] for k in (-1, 0, 1)]
        mean = (angle(steps[0], steps[1]) + angle(steps[1], steps[2])) / 2
        out[i] = "E" if mean < 60 else "H" if mean > 120 else "C"
    return "".join(out[i - 1] if 0 < i < n - 1 and out[i - 1] == out[i + 1] != "C" else out[i] for i in range(n))


def test_secondary_structure_by_its_definition(spark):
    rng = np.random.default_rng(3)
    chains = {"line": [(3.8 * i, 0, 0) for i in range(8)], "zigzag": [(i % 2, 0.01 * i, 0) for i in range(8)], "short": [(0, 0, 0), (1, 0, 0), (2, 0, 0)]}
    chains |= {f"walk{k}": np.cumsum(rng.normal(size=(25, 3)) + 0.4 * k, axis=0).tolist() for k in range(6)}
    rows = [(name, i, *map(float, p)) for name, points in chains.items() for i, p in enumerate(points)]
    got = {}
    for r in PR.secondary_structure(spark.createDataFrame(rows, "pdb_id string, idx long, x double, y double, z double")).collect():
        got.setdefault(r["pdb_id"], {})[r["idx"]] = r["ss"]
    letters = {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()}
    assert letters == {k: turns(v) for k, v in chains.items()}
    assert letters["line"] == "CCEEEECC" and letters["zigzag"] == "CCHHHHCC" and letters["short"] == "CCC"


def test_sparse_modes_against_dense(spark):
    e = G.flip_hash(L.square(spark, 6).edges, 0.2)
    m = G.laplacian(e)
    dense = [r["ev"] for r in SP.spectrum(m).orderBy("k").collect()]
    rows = SP.sparse_modes(m, 2, pad=5, degree=8, tolerance=1e-5).collect()
    for k in range(2):
        own = [r for r in rows if r["k"] == k]
        assert len(own) == 36 and own[0]["residual"] < 1e-4
        assert abs(own[0]["ev"] - dense[k]) < 1e-6 and abs(sum(r["x"] ** 2 for r in own) - 1) < 1e-6


def test_linkage_against_the_plain_search(spark):
    """Merge heights by searching all pairs at each step."""
    rng = np.random.default_rng(4)
    p = rng.integers(0, 12, (25, 2)).astype(float)
    full = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    rows = [(i, j, float(full[i, j])) for i in range(25) for j in range(i + 1, 25)]
    df = spark.createDataFrame(rows, "i long, j long, d double")
    for method, join in (("single", min), ("complete", max), ("average", lambda x: sum(x) / len(x))):
        groups, want = [[i] for i in range(25)], []
        while len(groups) > 1:
            h, a, b = min((join([full[x, y] for x in groups[a] for y in groups[b]]), a, b) for a in range(len(groups)) for b in range(a))
            want.append(h)
            groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
        got = [r["height"] for r in SP.linkage(df, method).orderBy("step").collect()]
        assert np.allclose(got[: len(want) if method == "single" else 10], want[: len(want) if method == "single" else 10])
        assert len(got) == 24 and all(r["size"] >= 2 for r in SP.linkage(df, method).collect())


def test_least_hashes(spark):
    e = L.square(spark, 12).edges
    rows = sorted((r["h"], r["src"], r["dst"]) for r in e.select("src", "dst", H.edge_hash(salt=3).alias("h")).collect())
    for k in (0, 1, 7, 100, 287, 288, 500):
        assert sorted(map(tuple, G.least_hashes(e, k, 3).collect())) == sorted(r[1:] for r in rows[:k])
    assert G.sample_links(e, 9, salt=3).count() == 9


def test_replica_kernels_against_numpy(spark):
    """Disorder, modes, sign clusters and reconstruction of each replica, by plain arrays."""
    from spinweave.plans import kernels as K

    p = {"side": 5, "p": 0.3, "temperature": 0.4, "sweeps": 3}
    edges, n = K.disordered(spark, p, 2, 2)
    by = {}
    for r in edges.collect():
        by.setdefault(r["graph"], []).append((r["src"], r["dst"], r["w"]))
    assert sorted(by) == [2, 3] and n == 25 and len({tuple(sorted(v)) for v in by.values()}) == 2
    clusters = {}
    for r in K.cluster_kernel(spark, p, 2, 2).collect():
        clusters.setdefault(r["replica"], []).append(r["size"])
    matches = {}
    for r in K.reconstruction_kernel(spark, p | {"modes": 25}, 2, 2).collect():
        matches.setdefault(r["replica"], {})[r["k"]] = r["overlap"]
    starts = {(r["replica"], r["metric"]): r["value"] for r in K.mode_ising_kernel(spark, p, 2, 2).where("step = 0").collect()}
    for graph, rows in by.items():
        a = np.zeros((n, n))
        for i, j, w in rows:
            a[i, j] = a[j, i] = w
        ev, v = np.linalg.eigh(np.diag(np.abs(a).sum(0)) - a)
        assert ev[1] - ev[0] > 1e-6
        s = np.where(v[:, 0] < 0, -1, 1)
        label = list(range(n))
        for _ in range(n):
            for i, j, _ in rows:
                if s[i] == s[j]:
                    label[i] = label[j] = min(label[i], label[j])
        assert sorted(clusters[graph]) == sorted(label.count(x) for x in set(label))
        energy = -sum(w * s[i] * s[j] for i, j, w in rows) / len(rows)
        assert abs(starts[graph, "energy"] - energy) < 1e-9 and abs(starts[graph, "overlap"] - 1) < 1e-9
        assert len(matches[graph]) == 24 and all(abs(x) <= 1 for x in matches[graph].values())
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(8, 8)))[0]
    spins = np.array([1.0, -1, 1, 1, -1, -1, 1, 1])
    for k, overlap, matching in K.match_rows(spins, basis):
        r = sum((basis[q] @ spins) * basis[q] for q in range(k + 1))
        q = np.mean(np.where(r < 0, -1, 1) * spins)
        assert abs(q - overlap) < 1e-12 and abs(matching - abs(q) / 2 - 0.5) < 1e-12


def test_sweeps_of_spectra_go_on(spark, tmp_path):
    from spinweave import cli
    from spinweave.plans import kernels as K
    from spinweave.plans import sweep

    run = ["spectrum", str(tmp_path / "s"), "--geo", "sc", "--side", "3", "--p", "0.2", "--replicas"]
    assert cli.main([*run, "2"]) == 2 and cli.main([*run, "3"]) == 1 and cli.main([*run, "3"]) == 0
    rows = sweep.results(spark, str(tmp_path / "s"))
    assert rows.count() == 81 and K.value_distribution(rows, 10).agg(F.sum("cnt")).first()[0] == 81
    assert cli.main(["clusters", str(tmp_path / "c"), "--side", "4;5", "--p", "0.1;0.2", "--replicas", "2"]) == 8
    sizes = sweep.results(spark, str(tmp_path / "c"))
    assert {(r["side"], r["n"]) for r in sizes.groupBy("side").agg(F.sum("size").alias("n")).collect()} == {(4, 64), (5, 100)}
    assert K.size_distribution(sizes, ["side"]).agg(F.sum(F.col("size") * F.col("cnt"))).first()[0] == 164
    assert cli.main(["modes", str(tmp_path / "m"), "--side", "4", "--p", "0.1", "--howmany", "2", "--replicas", "2"]) == 2
    modes = sweep.results(spark, str(tmp_path / "m"))
    assert modes.count() == 64 and K.mode_distribution(modes, 0, 5).agg(F.sum("cnt")).first()[0] <= 32


def test_fields_and_lowered_diffusion(spark):
    """Lowered by its least eigenvalue, diffusion keeps the lowest mode; contact by number is a plain loop."""
    g = L.square(spark, 4)
    e = G.flip_hash(g.edges, 0.2)
    low = SP.eigen(G.laplacian(e), 1).select(F.col("node").alias("id"), "ev", "x").collect()
    field = spark.createDataFrame([(r["id"], r["x"]) for r in low], "id long, x double")
    out = {r["id"]: r["x"] for r in D.diffusion(e, field, 0.05, 4, lowest=low[0]["ev"]).collect()}
    assert all(abs(out[r["id"]] - r["x"]) < 1e-9 for r in low)
    for kind, total in (("delta", 1.0), ("constant", 16.0)):
        assert abs(D.start_field(g.nodes, kind).agg(F.sum("x")).first()[0] - total) < 1e-12
    x = [r["x"] for r in D.start_field(spark.range(4000), "normal", 2.0).collect()]
    assert abs(np.mean(x)) < 0.15 and abs(np.std(x) - 2) < 0.15
    rows = D.contact(spark, e, 16, recovery=0.3, sweeps=3, count=2, update="sequential", seed=4).collect()
    graph = D.Adjacency(*D.load(e, 16))
    for replica in range(2):
        rng = np.random.default_rng([4, replica])
        s = (D.initial(graph, rng, "uniform") > 0).astype(int)
        for t in range(1, 4):
            u = rng.random(16)
            for i in range(16):
                to, w = graph.lists[i]
                rate = sum(s[j] * max(c, 0) for j, c in zip(to, w)) if not s[i] else 0.3 + sum(s[j] * max(-c, 0) for j, c in zip(to, w))
                if u[i] < 1 - np.exp(-rate):
                    s[i] = 1 - s[i]
            assert [r["value"] for r in rows if r["replica"] == replica and r["step"] == t] == [s.mean()]


def test_composed_protein_features(spark):
    from spinweave.operators import protein_bases as PB

    rng = np.random.default_rng(8)
    names = [*PB.RESIDUES, "XXX"]
    rows, points = [], {}
    for k, n in enumerate((2, 12, 60)):
        p = rng.normal(size=(n, 3)) * 9
        kinds = [names[rng.integers(0, 21)] for _ in range(n)]
        letters = ["HEC"[rng.integers(0, 3)] for _ in range(n)]
        points[f"p{k}"] = (p, kinds, letters)
        rows += [(f"p{k}", i, kinds[i], letters[i], *map(float, p[i])) for i in range(n)]
    atoms = spark.createDataFrame(rows, "pdb_id string, idx long, residue string, ss string, x double, y double, z double").repartition(3)

    def gathered(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["pdb_id"], {})[r["k"]] = r["v"]
        return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}

    enhanced, whole = gathered(PB.enhanced_features(atoms, 120)), gathered(PB.comprehensive_features(atoms, 80))
    for name, (p, kinds, letters) in points.items():
        n, q = len(p), p - p.mean(0)
        shares = [letters.count(x) / n for x in "HEC"], [kinds.count(x) / n for x in PB.RESIDUES]
        gyration = np.sqrt((q**2).sum() / n)
        var = sorted(np.linalg.eigvalsh((q.T @ q) / (n - 1)), reverse=True) if n > 2 else []
        line = [c for row in q for c in row]
        own = line if len(line) <= 90 else [line[int(i * (len(line) - 1) / 89)] for i in range(90)]
        full = own + [0.0] * (90 - len(own)) + shares[0] + shares[1] + [gyration / 50] + [x / (var[0] + 1e-8) for x in var]
        full = np.array(full + [0.0] * (120 - len(full)))
        assert np.allclose(enhanced[name], full / np.abs(full).max())
        far = [float(np.linalg.norm(p[i] - p[j])) for i in range(n) for j in range(i + 1, n)]
        near = n + 2 * sum(d < 8 for d in far)
        full = far[:40] + shares[1] + shares[0] + [gyration] + ([var[0] - (var[1] + var[2]) / 2, *var] if n > 2 else []) + [near / (n * (n - 1))]
        full = np.array((full + [0.0] * 80)[:80])
        assert np.allclose(whole[name], full / full.max())
    assert {r["pdb_id"] for r in PB.in_range(atoms, 3, 30).select("pdb_id").distinct().collect()} == {"p1"}


def test_bases_of_all_topologies(spark):
    from spinweave.operators import protein_bases as PB

    atoms = spark.createDataFrame([("a", i, float(i % 3), float(i), 1.0) for i in range(6)], "pdb_id string, idx long, x double, y double, z double")
    for name in PB.FLIPPED:
        b = PB.basis(spark, name, 18)
        n = b.agg(F.countDistinct("node")).first()[0]
        assert n >= 18 and SP.is_orthonormal(b).first()[0] and b.agg(F.max("k")).first()[0] == n - 1
    curves = PB.curves_by_topology(spark, atoms, ["l2d_square", "er_sg"], least=2)
    first = {r["topology"]: r["mse"] for r in curves.where("used = 0").collect()}
    total = sum((i % 3) ** 2 + i**2 + 1 for i in range(6))
    assert abs(first["l2d_square"] - total / 25) < 1e-9 and abs(first["er_sg"] - total / 18) < 1e-9
    with pytest.raises(ValueError):
        PB.topology(spark, "none", 5)
