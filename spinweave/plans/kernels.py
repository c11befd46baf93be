"""Kernels of sweeps: rows of many replicas of one disordered graph at once.

A replica is a number that seeds its disorder and its dynamics. Replicas are a
column (``graph``) of one table of edges, so a kernel is a few jobs whatever
the number of replicas: spectra and runs are a task each, components are found
in one go over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import stats as S
from ..operators import components as C
from ..operators import dynamics as D
from ..operators import spectral as SP
from ..sources import lattices as L
from .common import r6

PLANE = {"square": L.square, "triangular": L.triangular, "hexagonal": L.hexagonal, "octagonal": L.octagonal}
SPACE = ("sc", "bcc", "fcc")
GEOMETRIES = (*PLANE, *SPACE, "er")


def base_graph(spark: SparkSession, p: dict) -> L.Graph:
    """The graph of p["geo"] (square by default) with p["side"] cells a side; er has side nodes and all pairs."""
    geo, side = p.get("geo", "square"), p["side"]
    if geo in PLANE:
        return PLANE[geo](spark, side, side)
    if geo in SPACE:
        return L.cubic(spark, (side, side, side), geo)
    if geo == "er":
        return L.complete(spark, side)
    raise ValueError(f"geo must be one of {GEOMETRIES}")


def disordered(spark: SparkSession, p: dict, first: int, count: int) -> tuple[DataFrame, int]:
    """Edges (graph, src, dst, w) of replicas first to first + count - 1, and the nodes of each.

    A share p["p"] of each replica's links is negative, by hashes of link and
    replica; of er, pairs are linked with probability p["link"] by another hash.
    """
    g = base_graph(spark, p)
    copies = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long")))
    e = g.edges.select(copies.alias("graph"), "src", "dst")
    if p.get("geo") == "er":
        e = e.where(H.flips(p["link"], salt="(graph + 500000)"))
    return e.withColumn("w", F.when(H.flips(p["p"], salt="graph"), -1.0).otherwise(1.0)), g.n


def laplacians(edges: DataFrame, n: int) -> DataFrame:
    """(graph, i, j, v): signed Laplacians; nodes without links have a 0."""
    w, own = F.col("w"), lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("v"))
    four = F.array(own("src", "dst", -w), own("dst", "src", -w), own("src", "src", F.abs(w)), own("dst", "dst", F.abs(w)))
    parts = edges.select("graph", F.explode(four).alias("x")).select("graph", "x.*")
    nodes = edges.select("graph").distinct().select("graph", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    every = parts.unionByName(nodes.select("graph", "i", F.col("i").alias("j"), F.lit(0.0).alias("v")))
    return every.groupBy("graph", "i", "j").agg(F.sum("v").alias("v"))


def spectrum_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, k, ev): all eigenvalues of the signed Laplacian, or the p["howmany"] least."""
    e, n = disordered(spark, p, first, count)
    out = SP.spectrum(laplacians(e, n)).select(F.col("graph").alias("replica"), "k", "ev")
    return out if p.get("howmany") is None else out.where(F.col("k") < p["howmany"])


def modes_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, k, node, x): the p["howmany"] lowest modes (1 by default)."""
    e, n = disordered(spark, p, first, count)
    modes = SP.eigen(laplacians(e, n), p.get("howmany", 1))
    return modes.select(F.col("graph").alias("replica"), "k", "node", "x")


def mode_signs(modes: DataFrame, k: int) -> DataFrame:
    """(graph, id, s) of modes(graph, k, node, x): -1 below 0, else 1."""
    return modes.where(F.col("k") == k).select("graph", F.col("node").alias("id"), F.when(F.col("x") < 0, -1).otherwise(1).alias("s"))


def replica_clusters(edges: DataFrame, graphs: DataFrame, n: int) -> DataFrame:
    """(graph, root, size): components of each replica, isolated nodes among them; one search for all replicas."""
    number = lambda c: F.col("graph") * n + F.col(c)
    nodes = graphs.select("graph", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("id")).select(number("id").alias("id"))
    found = C.components(edges.select(number("src").alias("src"), number("dst").alias("dst")), nodes)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.select(F.expr(f"root div {n}").alias("graph"), (F.col("root") % n).alias("root"), "size")


def cluster_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, root, size): by p["of"], clusters of positive links ("links") or of equal signs of mode p["number"] ("mode")."""
    e, n = disordered(spark, p, first, count)
    graphs = spark.range(first, first + count).select(F.col("id").alias("graph"))
    if p.get("of", "mode") == "links":
        inside = e.where("w > 0")
    else:
        number = p.get("number", 0)
        s = C.saved(mode_signs(SP.eigen(laplacians(e, n), number + 1), number))
        ends = e.join(s.select("graph", F.col("id").alias("src"), F.col("s").alias("a")), ["graph", "src"])
        inside = ends.join(s.select("graph", F.col("id").alias("dst"), F.col("s").alias("b")), ["graph", "dst"]).where("a = b")
    return replica_clusters(inside, graphs, n).withColumnRenamed("graph", "replica")


def percolation_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, pinf, spread) of the positive links' clusters."""
    return order(cluster_kernel(spark, p | {"of": "links"}, first, count), ["replica"])


def order(clusters: DataFrame, by: list[str]) -> DataFrame:
    """(by, pinf, spread) of clusters(by, size): the largest one's share, and the mean size that a node of the others sees."""
    size = F.col("size")
    s = clusters.groupBy(*by).agg(F.max(size).alias("m"), F.sum(size).alias("n"), F.sum(size * size).alias("q"))
    others = (F.col("q") - F.col("m") * F.col("m")) / F.nullif(F.col("n") - F.col("m"), F.lit(0))
    return s.select(*by, (F.col("m") / F.col("n")).alias("pinf"), F.coalesce(others, F.lit(0.0)).alias("spread"))


def size_distribution(clusters: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, cnt): clusters of all replicas by their size."""
    return clusters.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("cnt"))


def value_distribution(table: DataFrame, bins: int = 500) -> DataFrame:
    """(bin, center, cnt) of the eigenvalues of all replicas."""
    return S.linear_histogram(table, "ev", bins)


def mode_distribution(table: DataFrame, k: int, bins: int = 500) -> DataFrame:
    """(side, bin, center, cnt) of the k-th modes' entries of all replicas, by logarithmic bins on either side of 0."""
    return S.symlog_histogram(table.where(F.col("k") == k), "x", bins)


def _runs(spark: SparkSession, p: dict, first: int, count: int, modes: int, work, schema: str) -> DataFrame:
    """work(replica, edges, modes, n) for each replica, in a task of its own; modes is (number, n)."""
    e, n = disordered(spark, p, first, count)
    e = C.saved(e)
    basis = SP.eigen(laplacians(e, n), modes).select("graph", "k", "node", "x")

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        v = right.sort_values(["k", "node"])["x"].to_numpy().reshape(-1, n)
        g = left.sort_values(["src", "dst"])
        rows = work(int(key[0]), D.Adjacency(n, g["src"].to_numpy(), g["dst"].to_numpy(), g["w"].to_numpy()), v)
        return pd.DataFrame([(int(key[0]), *r) for r in rows], columns=[x.split()[0] for x in schema.split(", ")])

    return e.groupBy("graph").cogroup(basis.groupBy("graph")).applyInPandas(one, schema)


def sign_clusters(g: D.Adjacency, s: np.ndarray) -> list[np.ndarray]:
    """Clusters of linked nodes with equal signs, largest first, then by least node."""
    f = C.Forest(g.n)
    for i, j in zip(g.i.tolist(), g.to.tolist(), strict=True):
        if i < j and s[i] == s[j]:
            f.join(i, j)
    root = np.array([f.find(i) for i in range(g.n)])
    members = [np.flatnonzero(root == r) for r in np.unique(root)]
    return sorted(members, key=lambda c: (-len(c), c[0]))


def mode_ising_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, step, metric, value): disorder, its mode p["number"], that mode's sign clusters, then Ising dynamics.

    The run starts from the mode's signs and records the mean spins of the
    p["clusters"] largest clusters. Settings: temperature, sweeps, update.
    """
    number, most = p.get("number", 0), p.get("clusters", 5)

    def work(replica: int, g: D.Adjacency, v: np.ndarray) -> list[tuple]:
        mode = v[number]
        own = sign_clusters(g, np.where(mode < 0, -1, 1))[:most]
        rng = np.random.default_rng([p.get("seed", 0), replica])
        return D.ising_series(g, rng, temperature=p["temperature"], sweeps=p.get("sweeps", 5), update=p.get("update", "sequential"), clusters=own, mode=mode)[0]

    return _runs(spark, p, first, count, number + 1, work, "replica long, step int, metric string, value double")


def match_rows(s: np.ndarray, basis: np.ndarray) -> Iterator[tuple[int, float, float]]:
    """(k, overlap, matching) of spins with the signs of their sums of the first k + 1 components, for all k but the last."""
    run = np.cumsum((basis @ s)[:, None] * basis, axis=0)
    for k in range(len(basis) - 1):
        q = float((np.where(run[k] < 0, -1, 1) * s).mean())
        yield k, q, abs(q) / 2 + 0.5


def reconstruction_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """(replica, k, overlap, matching): spins after an Ising run, rebuilt from the lowest modes of their own graph.

    The basis has p["modes"] modes (all by default), from p["start"] on, every
    p["step"]-th. Settings of the run: temperature, sweeps, update, start of
    the spins ("uniform", "up", "delta", or "mode_k" for the signs of mode k).
    """
    init = p.get("spins", "uniform")
    wanted = p.get("modes")

    def work(replica: int, g: D.Adjacency, v: np.ndarray) -> list[tuple]:
        rng = np.random.default_rng([p.get("seed", 0), replica])
        mode = v[int(init[5:])] if init.startswith("mode_") else None
        settings = dict(temperature=p["temperature"], sweeps=p.get("sweeps", 5), update=p.get("update", "sequential"), mode=mode)
        s = D.ising_series(g, rng, **settings, start="uniform" if mode is not None else init)[1]
        return list(match_rows(s.astype(float), v[p.get("start", 0) : wanted : p.get("step", 1)]))

    _, n = disordered(spark, p, 0, 1)
    return _runs(spark, p, first, count, n if wanted is None else wanted, work, "replica long, k int, overlap double, matching double")


# --- queries -------------------------------------------------------------------

_SALTED = "CASE WHEN {h} % 1000 < {share} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


def _edges_sql(edges: str, replicas: int, p: float) -> str:
    w = _SALTED.format(h=H.edge_hash_sql("src", "dst", "graph"), share=1000 * p)
    return f"SELECT graph, src, dst, {w} AS w FROM ({edges}) CROSS JOIN range({replicas}) r(graph)"


def _plane_sql(side: int) -> str:
    from .common import square_sql

    return square_sql(side)


def _cube_sql(side: int) -> str:
    s = side
    return f"""SELECT least(a, b) AS src, greatest(a, b) AS dst FROM (
  SELECT id AS a, unnest([(((id // {s * s}) + 1) % {s}) * {s * s} + id % {s * s}, (id // {s * s}) * {s * s} + ((id // {s}) % {s} + 1) % {s} * {s} + id % {s},
    (id // {s}) * {s} + (id % {s} + 1) % {s}]) AS b FROM range({s**3}) t(id)) GROUP BY 1, 2"""


def _moments_sql(edges: str) -> str:
    """Traces of the second and fourth power of each replica's signed Laplacian."""
    return f"""WITH e AS ({edges}),
l AS (SELECT graph, i, j, sum(v) AS v FROM (SELECT graph, src AS i, dst AS j, -w AS v FROM e UNION ALL SELECT graph, dst, src, -w FROM e
      UNION ALL SELECT graph, src, src, abs(w) FROM e UNION ALL SELECT graph, dst, dst, abs(w) FROM e) GROUP BY 1, 2, 3),
q AS (SELECT a.graph, a.i, b.j, sum(a.v * b.v) AS v FROM l a JOIN l b ON a.graph = b.graph AND a.j = b.i GROUP BY 1, 2, 3),
t AS (SELECT graph, sum(v * v) AS second FROM l GROUP BY 1), f AS (SELECT graph, sum(v * v) AS fourth FROM q GROUP BY 1)
SELECT t.graph AS replica, round(second, 3) AS second, round(fourth, 3) AS fourth FROM t JOIN f ON t.graph = f.graph"""


def _clusters_sql(edges: str, n: int, replicas: int) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), b AS (SELECT graph, src AS i, dst AS j FROM e WHERE w > 0 UNION ALL SELECT graph, dst, src FROM e WHERE w > 0),
r AS (SELECT graph, id, id AS x FROM range({n}) t(id) CROSS JOIN range({replicas}) g(graph) UNION SELECT r.graph, r.id, b.j FROM r JOIN b ON r.graph = b.graph AND r.x = b.i),
c AS (SELECT graph, id, min(x) AS root FROM r GROUP BY 1, 2), z AS (SELECT graph, root, count(*) AS size FROM c GROUP BY 1, 2) """


_COUNTED = "SELECT size, count(*) AS cnt FROM z GROUP BY 1"
_ORDERED = """SELECT graph AS replica, round(max(size) / sum(size), 6) AS pinf,
  round(coalesce((sum(size * size) - max(size) * max(size)) / nullif(sum(size) - max(size), 0), 0), 6) AS spread FROM z GROUP BY 1"""
_ER = f"SELECT e.graph, e.src, e.dst, {_SALTED.format(h=H.edge_hash_sql('src', 'dst', 'graph'), share=200)} AS w FROM (SELECT a.id AS src, b.id AS dst, g.graph FROM range(40) a(id) JOIN range(40) b(id) ON a.id < b.id CROSS JOIN range(4) g(graph)) e WHERE {H.edge_hash_sql('src', 'dst', '(graph + 500000)')} % 1000 < 150"


def _moments(table: DataFrame) -> DataFrame:
    own = table.groupBy("replica").agg(F.sum(F.pow("ev", 2)).alias("a"), F.sum(F.pow("ev", 4)).alias("b"))
    return own.select("replica", F.round("a", 3).alias("second"), F.round("b", 3).alias("fourth"))


def spectrum_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and fourth moments of the spectra of four replicas, held against traces of matrix powers."""
    return _moments(spectrum_kernel(spark, {"side": 8, "p": 0.15}, 0, 4))


def spectrum_sweep_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spectrum_kernel(spark, {"geo": "sc", "side": 4, "p": 0.3}, 0, 3))


def spectrum_sweep_er(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spectrum_kernel(spark, {"geo": "er", "side": 40, "link": 0.15, "p": 0.2}, 0, 4))


def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_distribution(cluster_kernel(spark, {"side": 12, "p": 0.55, "of": "links"}, 0, 3), [])


def order_sweep_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percolation_kernel(spark, {"geo": "sc", "side": 5, "p": 0.75}, 0, 4)
    return out.select("replica", r6(F.col("pinf")).alias("pinf"), r6(F.col("spread")).alias("spread"))


def mode_ising_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy per link of the start: without disorder the lowest mode is constant, so all links are satisfied."""
    rows = mode_ising_kernel(spark, {"side": 6, "p": 0.0, "temperature": 0.0, "sweeps": 2}, 0, 2)
    return rows.where("step = 0").select("replica", "metric", r6(F.abs("value")).alias("size"))


def reconstruction_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spins up are the lowest mode alone where nothing is disordered: every prefix rebuilds them."""
    rows = reconstruction_kernel(spark, {"side": 4, "p": 0.0, "temperature": 0.0, "sweeps": 1, "spins": "up", "modes": 6}, 0, 2)
    return rows.select("replica", "k", r6(F.abs("overlap")).alias("overlap"), r6(F.col("matching")).alias("matching"))


QUERIES = {
    f.__name__: f for f in (spectrum_sweep, spectrum_sweep_3d, spectrum_sweep_er, cluster_sweep, order_sweep_3d, mode_ising_start, reconstruction_start)
}
SQL = {
    "spectrum_sweep": _moments_sql(_edges_sql(_plane_sql(8), 4, 0.15)),
    "spectrum_sweep_3d": _moments_sql(_edges_sql(_cube_sql(4), 3, 0.3)),
    "spectrum_sweep_er": _moments_sql(_ER),
    "cluster_sweep": _clusters_sql(_edges_sql(_plane_sql(12), 3, 0.55), 144, 3) + _COUNTED,
    "order_sweep_3d": _clusters_sql(_edges_sql(_cube_sql(5), 4, 0.75), 125, 4) + _ORDERED,
    "mode_ising_start": "SELECT r AS replica, m AS metric, 1.0::DOUBLE AS size FROM range(2) t(r) CROSS JOIN (VALUES ('magnetisation'), ('cluster_0'), ('overlap'), ('energy')) v(m)",
    "reconstruction_start": "SELECT r AS replica, CAST(k AS INTEGER) AS k, 1.0::DOUBLE AS overlap, 1.0::DOUBLE AS matching FROM range(2) t(r) CROSS JOIN range(5) u(k)",
}
