"""Proteins in the modes of named graphs: bases by topology, composed features, inverses and error curves.

atoms(pdb_id, idx, residue, x, y, z) has one row per residue, features(pdb_id, k, v)
one per value, a basis is modes(k, node, x). All proteins go through one basis
together, as joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import lattices as L
from . import graph as G
from . import protein as PR
from . import spectral as SP

#: fixed values: names of topologies, the shares of their links that are negative or rewired, and rules of links
FLIPPED = {"l2d_square": 0.0, "l2d_hex": 0.0, "l2d_anti_tri": 1.0, "l3d": 0.0, "l3d_sg": 0.35, "er": 0.0, "er_sg": 0.35, "er_dense": 0.0, "l2d_sqr_rew": 0.0}
REWIRED = 0.1
#: fixed values: (least, most, links a node) of a random graph's probability of a link
LINKS = {"er": (0.005, 0.02, 10.0), "er_sg": (0.005, 0.02, 10.0), "er_dense": (0.02, 0.1, 50.0)}
#: fixed values: order of secondary structure and of residues in composed features
STRUCTURES = ["H", "E", "C"]
RESIDUES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]


def topology(spark: SparkSession, name: str, dof: int) -> L.Graph:
    """The named graph with dof nodes at least (random graphs: exactly), its disorder by hashes."""
    if name not in FLIPPED:
        raise ValueError(f"name must be one of {sorted(FLIPPED)}")
    side = math.isqrt(dof - 1) + 1 if dof > 1 else 1
    if name in LINKS:
        least, most, links = LINKS[name]
        g = L.erdos_renyi(spark, dof, max(least, min(most, links / dof)), salt=42)
    elif name.startswith("l3d"):
        edge = next(s for s in range(1, dof + 1) if s**3 >= dof)
        g = L.cubic(spark, (edge, edge, edge))
    elif name == "l2d_hex":
        g = L.hexagonal(spark, side + side % 2, side + side % 2)
    elif name == "l2d_anti_tri":
        g = L.triangular(spark, side + side % 2, side + side % 2)
    else:
        g = L.square(spark, side)
        g = L.rewire(g, REWIRED, salt=42) if name == "l2d_sqr_rew" else g
    share = FLIPPED[name]
    edges = g.edges.withColumn("w", -F.col("w")) if share == 1.0 else G.flip_hash(g.edges, share, salt=43)
    return L.Graph(name, g.n, g.coordination, g.nodes, edges)


def basis(spark: SparkSession, name: str, dof: int, modes: int | None = None) -> DataFrame:
    """modes(k, node, x) of the named graph's signed Laplacian, all or the lowest ones."""
    g = topology(spark, name, dof)
    every = G.laplacian(g.edges).unionByName(g.nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")))
    return SP.eigen(every, modes).select("k", "node", "x")


def flat(atoms: DataFrame) -> DataFrame:
    """features(pdb_id, k, v): coordinates one after another."""
    rows = atoms.select("pdb_id", "idx", F.posexplode(F.array("x", "y", "z")).alias("axis", "v"))
    return rows.select("pdb_id", (F.col("idx") * 3 + F.col("axis")).alias("k"), "v")


def coordinate_scales(atoms: DataFrame, n: int = 1024) -> DataFrame:
    """(pdb_id, residues, step, scale, mx, my, mz): what PR.coordinate_features divided by, left out and took off."""
    means = atoms.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("residues"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    both = flat(PR.centred(atoms)).join(means, "pdb_id")
    step = F.greatest(F.lit(1), F.expr(f"3 * residues div {n}"))
    kept = both.withColumn("step", step).where((F.col("k") % F.col("step") == 0) & (F.expr("k div step") < n))
    return kept.groupBy("pdb_id", "residues", "step", "mx", "my", "mz").agg(F.max(F.abs("v")).alias("scale"))


def coordinates(features: DataFrame, scales: DataFrame, n: int = 1024) -> DataFrame:
    """atoms(pdb_id, idx, x, y, z) from features(pdb_id, k, v): values left out take the nearest kept one's, the lower of two.

    Features missing at the end count as not kept; proteins without scales have 10 residues at the origin.
    """
    own = scales.withColumn("kept", F.least(F.lit(n), F.ceil(3 * F.col("residues") / F.col("step"))))
    last = features.groupBy("pdb_id").agg(F.max("k").alias("last"))
    own = own.join(last, "pdb_id").withColumn("kept", F.least("kept", F.col("last") + 1))
    places = own.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col("residues") - 1)))
    below = F.least(F.expr("at div step"), F.col("kept") - 1)
    nearer = (F.col("at") - below * F.col("step") <= (below + 1) * F.col("step") - F.col("at")) | (below + 1 >= F.col("kept"))
    wanted = places.withColumn("k", F.when(nearer, below).otherwise(below + 1).cast("long"))
    axis = F.col("at") % 3
    mean = F.when(axis == 0, F.col("mx")).when(axis == 1, F.col("my")).otherwise(F.col("mz"))
    values = wanted.join(features, ["pdb_id", "k"], "left").select("pdb_id", F.expr("at div 3").alias("idx"), axis.alias("axis"), (F.coalesce("v", F.lit(0.0)) * F.col("scale") + mean).alias("v"))
    found = values.groupBy("pdb_id", "idx").agg(*[F.max(F.when(F.col("axis") == a, F.col("v"))).alias(c) for a, c in enumerate("xyz")])
    nothing = features.select("pdb_id").distinct().join(scales, "pdb_id", "left_anti")
    origin = [F.lit(0.0).alias(c) for c in "xyz"]
    return found.unionByName(nothing.select("pdb_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("idx"), *origin))


def _each(atoms: DataFrame, compose: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """features(pdb_id, k, v) of one protein a task; atoms with a column ss of secondary structure."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = compose(pdf.sort_values("idx"))
        return pd.DataFrame({"pdb_id": pdf["pdb_id"].iloc[0], "k": np.arange(len(v)), "v": v})

    return atoms.groupBy("pdb_id").applyInPandas(work, "pdb_id string, k long, v double")


def _shares(values: pd.Series, names: list[str]) -> np.ndarray:
    return np.array([(values == x).sum() for x in names], float) / max(1, len(values))


def _shape(q: np.ndarray) -> tuple[float, np.ndarray]:
    """Radius of gyration, and the variances along the principal axes, falling (of three points at least)."""
    spread = np.sort(np.linalg.eigvalsh(np.cov(q.T)))[::-1] if len(q) > 2 else np.zeros(0)
    return float(np.sqrt((q**2).sum(1).mean())), spread


def enhanced_features(atoms: DataFrame, n: int = 1024) -> DataFrame:
    """Three quarters centred coordinates (spread evenly if there are more), then shares of structures and residues,
    gyration / 50 and the principal variances over the greatest; all by the greatest size. n is 108 at least."""
    room = int(n * 0.75)
    if n - room < 27:
        raise ValueError("n must be 108 at least")

    def compose(pdf: pd.DataFrame) -> np.ndarray:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        q = p - p.mean(0)
        line = q.ravel()
        out = np.zeros(n)
        own = line if len(line) <= room else line[np.linspace(0, len(line) - 1, room, dtype=int)]
        out[: len(own)] = own
        gyration, spread = _shape(q)
        rest = np.concatenate([_shares(pdf["ss"], STRUCTURES), _shares(pdf["residue"], RESIDUES), [gyration / 50], spread / (spread[0] + 1e-8) if len(spread) else []])
        out[room : room + len(rest)] = rest
        return out / (np.abs(out).max() or 1.0)

    return _each(atoms, compose)


def comprehensive_features(atoms: DataFrame, n: int = 1024, contact: float = 8.0) -> DataFrame:
    """The first n / 2 distances of pairs, shares of residues and structures, gyration, asphericity, principal variances
    and contact density; cut or filled with 0 to n, by the greatest value if that is over 0. Contacts of a residue with itself count."""

    def compose(pdf: pd.DataFrame) -> np.ndarray:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        q, m = p - p.mean(0), len(p)
        near, distances, left = m, [], n // 2
        for i in range(m):
            d = np.sqrt(((q[i + 1 :] - q[i]) ** 2).sum(1))
            near += 2 * int((d < contact).sum())
            distances.append(d[:left])
            left -= len(distances[-1])
        gyration, spread = _shape(q)
        shape = [gyration] + ([spread[0] - (spread[1] + spread[2]) / 2, *spread] if len(spread) else [])
        every = np.concatenate([*distances, _shares(pdf["residue"], RESIDUES), _shares(pdf["ss"], STRUCTURES), shape, [near / (m * (m - 1)) if m > 1 else 0.0]])
        out = np.zeros(n)
        out[: min(n, len(every))] = every[:n]
        return out / out.max() if out.max() > 0 else out

    return _each(atoms, compose)


def with_structure(atoms: DataFrame) -> DataFrame:
    """atoms with a column ss."""
    return atoms.join(PR.secondary_structure(atoms), ["pdb_id", "idx"])


def in_range(atoms: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Atoms of proteins with least to most residues."""
    size = atoms.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n"))
    ok = F.lit(True) if least is None else F.col("n") >= least
    ok = ok if most is None else ok & (F.col("n") <= most)
    return atoms.join(size.where(ok).select("pdb_id"), "pdb_id", "left_semi")


def fixed_reconstruction(spark: SparkSession, atoms: DataFrame, name: str, residues: int, modes: int | None = None) -> DataFrame:
    """atoms(pdb_id, idx, x, y, z) rebuilt from the lowest modes of the named graph for ``residues`` residues.

    Proteins are cut or filled with their centroid first, and come back with the residues that they had, residues at most.
    """
    whole = PR.padded(atoms, residues)
    n = 3 * residues
    rebuilt = PR.reconstruct(PR.coordinate_features(whole, n), basis(spark, name, n), modes)
    size = atoms.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n"))
    back = coordinates(rebuilt.where(F.col("k") < n), coordinate_scales(whole, n), n)
    return back.join(size, "pdb_id").where(F.col("idx") < F.col("n")).drop("n")


def error_curves(features: DataFrame, modes: DataFrame, points: int = 100) -> DataFrame:
    """(pdb_id, used, mse): mean square error of features rebuilt from the first ``used`` modes, at about ``points`` numbers of modes.

    Missing features are 0, those beyond the basis are left out. The modes are
    orthonormal, so the error is what the unused coefficients hold.
    """
    n, m = modes.agg(F.countDistinct("node"), F.max("k") + 1).first()
    inside = features.where(F.col("k") < n)
    c = inside.join(modes.select(F.col("k").alias("mode"), F.col("node").alias("k"), "x"), "k").groupBy("pdb_id", "mode").agg(F.sum(F.col("v") * F.col("x")).alias("c"))
    total = inside.groupBy("pdb_id").agg(F.sum(F.col("v") * F.col("v")).alias("total"))
    before = F.coalesce(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("pdb_id").orderBy("mode").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    used = c.withColumn("held", before).where(F.col("mode") % max(1, m // points) == 0)
    return used.join(total, "pdb_id").select("pdb_id", F.col("mode").alias("used"), (F.greatest(F.lit(0.0), F.col("total") - F.col("held")) / n).alias("mse"))


def curves_by_topology(spark: SparkSession, atoms: DataFrame, names: list[str], least: int | None = None, most: int | None = None, size: int | None = None, points: int = 100) -> DataFrame:
    """(topology, pdb_id, used, mse) of proteins in a range of residues; bases for the largest of them, or of ``size`` features."""
    own, out = in_range(atoms, least, most), None
    dof = size or 3 * (own.groupBy("pdb_id").count().agg(F.max("count")).first()[0] or 1)
    for name in names:
        one = error_curves(flat(own), basis(spark, name, dof), points).withColumn("topology", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("topology", "pdb_id", "used", "mse")
