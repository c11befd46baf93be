"""Protein coordinates as features and back. atoms(pdb_id, idx, residue, x, y, z), one row per residue."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance_features(atoms: DataFrame, n: int = 784) -> DataFrame:
    """(pdb_id, k, v): distances of pairs i < j in row order, the first n, divided by the greatest; missing ones 0."""
    a = atoms.select("pdb_id", F.col("idx").alias("i"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    size = atoms.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("m"))
    # only rows that can hold one of the first n pairs meet others
    k = F.expr("i * m - i * (i + 1) div 2 + j - i - 1")
    b = atoms.select("pdb_id", F.col("idx").alias("j"), "x", "y", "z")
    d = a.join(size, "pdb_id").where(F.expr(f"i * m - i * (i + 1) div 2 < {n}")).join(b, "pdb_id").where("i < j").withColumn("k", k).where(F.col("k") < n).select("pdb_id", "k", F.sqrt(F.pow(F.col("xa") - F.col("x"), 2) + F.pow(F.col("ya") - F.col("y"), 2) + F.pow(F.col("za") - F.col("z"), 2)).alias("d"))
    top = d.groupBy("pdb_id").agg(F.max("d").alias("top"))
    every = size.select("pdb_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    return every.join(d.withColumn("k", F.col("k").cast("long")), ["pdb_id", "k"], "left").join(top, "pdb_id", "left").select("pdb_id", "k", F.coalesce(F.col("d") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)).alias("v"))


def centred(atoms: DataFrame) -> DataFrame:
    w = Window.partitionBy("pdb_id")
    return atoms.select("pdb_id", "idx", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in "xyz"])


def coordinate_features(atoms: DataFrame, n: int = 1024) -> DataFrame:
    """(pdb_id, k, v): centred coordinates row by row, scaled by the greatest size and padded with 0.

    Of m values over n, every (m div n)-th is taken from the first on, n in all.
    """
    axes = centred(atoms).select("pdb_id", F.posexplode(F.array("x", "y", "z")).alias("axis", "v"), "idx")
    c = axes.select("pdb_id", (F.col("idx") * 3 + F.col("axis")).alias("at"), "v")
    w = Window.partitionBy("pdb_id")
    step = F.greatest(F.lit(1), F.expr(f"m div {n}"))
    s = c.withColumn("m", F.count(F.lit(1)).over(w)).withColumn("step", step)
    s = s.where((F.col("at") % F.col("step") == 0) & (F.expr("at div step") < n)).withColumn("top", F.max(F.abs("v")).over(w))
    scaled = F.coalesce(F.col("v") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0))
    own = s.select("pdb_id", F.expr("at div step").alias("k"), scaled.alias("v"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    every = atoms.select("pdb_id").distinct().select("pdb_id", places.alias("k"))
    return every.join(own, ["pdb_id", "k"], "left").select("pdb_id", "k", F.coalesce("v", F.lit(0.0)).alias("v"))


def secondary_structure(atoms: DataFrame) -> DataFrame:
    """(pdb_id, idx, ss): by the mean of the turns at a residue and at the next one.

    A turn is the angle between the steps to and from a residue, so 0 on a
    straight line. A mean under 60 degrees is E, over 120 H, else C; the first
    two and the last two residues are C. Then a residue between two that agree
    and aren't C takes theirs.
    """
    w = Window.partitionBy("pdb_id").orderBy("idx")
    step = [(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in "xyz"]
    count = F.count(F.lit(1)).over(Window.partitionBy("pdb_id"))
    steps = atoms.select("pdb_id", "idx", *step, (F.row_number().over(w) - 1).alias("place"), count.alias("n"))
    # a step of no length turns by a right angle
    steps = steps.withColumn("size", F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))) + 1e-8)
    dot = sum((F.lag(f"d{c}").over(w) * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))
    cosine = dot / (F.lag("size").over(w) * F.col("size"))
    turns = steps.withColumn("turn", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    mean = turns.withColumn("mean", (F.col("turn") + F.lead("turn").over(w)) / 2)
    inner = (F.col("place") >= 2) & (F.col("place") <= F.col("n") - 3)
    kind = F.when(inner & (F.col("mean") < math.pi / 3), "E").when(inner & (F.col("mean") > 2 * math.pi / 3), "H").otherwise("C")
    raw = mean.select("pdb_id", "idx", kind.alias("ss"))
    before, after = F.lag("ss").over(w), F.lead("ss").over(w)
    return raw.select("pdb_id", "idx", F.when((before == after) & (before != "C"), before).otherwise(F.col("ss")).alias("ss"))


def summary(atoms: DataFrame, contact: float = 8.0) -> DataFrame:
    """(pdb_id, residues, gyration, contact_density, asphericity): contacts are pairs nearer than contact, of all pairs."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        q = p - p.mean(0)
        n = len(p)
        near = sum(int((((p[i + 1 :] - p[i]) ** 2).sum(1) < contact**2).sum()) for i in range(n))
        e = np.linalg.eigvalsh(q.T @ q / n)
        return pd.DataFrame([(pdf["pdb_id"].iloc[0], n, float(np.sqrt((q**2).sum() / n)), near / max(1, n * (n - 1) // 2), float(e[2] - (e[0] + e[1]) / 2))], columns=["pdb_id", "residues", "gyration", "contact_density", "asphericity"])

    return atoms.groupBy("pdb_id").applyInPandas(work, "pdb_id string, residues long, gyration double, contact_density double, asphericity double")


def padded(atoms: DataFrame, residues: int) -> DataFrame:
    """Exactly residues rows per protein: cut, or filled with the centroid."""
    c = atoms.groupBy("pdb_id").agg(*[F.avg(x).alias(f"m{x}") for x in "xyz"])
    every = c.select("pdb_id", *[f"m{x}" for x in "xyz"], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(residues - 1).cast("long"))).alias("idx"))
    return every.join(atoms.select("pdb_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z"), ["pdb_id", "idx"], "left").select("pdb_id", "idx", *[F.coalesce(x, f"m{x}").alias(x) for x in "xyz"])


def reconstruct(features: DataFrame, basis: DataFrame, modes: int | None = None) -> DataFrame:
    """(pdb_id, k, v): features(pdb_id, k, v) projected on the first modes of an orthonormal basis(k, node, x) and summed again."""
    b = basis if modes is None else basis.where(F.col("k") < modes)
    own = b.select(F.col("k").alias("mode"), F.col("node").alias("k"), "x")
    c = features.join(own, "k").groupBy("pdb_id", "mode").agg(F.sum(F.col("v") * F.col("x")).alias("c"))
    return c.join(own, "mode").groupBy("pdb_id", "k").agg(F.sum(F.col("c") * F.col("x")).alias("v"))


def nearest_fill(kept: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, v): for each wanted(at) the value of the nearest kept(at, v), the lower one of two; an as-of join both ways by windows."""
    rows = kept.select("at", "v", F.lit(1).alias("own")).unionByName(wanted.select("at", F.lit(None).cast("double").alias("v"), F.lit(0).alias("own")))
    before, after = Window.orderBy("at", F.col("own").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("at", "own").rowsBetween(0, Window.unboundedFollowing)
    p = F.when(F.col("own") == 1, F.struct("at", "v"))
    near = rows.withColumn("a", F.last(p, True).over(before)).withColumn("b", F.first(p, True).over(after)).where("own = 0")
    return near.select("at", F.when(F.col("b").isNull() | (F.col("at") - F.col("a.at") <= F.col("b.at") - F.col("at")), F.col("a.v")).otherwise(F.col("b.v")).alias("v"))


def bandpass(series: DataFrame, low: float, high: float, rate: float, order: int = 4) -> DataFrame:
    """(id, t, v): zero-phase Butterworth band-pass of series(id, t, v), applied in the frequency domain; one task per id."""
    if not 0 < low < high < rate / 2 or order < 1:
        raise ValueError("0 < low < high < rate / 2 and order >= 1 are needed")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = pdf["v"].to_numpy(float)
        pad = min(len(v) - 1, 3 * (2 * order + 1))
        ext = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]) if pad > 0 else v
        warp = lambda f: np.tan(np.pi * f / rate)
        f = np.fft.rfftfreq(len(ext), 1 / rate)
        with np.errstate(divide="ignore"):
            o = warp(np.minimum(f, rate / 2 * (1 - 1e-12)))
            q = (o**2 - warp(low) * warp(high)) / (o * (warp(high) - warp(low)))
        gain = np.where(f == 0, 0.0, 1 / (1 + q ** (2 * order)))
        out = np.fft.irfft(np.fft.rfft(ext) * gain, len(ext))[pad : pad + len(v)]
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "v": out})

    return series.groupBy("id").applyInPandas(work, "id long, t long, v double")
