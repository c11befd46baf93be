"""Spectra, entropy over scales, distances, linkage and basis reconstruction.

A dense eigenproblem is one task's work (up to DENSE nodes); everything after
it is tables: spectrum(k, ev), modes(k, node, x). Larger graphs have their
lowest modes by iteration of tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import saved
from .graph import laplacian, matvec

DENSE = 4096


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids, flat = np.unique(pdf[["i", "j"]].to_numpy().ravel(), return_inverse=True)
    if len(ids) > DENSE:
        raise ValueError(f"{len(ids)} nodes are more than the {DENSE} of the dense path; use sparse_modes")
    at = flat.reshape(-1, 2)
    a = np.zeros((len(ids), len(ids)))
    np.add.at(a, (at[:, 0], at[:, 1]), pdf["v"].to_numpy(float))
    return ids, (a + a.T) / 2


def _one(matrix: DataFrame) -> DataFrame:
    """The matrix with a key that holds it together."""
    return matrix if "graph" in matrix.columns else matrix.withColumn("graph", F.col("i") * 0)


def eigen(matrix: DataFrame, k: int | None = None) -> DataFrame:
    """(graph, k, ev, node, x): modes of symmetric matrices(i, j, v), by rising eigenvalue; a task for each graph.

    A mode's sign is that of its greatest entry, the first one of equals.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, a = _dense(pdf)
        ev, v = np.linalg.eigh(a)
        m = len(ev) if k is None else min(k, len(ev))
        v = v[:, :m] * np.where(v[np.abs(v).round(9).argmax(0)[:m], np.arange(m)] < 0, -1.0, 1.0)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "k": np.repeat(np.arange(m), len(ids)), "ev": np.repeat(ev[:m], len(ids)), "node": np.tile(ids, m), "x": v.T.ravel()})

    return _one(matrix).groupBy("graph").applyInPandas(work, "graph long, k int, ev double, node long, x double")


def spectrum(matrix: DataFrame) -> DataFrame:
    """(graph, k, ev): eigenvalues alone."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ev = np.linalg.eigvalsh(_dense(pdf)[1])
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "k": np.arange(len(ev)), "ev": ev})

    return _one(matrix).groupBy("graph").applyInPandas(work, "graph long, k int, ev double")


def extreme_mode(matrix: DataFrame, shift: float, rounds: int = 200, tolerance: float = 1e-9, every: int = 10) -> tuple[float, DataFrame]:
    """The mode of the least eigenvalue by power iteration of shift - matrix, as joins; shift bounds the spectrum from above.

    Works at any size: a round is one join and one aggregation; the vector is
    written out every few rounds.
    """
    nodes = matrix.select(F.col("i").alias("id")).distinct()
    x = saved(nodes.withColumn("x", F.cos(F.col("id").cast("double") * 1.7) + 1.3))
    m = saved(matrix)
    last = None
    for step in range(rounds):
        y = x.join(matvec(m, x).withColumnRenamed("x", "y"), "id", "left").select("id", "x", (shift * F.col("x") - F.coalesce("y", F.lit(0.0))).alias("z"))
        y = saved(y) if step % every == every - 1 or step == 0 else y
        if step % every == every - 1:
            n, xz, xx = y.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))), F.sum(F.col("x") * F.col("z")), F.sum(F.col("x") * F.col("x"))).first()
            value = shift - xz / xx
            x = saved(y.select("id", (F.col("z") / n).alias("x")))
            if last is not None and abs(value - last) < tolerance * max(1.0, abs(shift)):
                return value, x
            last = value
        else:
            x = y.select("id", (F.col("z") / shift).alias("x"))
    return last if last is not None else float("nan"), x


def _times(matrix: DataFrame, x: DataFrame, m: int) -> DataFrame:
    """x with a column y = matrix @ x, for blocks x(id, x array of m, ...); one join and one aggregation for all m vectors."""
    own = matrix.join(x.select(F.col("id").alias("j"), F.col("x").alias("other")), "j")
    sums = own.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("v") * F.col("other")[c]) for c in range(m)]).alias("y"))
    nothing = F.array(*[F.lit(0.0)] * m)
    return x.join(sums, "id", "left").withColumn("y", F.coalesce("y", nothing))


def _turned(column: str, by: np.ndarray) -> Column:
    """A block's row times a small matrix."""
    return F.array(*[sum((F.col(column)[a] * float(by[a, b]) for a in range(by.shape[0])), F.lit(0.0)) for b in range(by.shape[1])])


def sparse_modes(matrix: DataFrame, k: int, *, pad: int = 4, degree: int = 12, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(k, ev, residual, node, x): the k lowest modes of a symmetric matrix(i, j, v) of any size.

    Subspace iteration of k + pad vectors with Chebyshev filters: a step is a
    join of the matrix with the block of vectors, and only matrices of
    (k + pad)^2 sums reach the driver. Rounds end when all k residuals
    |A x - ev x| are under tolerance times the bound of the spectrum. A step's
    block is written out, since the next one reads it twice. A mode's sign is
    that of its greatest entry, the least node of equals.
    """
    a = saved(matrix.groupBy("i", "j").agg(F.sum("v").alias("v")))
    nodes = a.select(F.col("i").alias("id")).distinct()
    high = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0] or 1.0
    m = min(k + pad, nodes.count())
    k = min(k, m)
    start = [F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 30)) / float(1 << 29) - 1 for c in range(m)]
    x = saved(nodes.select("id", F.array(*start).alias("x")))
    for r in range(rounds):
        both = saved(_times(a, x, m))
        pairs = [(c, d) for c in range(m) for d in range(c, m)]
        sums = both.agg(*[F.sum(F.col("x")[c] * F.col("x")[d]) for c, d in pairs], *[F.sum(F.col("x")[c] * F.col("y")[d]) for c, d in pairs]).first()
        gram, form = np.zeros((m, m)), np.zeros((m, m))
        for n, (c, d) in enumerate(pairs):
            gram[c, d] = gram[d, c] = sums[n]
            form[c, d] = form[d, c] = sums[len(pairs) + n]
        size, base = np.linalg.eigh(gram)
        size = np.maximum(size, size[-1] * 1e-14)
        whiten = base / np.sqrt(size)
        ev, turn = np.linalg.eigh(whiten.T @ form @ whiten)
        turn = whiten @ turn
        both = both.select("id", _turned("x", turn).alias("x"), _turned("y", turn).alias("y"))
        errors = both.agg(*[F.sqrt(F.sum(F.pow(F.col("y")[c] - float(ev[c]) * F.col("x")[c], 2))) for c in range(m)]).first()
        if max(errors[:k]) < tolerance * high or r == rounds - 1 or m == nodes.count():
            break
        # the filter is small between the least unwanted value and the bound, and grows fast below
        low = float(max(ev[-1], ev[0] + 1e-9 * high))
        centre, half = (high + low) / 2, (high - low) / 2
        t = saved(both.select("id", F.col("x").alias("before"), F.transform(F.arrays_zip("x", "y"), lambda z: (z["y"] - centre * z["x"]) / half).alias("x")))
        for _ in range(degree - 1):
            step = F.transform(F.arrays_zip("x", "y", "before"), lambda z: 2 * (z["y"] - centre * z["x"]) / half - z["before"])
            t = saved(_times(a, t, m).select("id", F.col("x").alias("before"), step.alias("x")))
        x = t.select("id", "x")
    rows = both.select(F.col("id").alias("node"), F.posexplode("x").alias("k", "x")).where(F.col("k") < k)
    top = rows.groupBy("k").agg(F.min_by("x", F.struct(-F.round(F.abs("x"), 9), F.col("node"))).alias("top"))
    table = both.sparkSession.createDataFrame([(c, float(ev[c]), float(errors[c])) for c in range(k)], "k int, ev double, residual double")
    signed = rows.join(F.broadcast(top), "k").withColumn("x", F.when(F.col("top") < 0, -F.col("x")).otherwise(F.col("x")))
    return signed.join(F.broadcast(table), "k").select("k", "ev", "residual", "node", "x")


def entropy(spec: DataFrame, taus: DataFrame, floor: float = 2.2e-16) -> DataFrame:
    """(i, tau, s, variance) of spectrum(k, ev) and taus(i, x): s = entropy of exp(-tau ev) / Z over ln N; variance of ev.

    Eigenvalues under the floor count as 0; a weight of 0 adds nothing. Each
    tau meets the whole spectrum: a grid of some hundreds times one graph's N.
    """
    ev = spec.select(F.when(F.abs("ev") < floor, 0.0).otherwise(F.col("ev")).alias("ev"))
    low = ev.agg(F.min("ev").alias("low"), F.count(F.lit(1)).alias("n"))
    j = taus.crossJoin(F.broadcast(ev.crossJoin(low)))
    # weights relative to the greatest one don't overflow
    g = j.select("i", F.col("x").alias("tau"), "ev", "n", F.exp(-F.col("x") * (F.col("ev") - F.col("low"))).alias("w"), (F.col("x") * (F.col("ev") - F.col("low"))).alias("u"))
    z = g.groupBy("i", "tau", "n").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("u")).alias("wu"), F.sum(F.col("w") * F.col("ev")).alias("we"), F.sum(F.col("w") * F.col("ev") * F.col("ev")).alias("wee"))
    return z.select("i", "tau", ((F.log("z") + F.col("wu") / F.col("z")) / F.log(F.col("n").cast("double"))).alias("s"), (F.col("wee") / F.col("z") - F.pow(F.col("we") / F.col("z"), 2)).alias("variance"))


def specific_heat(ent: DataFrame, n: int) -> DataFrame:
    """(i, tau, c): ln N times d(1 - s) / d ln tau between neighbours; tau is their geometric mean."""
    w = Window.orderBy("i")
    d = ent.withColumn("s2", F.lead("s").over(w)).withColumn("t2", F.lead("tau").over(w)).where("s2 IS NOT NULL")
    return d.select("i", F.sqrt(F.col("tau") * F.col("t2")).alias("tau"), (F.lit(float(np.log(n))) * (F.col("s") - F.col("s2")) / (F.log("t2") - F.log("tau"))).alias("c"))


def communicability(matrix: DataFrame, tau: float, signed: bool = False, form: str = "sparse") -> DataFrame:
    """(i, j, d), i < j, of rho = exp(-tau L) / trace.

    Unsigned: the mean of 1 / rho both ways. Signed: sqrt(1 - r / max r)
    ("sparse") or sqrt(max r - r) ("dense") with r = rho.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, a = _dense(pdf)
        ev, v = np.linalg.eigh(a)
        e = np.exp(-tau * (ev - ev.min()))
        rho = (v * (e / e.sum())) @ v.T
        if not signed:
            with np.errstate(divide="ignore"):
                d = 1 / rho
            d = np.maximum(d, d.T)
        else:
            top = rho.max()
            d = np.sqrt(np.maximum(0, 1 - rho / top if form == "sparse" else top - rho))
        i, j = np.triu_indices(len(ids), 1)
        return pd.DataFrame({"i": ids[i], "j": ids[j], "d": d[i, j]})

    return _one(matrix).groupBy("graph").applyInPandas(work, "i long, j long, d double")


def linkage(distances: DataFrame, method: str = "average") -> DataFrame:
    """(step, a, b, height, size) of agglomerative clustering of (i, j, d); method: single, complete, average or ward.

    Leaves are numbered by rising node, merged clusters from their number on.
    One task by the Lance-Williams recurrence, each row's nearest other kept.
    """
    if method not in ("single", "complete", "average", "ward"):
        raise ValueError(method)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(pdf[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        at, n = flat.reshape(-1, 2), len(ids)
        d = np.full((n, n), np.inf)
        d[at[:, 0], at[:, 1]] = d[at[:, 1], at[:, 0]] = pdf["d"].to_numpy(float)
        name, size, alive, rows = list(range(n)), np.ones(n), np.ones(n, bool), []
        # each row's nearest other (the first of equals): only rows that lose theirs are searched again
        near = d.argmin(1)
        least = d[np.arange(n), near]
        for step in range(n - 1):
            x = int(np.argmin(least))
            y = int(near[x])
            x, y = min(x, y), max(x, y)
            h = d[x, y]
            a, b = sorted((name[x], name[y]))
            rows.append((step, a, b, h, int(size[x] + size[y])))
            dx, dy = d[x], d[y]
            with np.errstate(invalid="ignore"):
                if method == "single":
                    new = np.minimum(dx, dy)
                elif method == "complete":
                    new = np.maximum(dx, dy)
                elif method == "average":
                    new = (size[x] * dx + size[y] * dy) / (size[x] + size[y])
                else:
                    t = size[x] + size[y] + size
                    new = np.sqrt(np.maximum(0, ((size[x] + size) * dx**2 + (size[y] + size) * dy**2 - size * h**2) / t))
            alive[y] = False
            size[x] += size[y]
            name[x] = n + step
            d[x], d[:, x] = new, new
            d[y], d[:, y] = np.inf, np.inf
            d[x, ~alive] = d[~alive, x] = np.inf
            d[x, x] = np.inf
            closer = alive & ((d[:, x] < least) | ((d[:, x] == least) & (x < near)))
            lost = np.flatnonzero(alive & ((near == x) | (near == y)))
            near[closer], least[closer] = x, d[closer, x]
            for row in {x, *lost.tolist()}:
                near[row] = d[row].argmin()
                least[row] = d[row, near[row]]
            least[y] = np.inf
        return pd.DataFrame(rows, columns=["step", "a", "b", "height", "size"])

    return distances.withColumn("one", F.col("i") * 0).groupBy("one").applyInPandas(work, "step int, a long, b long, height double, size long")


def cophenetic(link: DataFrame, n: int) -> DataFrame:
    """(i, j, d), i < j: the height at which two leaves first share a cluster."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        members, rows = {k: [k] for k in range(n)}, []
        for r in pdf.sort_values("step").itertuples():
            a, b = members.pop(r.a), members.pop(r.b)
            rows += [(min(x, y), max(x, y), r.height) for x in a for y in b]
            members[n + r.step] = a + b
        return pd.DataFrame(rows, columns=["i", "j", "d"])

    return link.withColumn("one", F.col("step") * 0).groupBy("one").applyInPandas(work, "i long, j long, d double")


def gap_threshold(link: DataFrame, scale: float = 0.9) -> DataFrame:
    """The upper height of the largest logarithmic gap between following merge heights, times scale."""
    w = Window.orderBy("height", "step")
    g = link.withColumn("up", F.lead("height").over(w)).where((F.col("height") > 0) & F.col("up").isNotNull())
    return g.agg((F.max_by("up", F.log10("up") - F.log10("height")) * scale).alias("threshold"))


def layout(modes: DataFrame, dim: int = 2) -> DataFrame:
    """(node, axis, x): modes 1 to dim centred and divided by the greatest size."""
    own = modes.where(F.col("k").between(1, dim)).select("node", (F.col("k") - 1).alias("axis"), "x")
    centred = own.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("axis")))
    top = centred.agg(F.max(F.abs("x")).alias("top"))
    return centred.crossJoin(F.broadcast(top)).select("node", "axis", (F.col("x") / F.col("top")).alias("x"))


def circular_layout(assignment: DataFrame) -> DataFrame:
    """(node, x, y) on a circle in the order of assignment(node, cluster)."""
    k = F.row_number().over(Window.orderBy("cluster", "node")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    a = assignment.withColumn("_a", 2 * np.pi * k / n)
    return a.select("node", F.cos("_a").alias("x"), F.sin("_a").alias("y"))


# --- bases ----------------------------------------------------------------


def coefficients(basis: DataFrame, vector: DataFrame) -> DataFrame:
    """(k, c): products of an orthonormal basis(k, node, x) with vector(node, v)."""
    return basis.join(vector, "node").groupBy("k").agg(F.sum(F.col("x") * F.col("v")).alias("c"))


def prefix_reconstruction(basis: DataFrame, vector: DataFrame) -> DataFrame:
    """(k, node, v): sums of the first k + 1 components, all but the last k: one running sum per node."""
    c = coefficients(basis, vector)
    part = basis.join(c, "k").select("k", "node", (F.col("c") * F.col("x")).alias("p"))
    last = basis.agg(F.max("k").alias("last"))
    run = part.withColumn("v", F.sum("p").over(Window.partitionBy("node").orderBy("k")))
    return run.crossJoin(F.broadcast(last)).where(F.col("k") < F.col("last")).select("k", "node", "v")


def reconstruction_mse(recon: DataFrame, vector: DataFrame) -> DataFrame:
    """(k, mse) after dividing by the greatest value of the longest prefix."""
    top = recon.groupBy("k").agg(F.max("v").alias("m")).agg(F.max_by("m", "k").alias("top"))
    return recon.join(vector.withColumnRenamed("v", "t"), "node").crossJoin(F.broadcast(top)).groupBy("k").agg(F.avg(F.pow(F.col("v") / F.col("top") - F.col("t"), 2)).alias("mse"))


def match_series(recon: DataFrame, spins: DataFrame, symmetric: bool = True) -> DataFrame:
    """(k, overlap, matching) of the sign of each prefix with spins(node, s)."""
    j = recon.join(spins, "node").select("k", F.when(F.col("v") < 0, -1).otherwise(1).alias("a"), "s")
    q = F.avg(F.col("a") * F.col("s"))
    return j.groupBy("k").agg(q.alias("overlap"), ((F.abs(q) if symmetric else q) / 2 + 0.5).alias("matching"))


def gram(basis: DataFrame) -> DataFrame:
    """(a, b, g): inner products of all modes, a <= b."""
    return basis.select(F.col("k").alias("a"), "node", F.col("x").alias("xa")).join(basis.select(F.col("k").alias("b"), "node", F.col("x").alias("xb")), "node").where(F.col("a") <= F.col("b")).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("g"))


def is_orthonormal(basis: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    return gram(basis).agg(F.bool_and(F.abs(F.col("g") - (F.col("a") == F.col("b")).cast("double")) <= tolerance).alias("orthonormal"))


def solve(basis: DataFrame, vector: DataFrame) -> DataFrame:
    """(k, c): coefficients in a basis that needn't be orthogonal, solved in one task."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = left.pivot(index="node", columns="k", values="x").sort_index()
        v = right.set_index("node")["v"].reindex(b.index).to_numpy()
        c, *_ = np.linalg.lstsq(b.to_numpy(), v, rcond=None)
        return pd.DataFrame({"k": b.columns.astype(int), "c": c})

    one = F.col("node") * 0
    return basis.withColumn("one", one).groupBy("one").cogroup(vector.withColumn("one", one).groupBy("one")).applyInPandas(work, "k int, c double")


def upper_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Euclidean distance of two (i, j, d) triangles."""
    return a.join(b.withColumnRenamed("d", "e"), ["i", "j"]).where("i < j").agg(F.sqrt(F.sum(F.pow(F.col("d") - F.col("e"), 2))).alias("distance"))


def signed_modes(edges: DataFrame, k: int | None = None) -> DataFrame:
    return eigen(laplacian(edges), k)
