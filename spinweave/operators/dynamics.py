"""Dynamics on signed graphs: one task per replica, results as series rows.

A sequential update is inherently serial, so parallelism is over replicas and
parameters. The graph travels once to every task as arrays; its size is
checked. Each replica's randomness is seeded by its number alone, so a task
that is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: edges that a task may hold
MAX_EDGES = 20_000_000
SERIES = "replica long, step int, metric string, value double"


class Adjacency:
    """Neighbour lists in compressed rows."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        i, j, v = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
        order = np.lexsort((j, i))
        self.n, self.m = n, len(src)
        self.to, self.w = j[order], v[order]
        self.at = np.searchsorted(i[order], np.arange(n + 1))
        self.lists = [(self.to[a:b], self.w[a:b]) for a, b in zip(self.at, self.at[1:], strict=False)]
        self.i = i[order]

    def fields(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, weights=self.w * s[self.to], minlength=self.n)


def load(edges: DataFrame, n: int) -> tuple:
    """The graph's arrays, for a broadcast; refuses more than MAX_EDGES."""
    m = edges.count()
    if m > MAX_EDGES:
        raise ValueError(f"{m} edges are more than the {MAX_EDGES} that a task may hold")
    t = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.coalesce("w", F.lit(1.0)).cast("double").alias("w")).orderBy("src", "dst").toArrow()
    return n, t["src"].to_numpy(), t["dst"].to_numpy(), t["w"].to_numpy()


def replicas(spark: SparkSession, edges: DataFrame, n: int, count: int, run: Callable[[Adjacency, np.random.Generator, int], list[tuple]], schema: str = SERIES, seed: int = 0) -> DataFrame:
    """run(graph, rng, replica) -> rows without the replica's number, for each replica."""
    shared = spark.sparkContext.broadcast(load(edges, n))
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for b in batches:
            g = g or Adjacency(*shared.value)
            for r in b["id"].tolist():
                rows = run(g, np.random.default_rng([seed, r]), r)
                yield pd.DataFrame([(r, *x) for x in rows], columns=names)

    parts = max(1, min(count, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, count, 1, parts).mapInPandas(work, schema)


def initial(g: Adjacency, rng: np.random.Generator, start: str = "uniform", mode: np.ndarray | None = None) -> np.ndarray:
    """uniform (random signs), up, delta (one turned), or the signs of a mode."""
    if mode is not None:
        return np.where(np.asarray(mode) < 0, -1, 1).astype(np.int8)
    if start == "uniform":
        return (1 - 2 * rng.integers(0, 2, g.n)).astype(np.int8)
    s = np.ones(g.n, np.int8)
    if start == "delta":
        s[g.n // 2] = -1
    elif start != "up":
        raise ValueError(start)
    return s


def _sweep(g: Adjacency, s: np.ndarray, order: np.ndarray, temperature: float, rng: np.random.Generator, field: np.ndarray | None) -> None:
    """Metropolis updates of nodes in an order; at temperature 0 only strict gains."""
    u = rng.random(len(order)) if temperature > 0 else None
    for k, i in enumerate(order.tolist()):
        to, w = g.lists[i]
        d = 2 * s[i] * (float((w * s[to]).sum()) + (0.0 if field is None else field[i]))
        if d < 0 or (u is not None and u[k] < np.exp(-d / temperature)):
            s[i] = -s[i]


def ising_series(
    g: Adjacency,
    rng: np.random.Generator,
    *,
    temperature: float,
    sweeps: int,
    update: str = "sequential",
    start: str = "uniform",
    every: int = 1,
    field: np.ndarray | None = None,
    clusters: list | None = None,
    mode: np.ndarray | None = None,
    cooling_from: float | None = None,
) -> tuple[list[tuple], np.ndarray]:
    """(step, metric, value) rows of one run, and the spins at its end; the arguments are those of ising()."""
    if update not in ("sequential", "asynchronous", "synchronous"):
        raise ValueError(update)
    s, rows = initial(g, rng, start, mode), []
    first = s.copy()
    for t in range(sweeps + 1):
        h = g.fields(s)
        if t % every == 0 or t == sweeps:
            rows += [(t, "energy", float(-(s * h).sum() / 2 / max(1, g.m))), (t, "magnetisation", float(s.mean()))]
            rows += [(t, f"cluster_{k}", float(s[c].mean())) for k, c in enumerate(clusters or [])]
            if mode is not None:
                rows.append((t, "overlap", float((s * first).mean())))
        if t == sweeps or (temperature == 0 and field is None and (s * h >= 0).all()):
            break
        now = temperature if cooling_from is None else cooling_from * (max(temperature, 1e-12) / cooling_from) ** (t / max(1, sweeps - 1))
        if update == "synchronous":
            d = 2 * s * (h + (0 if field is None else field))
            turn = d < 0 if now <= 0 else (d < 0) | (rng.random(g.n) < np.exp(-np.maximum(d, 0) / now))
            s = np.where(turn, -s, s).astype(np.int8)
        else:
            _sweep(g, s, np.arange(g.n) if update == "sequential" else rng.integers(0, g.n, g.n), now, rng, field)
    return rows, s


def ising(spark: SparkSession, edges: DataFrame, n: int, *, temperature: float, sweeps: int, count: int, update: str = "sequential", start: str = "uniform", every: int = 1, field: np.ndarray | None = None, clusters: list[list[int]] | None = None, mode: np.ndarray | None = None, cooling_from: float | None = None, seed: int = 0) -> DataFrame:
    """Series of energy per edge ("energy") and mean spin ("magnetisation") before each recorded sweep.

    update: sequential, asynchronous (draws with replacement) or synchronous.
    clusters add "cluster_k", their mean spins; mode starts from its signs and
    adds "overlap" with them; cooling_from cools geometrically to the
    temperature. Stops when stable at temperature 0.
    """
    if update not in ("sequential", "asynchronous", "synchronous"):
        raise ValueError(update)

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        settings = dict(temperature=temperature, sweeps=sweeps, update=update, start=start, every=every)
        return ising_series(g, rng, **settings, field=field, clusters=clusters, mode=mode, cooling_from=cooling_from)[0]

    return replicas(spark, edges, n, count, run, seed=seed)


def snapshots(spark: SparkSession, edges: DataFrame, n: int, *, temperature: float, sweeps: int, every: int, count: int, seed: int = 0) -> DataFrame:
    """(replica, step, node, s): states at every few sweeps."""

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        s, rows = initial(g, rng), []
        for t in range(sweeps + 1):
            if t % every == 0:
                rows += [(t, i, int(x)) for i, x in enumerate(s.tolist())]
            _sweep(g, s, np.arange(g.n), temperature, rng, None)
        return rows

    return replicas(spark, edges, n, count, run, "replica long, step int, node long, s int", seed)


def voter(spark: SparkSession, edges: DataFrame, n: int, *, sweeps: int, count: int, start: str = "uniform", seed: int = 0) -> DataFrame:
    """Nodes in random order copy a random neighbour's spin times the link's sign; series of the mean spin."""

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        s, rows = initial(g, rng, start), [(0, "magnetisation", 0.0)]
        rows[0] = (0, "magnetisation", float(s.mean()))
        for t in range(1, sweeps + 1):
            u = rng.random(g.n)
            for i in rng.permutation(g.n).tolist():
                to, w = g.lists[i]
                if len(to):
                    k = int(u[i] * len(to))
                    s[i] = s[to[k]] * (1 if w[k] >= 0 else -1)
            rows.append((t, "magnetisation", float(s.mean())))
        return rows

    return replicas(spark, edges, n, count, run, seed=seed)


def contact(
    spark: SparkSession,
    edges: DataFrame,
    n: int,
    *,
    recovery: float = 1.0,
    sweeps: int = 10,
    count: int = 1,
    start: str = "uniform",
    update: str = "random",
    seed: int = 0,
) -> DataFrame:
    """Signed contact process: inactive nodes turn active at the sum of active positive links, active ones inactive at
    recovery plus that of active negative links' sizes, with probability 1 - exp(-rate); series of the active share.

    update: every node once a sweep, in random order ("random") or by number ("sequential")."""
    if update not in ("random", "sequential"):
        raise ValueError(update)

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        s = (initial(g, rng, start) > 0).astype(np.int8)
        rows = [(0, "active", float(s.mean()))]
        for t in range(1, sweeps + 1):
            u = rng.random(g.n)
            for i in (range(g.n) if update == "sequential" else rng.permutation(g.n).tolist()):
                to, w = g.lists[i]
                rate = float((s[to] * np.maximum(w, 0)).sum()) if not s[i] else recovery + float((s[to] * np.maximum(-w, 0)).sum())
                if u[i] < 1 - np.exp(-rate):
                    s[i] = 1 - s[i]
            rows.append((t, "active", float(s.mean())))
        return rows

    return replicas(spark, edges, n, count, run, seed=seed)


def contact_rates(edges: DataFrame, state: DataFrame, recovery: float = 1.0) -> DataFrame:
    """(id, infection, recovery) of state(id, s) with s 0 or 1, as joins."""
    from .graph import both_ways

    j = both_ways(edges).join(state.select(F.col("id").alias("j"), "s"), "j").groupBy(F.col("i").alias("id"))
    return j.agg(F.sum(F.col("s") * F.greatest(F.lit(0.0), F.col("w"))).alias("infection"), (F.lit(recovery) + F.sum(F.col("s") * F.greatest(F.lit(0.0), -F.col("w")))).alias("recovery"))


def signed_walk(spark: SparkSession, edges: DataFrame, n: int, *, steps: int, count: int, start: int = 0, seed: int = 0) -> DataFrame:
    """(replica, step, node, sign): a walk that carries a sign, turned on negative links."""

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        at, sign, rows = start, 1, [(0, start, 1)]
        for t in range(1, steps + 1):
            to, w = g.lists[at]
            if not len(to):
                break
            k = int(rng.integers(0, len(to)))
            at, sign = int(to[k]), sign * (1 if w[k] >= 0 else -1)
            rows.append((t, at, sign))
        return rows

    return replicas(spark, edges, n, count, run, "replica long, step int, node long, sign int", seed)


def trapped_walk(spark: SparkSession, edges: DataFrame, n: int, *, columns: int, coordination: int, count: int, start: int, longest: int = 1_000_000, seed: int = 0) -> DataFrame:
    """(replica, steps, distance, node): walks until a border node (fewer links) or a negative link is met."""

    def run(g: Adjacency, rng: np.random.Generator, _: int) -> list[tuple]:
        at, steps = start, 0
        while steps < longest and len(g.lists[at][0]) >= coordination:
            to, w = g.lists[at]
            k = int(rng.integers(0, len(to)))
            if w[k] < 0:
                break
            at, steps = int(to[k]), steps + 1
        dy, dx = at // columns - start // columns, at % columns - start % columns
        return [(steps, float(np.hypot(dx, dy)), at)]

    return replicas(spark, edges, n, count, run, "replica long, steps long, distance double, node long", seed)


def random_patterns(spark: SparkSession, count: int, n: int, salt: int = 0) -> DataFrame:
    """(pattern, id, s): count patterns of n hashed signs, to be stored as Hebbian weights."""
    from ..functions import hashing as H

    nodes = spark.range(count).select(F.col("id").alias("pattern")).crossJoin(spark.range(n))
    return nodes.select("pattern", "id", H.spin("id", f"(pattern + {salt})").alias("s"))


def start_field(nodes: DataFrame, kind: str = "delta", size: float = 1.0, salt: int = 0) -> DataFrame:
    """field(id, x) of nodes(id): delta (the middle id), constant, uniform in [-size, size) or normal, by hashes of the ids."""
    from ..functions import hashing as H

    u = (H.node_hash("id", salt) % 1_000_000 + 0.5) / 1e6
    v = (H.node_hash("id", salt + 1) % 1_000_000 + 0.5) / 1e6
    if kind == "delta":
        middle = nodes.count() // 2
        x = F.when(F.col("id") == middle, size).otherwise(0.0)
    elif kind == "constant":
        x = F.lit(float(size))
    elif kind == "uniform":
        x = size * (2 * u - 1)
    elif kind == "normal":
        x = size * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)
    else:
        raise ValueError(kind)
    return nodes.select("id", x.alias("x"))


def diffusion(
    edges: DataFrame, field: DataFrame, dt: float, steps: int, signed: bool = True, tolerance: float = 1e-10, blow_up: float = 200.0, lowest: float | None = None
) -> DataFrame:
    """field(id, x) after steps of x - dt L x, as joins; stops when the relative change or the size's logarithm says so.

    lowest: the least eigenvalue; L is then lowered by it, so that the lowest mode neither grows nor fades.
    """
    from .components import saved
    from .graph import laplacian, matvec, shift_diagonal

    m = laplacian(edges, signed)
    m, x = saved(m if lowest is None else shift_diagonal(m, lowest)), field.select("id", "x")
    for k in range(steps):
        moved = x.join(matvec(m, x).withColumnRenamed("x", "y"), "id", "left").select("id", "x", (F.col("x") - dt * F.coalesce("y", F.lit(0.0))).alias("z"))
        if k % 5 == 4:
            moved = saved(moved)
            change, size = moved.agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("x"), 2))) / F.sqrt(F.sum(F.pow("x", 2))), F.max(F.abs("z"))).first()
            if (change is not None and change < tolerance) or (size and abs(np.log10(size)) > blow_up):
                return moved.select("id", F.col("z").alias("x"))
        x = moved.select("id", F.col("z").alias("x"))
    return x


def chain(spark: SparkSession, length: int, temperature: float, coupling: float = 1.0, count: int = 1, seed: int = 0) -> DataFrame:
    """(replica, i, s): sequences of signs that repeat with probability (tanh(J / T) + 1) / 2."""
    stay = (np.tanh(coupling / temperature) + 1) / 2

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b["id"].tolist():
                rng = np.random.default_rng([seed, r])
                turns = np.where(rng.random(length) < stay, 1, -1)
                turns[0] = rng.choice([-1, 1])
                yield pd.DataFrame({"replica": r, "i": np.arange(length), "s": np.cumprod(turns)})

    return spark.range(count).mapInPandas(work, "replica long, i long, s int")


def resume(done: DataFrame | None, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters still to run: wanted without those whose results are there. Averages are taken when results are read."""
    return wanted if done is None else wanted.join(done.select(*keys).distinct(), keys, "left_anti")
