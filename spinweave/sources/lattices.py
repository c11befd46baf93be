"""Graph sources: lattices and random graphs as edge tables made by range and arithmetic.

Every source gives edges(src, dst, w) with src < dst, w = 1.0, no self-loop and
no duplicate, and nodes are 0 .. n - 1. Nothing is built on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


@dataclass(frozen=True)
class Graph:
    """A graph's tables and what is known of it without building it. nodes(id, ...), edges(src, dst, w)."""

    name: str
    n: int
    coordination: int | None
    nodes: DataFrame
    edges: DataFrame


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, src < dst; of repeated ones the least weight."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    e = e.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), F.coalesce("w", F.lit(1.0)).cast("double").alias("w"))
    return e.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("w").alias("w"))


def _fan(nodes: DataFrame, targets: list[Column]) -> DataFrame:
    """An edge from each node to each of its targets that isn't null."""
    out = nodes.select(F.col("id").alias("src"), F.explode(F.array(*targets)).alias("dst"))
    return canonical(out.where(F.col("dst").isNotNull()))


def _checked(*sides: int) -> None:
    if any(not isinstance(s, int) or s < 1 for s in sides):
        raise ValueError("sides must be positive whole numbers")


def _plane(spark: SparkSession, m: int, n: int) -> DataFrame:
    return spark.range(m * n).select("id", F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("c"))


def _step(at: Column, by: int, side: int, periodic: bool) -> Column:
    """Coordinate after a step: wrapped if the axis is periodic and longer than 2, else null outside."""
    moved = at + by
    return F.pmod(moved, F.lit(side)) if periodic and side > 2 else F.when((moved >= 0) & (moved < side), moved)


def square(spark: SparkSession, m: int, n: int | None = None, periodic: bool | tuple[bool, bool] = True) -> Graph:
    n = n or m
    _checked(m, n)
    pr, pc = periodic if isinstance(periodic, tuple) else (periodic, periodic)
    nodes = _plane(spark, m, n)
    r, c = F.col("r"), F.col("c")
    return Graph("square", m * n, 4, nodes, _fan(nodes, [r * n + _step(c, 1, n, pc), _step(r, 1, m, pr) * n + c]))


def triangular(spark: SparkSession, m: int, n: int, periodic: bool = True) -> Graph:
    """m rows (even if periodic) of n nodes; diagonals lean left on even and right on odd rows; rows are sqrt(3)/2 apart."""
    _checked(m, n)
    if periodic and (m < 3 or n < 5 or m % 2):
        raise ValueError("a periodic triangular lattice needs an even number of rows over 2 and 5 columns")
    nodes = _plane(spark, m, n).withColumn("x", F.col("c") + F.when(F.col("r") % 2 == 1, 0.5).otherwise(0.0)).withColumn("y", F.col("r") * (math.sqrt(3) / 2))
    r, c = F.col("r"), F.col("c")
    up = _step(r, 1, m, periodic)
    side = F.when(r % 2 == 1, _step(c, 1, n, periodic)).otherwise(_step(c, -1, n, periodic))
    return Graph("triangular", m * n, 6, nodes, _fan(nodes, [r * n + _step(c, 1, n, periodic), up * n + c, up * n + side]))


def hexagonal(spark: SparkSession, m: int, n: int, periodic: bool = True) -> Graph:
    """Brick wall: all edges along a column, and along a row where row and column are both even or both odd."""
    _checked(m, n)
    if periodic and (m % 2 or n % 2):
        raise ValueError("a periodic hexagonal lattice needs even sides")
    nodes = _plane(spark, m, n)
    r, c = F.col("r"), F.col("c")
    return Graph("hexagonal", m * n, 3, nodes, _fan(nodes, [_step(r, 1, m, periodic) * n + c, F.when(r % 2 == c % 2, r * n + _step(c, 1, n, periodic))]))


def octagonal(spark: SparkSession, m: int, n: int, periodic: bool = True) -> Graph:
    """Squares and octagons: four nodes a cell in a ring 0-1-3-2; 2 meets the right cell's 1, 3 the upper cell's 0."""
    _checked(m, n)
    cells = _plane(spark, m, n)
    nodes = spark.range(4 * m * n).select("id", F.expr("id div 4").alias("cell"), (F.col("id") % 4).alias("k")).select("id", F.expr(f"cell div {n}").alias("r"), (F.col("cell") % n).alias("c"), "k")
    at = F.col("id") * 4
    right, above = F.col("r") * n + _step(F.col("c"), 1, n, periodic), _step(F.col("r"), 1, m, periodic) * n + F.col("c")
    pairs = [(at, at + 1), (at + 1, at + 3), (at + 3, at + 2), (at + 2, at), (at + 2, right * 4 + 1), (at + 3, above * 4)]
    e = cells.select(F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in pairs])).alias("e")).select("e.*").where(F.col("dst").isNotNull())
    return Graph("octagonal", 4 * m * n, 3, nodes, canonical(e))


def hypercubic(spark: SparkSession, dims: list[int] | tuple[int, ...], periodic: bool = True) -> Graph:
    """A lattice of any dimension; ids are mixed-radix numbers with the last axis fastest."""
    _checked(*dims)
    n = math.prod(dims)
    nodes, targets, stride = spark.range(n), [], n
    for k, side in enumerate(dims):
        stride //= side
        at = F.expr(f"(id div {stride}) % {side}")
        nodes = nodes.withColumn(f"x{k}", at)
        targets.append(F.col("id") + (_step(at, 1, side, periodic) - at) * stride)
    return Graph("hypercubic", n, 2 * len(dims), nodes, _fan(nodes, targets))


#: offsets of a cell's nodes in half units
_BASES = {"sc": [(0, 0, 0)], "bcc": [(0, 0, 0), (1, 1, 1)], "fcc": [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]}


def cubic(spark: SparkSession, dims: tuple[int, int, int], geo: str = "sc", periodic: bool = True, nearest: bool = False) -> Graph:
    """sc, bcc or fcc. id = cell * nodes a cell + place in it.

    bcc joins each centre to its cube's corners ("link") and corners along axes ("box").
    fcc joins equal places along axes, four separate cubic copies, unless
    ``nearest`` asks for the twelve nearest neighbours.
    """
    _checked(*dims)
    a, b, c = dims
    base = _BASES[geo]
    k = len(base)
    nodes = spark.range(a * b * c * k).select("id", F.expr(f"id div {k}").alias("cell"), (F.col("id") % k).cast("int").alias("place"))
    nodes = nodes.select("id", "place", F.expr(f"cell div {b * c}").alias("x"), F.expr(f"(cell div {c}) % {b}").alias("y"), F.expr(f"cell % {c}").alias("z"))

    def to(dx: int, dy: int, dz: int, place: int) -> Column:
        return ((_step(F.col("x"), dx, a, periodic) * b + _step(F.col("y"), dy, b, periodic)) * c + _step(F.col("z"), dz, c, periodic)) * k + place

    axes = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    targets: list[Column] = []
    for p in range(k):
        here = F.col("place") == p
        if not (geo == "fcc" and nearest):
            if not (geo == "bcc" and p == 1):
                targets += [F.when(here, to(*d, p)) for d in axes]
        if geo == "bcc" and p == 1:
            targets += [F.when(here, to(dx, dy, dz, 0)) for dx in (0, 1) for dy in (0, 1) for dz in (0, 1)]
        if geo == "fcc" and nearest:
            for q in range(k):
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        for dz in (-1, 0, 1):
                            gap = [2 * d + base[q][i] - base[p][i] for i, d in enumerate((dx, dy, dz))]
                            if p != q and sum(g * g for g in gap) == 2:
                                targets.append(F.when(here, to(dx, dy, dz, q)))
    z = {"sc": 6, "bcc": None, "fcc": 12 if nearest else 6}[geo]
    return Graph(geo, a * b * c * k, z, nodes, _fan(nodes, targets))


def complete(spark: SparkSession, n: int) -> Graph:
    nodes = spark.range(n)
    e = nodes.select(F.col("id").alias("src"), F.explode(F.when(F.col("id") < n - 1, F.sequence(F.col("id") + 1, F.lit(n - 1)))).alias("dst"))
    return Graph("complete", n, n - 1, nodes, e.select("src", "dst", F.lit(1.0).alias("w")))


def erdos_renyi(spark: SparkSession, n: int, p: float, salt: int = 0) -> Graph:
    """G(n, p): pairs are kept by their hash, so any engine gives the same graph. Not restricted to its giant component."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    full = complete(spark, n)
    return Graph("erdos_renyi", n, None, full.nodes, full.edges.where(H.flips(p, salt=salt)))


def ring(spark: SparkSession, n: int, k: int) -> Graph:
    """Each node joined to its k / 2 next ones."""
    nodes = spark.range(n)
    return Graph("ring", n, k, nodes, canonical(nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("step")).select("src", ((F.col("src") + F.col("step")) % n).alias("dst"))))


def rewire(g: Graph, p: float, salt: int = 0) -> Graph:
    """Each edge with a share p moves its second end to a hashed node; loops and edges that exist stay where they are."""
    moved = g.edges.withColumn("new", F.when(H.flips(p, salt=salt), F.pmod(H.edge_hash(salt=salt + 1), F.lit(g.n))))
    to = F.struct(F.least("src", "new").alias("a"), F.greatest("src", "new").alias("b"))
    want = moved.withColumn("a", to["a"]).withColumn("b", to["b"]).withColumn("first", F.row_number().over(Window.partitionBy("a", "b").orderBy("src", "dst")))
    taken = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("taken"))
    j = want.join(taken, ["a", "b"], "left")
    ok = F.col("new").isNotNull() & (F.col("new") != F.col("src")) & F.col("taken").isNull() & (F.col("first") == 1)
    return Graph(g.name + "_rewired", g.n, None, g.nodes, j.select(F.when(ok, F.col("a")).otherwise(F.col("src")).alias("src"), F.when(ok, F.col("b")).otherwise(F.col("dst")).alias("dst"), "w"))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, salt: int = 0) -> Graph:
    return rewire(ring(spark, n, k), p, salt)


def recursive_triangles(spark: SparkSession, generations: int) -> Graph:
    """Scale-free graph grown from one edge: in each generation every edge gets a node joined to both its ends."""
    edges, n = spark.createDataFrame([(0, 1)], "src long, dst long"), 2
    for _ in range(generations):
        size = n - 2 + 1 if n == 2 else None
        count = size if size else 2 * n - 3
        number = F.row_number().over(Window.orderBy("src", "dst")) - 1 + n
        new = edges.withColumn("x", number.cast("long"))
        edges = new.select("src", "dst").unionByName(new.select("src", F.col("x").alias("dst"))).unionByName(new.select(F.col("dst").alias("src"), F.col("x").alias("dst")))
        n += count
    return Graph("recursive_triangles", n, None, spark.range(n), edges.withColumn("w", F.lit(1.0)))


def dilute(g: Graph, p: float, salt: int = 0) -> Graph:
    """Without the floor(p * edges) edges of the least hashes."""
    from ..operators.graph import least_hashes

    gone = least_hashes(g.edges, int(p * g.edges.count()), salt)
    return Graph(g.name + "_diluted", g.n, None, g.nodes, g.edges.join(gone, ["src", "dst"], "left_anti"))


def project(nodes: DataFrame, theta: float = math.pi / 6, phi: float = math.pi / 6) -> DataFrame:
    """x, y, z turned by theta and phi and seen from above: columns px, py."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return nodes.withColumn("px", x * math.cos(phi) - y * math.sin(phi) * math.cos(theta) + z * math.sin(phi) * math.sin(theta)).withColumn("py", x * math.sin(phi) + y * math.cos(phi) * math.cos(theta) - z * math.cos(phi) * math.sin(theta))
