"""Signed graphs as tables: disorder, matrices, neighbourhoods, patterns, partitions.

edges(src, dst, w) hold each undirected edge once, src < dst; a missing weight
counts as 1. Matrices are (i, j, v) tables. Nothing here collects a graph.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


def both_ways(edges: DataFrame) -> DataFrame:
    """(i, j, w) in either direction: one scan, no shuffle."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j"), F.coalesce("w", F.lit(1.0)).alias("w")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j"), F.coalesce("w", F.lit(1.0)).alias("w")))).alias("e")).select("e.*")


# --- disorder ----------------------------------------------------------------


def flip_hash(edges: DataFrame, p: float, salt: int = 0) -> DataFrame:
    """Weights of about a share p of the edges times -1, chosen by hash."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    return edges.withColumn("w", F.when(H.flips(p, salt=salt), -F.col("w")).otherwise(F.col("w")))


def least_hashes(edges: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """The k edges (src, dst) of the least (hash, src, dst), found by counts of hashes instead of a sort of all edges."""
    own = edges.select("src", "dst", H.edge_hash(salt=salt).alias("hash"))
    if k <= 0:
        return own.select("src", "dst").limit(0)
    left, low, width = k, 0, 1 << 22
    while width > 1:
        # counts of at most 2,048 ranges reach the driver
        step = max(1, width >> 11)
        inside = own.where((F.col("hash") >= low) & (F.col("hash") < low + width))
        counts = inside.groupBy(F.floor((F.col("hash") - low) / step).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
        for r in counts:
            if r["n"] >= left:
                low, width = low + int(r["range"]) * step, step
                break
            left -= r["n"]
        else:
            return own.select("src", "dst")
    ties = own.where(F.col("hash") == low).orderBy("src", "dst").limit(left)
    return own.where(F.col("hash") < low).unionByName(ties).select("src", "dst")


def flip_exact(edges: DataFrame, p: float, salt: int = 0) -> DataFrame:
    """Weights of exactly floor(p * edges) edges times -1: those of the least hashes."""
    return flip_selected(edges, least_hashes(edges, int(p * edges.count()), salt))


def flip_selected(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Weights of the given links times -1; a link named twice or in both directions is turned once."""
    chosen = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("_f", F.lit(-1.0))
    return edges.join(chosen, ["src", "dst"], "left").select("src", "dst", (F.col("w") * F.coalesce("_f", F.lit(1.0))).alias("w"))


def unflip(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.abs("w"))


def random_normal(edges: DataFrame, mu: float = 1.0, sigma: float = 1.0, salt: int = 0) -> DataFrame:
    """Gaussian weights by the Box-Muller transform of two hashes of each edge."""
    u = (F.pmod(F.xxhash64(F.lit(salt), "src", "dst"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    v = (F.pmod(F.xxhash64(F.lit(salt + 1), "src", "dst"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return edges.withColumn("w", mu + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v))


def sample_links(edges: DataFrame, n: int, sign: str = "", salt: int = 0) -> DataFrame:
    """n links of the least hashes of all, negative ("-") or positive ("+") ones."""
    own = edges.where(F.col("w") < 0) if sign == "-" else edges.where(F.col("w") >= 0) if sign == "+" else edges
    return own.join(least_hashes(own, n, salt), ["src", "dst"], "left_semi").select(*edges.columns)


# --- patterns ----------------------------------------------------------------


def star_links(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """All links of the given nodes, each once."""
    c = centres.select(F.col("id").alias("i")).distinct()
    hit = both_ways(edges).join(c, "i", "left_semi")
    return hit.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct()


def square_links(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """For each node a square through it: its least neighbour a, and the least b and common x of a and b that close it.

    (centre, src, dst): four links; nodes without a square have their first two links.
    """
    e = both_ways(edges).select("i", "j")
    c = centres.select(F.col("id").alias("centre")).distinct()
    one = c.join(e, F.col("centre") == F.col("i")).select("centre", F.col("j").alias("a"))
    two = one.join(e.withColumnRenamed("j", "x"), F.col("a") == F.col("i")).where(F.col("x") != F.col("centre")).select("centre", "a", "x")
    pair = two.alias("p").join(two.alias("q"), (F.col("p.centre") == F.col("q.centre")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.a") < F.col("q.a"))).select(F.col("p.centre").alias("centre"), F.col("p.a").alias("a"), F.col("q.a").alias("b"), F.col("p.x").alias("x"))
    best = pair.groupBy("centre").agg(F.min(F.struct("a", "b", "x")).alias("m")).select("centre", "m.*")
    firsts = one.withColumn("k", F.row_number().over(Window.partitionBy("centre").orderBy("a"))).where(F.col("k") <= 2).join(best, "centre", "left_anti").select("centre", F.col("centre").alias("u"), F.col("a").alias("v"))
    cols = [("centre", "a"), ("a", "x"), ("x", "b"), ("b", "centre")]
    full = best.select("centre", F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in cols])).alias("s")).select("centre", "s.*")
    return full.unionByName(firsts).select("centre", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def triangle_links(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """For each node its least neighbour a and their least common neighbour x: three links, or one where there is none."""
    e = both_ways(edges).select("i", "j")
    first = centres.select(F.col("id").alias("centre")).distinct().join(e, F.col("centre") == F.col("i")).groupBy("centre").agg(F.min("j").alias("a"))
    common = common_neighbours(edges).unionByName(common_neighbours(edges).select(F.col("v").alias("u"), F.col("u").alias("v"), "x"))
    third = first.join(common, (F.col("centre") == F.col("u")) & (F.col("a") == F.col("v")), "left").groupBy("centre", "a").agg(F.min("x").alias("x"))
    links = third.select("centre", F.explode(F.array(F.struct(F.col("centre").alias("u"), F.col("a").alias("v")), F.struct(F.col("a").alias("u"), F.col("x").alias("v")), F.struct(F.col("x").alias("u"), F.col("centre").alias("v")))).alias("s")).select("centre", "s.*")
    return links.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("centre", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"))


def ball_links(edges: DataFrame, centre: int, radius: int) -> DataFrame:
    """Links that leave nodes at distance exactly radius from the centre."""
    at = bfs(edges, centre, radius).where(F.col("distance") == radius).select(F.col("id"))
    return star_links(edges, at)


# --- matrices ----------------------------------------------------------------


def adjacency(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("i", "j", F.col("w").alias("v"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, degree (links), strength (sum of w), abs_strength (sum of |w|), negative (links with w < 0)."""
    d = both_ways(edges).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"), F.sum(F.abs("w")).alias("abs_strength"), F.sum((F.col("w") < 0).cast("long")).alias("negative"))
    if nodes is None:
        return d
    return nodes.select("id").join(d, "id", "left").na.fill(0)


def laplacian(edges: DataFrame, signed: bool = True) -> DataFrame:
    """(i, j, v) of D - A; signed: the degree is the sum of |w|. One aggregation, no join."""
    one = both_ways(edges)
    d = F.abs("w") if signed else F.col("w")
    parts = one.select(F.explode(F.array(F.struct("i", "j", (-F.col("w")).alias("v")), F.struct(F.col("i"), F.col("i").alias("j"), d.alias("v")))).alias("x")).select("x.*")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def normalized_laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, v) of I - D^-1/2 A D^-1/2 with D the sums of |w|."""
    one = both_ways(edges)
    d = one.groupBy("i").agg(F.sum(F.abs("w")).alias("d"))
    off = one.join(d.withColumnRenamed("d", "di"), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))
    return off.unionByName(d.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))


def shift_diagonal(matrix: DataFrame, by: float) -> DataFrame:
    """The matrix less by on its diagonal."""
    return matrix.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") - by).otherwise(F.col("v")))


def matvec(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """matrix(i, j, v) times x(id, x) -> (id, x)."""
    return matrix.join(x.select(F.col("id").alias("j"), F.col("x").alias("_x")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("v") * F.col("_x")).alias("x"))


def traces(edges: DataFrame) -> DataFrame:
    """tr and tr of the square of the signed Laplacian, from degrees and weights alone."""
    d = degrees(edges).agg(F.sum("abs_strength").alias("trace"), F.sum(F.col("abs_strength") * F.col("abs_strength")).alias("dd"))
    return d.crossJoin(edges.agg(F.sum(F.col("w") * F.col("w")).alias("ww"))).select("trace", (F.col("dd") + 2 * F.col("ww")).alias("trace_square"))


def quadratic_form(edges: DataFrame, x: DataFrame) -> DataFrame:
    """x' L x of the signed Laplacian: sum of |w| (x_i - sgn(w) x_j)^2."""
    j = edges.join(x.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(x.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
    return j.agg(F.sum(F.abs("w") * F.pow(F.col("xs") - F.signum("w") * F.col("xd"), 2)).alias("value"))


# --- neighbourhoods ----------------------------------------------------------


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return both_ways(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("i") == node).select(F.col("j").alias("id"), "w")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v, x): x is joined to both ends of the edge u - v."""
    e = both_ways(edges).select("i", "j")
    a = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(e.select(F.col("i").alias("u"), F.col("j").alias("x")), "u")
    return a.join(e.select(F.col("i").alias("v"), F.col("j").alias("x")), ["v", "x"]).select("u", "v", "x")


def bfs(edges: DataFrame, source: int, depth: int | None = None) -> DataFrame:
    """(id, distance) from the source, to the depth or to the end. A level is a join and an anti join, written out."""
    from .components import saved

    e = both_ways(edges).select("i", "j")
    level = edges.sparkSession.createDataFrame([(source, 0)], "id long, distance int")
    seen, k = level, 0
    while depth is None or k < depth:
        k += 1
        new = level.join(e, F.col("id") == F.col("i")).select(F.col("j").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(k))
        new = saved(new)
        if new.isEmpty():
            break
        seen, level = seen.unionByName(new), new
    return seen


def neighbours_at(edges: DataFrame, source: int, order: int) -> DataFrame:
    if order < 1:
        raise ValueError("order must be positive")
    return bfs(edges, source, order).where(F.col("distance") == order).select("id")


# --- partitions ----------------------------------------------------------------

_CONDITION = re.compile(r"\s*(<=|>=|!=|=|<|>)\s*(.+?)\s*$")


def condition(rule: str | float, column: str = "value") -> Column:
    """A predicate of a column from "<=2", "!=a", a number (equality) and the like."""
    if isinstance(rule, (int, float)):
        return F.col(column) == rule
    m = _CONDITION.match(rule)
    if not m:
        raise ValueError(f"not a condition: {rule!r}")
    try:
        value: float | str = float(m[2])
        value = int(value) if value == int(value) else value
    except (ValueError, OverflowError):
        value = m[2]
    c = F.col(column)
    return {"<=": c <= value, ">=": c >= value, "!=": c != value, "=": c == value, "<": c < value, ">": c > value}[m[1]]


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w")


def split(edges: DataFrame, values: DataFrame, rule: str | float) -> tuple[DataFrame, DataFrame]:
    """(matching, not_matching): edges within nodes whose value(id, value) meets the rule, and within the others."""
    hit = condition(rule)
    return induced(edges, values.where(hit)), induced(edges, values.where(~hit))


def regions(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """Nodes whose neighbours' spins(id, s) all equal theirs ("ferro") or all differ ("antiferro")."""
    j = both_ways(edges).join(spins.select(F.col("id").alias("i"), F.col("s").alias("si")), "i").join(spins.select(F.col("id").alias("j"), F.col("s").alias("sj")), "j")
    g = j.groupBy(F.col("i").alias("id")).agg(F.bool_and(F.col("si") == F.col("sj")).alias("same"), F.bool_and(F.col("si") != F.col("sj")).alias("other"))
    return g.where("same OR other").select("id", F.when(F.col("same"), "ferro").otherwise("antiferro").alias("region"))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges in another labelling; mapping(old, new). Edges with an unmapped end are left out."""
    m = mapping.select("old", "new")
    j = edges.join(m.select(F.col("old").alias("src"), F.col("new").alias("a")), "src").join(m.select(F.col("old").alias("dst"), F.col("new").alias("b")), "dst")
    return j.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w")


def node_map(order_a: DataFrame, order_b: DataFrame) -> DataFrame:
    """(old, new) by place: the k-th of order_a(id, k) is the k-th of order_b(id, k)."""
    return order_a.select(F.col("id").alias("old"), "k").join(order_b.select(F.col("id").alias("new"), "k"), "k").select("old", "new")


def energies(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """total = -sum w s s, and it per spin, per edge, and with each spin's field divided by its degree."""
    s = spins.select("id", "s")
    j = edges.join(s.select(F.col("id").alias("src"), F.col("s").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
    total = j.agg(F.sum(-F.coalesce("w", F.lit(1.0)) * F.col("a") * F.col("b")).alias("total"), F.count(F.lit(1)).alias("n_edges"))
    mean = local_fields(edges, spins).agg(F.sum(-F.col("s") * F.col("field") / F.col("degree")).alias("degree_mean"))
    return total.crossJoin(s.agg(F.count(F.lit(1)).alias("n"))).crossJoin(mean).select("total", (F.col("total") / F.col("n")).alias("per_spin"), (F.col("total") / F.col("n_edges")).alias("per_edge"), "degree_mean")


def local_fields(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """(id, s, field, degree): field = sum over neighbours of w s. Nodes without links have no row."""
    s = spins.select("id", "s")
    j = both_ways(edges).join(s.select(F.col("id").alias("j"), F.col("s").alias("sj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("sj")).alias("field"), F.count(F.lit(1)).alias("degree"))
    return s.join(j, "id")


def stable_at_zero(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """Whether no spin gains by turning."""
    return local_fields(edges, spins).agg(F.bool_and(F.col("s") * F.col("field") >= 0).alias("stable"))


def parallel_step(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """All spins with s * field < 0 turned at once (zero temperature)."""
    f = local_fields(edges, spins).select("id", "field")
    return spins.select("id", "s").join(f, "id", "left").select("id", F.when(F.col("s") * F.coalesce("field", F.lit(0.0)) < 0, -F.col("s")).otherwise(F.col("s")).alias("s"))
