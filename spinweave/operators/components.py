"""Connected components, clusters, percolation thresholds and cores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, degrees, induced


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut; where none is set, to one in the warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_spinweave")
    return df.checkpoint(eager=True)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, root): the least node of each node's component; isolated nodes are their own if nodes(id) is given.

    Large-star and small-star rounds: the number of rounds grows slowly with
    the graph, minima are partly taken before each shuffle.
    """
    e = saved(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where(F.col("a") != F.col("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.least("v", "m").alias("m"), F.greatest("v", "m").alias("u")).distinct()
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(low, "u").where(F.col("m") != F.col("low")).select(F.least("m", "low").alias("a"), F.greatest("m", "low").alias("b"))
        e = saved(small.union(low.select(F.col("low").alias("a"), F.col("u").alias("b"))).distinct())
    found = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    if nodes is None:
        return found.union(e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def cluster_sizes(comps: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, root, size): clusters by falling size, then root; with top only that many, whose ranks alone are sorted in one task."""
    sizes = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    if top is not None:
        sizes = sizes.orderBy(F.col("size").desc(), "root").limit(top)
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "root"))).select("rank", "root", "size")


def cluster_distribution(comps: DataFrame) -> DataFrame:
    return comps.groupBy("root").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("cnt"))


def order_parameter(comps: DataFrame) -> DataFrame:
    """pinf = largest / nodes; spread = (sum of squares less the largest's) / (sum less the largest), 0 for one cluster."""
    s = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size")).agg(F.max("size").alias("m"), F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("q"))
    return s.select((F.col("m") / F.col("n")).alias("pinf"), F.when(F.col("n") > F.col("m"), (F.col("q") - F.col("m") * F.col("m")) / (F.col("n") - F.col("m"))).otherwise(0.0).alias("spread"))


def giant(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes of the largest component, edges in it, nodes left off); of equal ones the one with the least node."""
    c = saved(components(edges, nodes))
    best = c.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "root").limit(1).select("root")
    inside, outside = c.join(best, "root", "left_semi").select("id"), c.join(best, "root", "left_anti").select("id")
    return inside, induced(edges, inside), outside


def same_sign_clusters(edges: DataFrame, spins: DataFrame) -> DataFrame:
    """Components of edges whose ends have equal spins(id, s)."""
    s = spins.select("id", "s")
    e = edges.join(s.select(F.col("id").alias("src"), F.col("s").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst").where(F.col("a") == F.col("b"))
    return components(e, spins)


class Forest:
    """Disjoint sets with sizes, for grouped tasks."""

    def __init__(self, n: int):
        self.root, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.root[y] = x
        self.size[x] += self.size[y]
        return True


def spanning_forest(edges: DataFrame, parts: int = 16) -> DataFrame:
    """(src, dst, w) of a maximum spanning forest: each of ``parts`` shares of the edges gives its own, then one task theirs.

    A share's forest has fewer edges than there are nodes, so the last task
    reads at most parts * nodes edges whatever the number of edges.
    """

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "src", "dst"], ascending=[False, True, True], kind="stable")
        ids, flat = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        pairs, f = flat.reshape(-1, 2).tolist(), Forest(len(ids))
        return pdf[["src", "dst", "w"]][[f.join(a, b) for a, b in pairs]] if len(pdf) else pdf[["src", "dst", "w"]]

    own = edges.select("src", "dst", "w", F.pmod(F.xxhash64("src", "dst"), F.lit(parts)).alias("part"))
    first = own.groupBy("part").applyInPandas(forest, "src long, dst long, w double")
    return first.withColumn("one", F.col("src") * 0).groupBy("one").applyInPandas(forest, "src long, dst long, w double")


def thresholds(edges: DataFrame, nodes: int, points: int) -> DataFrame:
    """(threshold, giant_nodes, giant_edges): shares of all nodes and edges in the largest component of edges with |w| >= it.

    Thresholds are spaced by logarithm from the least to the greatest |w|.
    Connectivity comes from the spanning forest, gone through once by falling
    weight; a node's stays in the largest component are spans of thresholds, so
    edges are counted by one join with their nodes' spans.
    """
    a = edges.select("src", "dst", F.abs("w").alias("w")).where(F.col("w") > 0)
    lo, hi, total = a.agg(F.min("w"), F.max("w"), F.count(F.lit(1))).first()
    grid = [lo * (hi / lo) ** (k / (points - 1)) for k in range(points - 1)] + [hi] if points > 1 else [lo]
    falling = sorted(grid, reverse=True)
    tree = spanning_forest(a)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", ascending=False)
        ids, flat = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        pairs, f, at = flat.reshape(-1, 2).tolist(), Forest(len(ids)), 0
        w = pdf["w"].tolist()
        since, inside, out = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), []
        for k, t in enumerate(falling):
            while at < len(w) and w[at] >= t:
                f.join(*pairs[at])
                at += 1
            root = np.array(f.root, np.int64)
            while len(root) and (root != root[root]).any():
                root = root[root]
            size = np.bincount(root, minlength=1)
            # of equal components the one with the least node
            now = root == root[np.argmax(size[root])] if len(root) else inside
            left = np.flatnonzero(inside & ~now)
            out.append(pd.DataFrame({"node": ids[left], "first": since[left], "after": k, "giant_nodes": None}))
            since[now & ~inside] = k
            inside = now
            out.append(pd.DataFrame({"node": [None], "first": [k], "after": [k], "giant_nodes": [max(1, int(size.max())) / nodes]}))
        stay = np.flatnonzero(inside)
        out.append(pd.DataFrame({"node": ids[stay], "first": since[stay], "after": len(falling), "giant_nodes": None}))
        return pd.concat(out).astype({"node": "Int64", "giant_nodes": "float64"})

    spans = saved(tree.withColumn("one", F.col("src") * 0).groupBy("one").applyInPandas(work, "node long, first long, after long, giant_nodes double"))
    held = a.join(spans.where("node IS NOT NULL").withColumnRenamed("node", "src"), "src")
    start = F.greatest("first", F.size(F.filter(F.array(*[F.lit(t) for t in falling]), lambda t: t > F.col("w"))))
    changes = held.select(start.alias("first"), "after").where(F.col("first") < F.col("after"))
    both = changes.select(F.explode(F.array(F.struct(F.col("first").alias("k"), F.lit(1).alias("n")), F.struct(F.col("after").alias("k"), F.lit(-1).alias("n")))).alias("x"))
    steps = both.groupBy("x.k").agg(F.sum("x.n").alias("n"))
    # as many rows as thresholds from here on
    table = spans.where("node IS NULL").select(F.col("first").alias("k"), "giant_nodes").join(steps, "k", "left")
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k"))
    by = F.array(*[F.lit(float(t)) for t in falling])
    return table.select(F.get(by, F.col("k").cast("int")).alias("threshold"), "giant_nodes", (run / total).alias("giant_edges"))


def detachment_threshold(edges: DataFrame) -> DataFrame:
    """The greatest |w| at which the graph is still connected as a whole: the least edge of its maximum spanning tree."""
    return spanning_forest(edges.select("src", "dst", F.abs("w").alias("w"))).agg(F.min("w").alias("threshold"))


def select_threshold(stats: DataFrame, share: float = 0.9) -> DataFrame:
    """The least threshold at which the giant component has under the share of nodes, else the greatest."""
    return stats.agg(F.coalesce(F.min(F.when(F.col("giant_nodes") < share, F.col("threshold"))), F.max("threshold")).alias("threshold"))


def core_numbers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, core) by peeling: rounds of dropping all nodes under the degree k, then k + 1."""
    left, e, k = nodes.select("id"), edges.select("src", "dst", "w"), 0
    done = None
    while not left.isEmpty():
        while True:
            low = saved(degrees(e, left).where(F.col("degree") <= k).select("id"))
            if low.isEmpty():
                break
            out = low.withColumn("core", F.lit(k))
            done = out if done is None else done.unionByName(out)
            left = saved(left.join(low, "id", "left_anti"))
            e = saved(induced(e, left))
        k += 1
    return done if done is not None else nodes.select("id", F.lit(0).alias("core")).limit(0)


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of points(id, x, y) within the radius: cells of that side meet their neighbours, no cross join."""
    cell = points.select("id", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = cell.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.expr("transform(sequence(0, 8), k -> struct(cx + (k div 3) - 1 AS cx, cy + k % 3 - 1 AS cy))")).alias("c")).select("b", "bx", "by", "c.cx", "c.cy")
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
    return cell.join(around, ["cx", "cy"]).where(F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", d.alias("distance")).where(F.col("distance") <= radius)


def circle_clusters(circles: DataFrame, radius: float) -> DataFrame:
    """Components of circles(id, x, y) of one radius that touch."""
    return components(close_pairs(circles, 2 * radius).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")), circles)


def short_cycle(edges: DataFrame, node: int) -> DataFrame:
    """Length of a shortest cycle through the node (null if none): the nearest edge that joins two of its branches."""
    e = both_ways(edges).select("i", "j")
    branch = e.where(F.col("i") == node).select(F.col("j").alias("id"), F.col("j").alias("root"), F.lit(1).alias("d"))
    seen, level, k = saved(branch), saved(branch), 1
    rest = e.where((F.col("i") != node) & (F.col("j") != node))
    while not level.isEmpty():
        a = rest.join(seen.select(F.col("id").alias("i"), F.col("root").alias("ra"), F.col("d").alias("da")), "i").join(seen.select(F.col("id").alias("j"), F.col("root").alias("rb"), F.col("d").alias("db")), "j").where(F.col("ra") != F.col("rb"))
        best = a.agg(F.min(F.col("da") + F.col("db") + 1)).first()[0]
        if best is not None and best <= 2 * k + 1:
            return edges.sparkSession.createDataFrame([(best,)], "length int")
        k += 1
        new = level.join(rest, F.col("id") == F.col("i")).groupBy(F.col("j").alias("id")).agg(F.min("root").alias("root")).join(seen, "id", "left_anti").select("id", "root", F.lit(k).alias("d"))
        level = saved(new)
        seen = saved(seen.unionByName(level))
    return edges.sparkSession.createDataFrame([(None,)], "length int")
