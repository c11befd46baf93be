"""Signed lattices: disorder, matrices, neighbourhoods, clusters, energies, steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import stats as S
from ..operators import components as C
from ..operators import dynamics as D
from ..operators import graph as G
from ..sources import lattices as L
from .common import BASE, N, SIDE, lattice, r6, signed, signed_sql, spins, spins_sql, square_sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = lambda spark, sf_dir: f(spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


W = f"WITH {BASE} "


@query(f"SELECT src, dst, w FROM ({signed_sql()})")
def flip_hash(spark: SparkSession) -> DataFrame:
    return signed(spark)


@query(f"SELECT src, dst, CASE WHEN row_number() OVER (ORDER BY {H.edge_hash_sql('src', 'dst')}, src, dst) <= {int(0.25 * 2 * N)} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ({square_sql()})")
def flip_exact_k(spark):
    return G.flip_exact(lattice(spark).edges, 0.25)


@query(W + "SELECT src, dst, w * CASE WHEN src % 7 = 0 OR dst % 7 = 0 THEN -1 ELSE 1 END AS w FROM e")
def flip_stars(spark):
    return G.flip_selected(signed(spark), G.star_links(signed(spark), spark.range(N).where("id % 7 = 0")))


@query(W + "SELECT DISTINCT src, dst FROM e WHERE src % 50 = 3 OR dst % 50 = 3")
def cells_star(spark):
    return G.star_links(signed(spark), spark.range(N).where("id % 50 = 3"))


@query(
    W
    + """, one AS (SELECT i AS centre, j AS a FROM b WHERE i % 60 = 7), two AS (SELECT centre, a, j AS x FROM one JOIN b ON a = i WHERE j <> centre),
pr AS (SELECT p.centre, p.a, q.a AS b2, p.x FROM two p JOIN two q ON p.centre = q.centre AND p.x = q.x AND p.a < q.a),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY a, b2, x) AS k FROM pr) WHERE k = 1),
l AS (SELECT centre, centre AS u, a AS v FROM m UNION ALL SELECT centre, a, x FROM m UNION ALL SELECT centre, x, b2 FROM m UNION ALL SELECT centre, b2, centre FROM m)
SELECT centre, least(u, v) AS src, greatest(u, v) AS dst FROM l"""
)
def cells_square(spark):
    return G.square_links(signed(spark), spark.range(N).where("id % 60 = 7"))


_TRI = "SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT id AS a, unnest([r * 10 + (c + 1) % 10, ((r + 1) % 8) * 10 + c, ((r + 1) % 8) * 10 + (CASE WHEN r % 2 = 1 THEN (c + 1) % 10 ELSE (c + 9) % 10 END)]) AS b FROM (SELECT id, id // 10 AS r, id % 10 AS c FROM range(80) t(id)))"


@query(f"WITH e AS ({_TRI}), b AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e) SELECT e.src AS u, e.dst AS v, p.j AS x FROM e JOIN b p ON p.i = e.src JOIN b q ON q.i = e.dst AND q.j = p.j")
def common_neighbours(spark):
    return G.common_neighbours(L.triangular(spark, 8, 10).edges).select("u", "v", "x")


@query(
    f"""WITH e AS ({_TRI}), b AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e),
f AS (SELECT i AS centre, min(j) AS a FROM b WHERE i % 9 = 0 GROUP BY i),
t AS (SELECT centre, a, min(q.j) AS x FROM f JOIN b p ON p.i = centre JOIN b q ON q.i = a AND q.j = p.j GROUP BY ALL),
l AS (SELECT centre, centre AS u, a AS v FROM t UNION ALL SELECT centre, a, x FROM t UNION ALL SELECT centre, x, centre FROM t)
SELECT centre, least(u, v) AS src, greatest(u, v) AS dst FROM l"""
)
def cells_triangle(spark):
    g = L.triangular(spark, 8, 10)
    return G.triangle_links(g.edges, g.nodes.where("id % 9 = 0"))


_DIST = f"least(abs(id // {SIDE} - 8), {SIDE} - abs(id // {SIDE} - 8)) + least(abs(id % {SIDE} - 8), {SIDE} - abs(id % {SIDE} - 8))"
_CENTRE = 8 * SIDE + 8


@query(f"SELECT id, CAST({_DIST} AS INTEGER) AS distance FROM range({N}) t(id)")
def bfs_distance(spark):
    return G.bfs(lattice(spark).edges, _CENTRE).select("id", "distance")


@query(f"SELECT id FROM range({N}) t(id) WHERE {_DIST} = 3")
def kth_neighbours(spark):
    return G.neighbours_at(lattice(spark).edges, _CENTRE, 3)


@query(f"WITH e AS ({square_sql()}), d AS (SELECT id FROM range({N}) t(id) WHERE {_DIST} = 2) SELECT src, dst FROM e WHERE src IN (SELECT id FROM d) OR dst IN (SELECT id FROM d)")
def ball_links(spark):
    return G.ball_links(lattice(spark).edges, _CENTRE, 2)


@query(W + "SELECT i AS id, count(*) AS degree, sum(w) AS strength, sum(abs(w)) AS abs_strength, CAST(sum(CASE WHEN w < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM b GROUP BY i")
def degree(spark):
    return G.degrees(signed(spark))


@query(W + "SELECT i, j, w AS v FROM b")
def adjacency_coo(spark):
    return G.adjacency(signed(spark))


@query(W + "SELECT i, j, -w AS v FROM b UNION ALL SELECT i, i, sum(w) FROM b GROUP BY i")
def laplacian_coo(spark):
    return G.laplacian(signed(spark), signed=False).select("i", "j", (F.col("v") + 0.0).alias("v"))


@query(W + "SELECT i, j, -w AS v FROM b UNION ALL SELECT i, i, sum(abs(w)) FROM b GROUP BY i")
def signed_laplacian_coo(spark):
    return G.laplacian(signed(spark))


@query(W + ", d AS (SELECT i, sum(abs(w)) AS d FROM b GROUP BY i) SELECT b.i, b.j, round(-w / sqrt(p.d * q.d), 6) + 0.0 AS v FROM b JOIN d p ON p.i = b.i JOIN d q ON q.i = b.j UNION ALL SELECT i, i, 1.0::DOUBLE FROM d")
def normalized_laplacian(spark):
    return G.normalized_laplacian(signed(spark)).select("i", "j", r6(F.col("v")).alias("v"))


@query(W + ", l AS (SELECT i, j, -w AS v FROM b UNION ALL SELECT i, i, sum(abs(w)) FROM b GROUP BY i) SELECT (SELECT sum(v) FROM l WHERE i = j) AS trace, (SELECT sum(p.v * q.v) FROM l p JOIN l q ON p.i = q.j AND p.j = q.i) AS trace_square")
def laplacian_traces(spark):
    return G.traces(signed(spark))


@query(W + ", l AS (SELECT i, j, -w AS v FROM b UNION ALL SELECT i, i, sum(abs(w)) FROM b GROUP BY i) SELECT sum(p.s * l.v * q.s) AS value FROM l JOIN s p ON p.id = l.i JOIN s q ON q.id = l.j")
def quad_form(spark):
    return G.quadratic_form(signed(spark), spins(spark).select("id", F.col("s").cast("double").alias("x")))


@query(W + ", l AS (SELECT i, j, -w AS v FROM b UNION ALL SELECT i, i, sum(abs(w)) FROM b GROUP BY i) SELECT i AS id, sum(v * s) AS x FROM l JOIN s ON id = j GROUP BY i")
def matvec(spark):
    return G.matvec(G.laplacian(signed(spark)), spins(spark).select("id", F.col("s").cast("double").alias("x"))).select("id", (F.col("x") + 0.0).alias("x"))


@query(W + "SELECT src, dst, w, CASE WHEN p.s = -1 THEN 'yes' ELSE 'no' END AS part FROM e JOIN s p ON p.id = src JOIN s q ON q.id = dst WHERE p.s = q.s")
def subgraph_split(spark):
    yes, no = G.split(signed(spark), spins(spark).select("id", F.col("s").alias("value")), "=-1")
    return yes.withColumn("part", F.lit("yes")).unionByName(no.withColumn("part", F.lit("no")))


@query(W + "SELECT CASE WHEN w < 0 THEN -1 ELSE 1 END AS sign, count(*) AS cnt FROM e GROUP BY 1")
def edge_sign_counts(spark):
    return signed(spark).groupBy(F.when(F.col("w") < 0, -1).otherwise(1).alias("sign")).agg(F.count(F.lit(1)).alias("cnt"))


@query(W + "SELECT b.i AS id, CASE WHEN bool_and(p.s = q.s) THEN 'ferro' ELSE 'antiferro' END AS region FROM b JOIN s p ON p.id = b.i JOIN s q ON q.id = b.j GROUP BY b.i HAVING bool_and(p.s = q.s) OR bool_and(p.s <> q.s)")
def ferro_antiferro(spark):
    return G.regions(signed(spark), spins(spark))


@query(W + "SELECT least(dst_new, src_new) AS src, greatest(dst_new, src_new) AS dst, w FROM (SELECT (src * 37 + 5) % 256 AS src_new, (dst * 37 + 5) % 256 AS dst_new, w FROM e)")
def relabel(spark):
    return G.relabel(signed(spark), spark.range(N).select(F.col("id").alias("old"), ((F.col("id") * 37 + 5) % N).alias("new")))


@query(W + f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY {H.edge_hash_sql('src', 'dst', 3)}, src, dst) AS k FROM e WHERE w < 0) WHERE k <= 10")
def sample_negative(spark):
    return G.sample_links(signed(spark), 10, "-", salt=3).select("src", "dst")


@query(W + "SELECT 'difference' AS op, count(*) AS cnt FROM (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM e WHERE w < 0) UNION ALL SELECT 'union', count(*) FROM (SELECT src, dst FROM e WHERE w < 0 UNION SELECT src, dst FROM e WHERE src % 2 = 0) UNION ALL SELECT 'intersection', count(*) FROM (SELECT src, dst FROM e WHERE w < 0 INTERSECT SELECT src, dst FROM e WHERE src % 2 = 0) UNION ALL SELECT 'symmetric', count(*) FROM (SELECT src, dst FROM e WHERE (w < 0) <> (src % 2 = 0))")
def edge_set_operations(spark):
    e = signed(spark)
    a, b = e.where("w < 0").select("src", "dst"), e.where("src % 2 = 0").select("src", "dst")
    ops = {"difference": e.select("src", "dst").subtract(a), "union": a.union(b).distinct(), "intersection": a.intersect(b), "symmetric": a.subtract(b).union(b.subtract(a))}
    out = None
    for k, d in ops.items():
        one = d.agg(F.lit(k).alias("op"), F.count(F.lit(1)).alias("cnt"))
        out = one if out is None else out.unionByName(one)
    return out


# --- components ----------------------------------------------------------------

#: edges of the lattice that a share 0.55 of hashes keeps
_KEPT = f"SELECT src, dst FROM ({square_sql()}) WHERE NOT ({H.edge_hash_sql('src', 'dst', 5)} % 1000 < 550)"
_COMP = f"""WITH RECURSIVE e AS ({_KEPT}), b AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT id, id AS x FROM range({N}) t(id) UNION SELECT r.id, b.j FROM r JOIN b ON r.x = b.i),
c AS (SELECT id, min(x) AS root FROM r GROUP BY id) """


def _diluted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    g = lattice(spark)
    return g.edges.where(~H.flips(0.55, salt=5)), g.nodes.select("id")


def _comps(spark: SparkSession) -> DataFrame:
    return C.components(*_diluted(spark))


@query(_COMP + "SELECT id, root FROM c")
def components(spark):
    return _comps(spark)


@query(_COMP + "SELECT row_number() OVER (ORDER BY count(*) DESC, root) AS rank, root, count(*) AS size FROM c GROUP BY root ORDER BY 3 DESC, 2 LIMIT 10")
def top_k_clusters(spark):
    return C.cluster_sizes(_comps(spark), top=10).select(F.col("rank").cast("long").alias("rank"), "root", "size")


@query(_COMP + "SELECT size, count(*) AS cnt FROM (SELECT root, count(*) AS size FROM c GROUP BY root) GROUP BY size")
def cluster_distribution(spark):
    return C.cluster_distribution(_comps(spark))


@query(_COMP + ", z AS (SELECT count(*) AS size FROM c GROUP BY root) SELECT round(max(size) / sum(size), 6) AS pinf, round((sum(size * size) - max(size) * max(size)) / (sum(size) - max(size)), 6) AS spread FROM z")
def pinf(spark):
    return C.order_parameter(_comps(spark)).select(r6(F.col("pinf")).alias("pinf"), r6(F.col("spread")).alias("spread"))


@query(_COMP + "SELECT id FROM c WHERE root <> (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)")
def giant_leftoff(spark):
    return C.giant(*_diluted(spark))[2]


@query(f"WITH RECURSIVE {BASE}, k AS (SELECT src AS i, dst AS j FROM e JOIN s p ON p.id = src JOIN s q ON q.id = dst WHERE p.s = q.s), b2 AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k), r AS (SELECT id, id AS x FROM s UNION SELECT r.id, b2.j FROM r JOIN b2 ON r.x = b2.i), c AS (SELECT id, min(x) AS root FROM r GROUP BY id) SELECT s.s, max(n) AS largest, count(*) AS clusters FROM (SELECT root, count(*) AS n FROM c GROUP BY root) JOIN s ON s.id = root GROUP BY s.s")
def same_sign_clusters(spark):
    c = C.same_sign_clusters(signed(spark), spins(spark)).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return c.join(spins(spark), F.col("root") == F.col("id")).groupBy("s").agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("clusters"))


_WEIGHTED = f"SELECT src, dst, (1 + {H.edge_hash_sql('src', 'dst', 9)} % 1000) / 1000.0::DOUBLE AS w FROM ({square_sql(8)})"


def _weighted(spark: SparkSession) -> DataFrame:
    return lattice(spark, 8).edges.select("src", "dst", ((1 + H.edge_hash(salt=9) % 1000) / 1000.0).alias("w"))


@query(
    f"""WITH RECURSIVE e AS ({_WEIGHTED}), g AS (SELECT DISTINCT w AS t FROM e),
b AS (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e),
r AS (SELECT t, 0::BIGINT AS x FROM g UNION SELECT r.t, b.j FROM r JOIN b ON r.x = b.i AND b.w >= r.t),
n AS (SELECT t, count(*) AS n FROM r GROUP BY t)
SELECT round(max(t), 6) AS threshold FROM n WHERE n = 64"""
)
def detachment_threshold(spark):
    return C.detachment_threshold(_weighted(spark)).select(r6(F.col("threshold")).alias("threshold"))


@query(
    f"""WITH RECURSIVE e AS ({_WEIGHTED}), m AS (SELECT min(w) AS lo, max(w) AS hi, count(*) AS total FROM e),
g AS (SELECT k, CASE WHEN k = 11 THEN hi ELSE lo * pow(hi / lo, k / 11.0) END AS t FROM range(12) t(k), m),
b AS (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e),
r AS (SELECT k, t, id, id AS x FROM g, range(64) u(id) UNION SELECT r.k, r.t, r.id, b.j FROM r JOIN b ON r.x = b.i AND b.w >= r.t),
c AS (SELECT k, t, id, min(x) AS root FROM r GROUP BY ALL), z AS (SELECT k, t, root, count(*) AS n FROM c GROUP BY ALL)
SELECT round(t, 6) AS threshold, round(max(n) / 64, 6) AS giant_nodes FROM z GROUP BY k, t"""
)
def threshold_curve(spark):
    return C.thresholds(_weighted(spark), 64, 12).select(r6(F.col("threshold")).alias("threshold"), r6(F.col("giant_nodes")).alias("giant_nodes"))


@query(f"SELECT id, CAST(CASE WHEN id < 30 THEN 5 ELSE 2 END AS INTEGER) AS core FROM range(36) t(id)")
def core_numbers(spark):
    """A ring of 36 nodes with two neighbours each, and its first 30 nodes in five-core blocks of six."""
    block = spark.range(30).select(F.col("id").alias("src"), F.explode(F.expr("sequence(id div 6 * 6, id div 6 * 6 + 5)")).alias("dst"))
    e = L.canonical(block.unionByName(spark.range(36).select(F.col("id").alias("src"), ((F.col("id") + 1) % 36).alias("dst"))))
    return C.core_numbers(e, spark.range(36)).select("id", "core")


# --- spins ----------------------------------------------------------------


@query(
    W
    + f""", t AS (SELECT -sum(w * p.s * q.s) AS total FROM e JOIN s p ON p.id = src JOIN s q ON q.id = dst),
h AS (SELECT i, avg(w * s) AS f FROM b JOIN s ON id = j GROUP BY i)
SELECT total, round(total / {N}, 6) AS per_spin, round(total / {2 * N}, 6) AS per_edge, round((SELECT -sum(s * f) FROM h JOIN s ON id = i), 6) AS degree_mean FROM t"""
)
def energy_variants(spark):
    return G.energies(signed(spark), spins(spark)).select("total", *[r6(F.col(c)).alias(c) for c in ("per_spin", "per_edge", "degree_mean")])


@query(W + "SELECT id, s.s, sum(w * q.s2) AS field, count(*) AS degree FROM s JOIN b ON b.i = s.id JOIN (SELECT id AS id2, s AS s2 FROM s) q ON q.id2 = b.j GROUP BY id, s.s")
def local_fields(spark):
    return G.local_fields(signed(spark), spins(spark)).select("id", "s", (F.col("field") + 0.0).alias("field"), "degree")


_FIELD = W + ", h AS (SELECT i, sum(w * s) AS f FROM b JOIN s ON id = j GROUP BY i) "


@query(_FIELD + "SELECT bool_and(s * f >= 0) AS stable FROM h JOIN s ON id = i")
def stable_at_zero(spark):
    return G.stable_at_zero(signed(spark), spins(spark))


@query(_FIELD + "SELECT id, CAST(CASE WHEN s * f < 0 THEN -s ELSE s END AS INTEGER) AS s FROM h JOIN s ON id = i")
def synchronous_t0_sweep(spark):
    return G.parallel_step(signed(spark), spins(spark))


@query(f"WITH a AS ({spins_sql()}), b AS ({spins_sql(salt=1)}) SELECT round(abs(avg(a.s * b.s)), 6) AS overlap, round(greatest(avg(CASE WHEN a.s = b.s THEN 1.0 ELSE 0.0 END), avg(CASE WHEN a.s = -b.s THEN 1.0 ELSE 0.0 END)), 6) AS matching FROM a JOIN b ON a.id = b.id")
def spin_overlap(spark):
    j = spins(spark).join(spins(spark, salt=1).withColumnRenamed("s", "t"), "id")
    return j.agg(r6(S.overlap("s", "t")).alias("overlap"), r6(S.matching_fraction("s", "t")).alias("matching"))


_PATTERNS = " UNION ALL ".join(f"SELECT {k} AS pattern, id AS node, s FROM ({spins_sql(64, k)})" for k in range(3))


def _patterns(spark: SparkSession) -> DataFrame:
    out = None
    for k in range(3):
        one = spins(spark, 64, k).select(F.lit(k).alias("pattern"), F.col("id").alias("node"), "s")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH p AS ({_PATTERNS}) SELECT node, CAST(1 - 2 * (sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) % 2) AS INTEGER) AS s FROM p GROUP BY node")
def product_state(spark):
    return S.product_state(_patterns(spark))


@query(f"WITH p AS ({_PATTERNS}) SELECT node, CAST(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) % 2 AS INTEGER) AS x FROM p GROUP BY node")
def xor_state(spark):
    return S.xor_state(_patterns(spark))


@query(f"WITH p AS ({_PATTERNS}) SELECT node, CAST(CASE WHEN sum(s * (pattern + 0.5)) < 0 THEN -1 ELSE 1 END AS INTEGER) AS s FROM p GROUP BY node")
def weighted_state(spark):
    p = _patterns(spark)
    return S.weighted_state(p, p.select("pattern", (F.col("pattern") + 0.5).alias("weight")).distinct())


@query(f"WITH p AS ({_PATTERNS}) SELECT a.node AS i, b.node AS j, round(sum(a.s * b.s) / 3, 6) + 0.0 AS v FROM p a JOIN p b ON a.pattern = b.pattern AND a.node <> b.node GROUP BY 1, 2")
def hebbian_weights(spark):
    p = _patterns(spark)
    a, b = p.select("pattern", F.col("node").alias("i"), F.col("s").alias("sa")), p.select("pattern", F.col("node").alias("j"), F.col("s").alias("sb"))
    return a.join(b, "pattern").where("i <> j").groupBy("i", "j").agg(r6(F.sum(F.col("sa") * F.col("sb")) / 3).alias("v"))


@query(f"WITH p AS (SELECT id AS node, id % 5 AS g, CAST(s AS INTEGER) AS s FROM ({spins_sql()})), m AS (SELECT g, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) * 2 > count(*) AS most FROM p GROUP BY g) SELECT node, CAST(CASE WHEN most THEN -s ELSE s END AS INTEGER) AS s FROM p JOIN m ON p.g = m.g")
def majority_flip(spark):
    return S.majority_positive(spins(spark).select(F.col("id").alias("node"), (F.col("id") % 5).alias("g"), "s"), "s", ["g"]).select("node", "s")


@query(W + "SELECT i AS id, sum(CASE WHEN s > 0 THEN greatest(w, 0) ELSE 0 END) AS infection, 0.5 + sum(CASE WHEN s > 0 THEN greatest(-w, 0) ELSE 0 END) AS recovery FROM b JOIN s ON id = j GROUP BY i")
def contact_rates(spark):
    active = spins(spark).select("id", F.when(F.col("s") > 0, 1).otherwise(0).alias("s"))
    return D.contact_rates(signed(spark), active, 0.5)


_STEP = "SELECT id, x - 0.05 * sum(l) AS x FROM (SELECT y.id, y.x, abs(w) * y.x - w * z.x AS l FROM {x} y JOIN b ON b.i = y.id JOIN {x} z ON z.id = b.j) GROUP BY id, x"


@query(W + f", x0 AS (SELECT id, CAST(s AS DOUBLE) AS x FROM s), x1 AS ({_STEP.format(x='x0')}), x2 AS ({_STEP.format(x='x1')}), x3 AS ({_STEP.format(x='x2')}) SELECT id, round(x, 6) + 0.0 AS x FROM x3")
def diffusion_steps(spark):
    return D.diffusion(signed(spark), spins(spark).select("id", F.col("s").cast("double").alias("x")), 0.05, 3).select("id", r6(F.col("x")).alias("x"))


# --- series of replicas: no closed form, so rows only --------------------------


@query()
def ising_series(spark):
    return D.ising(spark, signed(spark), N, temperature=1.0, sweeps=5, count=4)


@query()
def ising_zero_temperature(spark):
    return D.ising(spark, signed(spark), N, temperature=0.0, sweeps=20, count=4, update="asynchronous", start="up")


@query()
def ising_annealed(spark):
    return D.ising(spark, signed(spark), N, temperature=0.1, sweeps=10, count=4, cooling_from=3.0)


@query()
def ising_snapshots(spark):
    return D.snapshots(spark, signed(spark), N, temperature=2.0, sweeps=4, every=2, count=2)


@query()
def voter_series(spark):
    return D.voter(spark, signed(spark), N, sweeps=5, count=4)


@query()
def contact_series(spark):
    return D.contact(spark, signed(spark), N, recovery=0.5, sweeps=5, count=4)


@query()
def signed_walk(spark):
    return D.signed_walk(spark, signed(spark), N, steps=50, count=4)


@query()
def trapped_walks(spark):
    g = L.square(spark, 50, periodic=False)
    return D.trapped_walk(spark, G.flip_hash(g.edges, 0.5), g.n, columns=50, coordination=4, count=20, start=25 * 50 + 25)


@query()
def correlated_chain(spark):
    return D.chain(spark, 200, 1.0, count=3)


QUERIES = Q

