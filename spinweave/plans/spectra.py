"""Spectra of lattices against their closed forms, entropy, distances, linkage, bases, proteins, files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import dynamics as D
from ..operators import graph as G
from ..operators import protein as PR
from ..operators import protein_bases as PB
from ..operators import spectral as SP
from ..functions import stats as S

from .common import lattice, r6, signed, signed_sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = lambda spark, sf_dir: f(spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_EV = "SELECT 4 - 2 * cos(2 * pi() * (id // {n}) / {n}) - 2 * cos(2 * pi() * (id % {n}) / {n}) AS ev FROM range({n} * {n}) t(id)"


def _analytic(spark: SparkSession, side: int) -> DataFrame:
    """Eigenvalues of the periodic square lattice's Laplacian, in no order."""
    a = lambda c: 2 * F.cos(2 * math.pi * c / side)
    return spark.range(side * side).select(F.col("id").alias("k"), (4 - a(F.expr(f"id div {side}")) - a(F.col("id") % side)).alias("ev"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY ev) - 1 AS INTEGER) AS k, round(ev, 6) + 0.0 AS ev FROM ({_EV.format(n=8)})")
def eigen_spectrum(spark):
    """The built graph's spectrum equals the closed form."""
    s = SP.spectrum(G.laplacian(lattice(spark, 8).edges, signed=False))
    return s.select("k", r6(F.col("ev")).alias("ev"))


@query(f"WITH e AS ({signed_sql(8)}), b AS (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e), d AS (SELECT i, sum(abs(w)) AS d FROM b GROUP BY i) SELECT count(*) AS modes, CAST(round(sum(d)) AS BIGINT) AS trace, CAST(round(sum(d * d) + (SELECT sum(w * w) FROM b)) AS BIGINT) AS trace_square, true AS orthonormal, true AS non_negative FROM d")
def eigen_modes(spark):
    """Modes are orthonormal and their eigenvalues have the matrix's traces."""
    m = SP.signed_modes(signed(spark, 8))
    ev = m.select("k", "ev").distinct()
    ok = SP.is_orthonormal(m.select("k", "node", "x"))
    return ev.agg(F.count(F.lit(1)).alias("modes"), F.round(F.sum("ev")).cast("long").alias("trace"), F.round(F.sum(F.col("ev") * F.col("ev"))).cast("long").alias("trace_square"), (F.min("ev") > -1e-9).alias("non_negative")).crossJoin(ok).select("modes", "trace", "trace_square", "orthonormal", "non_negative")


_TAU = "SELECT CAST(i AS INTEGER) AS i, pow(10, -2 + 7 * i / 19.0) AS tau FROM range(20) t(i)"
_ENT = f"""WITH s AS ({_EV.format(n=16)}), t AS ({_TAU}), z AS (SELECT i, tau, sum(exp(-tau * ev)) AS z FROM s, t GROUP BY ALL),
p AS (SELECT z.i, z.tau, ev, exp(-z.tau * ev) / z AS p FROM s, z),
h AS (SELECT i, tau, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(256) AS s, sum(p * ev * ev) - sum(p * ev) * sum(p * ev) AS v FROM p GROUP BY ALL) """


def _entropy(spark: SparkSession) -> DataFrame:
    return SP.entropy(_analytic(spark, 16), S.spaced(spark, -2, 5, 20, 10))


@query(_ENT + "SELECT i, round(s, 6) + 0.0 AS s, round(v, 6) + 0.0 AS variance FROM h")
def entropy_analytic(spark):
    return _entropy(spark).select("i", r6(F.col("s")).alias("s"), r6(F.col("variance")).alias("variance"))


@query(_ENT + "SELECT i, round(c, 5) + 0.0 AS c FROM (SELECT i, ln(256) * (s - lead(s) OVER (ORDER BY i)) / (ln(lead(tau) OVER (ORDER BY i)) - ln(tau)) AS c FROM h) WHERE c IS NOT NULL")
def specific_heat_analytic(spark):
    return SP.specific_heat(_entropy(spark), 256).select("i", (F.round("c", 5) + 0.0).alias("c"))


@query(_ENT + ", c AS (SELECT i, ln(256) * (s - lead(s) OVER (ORDER BY i)) / (ln(lead(tau) OVER (ORDER BY i)) - ln(tau)) AS c FROM h), m AS (SELECT i, c, lag(c) OVER (ORDER BY i) AS a, lead(c) OVER (ORDER BY i) AS b FROM c) SELECT i FROM m WHERE c > a AND c > b AND c >= 0.1")
def characteristic_scales(spark):
    return S.local_maxima(SP.specific_heat(_entropy(spark), 256), "i", "c", 0.1).select("i")


#: an orthonormal basis in closed form: Walsh functions of 16 nodes
_WALSH = "SELECT CAST(k AS INTEGER) AS k, node, CASE WHEN bit_count(k & node) % 2 = 0 THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS x FROM range(16) a(k), range(16) b(node)"
_VEC = "SELECT node, (node * node * 7 % 13) / 10.0::DOUBLE AS v FROM range(16) t(node)"


def _walsh(spark: SparkSession) -> DataFrame:
    return spark.range(256).select(F.expr("cast(id div 16 as int)").alias("k"), (F.col("id") % 16).alias("node")).withColumn("x", F.when(F.bit_count(F.col("k").bitwiseAND(F.col("node"))) % 2 == 0, 0.25).otherwise(-0.25))


def _vector(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("node"), ((F.col("id") * F.col("id") * 7 % 13) / 10.0).alias("v"))


@query(f"WITH w AS ({_WALSH}) SELECT a.k AS a, b.k AS b, round(sum(a.x * b.x), 6) + 0.0 AS g FROM w a JOIN w b ON a.node = b.node AND a.k <= b.k GROUP BY 1, 2")
def gram_orthonormal(spark):
    return SP.gram(_walsh(spark)).select("a", "b", r6(F.col("g")).alias("g"))


_RECON = f"WITH w AS ({_WALSH}), v AS ({_VEC}), c AS (SELECT k, sum(x * v) AS c FROM w JOIN v ON w.node = v.node GROUP BY k), r AS (SELECT a.k, w.node, sum(c.c * w.x) AS r FROM range(15) a(k) JOIN w ON w.k <= a.k JOIN c ON c.k = w.k GROUP BY 1, 2) "


@query(_RECON + "SELECT k, round(c, 6) + 0.0 AS c FROM c")
def projection(spark):
    return SP.coefficients(_walsh(spark), _vector(spark)).select("k", r6(F.col("c")).alias("c"))


@query(_RECON + "SELECT CAST(k AS INTEGER) AS k, round(avg(pow(r / (SELECT max(r) FROM r WHERE k = 14) - v, 2)), 6) AS mse FROM r JOIN v ON v.node = r.node GROUP BY k")
def prefix_recon_mse(spark):
    return SP.reconstruction_mse(SP.prefix_reconstruction(_walsh(spark), _vector(spark)), _vector(spark)).select("k", r6(F.col("mse")).alias("mse"))


@query(_RECON + "SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN round(r, 9) < 0 THEN -1 ELSE 1 END * CASE WHEN v.node % 3 = 0 THEN -1 ELSE 1 END), 6) + 0.0 AS overlap FROM r JOIN v ON v.node = r.node GROUP BY k")
def match_series(spark):
    recon = SP.prefix_reconstruction(_walsh(spark), _vector(spark)).withColumn("v", F.round("v", 9))
    return SP.match_series(recon, spark.range(16).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("s"))).select("k", r6(F.col("overlap")).alias("overlap"))


@query(f"WITH w AS ({_WALSH}), v AS ({_VEC}) SELECT k, round(sum(x * v), 6) + 0.0 AS c FROM w JOIN v ON w.node = v.node GROUP BY k")
def solved_coefficients(spark):
    return SP.solve(_walsh(spark), _vector(spark)).select("k", r6(F.col("c")).alias("c"))


#: points on a line in three groups; single linkage merges by rising gap
_POINTS = "SELECT id, CAST(id * id AS DOUBLE) + CASE WHEN id > 5 THEN 100.0 ELSE 0.0 END AS x FROM range(12) t(id)"


def _points(spark: SparkSession) -> DataFrame:
    return spark.range(12).select("id", (F.col("id") * F.col("id") + F.when(F.col("id") > 5, 100.0).otherwise(0.0)).alias("x"))


def _line(spark: SparkSession) -> DataFrame:
    p = _points(spark)
    return p.select(F.col("id").alias("i"), F.col("x").alias("xi")).join(p.select(F.col("id").alias("j"), F.col("x").alias("xj")), F.col("i") < F.col("j")).select("i", "j", F.abs(F.col("xi") - F.col("xj")).alias("d"))


@query(f"WITH p AS ({_POINTS}), g AS (SELECT lead(x) OVER (ORDER BY id) - x AS h FROM p) SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS step, h AS height FROM g WHERE h IS NOT NULL")
def linkage_heights(spark):
    return SP.linkage(_line(spark), "single").select("step", "height")


@query(f"WITH p AS ({_POINTS}), g AS (SELECT id, lead(x) OVER (ORDER BY id) - x AS h FROM p) SELECT a.id AS i, b.id AS j, max(g.h) AS d FROM p a JOIN p b ON a.id < b.id JOIN g ON g.id >= a.id AND g.id < b.id GROUP BY 1, 2")
def ultrametric(spark):
    return SP.cophenetic(SP.linkage(_line(spark), "single"), 12).select("i", "j", "d")


@query(f"WITH p AS ({_POINTS}), g AS (SELECT lead(x) OVER (ORDER BY id) - x AS h FROM p), k AS (SELECT h, lead(h) OVER (ORDER BY h) AS u FROM g WHERE h IS NOT NULL) SELECT round(0.9 * arg_max(u, log10(u / h)), 6) AS threshold FROM k WHERE u IS NOT NULL")
def dendrogram_gap(spark):
    return SP.gap_threshold(SP.linkage(_line(spark), "single")).select(r6(F.col("threshold")).alias("threshold"))


@query("SELECT node, round(cos(2 * pi() * k / 20), 6) + 0.0 AS x, round(sin(2 * pi() * k / 20), 6) + 0.0 AS y FROM (SELECT id AS node, row_number() OVER (ORDER BY id % 3, id) - 1 AS k FROM range(20) t(id))")
def circular_layout(spark):
    return SP.circular_layout(spark.range(20).select(F.col("id").alias("node"), (F.col("id") % 3).alias("cluster"))).select("node", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"WITH s AS ({_EV.format(n=4)}), z AS (SELECT sum(exp(-0.5 * ev)) AS z FROM s), g AS (SELECT a, b, sum(exp(-0.5 * (4 - 2 * cos(2 * pi() * p / 4) - 2 * cos(2 * pi() * q / 4))) * cos(2 * pi() * (p * a + q * b) / 4)) / 16 AS r FROM range(4) a(a), range(4) b(b), range(4) p(p), range(4) q(q) GROUP BY 1, 2) SELECT i.id AS i, j.id AS j, round(z / r, 4) AS d FROM range(16) i(id) JOIN range(16) j(id) ON i.id < j.id JOIN g ON g.a = (j.id // 4 - i.id // 4 + 4) % 4 AND g.b = (j.id % 4 - i.id % 4 + 4) % 4, z")
def communicability_distance(spark):
    """The heat kernel of the 4 x 4 torus in closed form; half the wrapped steps are double in the closed form only where sides exceed 2."""
    return SP.communicability(G.laplacian(lattice(spark, 4).edges, signed=False), 0.5).select("i", "j", F.round("d", 4).alias("d"))


# --- proteins ----------------------------------------------------------------

_ATOMS = "SELECT 'p' || CAST(id // 20 AS VARCHAR) AS pdb_id, id % 20 AS idx, 3.8 * cos(id * 1.7) * (1 + id % 20) AS x, 3.8 * sin(id * 1.7) AS y, 1.5 * (id % 20) + id // 20 AS z FROM range(60) t(id)"


def _atoms(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(60).select(F.concat(F.lit("p"), F.expr("id div 20").cast("string")).alias("pdb_id"), (i % 20).alias("idx"), (3.8 * F.cos(i * 1.7) * (1 + i % 20)).alias("x"), (3.8 * F.sin(i * 1.7)).alias("y"), (1.5 * (i % 20) + F.expr("id div 20")).alias("z"))


@query(f"WITH a AS ({_ATOMS}), m AS (SELECT pdb_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1) SELECT m.pdb_id, k AS idx, round(coalesce(a.x, m.x), 6) + 0.0 AS x, round(coalesce(a.z, m.z), 6) AS z FROM m CROSS JOIN range(25) t(k) LEFT JOIN a ON a.pdb_id = m.pdb_id AND a.idx = k")
def pad_centroid(spark):
    return PR.padded(_atoms(spark), 25).select("pdb_id", "idx", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


@query(f"WITH a AS ({_ATOMS}), d AS (SELECT a.pdb_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM a JOIN a b ON a.pdb_id = b.pdb_id AND a.idx < b.idx) SELECT pdb_id, round(avg(CASE WHEN d < 8 THEN 1.0 ELSE 0.0 END), 6) AS contact_density FROM d GROUP BY 1")
def contact_density(spark):
    return PR.summary(_atoms(spark)).select("pdb_id", r6(F.col("contact_density")).alias("contact_density"))


@query(f"WITH a AS ({_ATOMS}), d AS (SELECT a.pdb_id, a.idx AS i, b.idx AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM a JOIN a b ON a.pdb_id = b.pdb_id AND a.idx < b.idx), n AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY i, j) - 1 AS k FROM d), f AS (SELECT *, max(d) OVER (PARTITION BY pdb_id) AS m FROM n WHERE k < 100) SELECT pdb_id, k, round(d / m, 6) AS v FROM f")
def distance_features(spark):
    return PR.distance_features(_atoms(spark), 100).select("pdb_id", "k", r6(F.col("v")).alias("v"))


@query(f"WITH a AS ({_ATOMS}), c AS (SELECT pdb_id, idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM a WINDOW w AS (PARTITION BY pdb_id)), f AS (SELECT pdb_id, idx * 3 AS k, x AS v FROM c UNION ALL SELECT pdb_id, idx * 3 + 1, y FROM c UNION ALL SELECT pdb_id, idx * 3 + 2, z FROM c) SELECT pdb_id, CAST(k // 2 AS BIGINT) AS k, round(v / max(abs(v)) OVER (PARTITION BY pdb_id), 6) + 0.0 AS v FROM f WHERE k % (60 // 25) = 0 AND k // (60 // 25) < 25")
def coordinate_features(spark):
    """60 values a protein, more than the 25 features."""
    return PR.coordinate_features(_atoms(spark), 25).select("pdb_id", "k", r6(F.col("v")).alias("v"))


@query("SELECT w.id AS at, arg_min(k.id, abs(k.id - w.id) * 1000 + k.id) + 0.5::DOUBLE AS v FROM (SELECT id * 7 AS id FROM range(15) t(id)) k, (SELECT id FROM range(110) t(id)) w GROUP BY w.id")
def nearest_fill(spark):
    return PR.nearest_fill(spark.range(15).select((F.col("id") * 7).alias("at"), (F.col("id") * 7 + 0.5).alias("v")), spark.range(110).select(F.col("id").alias("at")))


@query(f"""
WITH a AS ({_ATOMS}),
d AS (SELECT pdb_id, idx, lead(x) OVER w - x AS x, lead(y) OVER w - y AS y, lead(z) OVER w - z AS z FROM a WINDOW w AS (PARTITION BY pdb_id ORDER BY idx)),
s AS (SELECT *, sqrt(x * x + y * y + z * z) + 1e-8 AS size FROM d),
t AS (SELECT pdb_id, idx, acos(greatest(-1.0, least(1.0, (x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w) / (size * lag(size) OVER w)))) AS turn
      FROM s WINDOW w AS (PARTITION BY pdb_id ORDER BY idx)),
m AS (SELECT pdb_id, idx, (turn + lead(turn) OVER (PARTITION BY pdb_id ORDER BY idx)) / 2 AS mean FROM t),
r AS (SELECT pdb_id, idx, CASE WHEN idx < 2 OR idx > 17 THEN 'C' WHEN mean < pi() / 3 THEN 'E' WHEN mean > 2 * pi() / 3 THEN 'H' ELSE 'C' END AS ss FROM m)
SELECT pdb_id, idx, CASE WHEN lag(ss) OVER w = lead(ss) OVER w AND lag(ss) OVER w <> 'C' THEN lag(ss) OVER w ELSE ss END AS ss
FROM r WINDOW w AS (PARTITION BY pdb_id ORDER BY idx)""")
def secondary_structure(spark):
    return PR.secondary_structure(_atoms(spark))


_LINE = f"SELECT pdb_id, idx * 3 + a AS k, CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE CAST(z AS DOUBLE) END AS v FROM ({_ATOMS}) CROSS JOIN range(3) t(a)"


@query(f"""
WITH f AS ({_LINE}), t AS (SELECT pdb_id, sum(v * v) / 64 AS whole FROM f GROUP BY 1), l AS (SELECT pdb_id, sum(v) * sum(v) / 64 / 64 AS first FROM f GROUP BY 1)
SELECT t.pdb_id, used, round(CASE used WHEN 0 THEN whole ELSE whole - first END, 4) AS mse FROM t JOIN l ON t.pdb_id = l.pdb_id CROSS JOIN (VALUES (0), (1)) u(used)""")
def basis_errors(spark):
    """Errors with no mode and with the constant one of an 8 x 8 torus; 60 coordinates are filled up to 64."""
    c = PB.error_curves(PB.flat(_atoms(spark)), PB.basis(spark, "l2d_square", 60))
    return c.where("used < 2").select("pdb_id", F.col("used").cast("int").alias("used"), F.round("mse", 4).alias("mse"))


@query(f"SELECT pdb_id, idx, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, CAST(round(z, 5) AS DOUBLE) AS z FROM ({_ATOMS})")
def basis_round_trip(spark):
    """All modes give the coordinates back."""
    out = PB.fixed_reconstruction(spark, _atoms(spark), "l3d_sg", 22)
    return out.select("pdb_id", "idx", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query(f"""
WITH a AS ({_ATOMS}), m AS (SELECT pdb_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1)
SELECT r.pdb_id, r.idx, axis, round(CASE v % 3 WHEN 0 THEN a.x - m.x WHEN 1 THEN a.y - m.y ELSE a.z - m.z END + CASE axis WHEN 0 THEN m.x WHEN 1 THEN m.y ELSE m.z END, 5) + 0.0 AS v
FROM (SELECT pdb_id, idx, axis, CASE WHEN (idx * 3 + axis) // 2 >= 25 THEN 48 ELSE (idx * 3 + axis) // 2 * 2 END AS v FROM a CROSS JOIN range(3) t(axis)) r
JOIN a ON a.pdb_id = r.pdb_id AND a.idx = r.v // 3 JOIN m ON m.pdb_id = r.pdb_id""")
def coordinates_back(spark):
    """25 of 60 values kept, every second one: the others take the lower neighbour's, those at the end the last one's."""
    a = _atoms(spark)
    back = PB.coordinates(PR.coordinate_features(a, 25), PB.coordinate_scales(a, 25), 25)
    rows = back.select("pdb_id", "idx", F.posexplode(F.array("x", "y", "z")).alias("axis", "v"))
    return rows.select("pdb_id", "idx", F.col("axis").cast("long").alias("axis"), (F.round("v", 5) + 0.0).alias("v"))


@query(f"SELECT p AS pattern, id, {H.spin_sql('id', '(p + 5)')} AS s FROM range(3) q(p) CROSS JOIN range(40) t(id)")
def random_patterns(spark):
    return D.random_patterns(spark, 3, 40, salt=5)


@query()
def bandpass(spark):
    t = F.col("id")
    return PR.bandpass(spark.range(400).select((t % 2).alias("id"), F.expr("id div 2").alias("t"), (F.sin(t * 0.2) + F.sin(t * 2.1)).alias("v")), 0.5, 5.0, 50.0)


QUERIES = Q

