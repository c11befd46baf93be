"""Graph sources as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import hashing as H
from ..sources import lattices as L
from .common import square_sql


def _edges(build: Callable[[SparkSession], L.Graph]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(spark).edges.select("src", "dst")


QUERIES = {
    "lat_square_edges": _edges(lambda s: L.square(s, 16)),
    "lat_square_open_edges": _edges(lambda s: L.square(s, 6, 9, periodic=False)),
    "lat_square_half_open_edges": _edges(lambda s: L.square(s, 6, 9, periodic=(True, False))),
    "lat_tri_edges": _edges(lambda s: L.triangular(s, 8, 10)),
    "lat_tri_open_edges": _edges(lambda s: L.triangular(s, 5, 7, periodic=False)),
    "lat_hex_edges": _edges(lambda s: L.hexagonal(s, 8, 10)),
    "lat_oct_edges": _edges(lambda s: L.octagonal(s, 4, 5)),
    "lat_cubic_edges": _edges(lambda s: L.cubic(s, (5, 4, 3))),
    "lat_bcc_edges": _edges(lambda s: L.cubic(s, (4, 4, 4), "bcc")),
    "lat_fcc_edges": _edges(lambda s: L.cubic(s, (4, 3, 3), "fcc")),
    "lat_hypercubic_edges": _edges(lambda s: L.hypercubic(s, [3, 4, 3, 3])),
    "recursive_triangle_edges": _edges(lambda s: L.recursive_triangles(s, 4)),
    "complete_edges": _edges(lambda s: L.complete(s, 30)),
    "random_pair_edges": _edges(lambda s: L.erdos_renyi(s, 120, 0.05)),
    "ring_edges": _edges(lambda s: L.ring(s, 50, 4)),
    "small_world_edges": _edges(lambda s: L.watts_strogatz(s, 200, 4, 0.1)),
    "diluted_edges": _edges(lambda s: L.dilute(L.square(s, 16), 0.2)),
}


def _once(rows: str) -> str:
    return f"SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM ({rows}) WHERE b IS NOT NULL AND a <> b"


def _axes(dims: list[int]) -> str:
    parts, stride = [], 1
    for side in reversed(dims):
        at = f"((id // {stride}) % {side})"
        parts.append(f"id + (({at} + 1) % {side} - {at}) * {stride}")
        stride *= side
    return _once(f"SELECT id AS a, unnest([{', '.join(parts)}]) AS b FROM range({stride}) t(id)")


def _grid(m: int, n: int, rows: str) -> str:
    return _once(f"SELECT id AS a, unnest([{rows}]) AS b FROM (SELECT id, id // {n} AS r, id % {n} AS c FROM range({m * n}) t(id))")


def _cells(dims: tuple[int, int, int], k: int, targets: list[tuple[int, int, int, int, int]]) -> str:
    """targets: (place, dx, dy, dz, place there)."""
    a, b, c = dims
    one = [f"SELECT id * {k} + {p} AS a, ((((x + {dx}) % {a}) * {b} + (y + {dy}) % {b}) * {c} + (z + {dz}) % {c}) * {k} + {q} AS b FROM g" for p, dx, dy, dz, q in targets]
    return f"WITH g AS (SELECT id, id // {b * c} AS x, (id // {c}) % {b} AS y, id % {c} AS z FROM range({a * b * c}) t(id)) " + _once(" UNION ALL ".join(one))


_AXES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]

SQL = {
    "lat_square_edges": square_sql(16),
    "lat_square_open_edges": _grid(6, 9, "CASE WHEN c < 8 THEN id + 1 END, CASE WHEN r < 5 THEN id + 9 END"),
    "lat_square_half_open_edges": _grid(6, 9, "CASE WHEN c < 8 THEN id + 1 END, ((r + 1) % 6) * 9 + c"),
    "lat_tri_edges": _grid(8, 10, "r * 10 + (c + 1) % 10, ((r + 1) % 8) * 10 + c, ((r + 1) % 8) * 10 + (CASE WHEN r % 2 = 1 THEN (c + 1) % 10 ELSE (c + 9) % 10 END)"),
    "lat_tri_open_edges": _grid(5, 7, "CASE WHEN c < 6 THEN id + 1 END, CASE WHEN r < 4 THEN id + 7 END, CASE WHEN r < 4 AND r % 2 = 1 AND c < 6 THEN id + 8 WHEN r < 4 AND r % 2 = 0 AND c > 0 THEN id + 6 END"),
    "lat_hex_edges": _grid(8, 10, "((r + 1) % 8) * 10 + c, CASE WHEN r % 2 = c % 2 THEN r * 10 + (c + 1) % 10 END"),
    "lat_oct_edges": "WITH g AS (SELECT id * 4 AS o, (id // 5 * 5 + (id % 5 + 1) % 5) * 4 AS rt, ((id // 5 + 1) % 4 * 5 + id % 5) * 4 AS up FROM range(20) t(id)) "
    + _once("SELECT o AS a, o + 1 AS b FROM g UNION ALL SELECT o + 1, o + 3 FROM g UNION ALL SELECT o + 3, o + 2 FROM g UNION ALL SELECT o + 2, o FROM g UNION ALL SELECT o + 2, rt + 1 FROM g UNION ALL SELECT o + 3, up FROM g"),
    "lat_cubic_edges": _axes([5, 4, 3]),
    "lat_bcc_edges": _cells((4, 4, 4), 2, [(0, *d, 0) for d in _AXES] + [(1, x, y, z, 0) for x in (0, 1) for y in (0, 1) for z in (0, 1)]),
    "lat_fcc_edges": _cells((4, 3, 3), 4, [(p, *d, p) for p in range(4) for d in _AXES]),
    "lat_hypercubic_edges": _axes([3, 4, 3, 3]),
    "complete_edges": "SELECT a.id AS src, b.id AS dst FROM range(30) a(id) JOIN range(30) b(id) ON a.id < b.id",
    "random_pair_edges": f"SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst FROM range(120) a(id) JOIN range(120) b(id) ON a.id < b.id) WHERE {H.edge_hash_sql('src', 'dst')} % 1000 < 50",
    "ring_edges": _once("SELECT id AS a, (id + k) % 50 AS b FROM range(50) t(id) CROSS JOIN (VALUES (1), (2)) v(k)"),
    "small_world_edges": f"""
WITH e AS ({_once('SELECT id AS a, (id + k) % 200 AS b FROM range(200) t(id) CROSS JOIN (VALUES (1), (2)) v(k)')}),
m AS (SELECT src, dst, CASE WHEN {H.edge_hash_sql('src', 'dst')} % 1000 < 100 THEN ({H.edge_hash_sql('src', 'dst', 1)}) % 200 END AS new FROM e),
k AS (SELECT *, least(src, new) AS a, greatest(src, new) AS b FROM m WHERE new IS NOT NULL AND new <> src),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY src, dst) AS first FROM k WHERE (a, b) NOT IN (SELECT (src, dst) FROM e))
SELECT m.src, m.dst FROM m LEFT JOIN (SELECT * FROM f WHERE first = 1) f ON m.src = f.src AND m.dst = f.dst WHERE f.src IS NULL
UNION ALL SELECT a AS src, b AS dst FROM f WHERE first = 1""",
    "diluted_edges": f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY {H.edge_hash_sql('src', 'dst')}, src, dst) AS k FROM ({square_sql(16)})) WHERE k > 102",
    "recursive_triangle_edges": "WITH RECURSIVE "
    + "g0 AS (SELECT 0 AS src, 1 AS dst), "
    + ", ".join(
        f"n{k} AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 + {n} AS x FROM g{k}), g{k + 1} AS (SELECT src, dst FROM n{k} UNION ALL SELECT src, x FROM n{k} UNION ALL SELECT dst, x FROM n{k})"
        for k, n in ((0, 2), (1, 3), (2, 6), (3, 15))
    )
    + " SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM g4",
}
