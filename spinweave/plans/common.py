"""Shared pieces of the queries: fixed graphs and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import graph as G
from ..sources import lattices as L

SIDE, P = 16, 0.15
N = SIDE * SIDE


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def lattice(spark: SparkSession, side: int = SIDE) -> L.Graph:
    return L.square(spark, side)


def signed(spark: SparkSession, side: int = SIDE, p: float = P) -> DataFrame:
    return G.flip_hash(L.square(spark, side).edges, p)


def spins(spark: SparkSession, n: int = N, salt: int = 0) -> DataFrame:
    return spark.range(n).select("id", H.spin("id", salt).alias("s"))


def square_sql(side: int = SIDE) -> str:
    """Edges of the periodic square lattice."""
    return f"""SELECT least(a, b) AS src, greatest(a, b) AS dst FROM (
  SELECT id AS a, unnest([(id // {side}) * {side} + (id % {side} + 1) % {side}, ((id // {side} + 1) % {side}) * {side} + id % {side}]) AS b
  FROM range({side * side}) t(id)) GROUP BY 1, 2"""


def signed_sql(side: int = SIDE, p: float = P, salt: int = 0) -> str:
    return f"SELECT src, dst, CASE WHEN {H.edge_hash_sql('src', 'dst', salt)} % 1000 < {1000 * p} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ({square_sql(side)})"


def spins_sql(n: int = N, salt: int = 0) -> str:
    return f"SELECT id, {H.spin_sql('id', salt)} AS s FROM range({n}) t(id)"


#: to follow WITH: e(src, dst, w), s(id, s), b(i, j, w) in both directions
BASE = f"e AS ({signed_sql()}), s AS ({spins_sql()}), b AS (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e)"
