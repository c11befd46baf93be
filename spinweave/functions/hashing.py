"""Deterministic disorder: integer hashes that any engine computes alike.

All products stay below 2**63, so results equal those of plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647


def _sql(x: str, div: str) -> str:
    a = f"(({x}) * 48271 + 11) % {M}"
    b = f"(({a}) * ({a}) + ({x})) % {M}"
    c = f"(({b}) * 69621 + 7) % {M}"
    return f"((({c}) * ({c})) % {M}) {div} 1024"


def edge_key(src: str, dst: str, salt: int | str = 0) -> str:
    """salt: a number, or the name of a column that holds it."""
    more = str(salt * 104729) if isinstance(salt, int) else f"CAST({salt} AS BIGINT) * 104729"
    return f"CAST({src} AS BIGINT) * 1000003 + CAST({dst} AS BIGINT) * 7919 + 17 + {more}"


def node_key(node: str, salt: int | str = 0) -> str:
    """salt: a number, or the name of a column that holds it."""
    more = str(1000003 * salt) if isinstance(salt, int) else f"CAST({salt} AS BIGINT) * 1000003"
    return f"CAST({node} AS BIGINT) + {more}"


def edge_hash(src: str = "src", dst: str = "dst", salt: int | str = 0) -> Column:
    """Hash of an edge, 0 to about 2**21."""
    return F.expr(_sql(edge_key(src, dst, salt), "div"))


def node_hash(node: str = "id", salt: int | str = 0) -> Column:
    return F.expr(_sql(node_key(node, salt), "div"))


def edge_hash_sql(src: str, dst: str, salt: int | str = 0) -> str:
    """The same hash in SQL with // as integer division."""
    return _sql(edge_key(src, dst, salt), "//")


def node_hash_sql(node: str, salt: int | str = 0) -> str:
    return _sql(node_key(node, salt), "//")


def flips(p: float, src: str = "src", dst: str = "dst", salt: int | str = 0) -> Column:
    """True for about a share p of all edges."""
    return edge_hash(src, dst, salt) % 1000 < F.lit(1000 * p)


def spin(node: str = "id", salt: int | str = 0) -> Column:
    """+1 or -1 by the node's hash."""
    return (F.lit(1) - F.lit(2) * (node_hash(node, salt) % 2)).cast("int")


def spin_sql(node: str, salt: int | str = 0) -> str:
    return f"CAST(1 - 2 * (({node_hash_sql(node, salt)}) % 2) AS INTEGER)"
