"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import emb, kernels, lattice, signed, spectra, tables

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [emb, lattice, signed, spectra, tables, kernels]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.SQL
    return out
