"""Sweeps: parameters times replicas, run where results are missing, averaged when they are read.

Results are a table partitioned by parameters; a run appends the replicas that
aren't there yet, so a sweep that was stopped goes on where it was, and no
running mean has to be kept or merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dynamics as D
from ..operators import graph as G
from ..sources import lattices as L
from .kernels import base_graph, percolation_kernel  # noqa: F401  (a kernel like the others here)


def results(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run(spark: SparkSession, path: str, params: list[dict], replicas: int, kernel: Callable[[SparkSession, dict, int, int], DataFrame]) -> int:
    """kernel(spark, params, first, count) -> rows with a replica column; gives how many replicas were run.

    Replicas are numbered from 0. Of each parameter point those from the first
    missing number on are run, and the missing ones appended.
    """
    done, ran = results(spark, path), 0
    for p in params:
        own = None if done is None else done.where(" AND ".join(f"{k} = {v!r}" for k, v in p.items()))
        wanted = spark.range(replicas).select(F.col("id").alias("replica"))
        missing = D.resume(own, wanted, ["replica"]).agg(F.min("replica"), F.count(F.lit(1))).first()
        if not missing[1]:
            continue
        rows = kernel(spark, p, missing[0], replicas - missing[0])
        if own is not None:
            rows = rows.join(own.select("replica").distinct(), "replica", "left_anti")
        for k, v in p.items():
            rows = rows.withColumn(k, F.lit(v))
        rows.write.partitionBy(*p).mode("append").parquet(path)
        ran += missing[1]
    return ran


def averages(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, spread): population deviation over replicas."""
    return table.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def ising_kernel(spark: SparkSession, p: dict, first: int, count: int) -> DataFrame:
    """Series of one disordered graph (geo, side, p, temperature); replica numbers seed the runs' randomness."""
    if p.get("geo") == "er":
        g = L.erdos_renyi(spark, p["side"], p["link"], salt=1)
    else:
        g = base_graph(spark, p)
    s = D.ising(spark, G.flip_hash(g.edges, p["p"]), g.n, temperature=p["temperature"], sweeps=p.get("sweeps", 5), count=first + count)
    return s.where(F.col("replica") >= first)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first if it isn't there. Seeds belong in the path as well as in build."""
    known = results(spark, path)
    if known is None:
        build().write.parquet(path)
        known = spark.read.parquet(path)
    return known
