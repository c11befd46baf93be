"""Small numeric helpers as column expressions and tables."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def line(x: Column, a: float, b: float) -> Column:
    return a * x + b


def saturation(x: Column, c1: float, c2: float, power: float = 1.0) -> Column:
    """c2 * (1 - c1 / |x|^power), a finite-size extrapolation."""
    return F.lit(c2) * (1 - F.lit(c1) / F.pow(F.abs(x), F.lit(power)))


def in_range(x: Column, start: float, stop: float) -> Column:
    return x.between(start, stop)


def within_of_least(df: DataFrame, column: str, eta: float) -> DataFrame:
    """Rows at most eta over the least value; the least is one number, found first."""
    low = df.agg(F.min(column)).first()[0]
    return df.where(F.col(column) - F.lit(low) <= eta)


def fraction(x: Column, digits: int = 6) -> Column:
    """x as struct(num, den) in lowest terms, rounded to digits decimals first; the divisor is one of the powers of 2 times powers of 5."""
    den = 10**digits
    num = F.round(x * den).cast("long")
    divisors = [2**i * 5**j for i in range(digits + 1) for j in range(digits + 1)]
    common = F.greatest(*[F.when(num % d == 0, F.lit(d)).otherwise(F.lit(1)) for d in divisors])
    return F.struct((num / common).cast("long").alias("num"), (F.lit(den) / common).cast("long").alias("den"))


def unit_vector(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Values divided by their group's Euclidean norm; a zero vector stays zero."""
    w = Window.partitionBy(*(by or []))
    n = F.sqrt(F.sum(F.col(column) * F.col(column)).over(w))
    return df.withColumn(column, F.when(n > 0, F.col(column) / n).otherwise(0.0))


def product(spark: SparkSession, dims: list[int], adjust: int = 0) -> DataFrame:
    """(x0, x1, ...): the Cartesian product of ranges, by decoding one number; no join."""
    sides, n = [d + adjust for d in dims], 1
    for s in sides:
        n *= s
    cols, stride = [], n
    for k, s in enumerate(sides):
        stride //= s
        cols.append(F.expr(f"(id div {stride}) % {s}").alias(f"x{k}"))
    return spark.range(n).select(*cols)


def random_ids(df: DataFrame, key: str, length: int = 10, salt: int = 0, chars: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") -> DataFrame:
    """A string of letters and digits for each row, by hashes of its key."""
    if length < 1 or not chars:
        raise ValueError("length and chars must not be empty")
    one = lambda i: F.substring(F.lit(chars), (F.pmod(F.xxhash64(F.lit(salt), F.col(key), i), F.lit(len(chars))) + 1).cast("int"), F.lit(1))
    return df.withColumn("rid", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), one), ""))


def interpolate(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, v) at wanted(x) on the broken line through points(x, v); null outside. Windows find both neighbours at once."""
    rows = points.select("x", "v", F.lit(1).alias("own")).unionByName(wanted.select("x", F.lit(None).cast("double").alias("v"), F.lit(0).alias("own")))
    p = F.when(F.col("own") == 1, F.struct("x", "v"))
    left = Window.orderBy("x", F.col("own").desc()).rowsBetween(Window.unboundedPreceding, 0)
    right = Window.orderBy("x", "own").rowsBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("a", F.last(p, True).over(left)).withColumn("b", F.first(p, True).over(right)).where("own = 0")
    slope = (F.col("b.v") - F.col("a.v")) / (F.col("b.x") - F.col("a.x"))
    return near.select("x", F.when(F.col("a.x") == F.col("x"), F.col("a.v")).when(F.col("b.x") == F.col("x"), F.col("b.v")).otherwise(F.col("a.v") + slope * (F.col("x") - F.col("a.x"))).alias("v"))


def grid_nearest(points: DataFrame, cells: int, side: float) -> DataFrame:
    """(r, c, v): each cell of a square grid over [0, side)^2 takes the mean of its points(x, y, v), or the nearest filled cell's in growing rings."""
    own = points.groupBy(F.least(F.lit(cells - 1), F.floor(F.col("y") / side * cells)).alias("r"), F.least(F.lit(cells - 1), F.floor(F.col("x") / side * cells)).alias("c")).agg(F.avg("v").alias("v"))
    every = product(points.sparkSession, [cells, cells]).select(F.col("x0").alias("r"), F.col("x1").alias("c"))
    done, reach = every.join(own, ["r", "c"], "left"), [0, 1, 2, 4, 8, 16, 32, 64]
    for low, high in pairwise(reach):
        holes = done.where("v IS NULL")
        if low >= cells or holes.isEmpty():
            break
        # holes meet filled cells of blocks of the ring's size
        a = holes.select("r", "c", F.explode(F.expr(f"transform(sequence(0, 8), k -> struct(r div {high} + (k div 3) - 1 AS br, c div {high} + k % 3 - 1 AS bc))")).alias("b")).select("r", "c", "b.br", "b.bc")
        b = own.select(F.col("r").alias("fr"), F.col("c").alias("fc"), "v", F.expr(f"r div {high}").alias("br"), F.expr(f"c div {high}").alias("bc"))
        d = F.pow(F.col("r") - F.col("fr"), 2) + F.pow(F.col("c") - F.col("fc"), 2)
        best = a.join(b, ["br", "bc"]).where(d <= high * high).groupBy("r", "c").agg(F.min_by("v", F.struct(d, "fr", "fc")).alias("nv"))
        done = done.join(best, ["r", "c"], "left").select("r", "c", F.coalesce("v", "nv").alias("v"))
    return done


def random_product(basis: DataFrame, salt: int = 0, least: int = 3) -> DataFrame:
    """(node, s): product of an odd number, at least ``least``, of the +-1 modes of basis(k, node, s), chosen by hash."""
    modes = basis.select("k").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(salt), "k"), "k")))
    n = modes.count()
    if n < least:
        raise ValueError("the basis has too few modes")
    odd = list(range(least, n + 1, 2))
    size = odd[salt % len(odd)]
    return basis.join(modes.where(F.col("rank") <= size), "k").groupBy("node").agg((1 - 2 * (F.sum((F.col("s") < 0).cast("int")) % 2)).cast("int").alias("s"))
