"""Histograms, moments, overlaps, finite differences and other column-level statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- histograms ----------------------------------------------------------------


def _bounds(df: DataFrame, x: Column) -> tuple[float, float]:
    return df.agg(F.min(x), F.max(x)).first()


def linear_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, center, cnt): equal bins [a, b) from the least to the greatest value, the last one closed. Empty bins have a row."""
    lo, hi = _bounds(df, F.col(column))
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, center double, cnt long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width)).cast("int")
    return _filled(df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt")), bins, F.lit(lo) + (F.col("bin") + 0.5) * width)


def _filled(counts: DataFrame, bins: int, center: Column) -> DataFrame:
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", center.alias("center"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def log_histogram(df: DataFrame, column: str, bins: int = 20, negative: bool = False) -> DataFrame:
    """(bin, center, width, cnt): bins of equal ratio over the positive values (or the negated negative ones).

    Centres are geometric. Edges run from the least to the greatest value; for
    negative values between whole powers of ten.
    """
    x = -F.col(column) if negative else F.col(column)
    own = df.where(x > 0)
    lo, hi = _bounds(own, F.log10(x))
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, center double, width double, cnt long")
    if negative:
        lo, hi = math.floor(lo), math.ceil(hi)
    if lo == hi:
        hi = lo + 1.0
    step = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.log10(x) - lo) / step)).cast("int")
    left = F.pow(F.lit(10.0), F.lit(lo) + F.col("bin") * step)
    out = _filled(own.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt")), bins, left * 10 ** (step / 2))
    return out.select("bin", "center", (left * (10**step - 1)).alias("width"), "cnt")


def symlog_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Logarithmic histograms of the positive (side 1) and negative (side -1) values."""
    return log_histogram(df, column, bins).withColumn("side", F.lit(1)).unionByName(log_histogram(df, column, bins, negative=True).withColumn("side", F.lit(-1)))


def right_closed_counts(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, cnt) by bins (a, b], values outside going to the nearest bin; bins without values have no row."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(column))) - 1
    return df.groupBy(F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), at)).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def coarsen(df: DataFrame, index: str, x: str, y: str, factor: int) -> DataFrame:
    """(bin, x, y): mean x and sum of y of every ``factor`` rows; the last bin is filled with the last x and y = 0."""
    n, last = df.agg(F.count(F.lit(1)), F.max_by(x, index)).first()
    missing = -n % factor
    own = df.select(F.expr(f"{index} div {factor}").alias("bin"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if missing:
        own = own.unionByName(df.sparkSession.range(missing).select(F.lit(n // factor).cast("long").alias("bin"), F.lit(float(last)).alias("x"), F.lit(0.0).alias("y")))
    return own.groupBy("bin").agg(F.avg("x").alias("x"), F.sum("y").alias("y"))


# --- moments ----------------------------------------------------------------


def binder(x: str) -> Column:
    """1 - <x^4> / (3 <x^2>^2), an aggregate."""
    return 1 - F.avg(F.pow(F.col(x), 4)) / (3 * F.pow(F.avg(F.col(x) * F.col(x)), 2))


def chunk_moments(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, n, mean, m2) of each chunk, to be merged."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), (F.var_pop(column) * F.count(column)).alias("m2"))


def merge_moments(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean and population variance of the union of chunks(n, mean, m2): sums of n, n * mean, m2 + n * mean^2 around the overall mean."""
    total = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * total * total
    return chunks.groupBy(*(by or [])).agg(F.sum("n").alias("n"), total.alias("mean"), ((F.sum("m2") + between) / F.sum("n")).alias("variance"))


def marchenko_pastur(x: Column, g: float) -> Column:
    """Density at x for the ratio g; 0 outside its support."""
    lo, hi = (1 - math.sqrt(g)) ** 2, (1 + math.sqrt(g)) ** 2
    return F.when((x > lo) & (x < hi), F.sqrt(F.greatest(F.lit(0.0), (F.lit(hi) - x) * (x - F.lit(lo)))) / (2 * math.pi * g * x)).otherwise(0.0)


# --- spins ----------------------------------------------------------------


def overlap(a: str, b: str, symmetric: bool = True) -> Column:
    q = F.avg(F.col(a) * F.col(b))
    return F.abs(q) if symmetric else q


def matching_fraction(a: str, b: str, symmetric: bool = True) -> Column:
    same = F.avg((F.col(a) == F.col(b)).cast("double"))
    return F.greatest(same, F.avg((F.col(a) == -F.col(b)).cast("double"))) if symmetric else same


def binary_sign(x: Column) -> Column:
    """Sign with 0 as +1."""
    return F.when(x < 0, -1).otherwise(1)


def threshold_sign(x: Column, threshold: float = 1e-17) -> Column:
    """Sign with 0 for sizes not over the threshold."""
    return F.when(F.abs(x) <= threshold, 0).when(x < 0, -1).otherwise(1)


def majority_positive(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Each group's values times -1 where over half of them are negative."""
    w = Window.partitionBy(*by)
    most = F.sum((F.col(column) < 0).cast("int")).over(w) * 2 > F.count(F.lit(1)).over(w)
    return df.withColumn(column, F.when(most, -F.col(column)).otherwise(F.col(column)))


def product_state(states: DataFrame) -> DataFrame:
    """(node, s): product of states(pattern, node, s) over patterns, by the parity of -1."""
    return states.groupBy("node").agg((1 - 2 * (F.sum((F.col("s") < 0).cast("int")) % 2)).cast("int").alias("s"))


def xor_state(states: DataFrame) -> DataFrame:
    """(node, x): whether an odd number of states is -1."""
    return states.groupBy("node").agg((F.sum((F.col("s") < 0).cast("int")) % 2).cast("int").alias("x"))


def weighted_state(states: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, s): sign of the sum of weights(pattern, weight) times states, 0 as +1."""
    return states.join(weights, "pattern").groupBy("node").agg(binary_sign(F.sum(F.col("weight") * F.col("s"))).alias("s"))


# --- sequences and numbers ----------------------------------------------------------------


def finite_difference(df: DataFrame, order: str, f: str, x: str, by: list[str] | None = None) -> DataFrame:
    """df(f) / df(x) between neighbours, one row fewer per group; keyed by the left one."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return df.withColumn("_f", F.lead(f).over(w)).withColumn("_x", F.lead(x).over(w)).where(F.col("_x").isNotNull()).select(*(by or []), order, ((F.col("_f") - F.col(f)) / (F.col("_x") - F.col(x))).alias("derivative"))


def local_maxima(df: DataFrame, order: str, f: str, least: float = float("-inf"), by: list[str] | None = None) -> DataFrame:
    """Rows strictly greater than both neighbours and at least ``least``."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return df.withColumn("_a", F.lag(f).over(w)).withColumn("_b", F.lead(f).over(w)).where((F.col(f) > F.col("_a")) & (F.col(f) > F.col("_b")) & (F.col(f) >= least)).drop("_a", "_b")


def smoothed(df: DataFrame, order: str, f: str, sigma: float, reach: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Gaussian mean of f over neighbours by place, weights normalised at the ends."""
    reach = reach or int(4 * sigma + 0.5)
    w = Window.partitionBy(*(by or [])).orderBy(order)
    terms = [(math.exp(-0.5 * (k / sigma) ** 2), F.lag(f, -k).over(w) if k else F.col(f)) for k in range(-reach, reach + 1)]
    top, below = F.lit(0.0), F.lit(0.0)
    for g, c in terms:
        top, below = top + F.coalesce(g * c, F.lit(0.0)), below + F.when(c.isNotNull(), g).otherwise(0.0)
    return df.withColumn(f, top / below)


def first_change(df: DataFrame, order: str, flag: str) -> DataFrame:
    """The order value at which the flag first differs from the one before."""
    w = Window.orderBy(order)
    return df.withColumn("_p", F.lag(flag).over(w)).where(F.col("_p") != F.col(flag)).agg(F.min(order).alias("at"))


def significant(x: Column, digits: int) -> Column:
    """x rounded to significant digits; 0 stays 0."""
    if not 1 <= digits < 18:
        raise ValueError("digits must lie in [1, 18)")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def symmetric_log(x: Column, a: float, b: float, c: float, d: float, tol: float = 1e-10) -> Column:
    """a * ln(b * |x| + c) + d with the sign of x, 0 for sizes up to tol."""
    return F.when(F.abs(x) <= tol, 0.0).otherwise(F.signum(x) * (a * F.log(b * F.abs(x) + c) + d))


def boltzmann(energy: Column, temperature: float, k: float = 1.0) -> Column:
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return F.exp(-energy / (k * temperature))


def clamp_infinite(df: DataFrame, column: str) -> DataFrame:
    """+-infinity as the greatest and least finite values."""
    finite = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column))
    w = Window.partitionBy()
    return df.withColumn("_hi", F.max(finite).over(w)).withColumn("_lo", F.min(finite).over(w)).withColumn(column, F.when(F.col(column) == float("inf"), F.col("_hi")).when(F.col(column) == float("-inf"), F.col("_lo")).otherwise(F.col(column))).drop("_hi", "_lo")


def spaced(spark, start: float, stop: float, num: int, base: float | None = None, endpoint: bool = True) -> DataFrame:
    """(i, x): num values from start to stop, as powers of base if one is given."""
    step = (stop - start) / max(1, num - 1 if endpoint else num)
    x = F.lit(float(start)) + F.col("id") * step if num > 1 or not endpoint else F.lit(float(stop))
    return spark.range(num).select(F.col("id").cast("int").alias("i"), (F.pow(F.lit(float(base)), x) if base else x).alias("x"))


def even(x: Column) -> Column:
    """The nearest even number, the upper one of two."""
    return (2 * F.floor((x + 1) / 2)).cast("long")


# --- strings ----------------------------------------------------------------


def first_integer(s: Column) -> Column:
    """The first run of digits, or null."""
    return F.when(s.rlike("[0-9]"), F.regexp_extract(s, "([0-9]+)", 1).cast("long"))


def join_non_empty(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def file_value(name: Column, pattern: str) -> Column:
    """The pattern's first group as a number, without dots at its ends; null if there is none."""
    return F.when(name.rlike(pattern), F.regexp_replace(F.regexp_extract(name, pattern, 1), r"^\.+|\.+$", "").try_cast("double"))


def shared_values(files: DataFrame, pattern: str, least: int = 2) -> DataFrame:
    """(value) found in at least ``least`` directories of files(directory, name)."""
    return files.select("directory", file_value(F.col("name"), pattern).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.countDistinct("directory").alias("n")).where(F.col("n") >= least).select("value").orderBy("value")


def after_last(s: Column, char: str) -> Column:
    """The suffix from the last occurrence of a character on, or the empty string."""
    return F.when(F.locate(char, s) > 0, F.concat(F.lit(char), F.substring_index(s, char, -1))).otherwise("")


def before_last(s: Column, char: str) -> Column:
    """The prefix before the last occurrence of a character, or the whole."""
    return F.regexp_replace(s, f"[{char}][^{char}]*$", "")


# --- planes ----------------------------------------------------------------


def shift_wrap(grid: DataFrame, rows: int, cols: int, right: int, down: int) -> DataFrame:
    """grid(r, c, v) shifted on a torus."""
    return grid.select(F.pmod(F.col("r") + down, F.lit(rows)).alias("r"), F.pmod(F.col("c") + right, F.lit(cols)).alias("c"), "v")


def zoom(grid: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Cells of a window of width and height centred on column x and row y, cut at the grid's edge."""
    return grid.where(F.col("c").between(x - width // 2, x - width // 2 + width - 1) & F.col("r").between(y - height // 2, y - height // 2 + height - 1))
