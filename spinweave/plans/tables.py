"""Graphs and statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..functions import stats as S
from ..operators import graph as G
from .common import r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""
WITH j AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, l.l_discount AS d FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey),
m AS (SELECT avg(l_discount) AS g FROM lineitem)
SELECT CAST(least(a, b) AS BIGINT) AS src, CAST(greatest(a, b) AS BIGINT) AS dst, count(*) AS n, round(avg(d) - max(g), 6) + 0.0 AS w FROM j, m GROUP BY 1, 2""")
def trade_graph(spark, d):
    """Nations joined by trade; the weight is the mean discount less the overall one."""
    l, o = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount"), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = _t(spark, d, "customer").select("c_custkey", "c_nationkey"), _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    mean = l.agg(F.avg("l_discount").alias("g"))
    e = j.groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"))
    return e.crossJoin(F.broadcast(mean)).select("src", "dst", "n", r6(F.col("d") - F.col("g")).alias("w"))


@query("""
WITH p AS (SELECT l_partkey AS p, l_suppkey AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.s AS src, b.s AS dst, count(*) AS shared, CAST(CASE WHEN sum(a.r + b.r) * 3 > sum(a.n + b.n) THEN -1 ELSE 1 END AS INTEGER) AS sign FROM p a JOIN p b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2""")
def part_graph(spark, d):
    """Suppliers that share a part; negative where over a third of their lines came back."""
    p = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"), F.count(F.lit(1)).alias("n"))
    a, b = p.select("p", F.col("s").alias("src"), F.col("r").alias("ra"), F.col("n").alias("na")), p.select("p", F.col("s").alias("dst"), F.col("r").alias("rb"), F.col("n").alias("nb"))
    g = a.join(b, "p").where("src < dst").groupBy("src", "dst")
    return g.agg(F.count(F.lit(1)).alias("shared"), F.when(F.sum(F.col("ra") + F.col("rb")) * 3 > F.sum(F.col("na") + F.col("nb")), -1).otherwise(1).alias("sign"))


@query("""
SELECT user_id, event_id, CAST(CASE WHEN value >= p THEN 1 ELSE -1 END AS INTEGER) AS sign FROM
 (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL""")
def event_chain_sign(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "events").withColumn("p", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("p IS NOT NULL").select("user_id", "event_id", F.when(F.col("value") >= F.col("p"), 1).otherwise(-1).alias("sign"))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(19, CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER)) AS bin, count(*) AS cnt FROM events, b WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(k AS INTEGER) AS bin, round(lo + (k + 0.5) * (hi - lo) / 20, 6) AS center, coalesce(cnt, 0) AS cnt FROM range(20) t(k) CROSS JOIN b LEFT JOIN c ON c.bin = k")
def linear_hist(spark, d):
    return S.linear_histogram(_t(spark, d, "events"), "value", 20).select("bin", r6(F.col("center")).alias("center"), "cnt")


_LOG = "WITH v AS (SELECT {x} AS x FROM {t}), b AS (SELECT {lo} AS lo, {hi} AS hi FROM v WHERE x > 0), c AS (SELECT least({n} - 1, CAST(floor((log10(x) - lo) / ((hi - lo) / {n})) AS INTEGER)) AS bin, count(*) AS cnt FROM v, b WHERE x > 0 GROUP BY 1) SELECT CAST(k AS INTEGER) AS bin, round(pow(10, lo + (k + 0.5) * (hi - lo) / {n}), 4) AS center, coalesce(cnt, 0) AS cnt FROM range({n}) t(k) CROSS JOIN b LEFT JOIN c ON c.bin = k"


@query(_LOG.format(x="o_totalprice", t="orders", n=15, lo="min(log10(x))", hi="max(log10(x))"))
def log_hist(spark, d):
    return S.log_histogram(_t(spark, d, "orders"), "o_totalprice", 15).select("bin", F.round("center", 4).alias("center"), "cnt")


@query(_LOG.format(x="-c_acctbal", t="customer", n=10, lo="floor(min(log10(x)))", hi="ceil(max(log10(x)))"))
def neglog_hist(spark, d):
    return S.log_histogram(_t(spark, d, "customer"), "c_acctbal", 10, negative=True).select("bin", F.round("center", 4).alias("center"), "cnt")


@query("SELECT CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END AS INTEGER) AS side, count(*) AS cnt FROM customer WHERE c_acctbal <> 0 GROUP BY 1")
def symlog_hist(spark, d):
    return S.symlog_histogram(_t(spark, d, "customer"), "c_acctbal", 10).groupBy("side").agg(F.sum("cnt").alias("cnt"))


@query("SELECT CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS cnt FROM lineitem GROUP BY 1")
def bin_right_closed(spark, d):
    return S.right_closed_counts(_t(spark, d, "lineitem"), "l_quantity", [0, 10, 20, 30, 40])


@query("WITH n AS (SELECT count(*) AS n, max(CAST(event_id AS DOUBLE)) AS last, 7 AS f FROM events), r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, CAST(event_id AS DOUBLE) AS x, value AS y FROM events UNION ALL SELECT n + k, last, 0.0 FROM n, range(7) t(k) WHERE k < (7 - n % 7) % 7) SELECT CAST(i // 7 AS BIGINT) AS bin, round(avg(x), 6) AS x, round(sum(y), 4) AS y FROM r GROUP BY 1")
def coarsen_bins(spark, d):
    e = _t(spark, d, "events").select("event_id", "value")
    return S.coarsen(e.withColumn("i", F.col("event_id") - F.lit(e.agg(F.min("event_id")).first()[0])), "i", "event_id", "value", 7).select("bin", r6(F.col("x")).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def moments_merge(spark, d):
    """Moments of chunks of lines, merged, equal those of all lines."""
    l = _t(spark, d, "lineitem").withColumn("chunk", F.col("l_orderkey") % 13)
    by = ["l_returnflag", "chunk"]
    price = S.merge_moments(S.chunk_moments(l, "l_extendedprice", by), ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 4).alias("mean"))
    return price.join(S.merge_moments(S.chunk_moments(l, "l_quantity", by), ["l_returnflag"]).select("l_returnflag", r6(F.col("variance")).alias("variance")), "l_returnflag")


@query("SELECT event_type, round(1 - avg(value * value * value * value) / (3 * avg(value * value) * avg(value * value)), 6) AS binder FROM events GROUP BY 1")
def binder(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(S.binder("value"), 6).alias("binder"))


@query("SELECT l_quantity AS x, round(CASE WHEN t > (1 - sqrt(0.5)) * (1 - sqrt(0.5)) AND t < (1 + sqrt(0.5)) * (1 + sqrt(0.5)) THEN sqrt(((1 + sqrt(0.5)) * (1 + sqrt(0.5)) - t) * (t - (1 - sqrt(0.5)) * (1 - sqrt(0.5)))) / (2 * pi() * 0.5 * t) ELSE 0 END, 6) AS density FROM (SELECT DISTINCT l_quantity, l_quantity / 15 AS t FROM lineitem)")
def mp_density(spark, d):
    return _t(spark, d, "lineitem").select("l_quantity").distinct().select(F.col("l_quantity").alias("x"), r6(S.marchenko_pastur(F.col("l_quantity") / 15, 0.5)).alias("density"))


_DAY = "WITH t AS (SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, sum(value) AS v FROM events GROUP BY 1)"


def _daily(spark, d):
    return _t(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum("value").alias("v"))


@query(_DAY + " SELECT day, round(d, 4) + 0.0 AS derivative FROM (SELECT day, (lead(v) OVER (ORDER BY day) - v) / (lead(day) OVER (ORDER BY day) - day) AS d FROM t) WHERE d IS NOT NULL")
def finite_diff(spark, d):
    return S.finite_difference(_daily(spark, d), "day", "v", "day").select("day", (F.round("derivative", 4) + 0.0).alias("derivative"))


@query(_DAY + " SELECT day, round(v, 4) AS v FROM (SELECT day, v, lag(v) OVER (ORDER BY day) AS a, lead(v) OVER (ORDER BY day) AS b FROM t) WHERE v > a AND v > b")
def local_maxima(spark, d):
    return S.local_maxima(_daily(spark, d), "day", "v").select("day", F.round("v", 4).alias("v"))


@query(_DAY + ", w AS (SELECT a.day, a.v, b.v AS u, exp(-0.5 * pow((a.day - b.day) / 3.0, 2)) AS g FROM t a JOIN t b ON abs(a.day - b.day) <= 12) SELECT day, round(sum(g * u) / sum(g), 4) AS v FROM w GROUP BY day")
def gaussian_smooth(spark, d):
    return S.smoothed(_daily(spark, d), "day", "v", 3.0).select("day", F.round("v", 4).alias("v"))


@query(_DAY + " SELECT min(day) AS at FROM (SELECT day, v > 1000 AS f, lag(v > 1000) OVER (ORDER BY day) AS p FROM t) WHERE f <> p")
def first_change(spark, d):
    return S.first_change(_daily(spark, d).withColumn("f", F.col("v") > 1000), "day", "f")


@query("SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice * pow(10, 2 - floor(log10(abs(p_retailprice))))) / pow(10, 2 - floor(log10(abs(p_retailprice)))) END AS v FROM part")
def sigfig_round(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.significant(F.col("p_retailprice"), 3).alias("v"))


@query("SELECT c_custkey, round(CASE WHEN abs(c_acctbal) <= 1e-10 THEN 0 ELSE sign(c_acctbal) * (2 * ln(0.5 * abs(c_acctbal) + 1) + 3) END, 6) AS v FROM customer")
def symmetric_log(spark, d):
    return _t(spark, d, "customer").select("c_custkey", r6(S.symmetric_log(F.col("c_acctbal"), 2, 0.5, 1, 3)).alias("v"))


@query("SELECT c_custkey, CAST(CASE WHEN abs(c_acctbal) <= 100 THEN 0 WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS INTEGER) AS s FROM customer")
def sign_threshold(spark, d):
    return _t(spark, d, "customer").select("c_custkey", S.threshold_sign(F.col("c_acctbal"), 100).alias("s"))


@query("SELECT p_partkey, CAST(2 * floor((p_size + 1) / 2.0) AS BIGINT) AS v FROM part")
def nearest_even(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.even(F.col("p_size")).alias("v"))


@query("SELECT event_id, CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT) AS v FROM events")
def first_int(spark, d):
    return _t(spark, d, "events").select("event_id", S.first_integer(F.col("props")).alias("v"))


@query("SELECT doc_id, concat_ws('_', nullif(lang, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, '')) AS v FROM documents")
def join_non_empty(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.join_non_empty("_", F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))).alias("v"))


_FILES = "SELECT CAST(s_suppkey % 7 AS VARCHAR) AS directory, 'out_p=' || CAST((s_suppkey * 3) % 5 AS VARCHAR) || '.5.pkl' AS name FROM supplier"


def _files(spark, d):
    return _t(spark, d, "supplier").select((F.col("s_suppkey") % 7).cast("string").alias("directory"), F.concat(F.lit("out_p="), ((F.col("s_suppkey") * 3) % 5).cast("string"), F.lit(".5.pkl")).alias("name"))


@query(f"SELECT directory, name, CAST(regexp_replace(regexp_extract(name, 'p=([0-9.]+)', 1), '\\.+$', '') AS DOUBLE) AS value FROM ({_FILES})")
def filename_values(spark, d):
    return _files(spark, d).select("directory", "name", S.file_value(F.col("name"), "p=([0-9.]+)").alias("value"))


@query(f"SELECT value FROM (SELECT directory, CAST(regexp_replace(regexp_extract(name, 'p=([0-9.]+)', 1), '\\.+$', '') AS DOUBLE) AS value FROM ({_FILES})) GROUP BY value HAVING count(DISTINCT directory) >= 2")
def shared_p_values(spark, d):
    return S.shared_values(_files(spark, d), "p=([0-9.]+)")


@query("SELECT p_partkey, CASE WHEN strpos(p_type, ' ') > 0 THEN regexp_extract(p_type, '( [^ ]*)$', 1) ELSE '' END AS suffix, regexp_replace(p_type, ' [^ ]*$', '') AS prefix FROM part")
def last_character_split(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.after_last(F.col("p_type"), " ").alias("suffix"), S.before_last(F.col("p_type"), " ").alias("prefix"))


@query("SELECT r_regionkey, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 5 AND n_nationkey <= 17 AND r_regionkey <> 2")
def condition_filter(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.where(G.condition(">=5", "n_nationkey") & G.condition("<=17", "n_nationkey") & G.condition("!=2", "r_regionkey")).select("r_regionkey", "n_nationkey")


_GRID = "SELECT id // 8 AS r, id % 8 AS c, CAST(id * 7 % 11 AS INTEGER) AS v FROM range(48) t(id)"


def _grid(spark):
    return spark.range(48).select(F.expr("id div 8").alias("r"), (F.col("id") % 8).alias("c"), (F.col("id") * 7 % 11).cast("int").alias("v"))


@query(f"SELECT (r + 2) % 6 AS r, (c + 3) % 8 AS c, v FROM ({_GRID})")
def shift_wrap(spark, d):
    return S.shift_wrap(_grid(spark), 6, 8, 3, 2)


@query(f"SELECT r, c, v FROM ({_GRID}) WHERE c BETWEEN 4 AND 7 AND r BETWEEN 0 AND 2")
def zoom_window(spark, d):
    return S.zoom(_grid(spark), 6, 1, 4, 3)


@query("SELECT CAST(i AS INTEGER) AS i, round(pow(10, -2 + i * 7 / 9.0), 6) AS x FROM range(10) t(i)")
def log_space(spark, d):
    return S.spaced(spark, -2, 5, 10, 10).select("i", r6(F.col("x")).alias("x"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming import events

    return events.windowed(_t(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s")
def event_sessions(spark, d):
    from ..streaming import events

    return events.sessions(_t(spark, d, "events")).select("user_id", "start", "n")


@query("SELECT a AS x0, b AS x1, c AS x2 FROM range(3) a(a), range(4) b(b), range(2) c(c)")
def range_product(spark, d):
    return SC.product(spark, [3, 4, 2])


@query("SELECT l_discount AS x, CAST(round(l_discount * 100) / g AS BIGINT) AS num, CAST(100 / g AS BIGINT) AS den FROM (SELECT DISTINCT l_discount, gcd(CAST(round(l_discount * 100) AS BIGINT), 100) AS g FROM lineitem)")
def fractions(spark, d):
    x = _t(spark, d, "lineitem").select("l_discount").distinct()
    return x.select(F.col("l_discount").alias("x"), SC.fraction(F.col("l_discount"), 2).alias("f")).select("x", "f.num", "f.den")


@query("SELECT c_custkey, round(c_acctbal / sqrt(sum(c_acctbal * c_acctbal) OVER (PARTITION BY c_nationkey)), 6) + 0.0 AS v FROM customer")
def unit_vectors(spark, d):
    return SC.unit_vector(_t(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("v")), "v", ["c_nationkey"]).select("c_custkey", r6(F.col("v")).alias("v"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice - (SELECT min(p_retailprice) FROM part) <= 20")
def within_of_least(spark, d):
    return SC.within_of_least(_t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20)


@query("SELECT p_partkey, round(2 * p_size + 0.5::DOUBLE, 6) AS line, round(3 * (1 - 0.25 / pow(abs(p_size), 1.5)), 6) AS model FROM part WHERE p_size <> 0")
def line_and_model(spark, d):
    x = F.col("p_size").cast("double")
    return _t(spark, d, "part").where("p_size <> 0").select("p_partkey", r6(SC.line(x, 2, 0.5)).alias("line"), r6(SC.saturation(x, 0.25, 3, 1.5)).alias("model"))


@query("SELECT CAST(id AS DOUBLE) AS x, round((id // 5 * 5) * (id // 5 * 5) + (id % 5) * ((id // 5 * 5 + 5) * (id // 5 * 5 + 5) - (id // 5 * 5) * (id // 5 * 5)) / 5.0, 6) AS v FROM range(1, 44) t(id)")
def interpolated(spark, d):
    pts = spark.range(10).select((F.col("id") * 5.0).alias("x"), F.pow(F.col("id") * 5.0, 2).alias("v"))
    return SC.interpolate(pts, spark.range(1, 44).select(F.col("id").cast("double").alias("x"))).select("x", r6(F.col("v")).alias("v"))


@query("WITH p AS (SELECT id * 7 % 20 AS c, id * 3 % 20 AS r, CAST(id AS DOUBLE) AS v FROM range(40) t(id)), o AS (SELECT r, c, avg(v) AS v FROM p GROUP BY 1, 2), g AS (SELECT a.r, b.c FROM range(20) a(r), range(20) b(c)) SELECT g.r, g.c, arg_min(o.v, pow(g.r - o.r, 2) * 1000000 + pow(g.c - o.c, 2) * 1000000 + o.r * 100 + o.c) AS v FROM g, o GROUP BY 1, 2")
def grid_nearest(spark, d):
    i = F.col("id")
    pts = spark.range(40).select((i * 7 % 20 + 0.5).alias("x"), (i * 3 % 20 + 0.5).alias("y"), i.cast("double").alias("v"))
    return SC.grid_nearest(pts, 20, 20.0)


QUERIES = Q
