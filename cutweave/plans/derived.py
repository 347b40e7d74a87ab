"""Graphs and cut tables derived from the star-schema tables; each also as SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import as_set


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The small example graph that results have to match, two four-cycles joined by two edges: (id, source, target).
TWO_SQUARES = [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0), (4, 4, 5), (5, 5, 6), (6, 6, 7), (7, 7, 4), (8, 2, 5), (9, 3, 4)]


def graph5(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(TWO_SQUARES, "id int, src int, dst int").coalesce(1)


def _trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cn, sn, n): line items by nation of customer and of supplier, added up by keys before nations are joined."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))
    sold = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy("l_orderkey", "sn").agg(F.count("*").alias("n"))
    bought = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "cn")
    return sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("cn", "sn").agg(F.sum("n").alias("n"))


def g_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions linked by trade; ids by (u, v)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = nation.toDF("cn", "ra"), nation.toDF("sn", "rb")
    pairs = _trade_pairs(spark, sf_dir).join(F.broadcast(a), "cn").join(F.broadcast(b), "sn").where("ra <> rb")
    pairs = pairs.select(F.least("ra", "rb").cast("int").alias("src"), F.greatest("ra", "rb").cast("int").alias("dst")).distinct()
    return pairs.select((F.row_number().over(Window.orderBy("src", "dst")) - 1).alias("id"), "src", "dst")


def g_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of the 25 nations, and an edge from each of them to the nation that it trades most with; these come after the ring, by (u, v)."""
    ring = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_nationkey").cast("int").alias("src"), ((F.col("n_nationkey") + 1) % 25).cast("int").alias("dst"))
    pairs = _trade_pairs(spark, sf_dir).where("cn <> sn").groupBy(F.least("cn", "sn").cast("int").alias("u"), F.greatest("cn", "sn").cast("int").alias("v")).agg(F.sum("n").alias("n"))
    both = pairs.withColumn("nation", F.explode(F.array("u", "v")))
    most = both.groupBy("nation").agg(F.max_by(F.struct("u", "v"), F.struct("n", -F.col("u"), -F.col("v"))).alias("p")).select("p.u", "p.v").distinct()
    chords = most.select((F.row_number().over(Window.orderBy("u", "v")) + 24).alias("id"), F.col("u").alias("src"), F.col("v").alias("dst"))
    return ring.union(chords)


def g_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and supplier hangs on its nation: nodes 0..24 are nations, customers 100, 102, ..., suppliers 101, 103, ...; an edge has the id of its outer node."""
    home = lambda t, key, nation, first: table(spark, sf_dir, t).select((F.col(key) * 2 + first).cast("int").alias("id"), F.col(nation).cast("int").alias("dst"))
    both = home("customer", "c_custkey", "c_nationkey", 100).union(home("supplier", "s_suppkey", "s_nationkey", 101))
    return both.select("id", F.col("id").alias("src"), "dst")


def g_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hang on their regions (nodes 25..29), which form a ring."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_nationkey").cast("int").alias("src"), (F.col("n_regionkey") + 25).cast("int").alias("dst"))
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 25).cast("int").alias("id"), (F.col("r_regionkey") + 25).cast("int").alias("src"), ((F.col("r_regionkey") + 1) % 5 + 25).cast("int").alias("dst"))
    return nation.union(region)


def cuts_orders(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """(line_no, edges): per order the distinct last digits of its suppliers (or of another key), at most ten."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col(key) % 10).cast("int")).alias("edges"))
    return rows.select(F.col("l_orderkey").alias("line_no"), as_set(F.col("edges")).alias("edges"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, ms, bonds): events as a run-time log; the stage is the length of the event type."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.length("event_type").alias("stage"), F.floor("value").cast("long").alias("ms"), (F.col("user_id") % 4).alias("bonds"))


GRAPH5_SQL = "g(id, src, dst) AS (VALUES " + ", ".join(map(str, TWO_SQUARES)) + ")"
TRADE_PAIRS_SQL = """tp AS (
  SELECT c.c_nationkey AS cn, s.s_nationkey AS sn, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)"""
REGION_SQL = f"""{TRADE_PAIRS_SQL},
rp AS (SELECT DISTINCT least(a.n_regionkey, b.n_regionkey) AS src, greatest(a.n_regionkey, b.n_regionkey) AS dst
       FROM tp JOIN nation a ON a.n_nationkey = tp.cn JOIN nation b ON b.n_nationkey = tp.sn WHERE a.n_regionkey <> b.n_regionkey),
g AS (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INTEGER) AS id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM rp)"""
TRADE_SQL = f"""{TRADE_PAIRS_SQL},
hp AS (SELECT least(cn, sn) AS u, greatest(cn, sn) AS v, sum(n) AS n FROM tp WHERE cn <> sn GROUP BY 1, 2),
hb AS (SELECT u, v, row_number() OVER (PARTITION BY x ORDER BY n DESC, u, v) AS r FROM (SELECT u AS x, * FROM hp UNION ALL SELECT v, * FROM hp)),
hr AS (SELECT u, v, row_number() OVER (ORDER BY u, v) AS r FROM (SELECT DISTINCT u, v FROM hb WHERE r = 1)),
g AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey AS INTEGER) AS src, CAST((n_nationkey + 1) % 25 AS INTEGER) AS dst FROM nation
      UNION ALL SELECT CAST(r + 24 AS INTEGER), CAST(u AS INTEGER), CAST(v AS INTEGER) FROM hr)"""
HOMES_SQL = """g AS (SELECT CAST(c_custkey * 2 + 100 AS INTEGER) AS id, CAST(c_custkey * 2 + 100 AS INTEGER) AS src, CAST(c_nationkey AS INTEGER) AS dst FROM customer
      UNION ALL SELECT CAST(s_suppkey * 2 + 101 AS INTEGER), CAST(s_suppkey * 2 + 101 AS INTEGER), CAST(s_nationkey AS INTEGER) FROM supplier)"""
GEO_SQL = """g AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey AS INTEGER) AS src, CAST(n_regionkey + 25 AS INTEGER) AS dst FROM nation
      UNION ALL SELECT CAST(r_regionkey + 25 AS INTEGER), CAST(r_regionkey + 25 AS INTEGER), CAST((r_regionkey + 1) % 5 + 25 AS INTEGER) FROM region)"""
CUTS_SQL = "cuts AS (SELECT l_orderkey AS line_no, list_sort(list(DISTINCT CAST(l_suppkey % 10 AS INTEGER))) AS edges FROM lineitem GROUP BY l_orderkey)"
LOG_SQL = "log AS (SELECT length(event_type) AS stage, CAST(floor(value) AS BIGINT) AS ms, user_id % 4 AS bonds FROM events)"


def subsets_sql(m: int) -> str:
    """cand(cid, edges): every set of 1..m edges of g."""
    parts = ["SELECT [id] AS edges, id AS top FROM g"]
    ctes = [f"s1 AS ({parts[0]})"]
    for s in range(2, m + 1):
        ctes.append(f"s{s} AS (SELECT list_append(s.edges, g.id) AS edges, g.id AS top FROM s{s - 1} s JOIN g ON g.id > s.top)")
    union = " UNION ALL ".join(f"SELECT edges FROM s{s}" for s in range(1, m + 1))
    return ",\n".join(ctes) + f",\ncand AS (SELECT row_number() OVER () AS cid, edges FROM ({union}))"


#: From g and cand(cid, edges): res(cid, edges, k, separates), by reachability and the definition.
CHECK_SQL = """ce AS (SELECT cid, unnest(edges) AS id FROM cand),
nodes AS (SELECT src AS n FROM g UNION SELECT dst FROM g),
alive AS (SELECT c.cid, g.src AS a, g.dst AS b FROM cand c CROSS JOIN g WHERE NOT list_contains(c.edges, g.id)),
step AS (SELECT * FROM alive UNION ALL SELECT cid, b, a FROM alive),
reach AS (SELECT cid, n AS a, n AS b FROM cand CROSS JOIN nodes UNION SELECT r.cid, r.a, s.b FROM reach r JOIN step s ON s.cid = r.cid AND s.a = r.b),
comp AS (SELECT cid, a AS n, min(b) AS c FROM reach GROUP BY cid, a),
ks AS (SELECT cid, count(DISTINCT c) AS k FROM comp GROUP BY cid),
sep AS (SELECT ce.cid, bool_and(x.c <> y.c) AS separates FROM ce JOIN g ON g.id = ce.id JOIN comp x ON x.cid = ce.cid AND x.n = g.src
        JOIN comp y ON y.cid = ce.cid AND y.n = g.dst GROUP BY ce.cid),
res AS (SELECT cand.cid, cand.edges, CAST(ks.k AS INTEGER) AS k, sep.separates FROM cand JOIN ks ON ks.cid = cand.cid LEFT JOIN sep ON sep.cid = cand.cid)"""
