"""Queries of the bond engine, each with the SQL that an independent engine can run for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import as_line, as_set, base_name, colour_name, line_size, opposite, parse_ids
from ..functions.order import ranked
from ..functions.scratch import Scratch
from ..operators import bonds as B
from ..operators import cuts as C
from ..operators import graph as G
from ..operators import reports as R
from ..sources import generators, readers, writers
from ..streaming.cuts import distinct_cuts
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string").coalesce(1)


def values_sql(name: str, values: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"{name}(line_no, value) AS (VALUES {rows})"


def text(c: str) -> F.Column:
    return as_line(F.col(c)).alias(c)


# sources ------------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS INTEGER) AS id, CAST(l_partkey AS INTEGER) AS src, CAST(l_suppkey AS INTEGER) AS dst FROM lineitem")
def edge_scan(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.concat_ws(";", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("value"))
    return readers.edge_lines(rows)


def _line_items(spark, sf) -> DataFrame:
    return D.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("int").alias("id"), F.col("l_partkey").cast("int").alias("src"), F.col("l_suppkey").cast("int").alias("dst"))


_LINE_ITEMS = "SELECT CAST(l_orderkey AS INTEGER) AS id, CAST(l_partkey AS INTEGER) AS src, CAST(l_suppkey AS INTEGER) AS dst FROM lineitem"


@query(_LINE_ITEMS)
def edge_file(spark, sf):
    """Edges written as lines and read back."""
    path = Scratch(spark).path()
    writers.write_edges(_line_items(spark, sf), path)
    return readers.read_edges(spark, path)


@query(_LINE_ITEMS)
def edge_lines_either_separator(spark, sf):
    rows = D.table(spark, sf, "lineitem")
    text = lambda sep: F.concat_ws(sep, "l_orderkey", "l_partkey", "l_suppkey", "l_comment" if "l_comment" in rows.columns else "l_linenumber")
    return readers.edge_lines(rows.select(F.when(F.col("l_linenumber") % 2 == 0, text(";")).otherwise(text(",")).alias("value")), ";,")


@query(f"WITH {D.LOG_SQL} SELECT stage, ms, bonds FROM log")
def runtime_log_file(spark, sf):
    """A run-time log written and read back."""
    path = Scratch(spark).path()
    writers.write_log(D.log_events(spark, sf), path)
    return readers.runtime_log(spark.read.text(path)).select(F.col("stage").cast("long").alias("stage"), "ms", "bonds")


@query(f"WITH {D.LOG_SQL} SELECT CAST(stage AS BIGINT) AS stage, CAST(bonds AS BIGINT) AS level, avg(CASE WHEN ms <> 0 THEN ms END) AS avg_len FROM log GROUP BY 1, 2")
def path_log_file(spark, sf):
    """A log of path lengths written, read back and averaged."""
    path = Scratch(spark).path()
    writers.write_log(D.log_events(spark, sf).select("stage", F.col("bonds").alias("level"), F.col("ms").alias("len")), path, sep=" ")
    return R.path_length_profile(readers.path_log(spark.read.text(path))).select(F.col("stage").cast("long").alias("stage"), F.col("level").cast("long").alias("level"), "avg_len")


@query(f"WITH {D.CUTS_SQL} SELECT row_number() OVER (ORDER BY line_no) AS nth, array_to_string(edges, ',') AS edges FROM cuts")
def cut_file_lines(spark, sf):
    """Cuts in a file; line numbers rise along it."""
    path = Scratch(spark).path()
    writers.write_cuts(D.cuts_orders(spark, sf).orderBy("line_no").coalesce(1), path)
    return ranked(readers.read_cuts(spark, path), "line_no").select((F.col("__before") + 1).alias("nth"), text("edges"))


@query(f"WITH {D.CUTS_SQL} SELECT CAST(len(edges) AS BIGINT) AS size, count(*) AS n, count(DISTINCT edges) AS different FROM cuts GROUP BY 1")
def cut_files_by_size(spark, sf):
    """Cuts written to a folder per size, and the folders read back."""
    path = Scratch(spark).path()
    writers.write_by_size(writers.cut_text(D.cuts_orders(spark, sf)), path)
    return spark.read.text(path).groupBy(F.col("size").cast("long").alias("size")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"))


@query("SELECT CAST(event_id AS INTEGER) AS id, CAST(user_id AS INTEGER) AS src, CAST(user_id % 7 AS INTEGER) AS dst FROM events WHERE CAST(day(ts) AS VARCHAR) > '1'")
def osm_filter(spark, sf):
    rows = D.table(spark, sf, "events").select("event_id", "user_id", F.col("user_id") % 7, "event_type", F.dayofmonth("ts").cast("string").alias("kind"))
    return readers.osm_filter(rows)


G6 = ["Bw", "C~", "D?{", "DQc", "E~~w", "G?`@fc", "~??Bw", "~~?????Bw", "~??C~", "~~?????D?{"]
_G6 = f"""{values_sql('l', G6)},
h AS (SELECT line_no, value, CASE WHEN value LIKE '~~%' AND length(value) > 8 THEN 8 WHEN value LIKE '~%' THEN 4 ELSE 1 END AS k FROM l),
c AS (SELECT line_no, CASE WHEN k = 1 THEN ord(value[1]) - 63 ELSE ord(value[k]) - 63 + 64 * (ord(value[k - 1]) - 63) + 4096 * (ord(value[k - 2]) - 63) END AS n, value[k + 1:] AS value FROM h),
s AS (SELECT line_no, n, i, ord(value[1 + i // 6]) - 63 AS six, 5 - i % 6 AS sh FROM c, range(0, 6 * 8) t(i) WHERE i < 6 * length(value)),
b AS (SELECT line_no, n, i FROM s WHERE (six >> sh) & 1 = 1),
p AS (SELECT line_no, n, x.j AS dst, b.i - x.j * (x.j - 1) // 2 AS src FROM b JOIN range(1, 20) x(j) ON b.i >= x.j * (x.j - 1) // 2 AND b.i < x.j * (x.j + 1) // 2 WHERE x.j < n)
SELECT line_no AS graph_id, CAST(n AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY line_no ORDER BY @) - 1 AS INTEGER) AS id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM p"""


def _g6(spark) -> DataFrame:
    return lines(spark, G6).toDF("graph_id", "g6")


@query("WITH " + _G6.replace("@)", "dst, src)"))
def graph6_decode_col(spark, sf):
    return readers.graph6_edges(_g6(spark), "col")


@query("WITH " + _G6.replace("@)", "src, dst)"))
def graph6_decode_row(spark, sf):
    return readers.graph6_edges(_g6(spark), "row")


@query("WITH " + _G6.replace("@)", "src, dst)").replace("SELECT line_no AS graph_id", ", o AS (SELECT line_no AS graph_id") + ") SELECT graph_id, id || ';' || src || ';' || dst AS value FROM o")
def graph6_csv_lines(spark, sf):
    rows = readers.graph6_edges(_g6(spark), "row")
    return rows.select("graph_id", F.concat_ws(";", "id", "src", "dst").alias("value")).join(writers.edge_text(rows).distinct(), "value", "left_semi")


CUT_LINES = ["3,1", "1,3", "2", "", "1,1", "1", "10,9,2", " 4 , 5 "]


@query(f"WITH {values_sql('l', CUT_LINES)} SELECT line_no, array_to_string(list_transform(string_split(value, ','), lambda x: trim(x)), ',') AS edges, CASE WHEN value = '' THEN 0 ELSE len(string_split(value, ',')) END AS size FROM l")
def cut_parse(spark, sf):
    return readers.cut_lines(lines(spark, CUT_LINES)).select("line_no", text("edges"), F.size("edges").cast("long").alias("size"))


NAME_LINES, LIST_LINES = ["7;1;2;roadA;x", "8;2;3;roadB;x", "9;3;4;roadA;y"], ["roadA;roadB;f1;f2;f3", "roadB;f1;f2;f3", "f1;f2;f3"]


@query(f"""WITH {values_sql('n', NAME_LINES)}, {values_sql('l', LIST_LINES)},
t AS (SELECT string_split(value, ';')[4] AS name, string_split(value, ';')[1] AS id, line_no FROM n QUALIFY row_number() OVER (PARTITION BY string_split(value, ';')[4] ORDER BY line_no DESC) = 1),
p AS (SELECT line_no, unnest(string_split(value, ';')[1:-4]) AS name, generate_subscripts(string_split(value, ';')[1:-4], 1) AS pos FROM l)
SELECT l.line_no, coalesce(string_agg(t.id, ',' ORDER BY p.pos), '') AS edges FROM l LEFT JOIN p ON p.line_no = l.line_no LEFT JOIN t ON t.name = p.name GROUP BY l.line_no""")
def names_to_ids(spark, sf):
    part = F.split("value", ";")
    names = lines(spark, NAME_LINES).select(F.get(part, 0).cast("int").alias("id"), F.get(part, 3).alias("name"), "line_no")
    return C.names_to_ids(names, readers.name_lists(lines(spark, LIST_LINES))).select("line_no", text("edges"))


@query("SELECT 'lineitem' AS base, count(*) AS n FROM lineitem")
def base_names(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(base_name(F.regexp_extract("_metadata.file_path", r"^.*/lineitem[^/]*", 0), ".parquet").alias("base"))
    return rows.groupBy("base").agg(F.count("*").alias("n"))


# cut sets -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {D.CUTS_SQL} SELECT line_no, array_to_string(edges, ',') AS edges FROM cuts")
def cut_canonical(spark, sf):
    return D.cuts_orders(spark, sf).select("line_no", text("edges"))


@query(f"WITH {D.CUTS_SQL} SELECT DISTINCT array_to_string(edges, ',') AS edges, CAST(len(edges) AS BIGINT) AS size FROM cuts")
def cut_uniq(spark, sf):
    return C.cut_uniq(D.cuts_orders(spark, sf)).select(text("edges"), F.col("size").cast("long").alias("size"))


@query(f"WITH {D.CUTS_SQL} SELECT array_to_string(edges, ',') AS edges, row_number() OVER (ORDER BY len(edges), edges) AS place FROM (SELECT DISTINCT edges FROM cuts)")
def cut_order_size_lex(spark, sf):
    return C.cut_uniq(D.cuts_orders(spark, sf)).select(text("edges"), F.row_number().over(Window.orderBy("size", "edges")).cast("long").alias("place"))


_TWO = f"{D.CUTS_SQL}, a AS (SELECT DISTINCT edges FROM cuts), b AS (SELECT DISTINCT list_sort(list(DISTINCT CAST(l_partkey % 10 AS INTEGER))) AS edges FROM lineitem GROUP BY l_orderkey)"


def _two_sets(spark, sf):
    """Last digits of the suppliers, and of the parts, of every order."""
    return D.cuts_orders(spark, sf), D.cuts_orders(spark, sf, "l_partkey")


@query(f"WITH {_TWO} SELECT array_to_string(edges, ',') AS edges FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def cut_diff(spark, sf):
    return C.cut_diff(*_two_sets(spark, sf)).select(text("edges"))


@query(f"WITH {D.CUTS_SQL} SELECT DISTINCT array_to_string(edges, ',') AS edges FROM cuts")
def cut_diff_nothing(spark, sf):
    """Without a right side, all cuts as a set."""
    return C.cut_diff(D.cuts_orders(spark, sf), readers.read_cuts(spark, "~")).select(text("edges"))


@query(f"WITH {_TWO} SELECT 'A' AS side, array_to_string(edges, ',') AS edges FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'B', array_to_string(edges, ',') FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def cut_symdiff(spark, sf):
    return C.cut_symdiff(*_two_sets(spark, sf)).select("side", text("edges"))


@query(f"WITH {D.CUTS_SQL} SELECT CAST(len(edges) AS BIGINT) AS size, count(*) AS n FROM cuts GROUP BY 1")
def cut_size_split_counts(spark, sf):
    written = writers.cut_text(D.cuts_orders(spark, sf))
    return C.size_counts(written, line_size(F.col("value"))).select(F.col("size").cast("long").alias("size"), "n")


@query(f"WITH {D.CUTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS nth, count(*) OVER () AS n FROM cuts) SELECT line_no, array_to_string(edges, ',') AS edges FROM r WHERE nth % greatest(1, n // 500) = 0")
def stride_sample(spark, sf):
    return C.stride_sample(D.cuts_orders(spark, sf), 500).select("line_no", text("edges"))


@query(f"WITH {D.CUTS_SQL}, u AS (SELECT line_no, edges, unnest(edges) AS restored FROM cuts) SELECT line_no, restored, array_to_string(list_filter(edges, lambda x: x <> restored), ',') AS edges FROM u")
def leave_one_out(spark, sf):
    return C.leave_one_out(D.cuts_orders(spark, sf)).select("line_no", "restored", text("edges"))


@query(f"WITH {D.CUTS_SQL} SELECT DISTINCT array_to_string(edges, ',') AS cut FROM cuts")
def stream_distinct_batch(spark, sf):
    return distinct_cuts(writers.cut_text(D.cuts_orders(spark, sf)))


# graphs -------------------------------------------------------------------------------------------------------------------

_REACH = """nodes AS (SELECT src AS n FROM g UNION SELECT dst FROM g), st AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g),
re AS (SELECT n AS a, n AS b FROM nodes UNION SELECT re.a, st.b FROM re JOIN st ON st.a = re.b)"""


@query(f"WITH RECURSIVE {D.HOMES_SQL}, {_REACH} SELECT a AS node, CAST(min(b) AS BIGINT) AS component FROM re GROUP BY a")
def components(spark, sf):
    return G.components(D.g_homes(spark, sf))


@query(f"WITH {D.TRADE_SQL} SELECT * FROM g")
def trade_graph(spark, sf):
    return D.g_trade(spark, sf)


@query(f"WITH {D.REGION_SQL} SELECT * FROM g")
def region_graph(spark, sf):
    return D.g_region(spark, sf)


@query(f"WITH {D.REGION_SQL} SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id")
def combos_2(spark, sf):
    return C.combinations(D.g_region(spark, sf), 2).select(F.get("edges", 0).alias("a"), F.get("edges", 1).alias("b"))


@query(f"WITH {D.TRADE_SQL} SELECT a.id || ',' || b.id || ',' || c.id AS edges FROM g a JOIN g b ON a.id < b.id JOIN g c ON b.id < c.id")
def combos_3(spark, sf):
    return C.combinations(D.g_trade(spark, sf), 3).select(text("edges"))


# an edge is in the minimal forest iff the edges with smaller ids do not connect its ends
_FOREST_SQL = """low AS (SELECT e.id, e.src, e.dst, o.src AS a, o.dst AS b FROM g e JOIN g o ON o.id < e.id),
ste AS (SELECT id, a, b FROM low UNION ALL SELECT id, b, a FROM low),
rch AS (SELECT id, src AS n FROM g UNION SELECT rch.id, ste.b FROM rch JOIN ste ON ste.id = rch.id AND ste.a = rch.n)
SELECT id, src, dst FROM g WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM rch WHERE rch.id = g.id AND rch.n = g.dst)"""


@query(f"WITH RECURSIVE {D.TRADE_SQL}, {_FOREST_SQL}")
def spanning_forest(spark, sf):
    return G.spanning_forest(D.g_trade(spark, sf))


@query(f"WITH RECURSIVE {D.TRADE_SQL}, st AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g), w AS (SELECT 0 AS n, 0 AS h UNION SELECT st.b, w.h + 1 FROM w JOIN st ON st.a = w.n WHERE w.h < 15) SELECT CAST(n AS BIGINT) AS node, CAST(min(h) AS BIGINT) AS hops FROM w GROUP BY n")
def bfs_hops(spark, sf):
    return G.bfs_hops(D.g_trade(spark, sf), [0])


@query(f"WITH RECURSIVE {D.TRADE_SQL}, st AS (SELECT src AS a, dst AS b FROM g WHERE id NOT IN (3, 20) UNION ALL SELECT dst, src FROM g WHERE id NOT IN (3, 20)), w AS (SELECT 0 AS n, 0 AS h UNION SELECT st.b, w.h + 1 FROM w JOIN st ON st.a = w.n WHERE w.h < 15) SELECT CAST(min(h) AS BIGINT) AS hops FROM w WHERE n IN (12, 15)")
def shortest_path(spark, sf):
    return G.shortest_path_length(D.g_trade(spark, sf), [0], [12, 15], F.col("id").isin(3, 20))


@query(f"""WITH RECURSIVE {D.TRADE_SQL}, st AS (SELECT id, src AS a, dst AS b FROM g WHERE id NOT IN (3, 20) UNION ALL SELECT id, dst, src FROM g WHERE id NOT IN (3, 20)),
w AS (SELECT s AS n, CAST([] AS INTEGER[]) AS p, [s] AS seen FROM (VALUES (0), (8)) t(s) UNION ALL
      SELECT st.b, list_append(w.p, st.id), list_append(w.seen, st.b) FROM w JOIN st ON st.a = w.n WHERE NOT list_contains(w.seen, st.b) AND len(w.p) < 8),
h AS (SELECT p FROM w WHERE n IN (12, 15) ORDER BY len(p), p LIMIT 1)
SELECT generate_subscripts(p, 1) - 1 AS pos, CAST(unnest(p) AS BIGINT) AS id FROM h""")
def canonical_path(spark, sf):
    return G.canonical_path(D.g_trade(spark, sf), [0, 8], [12, 15], F.col("id").isin(3, 20))


@query("SELECT CASE n_regionkey % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'red' ELSE 'blue' END AS colour, string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) AS items FROM nation GROUP BY 1")
def colour_lists(spark, sf):
    rows = D.table(spark, sf, "nation").select(colour_name(F.col("n_regionkey") % 3).alias("colour"), F.col("n_nationkey").alias("id"))
    return G.by_colour(rows)


@query(f"WITH RECURSIVE {D.HOMES_SQL}, {_REACH}, c AS (SELECT DISTINCT min(b) OVER (PARTITION BY a) AS c FROM re), o AS (SELECT c, lead(c) OVER (ORDER BY c) AS d, row_number() OVER (ORDER BY c) AS r FROM c) SELECT CAST((SELECT max(id) FROM g) + r AS INTEGER) AS id, CAST(c AS INTEGER) AS src, CAST(d AS INTEGER) AS dst FROM o WHERE d IS NOT NULL")
def make_connected(spark, sf):
    return G.make_connected(D.g_homes(spark, sf))


@query(f"WITH {D.TRADE_SQL} SELECT * FROM g WHERE id NOT IN (SELECT r_regionkey * 5 FROM region)")
def without_edges(spark, sf):
    """The trade graph without the edges whose ids are five times a region's key."""
    return G.without(D.g_trade(spark, sf), D.table(spark, sf, "region").select((F.col("r_regionkey") * 5).cast("int").alias("id")))


@query(f"WITH RECURSIVE {D.TRADE_SQL.replace('g AS (', 'g0 AS (')}, g AS (SELECT * FROM g0 WHERE id NOT IN (SELECT r_regionkey * 5 FROM region)), {_FOREST_SQL}")
def forest_without_edges(spark, sf):
    return G.spanning_forest(without_edges(spark, sf))


@query(f"WITH RECURSIVE {D.TRADE_SQL}, {_FOREST_SQL} ORDER BY id LIMIT 10")
def forest_start(spark, sf):
    """The first ten edges that Kruskal's algorithm takes, after which it stops."""
    return G.spanning_forest(D.g_trade(spark, sf), limit=10)


@query(f"WITH {D.HOMES_SQL} SELECT id, src AS node, dst AS other FROM g UNION ALL SELECT id, dst, src FROM g")
def incidence(spark, sf):
    """Every edge at each of its ends, with the other end."""
    ends = D.g_homes(spark, sf).select("id", "src", "dst", F.explode(F.array("src", "dst")).alias("node"))
    return ends.select("id", "node", opposite(F.col("src"), F.col("dst"), F.col("node")).alias("other"))


@query(f"WITH RECURSIVE {D.GEO_SQL}, cand AS (SELECT id AS cid, [id] AS edges FROM g), {D.CHECK_SQL} SELECT edges[1] AS id FROM res WHERE k = 2")
def bridges(spark, sf):
    return G.cycle_labels(D.g_geo(spark, sf)).where("label = 0").select("id")


@query(f"WITH {D.TRADE_SQL} SELECT o.line_no, CAST(o.pos - 1 AS INTEGER) AS pos, o.id, g.src, g.dst FROM (SELECT line_no, unnest(edges) AS id, generate_subscripts(edges, 1) AS pos FROM (SELECT 1 AS line_no, [3, 30, 99] AS edges UNION ALL SELECT 2, [7])) o LEFT JOIN g ON g.id = o.id")
def ids_to_edges(spark, sf):
    return C.ids_to_edges(D.g_trade(spark, sf), readers.cut_lines(spark.createDataFrame([(1, "3,30,99"), (2, "7")], "line_no int, value string")).withColumn("line_no", F.col("line_no").cast("int")))


@query(f"WITH {D.GRAPH5_SQL} SELECT 0 AS nth, 'graph two_squares {{' AS value UNION ALL SELECT id + 1, chr(9) || src || ' -- ' || dst || ' [label = \"' || id || '\"];' FROM g UNION ALL SELECT 11, '}}'".replace("{{", "{").replace("}}", "}"))
def dot_lines(spark, sf):
    rows = writers.dot_text(D.graph5(spark), "two_squares")
    return rows.select((F.row_number().over(Window.orderBy("line")) - 1).alias("nth"), "value")


_DRAW = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_RANDOM = f"""d AS (SELECT min(i) AS nth, {_DRAW.format("'3/' || i")} % 435 AS pair FROM range(0, 2000) t(i) GROUP BY 2),
r AS (SELECT pair, row_number() OVER (ORDER BY nth) - 1 AS id FROM d QUALIFY id < 40 + {_DRAW.format("'3/edges'")} % 21),
g AS (SELECT id, r.pair - x.j * (x.j - 1) // 2 AS src, x.j AS dst FROM r JOIN range(1, 30) x(j) ON r.pair >= x.j * (x.j - 1) // 2 AND r.pair < x.j * (x.j + 1) // 2),
st AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g), re AS (SELECT n AS a, n AS b FROM range(0, 30) t(n) UNION SELECT re.a, st.b FROM re JOIN st ON st.a = re.b),
c AS (SELECT DISTINCT min(b) OVER (PARTITION BY a) AS c FROM re), o AS (SELECT c, lead(c) OVER (ORDER BY c) AS e, row_number() OVER (ORDER BY c) AS k FROM c),
w AS (SELECT id, src, dst FROM g UNION ALL SELECT (SELECT max(id) FROM g) + k, c, e FROM o WHERE e IS NOT NULL)"""


@query(f"WITH RECURSIVE {_RANDOM} SELECT CAST(id AS INTEGER) AS id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM w")
def random_graph(spark, sf):
    return generators.random_graph(spark, 30, 40, 60, seed=3)


@query("SELECT CAST(e AS INTEGER) AS n_edges, CAST(t AS INTEGER) AS trial FROM range(6, 13) a(e), range(1, 4) b(t)")
def density_cells(spark, sf):
    return generators.density_cells(spark, 6, 12, 3)


_CONNECTED = """pr AS (SELECT j * (j - 1) // 2 + i AS bit, i, j FROM range(0, 5) a(i), range(1, 5) c(j) WHERE i < j),
ms AS (SELECT n, m FROM range(2, 6) t(n), range(0, 1024) u(m) WHERE m < (1 << (n * (n - 1) // 2))),
st AS (SELECT n, m, i AS a, j AS b FROM ms JOIN pr ON j < n AND (m >> bit) & 1 = 1 UNION ALL SELECT n, m, j, i FROM ms JOIN pr ON j < n AND (m >> bit) & 1 = 1),
re AS (SELECT n, m, 0::BIGINT AS v FROM ms UNION SELECT re.n, re.m, st.b FROM re JOIN st ON st.n = re.n AND st.m = re.m AND st.a = re.v),
co AS (SELECT n, m FROM re GROUP BY n, m HAVING count(*) = n)"""


@query(f"WITH RECURSIVE {_CONNECTED} SELECT CAST(n AS INTEGER) AS n, count(*) AS graphs FROM co GROUP BY n")
def connected_graph_counts(spark, sf):
    counts = [generators.all_connected_graphs(spark, n).select(F.lit(n).alias("n"), F.col("graph_id")).distinct().groupBy("n").agg(F.count("*").alias("graphs")) for n in (2, 3, 4, 5)]
    return reduce(DataFrame.union, counts)


# checks and bonds ---------------------------------------------------------------------------------------------------------

_CAND5 = f"{D.GRAPH5_SQL}, {D.CUTS_SQL}, cand AS (SELECT min(line_no) AS cid, edges FROM cuts GROUP BY edges), {D.CHECK_SQL}, al AS (SELECT cuts.line_no, res.k, res.separates FROM cuts JOIN res ON res.edges = cuts.edges)"
_STATUS = "CASE WHEN k = 1 THEN 'false_not_cut' WHEN separates THEN 'true' ELSE 'false_not_minimal' END"


def _checked(spark, sf) -> DataFrame:
    """The suppliers' last digits of every order, taken as edges of the small graph, which has the ids 0 to 9."""
    return C.check_cuts(D.graph5(spark), D.cuts_orders(spark, sf))


@query(f"WITH RECURSIVE {_CAND5} SELECT line_no, k AS n_components, {_STATUS} AS status FROM al")
def is_min_cut_status(spark, sf):
    return _checked(spark, sf).select("line_no", "n_components", "status")


@query(f"WITH RECURSIVE {_CAND5} SELECT line_no, k AS n_components FROM al")
def components_after_cut(spark, sf):
    return C.components_after(D.graph5(spark), D.cuts_orders(spark, sf)).select("line_no", "n_components")


@query(f"WITH RECURSIVE {_CAND5} SELECT line_no, k > 1 AS is_cut FROM al")
def is_cut(spark, sf):
    return _checked(spark, sf).select("line_no", (F.col("n_components") > 1).alias("is_cut"))


@query(f"WITH RECURSIVE {_CAND5} SELECT line_no, {_STATUS} AS status FROM al WHERE {_STATUS} <> 'true' ORDER BY line_no LIMIT 1")
def first_failure(spark, sf):
    return C.first_failure(_checked(spark, sf)).select("line_no", "status")


@query(f"WITH RECURSIVE {_CAND5} SELECT count(*) FILTER (WHERE {_STATUS} <> 'true') AS fails, count(*) AS total FROM al")
def fail_summary(spark, sf):
    return C.fail_summary(_checked(spark, sf))


@query(f"WITH RECURSIVE {D.GRAPH5_SQL}, cand AS (SELECT 0 AS cid, [0, 1, 3] AS edges), {D.CHECK_SQL} SELECT k AS n_components, {_STATUS} AS status FROM res")
def inline_cut_status(spark, sf):
    return C.check_cuts(D.graph5(spark), readers.inline_cut(spark, " 3, 0,1")).select("n_components", "status")


def _bonds_sql(graph: str, m: int, low: int, high: int) -> str:
    return f"WITH RECURSIVE {graph}, {D.subsets_sql(m)}, {D.CHECK_SQL} SELECT k, array_to_string(edges, ',') AS edges FROM res WHERE separates AND k BETWEEN {low} AND {high}"


def _bonds(edges: DataFrame, m: int, k: str, method: str = "algebra", exact: bool = False) -> DataFrame:
    return B.bonds(edges, m, k, method, exact).select("k", text("edges"))


@query(_bonds_sql(D.REGION_SQL, 6, 2, 2))
def two_bonds_region(spark, sf):
    return _bonds(D.g_region(spark, sf), 6, "2")


@query(_bonds_sql(D.TRADE_SQL, 3, 2, 2))
def two_bonds_trade_m3(spark, sf):
    return _bonds(D.g_trade(spark, sf), 3, "2")


@query(_bonds_sql(D.TRADE_SQL, 3, 2, 3))
def k_range_bonds(spark, sf):
    return _bonds(D.g_trade(spark, sf), 3, "2-3")


@query(_bonds_sql(D.REGION_SQL, 7, 3, 3))
def three_bonds_region(spark, sf):
    return _bonds(D.g_region(spark, sf), 7, "3")


@query(_bonds_sql(D.GEO_SQL, 2, 2, 3))
def bonds_geo_m2(spark, sf):
    return _bonds(D.g_geo(spark, sf), 2, "2-3")


@query(_bonds_sql(D.GRAPH5_SQL, 3, 2, 3))
def brute_bonds_graph5(spark, sf):
    return _bonds(D.graph5(spark), 3, "2-3", "brute")


@query(_bonds_sql(D.GRAPH5_SQL, 4, 2, 4))
def algebra_bonds_graph5(spark, sf):
    return _bonds(D.graph5(spark), 4, "2-4", exact=True)


@query(_bonds_sql(D.GEO_SQL, 3, 2, 3).replace("SELECT k, array_to_string(edges, ',') AS edges FROM res", "SELECT k, list_min(edges) AS seed, count(*) AS bonds FROM res") + " GROUP BY 1, 2")
def bonds_per_seed(spark, sf):
    return B.bonds_per_seed(B.bonds(D.g_geo(spark, sf), 3, "2-3"))


_ALL_FOUR = """pr AS (SELECT j * (j - 1) // 2 + i AS bit, i, j FROM range(0, 4) a(i), range(1, 4) c(j) WHERE i < j),
rm AS (SELECT a.m, s.m AS s FROM range(0, 64) a(m) JOIN range(0, 64) s(m) ON (a.m & s.m) = s.m),
st AS (SELECT m, s, i AS a, j AS b FROM rm JOIN pr ON ((m >> bit) & 1) = 1 AND ((s >> bit) & 1) = 0 UNION ALL SELECT m, s, j, i FROM rm JOIN pr ON ((m >> bit) & 1) = 1 AND ((s >> bit) & 1) = 0),
re AS (SELECT m, s, v AS a, v AS b FROM rm, range(0, 4) t(v) UNION SELECT re.m, re.s, re.a, st.b FROM re JOIN st ON st.m = re.m AND st.s = re.s AND st.a = re.b),
co AS (SELECT m, s, a, min(b) AS c FROM re GROUP BY m, s, a), ks AS (SELECT m, s, count(DISTINCT c) AS k FROM co GROUP BY m, s),
bad AS (SELECT DISTINCT x.m, x.s FROM pr JOIN co x ON x.a = pr.i JOIN co y ON y.m = x.m AND y.s = x.s AND y.a = pr.j WHERE ((x.s >> pr.bit) & 1) = 1 AND x.c = y.c),
bo AS (SELECT ks.m AS graph_id, ks.s, ks.k FROM ks JOIN ks o ON o.m = ks.m AND o.s = 0 AND o.k = 1 ANTI JOIN bad ON bad.m = ks.m AND bad.s = ks.s WHERE bit_count(ks.s) BETWEEN 1 AND 4 AND ks.k BETWEEN 2 AND 4)"""


@query(f"WITH RECURSIVE {_ALL_FOUR} SELECT graph_id, CAST(k AS INTEGER) AS k, count(*) AS bonds, 0::BIGINT AS differences FROM bo GROUP BY graph_id, k")
def method_diff(spark, sf):
    """The engine on all connected graphs of four nodes: bonds, and in how many it differs from the definition."""
    graphs = Scratch(spark).write(generators.all_connected_graphs(spark, 4))
    counts = B.bonds_of_graphs(graphs, 4, "2-4").groupBy("graph_id", "k").agg(F.count("*").alias("bonds"))
    diff = B.differential(graphs, 4, "2-4").groupBy("graph_id", "k").agg(F.count("*").alias("differences"))
    return counts.join(diff, ["graph_id", "k"], "full").select("graph_id", "k", F.coalesce("bonds", F.lit(0)).alias("bonds"), F.coalesce("differences", F.lit(0)).alias("differences"))


_KM = f"WITH RECURSIVE {D.GRAPH5_SQL}, {D.subsets_sql(4)}, {D.CHECK_SQL}, cell AS (SELECT k.k, m.m FROM range(2, 5) k(k), range(1, 5) m(m) WHERE m.m >= k.k - 1)"


@query(f"{_KM} SELECT CAST(cell.k AS INTEGER) AS k, CAST(cell.m AS INTEGER) AS m, count(r.k) AS bonds FROM cell LEFT JOIN res r ON r.separates AND r.k = cell.k AND len(r.edges) <= cell.m GROUP BY 1, 2")
def km_grid_counts(spark, sf):
    return R.km_counts(D.graph5(spark), readers.parse_bounds("4", 1)[1], readers.parse_bounds("2-4", 2))


# chains of splits whose smallest edges rise, level by level
_CHAINS = """c2 AS (SELECT edges, list_min(edges) AS last, 1 AS n FROM res WHERE separates AND k = 2),
i3 AS (SELECT r.edges, list_min(list_filter(r.edges, lambda x: NOT list_contains(c.edges, x))) AS low, c.last, c.n FROM c2 c JOIN res r ON r.separates AND r.k = 3 AND list_has_all(r.edges, c.edges)),
c3 AS (SELECT edges, low AS last, sum(n) AS n FROM i3 WHERE low > last GROUP BY edges, low),
i4 AS (SELECT r.edges, list_min(list_filter(r.edges, lambda x: NOT list_contains(c.edges, x))) AS low, c.last, c.n FROM c3 c JOIN res r ON r.separates AND r.k = 4 AND list_has_all(r.edges, c.edges)),
c4 AS (SELECT edges, low AS last, sum(n) AS n FROM i4 WHERE low > last GROUP BY edges, low),
ch AS (SELECT 3 AS k, len(edges) AS size, n FROM c3 UNION ALL SELECT 4, len(edges), n FROM c4),
kb AS (SELECT k, len(edges) AS size FROM res WHERE separates)"""
_CELLS = "(SELECT k.k, m.m FROM range(3, 5) k(k) JOIN range(3, {}) m(m) ON m.m >= k.k)"


def _chains_sql(graph: str, m: int) -> str:
    return f"""WITH RECURSIVE {graph}, {D.subsets_sql(m)}, {D.CHECK_SQL}, {_CHAINS}, cells AS {_CELLS.format(m + 1)}
SELECT CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, CAST(coalesce((SELECT sum(n) FROM ch WHERE ch.k = cells.k AND ch.size <= cells.m), 0) AS BIGINT) AS noncan,
       (SELECT count(*) FROM kb WHERE kb.k = cells.k AND kb.size <= cells.m) AS can FROM cells"""


@query(_chains_sql(D.GRAPH5_SQL, 5))
def noncanonicity_cells(spark, sf):
    return R.derivations(D.graph5(spark), 5, (3, 4))


@query(_chains_sql(D.GEO_SQL, 3))
def noncanonicity_geo(spark, sf):
    return R.derivations(D.g_geo(spark, sf), 3, (3, 4))


# two random graphs on six nodes, a seed each, and their 2-bonds of at most two edges by the definition
_DENSITY = f"""cell AS (SELECT e * 1009 + t AS s, e, t FROM range(6, 8) a(e), range(1, 2) b(t)),
d AS (SELECT s, e, min(i) AS nth, {_DRAW.format("s || '/' || i")} % 15 AS pair FROM cell, range(0, 300) u(i) GROUP BY ALL),
r AS (SELECT s, pair, row_number() OVER (PARTITION BY s ORDER BY nth) - 1 AS id FROM d QUALIFY id < e),
g0 AS (SELECT s, id, pair - x.j * (x.j - 1) // 2 AS src, x.j AS dst FROM r JOIN range(1, 6) x(j) ON pair >= x.j * (x.j - 1) // 2 AND pair < x.j * (x.j + 1) // 2),
st AS (SELECT s, src AS a, dst AS b FROM g0 UNION ALL SELECT s, dst, src FROM g0),
re AS (SELECT s, n AS a, n AS b FROM cell, range(0, 6) u(n) UNION SELECT re.s, re.a, st.b FROM re JOIN st ON st.s = re.s AND st.a = re.b),
c AS (SELECT DISTINCT s, min(b) OVER (PARTITION BY s, a) AS c FROM re),
o AS (SELECT s, c, lead(c) OVER (PARTITION BY s ORDER BY c) AS f, row_number() OVER (PARTITION BY s ORDER BY c) AS nth FROM c),
top AS (SELECT s, max(id) AS top FROM g0 GROUP BY s),
g AS (SELECT * FROM g0 UNION ALL SELECT o.s, top + nth, c, f FROM o JOIN top ON top.s = o.s WHERE f IS NOT NULL),
cand AS (SELECT s, id AS ca, id AS cb FROM g UNION ALL SELECT x.s, x.id, y.id FROM g x JOIN g y ON x.s = y.s AND x.id < y.id),
al AS (SELECT cand.s, ca, cb, src AS u, dst AS v FROM cand JOIN g ON g.s = cand.s AND g.id <> ca AND g.id <> cb),
sy AS (SELECT * FROM al UNION ALL SELECT s, ca, cb, v, u FROM al),
rr AS (SELECT s, ca, cb, n AS x, n AS y FROM cand, range(0, 6) u(n) UNION SELECT rr.s, rr.ca, rr.cb, rr.x, sy.v FROM rr JOIN sy ON sy.s = rr.s AND sy.ca = rr.ca AND sy.cb = rr.cb AND sy.u = rr.y),
co AS (SELECT s, ca, cb, x, min(y) AS c FROM rr GROUP BY ALL),
ks AS (SELECT s, ca, cb, count(DISTINCT c) AS k FROM co GROUP BY ALL),
bad AS (SELECT DISTINCT p.s, p.ca, p.cb FROM g JOIN co p ON p.s = g.s AND p.x = g.src JOIN co q ON q.s = p.s AND q.ca = p.ca AND q.cb = p.cb AND q.x = g.dst WHERE g.id IN (p.ca, p.cb) AND p.c = q.c),
ok AS (SELECT ks.s FROM ks ANTI JOIN bad ON bad.s = ks.s AND bad.ca = ks.ca AND bad.cb = ks.cb WHERE k = 2)"""


@query(f"WITH RECURSIVE {_DENSITY} SELECT CAST(e AS INTEGER) AS n_edges, CAST(t AS INTEGER) AS trial, (SELECT count(*) FROM ok WHERE ok.s = cell.s) AS bonds FROM cell")
def density_counts(spark, sf):
    """Bonds of random graphs of growing density; their run times are measured too, but differ from run to run."""
    return R.density_grid(spark, 6, 7, 1, 2, 2).drop("ms")


# reports ------------------------------------------------------------------------------------------------------------------

GRID_LINES = ["# k m noncan can", "3 3 150 120", "", "3 4 77 70", "4 4 9 9"]


_GRID = f"{values_sql('l', GRID_LINES)}, t AS (SELECT list_transform(string_split(value, ' '), lambda x: CAST(x AS INTEGER)) AS v FROM l WHERE value <> '' AND value NOT LIKE '#%')"


@query(f"WITH {_GRID} SELECT v[1] AS k, v[2] AS m, round(v[3] / v[4] * 100 - 100, 3) AS percent FROM t")
def noncanonicity_pct(spark, sf):
    return R.noncanonicity_percent(readers.noncanonicity_table(lines(spark, GRID_LINES)))


@query(f"WITH {D.LOG_SQL} SELECT CAST(stage AS BIGINT) AS stage, CAST(bonds AS BIGINT) AS level, avg(CASE WHEN ms <> 0 THEN ms END) AS avg_len FROM log GROUP BY 1, 2")
def path_length_avg(spark, sf):
    rows = D.log_events(spark, sf).select(F.col("stage").cast("long").alias("stage"), F.col("bonds").alias("level"), F.col("ms").alias("len"))
    return R.path_length_profile(rows)


@query(f"""WITH {D.LOG_SQL}, k AS (SELECT * FROM log WHERE ms <> 0 OR bonds <> 0), b AS (SELECT quantile_cont(CAST(ms AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS b FROM k),
q AS (SELECT CASE WHEN ms <= b[2] THEN 0 WHEN ms <= b[3] THEN 1 WHEN ms <= b[4] THEN 2 ELSE 3 END AS quartile, bonds FROM k, b)
SELECT CAST(i AS INTEGER) AS quartile, b[i + 1] AS low, b[i + 2] AS high, count(q.quartile) AS records, CAST(coalesce(sum(q.bonds), 0) AS BIGINT) AS bonds FROM b CROSS JOIN range(0, 4) t(i) LEFT JOIN q ON q.quartile = i GROUP BY i, b""")
def rtm_quartiles(spark, sf):
    return R.quartile_report(D.log_events(spark, sf))


@query(ORACLES["rtm_quartiles"].replace("\nSELECT CAST(i AS INTEGER) AS quartile", ", o AS (SELECT CAST(i AS INTEGER) AS quartile") + """)
SELECT quartile, format('{:g}', quartile / 4) || chr(9) || '&' || chr(9) || format('{:g}', (quartile + 1) / 4) || chr(9) || '& ' || format('{:g}', low) || chr(9) || '&' || chr(9) || format('{:g}', high) || chr(9) || '& '
       || records || chr(9) || '& ' || bonds || ' \\\\' AS value FROM o""")
def quartile_lines(spark, sf):
    return writers.quartile_text(R.quartile_report(D.log_events(spark, sf)))


@query(f"WITH {D.LOG_SQL} SELECT CAST(stage AS INTEGER) AS k, " + ", ".join(f"sum(CASE WHEN bonds = {i} THEN 1 END)::BIGINT AS \"{i}\"" for i in (1, 2, 3)) + " FROM log GROUP BY stage")
def table_pivot(spark, sf):
    rows = D.log_events(spark, sf).groupBy(F.col("stage").alias("k"), F.col("bonds").cast("int").alias("m")).agg(F.count("*").alias("n"))
    return R.pivot_table(rows, "n")


@query(f"WITH {_GRID} SELECT v[1] AS k, v[2] AS m, v[1] || ' & ' || v[2] || ' \\\\' AS value FROM t")
def tex_lines(spark, sf):
    return writers.tex_rows(readers.noncanonicity_table(lines(spark, GRID_LINES)).select("k", "m"), ["k", "m"])


SIZE_LINES = ["1,2", "(a,b),3", "7", "(x,y,z)"]


@query(f"WITH {values_sql('l', SIZE_LINES)} SELECT value, CAST(len(string_split(regexp_replace(value, '[(][^)]*[)]', 'x', 'g'), ',')) AS INTEGER) AS size FROM l")
def parenthesis_sizes(spark, sf):
    return lines(spark, SIZE_LINES).select("value", line_size(F.col("value")).alias("size"))


@query(f"WITH {values_sql('l', CUT_LINES)}, p AS (SELECT DISTINCT list_sort(list_distinct(list_transform(string_split(value, ','), lambda x: CAST(trim(x) AS INTEGER)))) AS e FROM l WHERE value <> '') SELECT array_to_string(e, ',') AS edges FROM p UNION ALL SELECT ''")
def cut_sets_from_lines(spark, sf):
    return lines(spark, CUT_LINES).select(as_set(parse_ids(F.col("value"))).alias("edges")).distinct().select(text("edges"))
