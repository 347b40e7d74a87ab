import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave import cli
from cutweave.functions import columns as X
from cutweave.functions.order import ranked, successor
from cutweave.functions.scratch import Scratch, shared_folder
from cutweave.operators import bonds as B
from cutweave.operators import cuts as C
from cutweave.operators import reports as R
from cutweave.operators import small
from cutweave.operators.bonds import bonds
from cutweave.operators.graph import component_count
from cutweave.operators.reference_methods import component_map
from cutweave.plans.derived import TWO_SQUARES, graph5
from cutweave.sources import generators, readers, writers
from cutweave.streaming.cuts import distinct_cut_stream


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def cuts(spark, values):
    return readers.cut_lines(lines(spark, values))


def edges_list(df):
    return [list(r.edges) for r in df.collect()]


def test_duplicates_and_orders(spark):
    assert edges_list(C.by_size(C.cut_uniq(cuts(spark, ["3,1", "1,3", "2"])))) == [[2], [1, 3]]
    assert edges_list(C.by_size(C.cut_uniq(cuts(spark, ["1,2", "3", ""])))) == [[3], [1, 2]]
    assert edges_list(C.cut_diff(cuts(spark, ["1,2", "3"])).orderBy("edges")) == [[1, 2], [3]]
    assert edges_list(C.by_size(C.cut_uniq(cuts(spark, ["1,1", "1"])))) == [[1], [1, 1]]
    assert edges_list(C.cut_diff(cuts(spark, ["1,1", "1"]))) == [[1]]
    assert edges_list(C.cut_diff(cuts(spark, ["1,2", "3"]), cuts(spark, ["2,1"]))) == [[3]]
    assert C.cut_diff(cuts(spark, ["1,2"]), readers.read_cuts(spark, "~")).count() == 1
    assert sorted((r.side, *r.edges) for r in C.cut_symdiff(cuts(spark, ["1", "2"]), cuts(spark, ["2", "3"])).collect()) == [("A", 1), ("B", 3)]


def test_status_and_unknown_ids(spark):
    got = {r.line_no: (r.status, r.n_components, list(r.unknown_ids)) for r in C.check_cuts(graph5(spark), cuts(spark, ["0,1", "0", "0,1,2", "0,1,3", "99", "", "0,0,1"])).collect()}
    assert got == {0: ("true", 2, []), 1: ("false_not_cut", 1, []), 2: ("false_not_minimal", 2, []), 3: ("true", 3, []), 4: ("unknown_edge", None, [99]), 5: ("false_not_cut", 1, []), 6: ("true", 2, [])}
    two = spark.createDataFrame([(1, 0, 1), (2, 2, 3)], "id int, src int, dst int")
    assert C.check_cuts(two, cuts(spark, [""])).first().status == "true"


def test_stride_sample(spark):
    rows = spark.range(12345).select((F.col("id") * 7).alias("line_no"), F.array(F.col("id").cast("int")).alias("edges"))
    got = C.stride_sample(rows)
    assert got.count() == 6173 and got.where("line_no % 14 <> 0").count() == 0
    assert C.stride_sample(rows.limit(100)).count() == 100


def test_lookups(spark):
    names = spark.createDataFrame([(7, "a", 0), (8, "b", 1), (9, "a", 2)], "id int, name string, line_no long")
    assert edges_list(C.names_to_ids(names, readers.name_lists(lines(spark, ["b;a;b;x;y;z"])))) == [[8, 9, 8]]
    with pytest.raises(Exception, match="unknown name"):
        C.names_to_ids(names, readers.name_lists(lines(spark, ["c;x;y;z"]))).collect()
    got = C.ids_to_edges(graph5(spark), cuts(spark, ["9,99"])).orderBy("pos").collect()
    assert [(r.id, r.src, r.dst) for r in got] == [(9, 3, 4), (99, None, None)]


def test_array_fold_refuses_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(small, "LOCAL_EDGES", 5)
    with pytest.raises(ValueError):
        C.fold_check(graph5(spark), cuts(spark, ["0"]).select("edges"))


@pytest.mark.parametrize("text", ["1;2", "x;1;2", "1;-2;3", "id;src;dst"])
def test_malformed_edges_raise(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        readers.edge_lines(lines(spark, [text])).collect()


def test_edge_files(spark, tmp_path):
    writers.write_edges(graph5(spark), str(tmp_path / "g"))
    assert sorted(map(tuple, readers.read_edges(spark, str(tmp_path / "g")).collect())) == TWO_SQUARES
    (tmp_path / "h.csv").write_text("id;source;target;name\n\n5;1;2;road\n")
    assert [tuple(r) for r in readers.read_edges(spark, str(tmp_path / "h.csv"), header=True).collect()] == [(5, 1, 2)]
    (tmp_path / "osm.csv").write_text("a,b,c,d,e\n1,2,3,x,2\n2,3,4,x,10\n3,4,5,x,1\n4,5,6,x,0\n5,6,7,x,\n")
    assert sorted(map(tuple, readers.read_osm_edges(spark, str(tmp_path / "osm.csv")).collect())) == [(1, 2, 3), (2, 3, 4)]
    both = lines(spark, ["1;2;3", "2,3,4"])
    assert sorted(map(tuple, readers.edge_lines(both, ";,").collect())) == [(1, 2, 3), (2, 3, 4)]


def encode_graph6(n, pairs):
    if n < 63:
        out = chr(n + 63)
    elif n < 258048:
        out = "~" + "".join(chr((n >> s & 63) + 63) for s in (12, 6, 0))
    else:
        out = "~~" + "".join(chr((n >> s & 63) + 63) for s in (30, 24, 18, 12, 6, 0))
    bits = [int((i, j) in pairs) for j in range(n) for i in range(j)]
    bits += [0] * (-len(bits) % 6)
    return out + "".join(chr(sum(b << 5 - k for k, b in enumerate(bits[a : a + 6])) + 63) for a in range(0, len(bits), 6))


def test_graph6(spark):
    k4 = [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)]
    big = {(0, 69), (3, 4), (68, 69), (1, 5)}
    df = spark.createDataFrame([(1, "C~"), (2, "D?{"), (3, encode_graph6(70, big)), (4, "B?"), (5, ">>graph6<<Bw")], "graph_id long, g6 string")
    col, row = ({} for _ in range(2))
    for out, order in ((col, "col"), (row, "row")):
        for r in readers.graph6_edges(df, order).orderBy("graph_id", "id").collect():
            out.setdefault(r.graph_id, []).append((r.src, r.dst))
    assert col[1] == k4 and row[1] == sorted(k4) and col[2] == [(i, 4) for i in range(4)]
    assert set(col[3]) == big and row[3] == sorted(big) and 4 not in col and len(col[5]) == 3
    for bad in (":Fa@x^", "C 1"):
        with pytest.raises(Exception, match="graph6"):
            readers.graph6_edges(spark.createDataFrame([(1, bad)], "graph_id long, g6 string")).collect()


def test_writers(spark, tmp_path):
    writers.write_cuts(cuts(spark, ["1,2", "3"]), str(tmp_path / "c"))
    assert sorted(edges_list(readers.read_cuts(spark, str(tmp_path / "c")))) == [[1, 2], [3]]
    writers.write_by_size(lines(spark, ["1,2", "(a,b),3", "7"]).select("value"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("size=*")) == ["size=1", "size=2"]
    writers.write_log(spark.createDataFrame([(1, 12, 3)], "stage int, ms long, bonds long"), str(tmp_path / "log"))
    assert [tuple(r) for r in readers.runtime_log(spark.read.text(str(tmp_path / "log"))).collect()] == [(1, 12, 3)]
    dot = [r.value for r in writers.dot_text(graph5(spark)).orderBy("line").collect()]
    assert dot[0] == "graph G {" and dot[1] == '\t0 -- 1 [label = "0"];' and dot[-1] == "}"


def test_columns(spark):
    row = spark.range(1).select(
        X.gf2_rank(F.array(*[F.lit(x).cast("long") for x in (5, 3, 6, 0)])).alias("rank"),
        X.has_coloop(F.array(*[F.lit(x).cast("long") for x in (5, 3, 6)])).alias("dependent"),
        X.has_coloop(F.array(*[F.lit(x).cast("long") for x in (5, 5, 6)])).alias("coloop"),
        X.opposite(F.lit(1), F.lit(2), F.lit(1)).alias("other"),
        X.colour_name(F.lit(2)).alias("colour"),
        X.base_name(F.lit("/x/y.z.csv")).alias("base"),
        X.round_half_up(F.lit(0.0125), 3).alias("rounded"),
    ).first()
    assert tuple(row) == (2, False, True, 2, "blue", "y.z", 0.013)


def test_reports(spark):
    log = readers.runtime_log(lines(spark, ["1\t1\t5", "1\t2\t1", "2\t3\t1", "2\t10\t2", "3\t0\t0", ""]))
    got = [tuple(r) for r in R.quartile_report(log).orderBy("quartile").collect()]
    assert got == [(0, 1.0, 1.75, 1, 5), (1, 1.75, 2.5, 1, 1), (2, 2.5, 4.75, 1, 1), (3, 4.75, 10.0, 1, 2)]
    assert sum(r.records for r in R.quartile_report(log, keep_zero=True).collect()) == 5
    paths = readers.path_log(lines(spark, ["1 2 4", "1 2 0", "1 3 0", "", "1 2 6"]))
    assert {(r.stage, r.level): r.avg_len for r in R.path_length_profile(paths).collect()} == {(1, 2): 5.0, (1, 3): None}
    table = readers.noncanonicity_table(lines(spark, ["# x", "3 4 150 120", "4 4 5 4"]))
    assert [tuple(r) for r in R.noncanonicity_percent(table).orderBy("k").collect()] == [(3, 4, 25.0), (4, 4, 25.0)]
    pivot = R.pivot_table(table, "noncan").orderBy("k")
    assert [r.value for r in writers.tex_rows(pivot, pivot.columns).select("value").collect()] == [r"3 &  &  &  & 150 \\", r"4 &  &  &  & 5 \\"]
    chains = {(r.k, r.m): (r.noncan, r.can) for r in R.derivations(graph5(spark), 4, (3, 3)).collect()}
    assert chains[(3, 3)][1] == 2 and chains[(3, 4)][1] == 35 and all(a >= b for a, b in chains.values())
    cells = R.km_grid(graph5(spark), (2, 3), (2, 2)).orderBy("m").collect()
    assert [r.bonds for r in cells] == [7, 19] and all(r.secs > 0 for r in cells)
    assert R.density_grid(spark, 4, 4, 1, 2, 2).count() == 1


def test_stream_of_cuts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("3,1\n1,3\n\n2\n")
    stream = distinct_cut_stream(spark, str(source)).writeStream.format("memory").queryName("cut_stream").outputMode("append").start()
    try:
        stream.processAllAvailable()
        (source / "b.txt").write_text("2\n1,1\n")
        stream.processAllAvailable()
        assert sorted(r.cut for r in spark.table("cut_stream").collect()) == ["1,1", "1,3", "2"]
    finally:
        stream.stop()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    g = tmp_path / "g.csv"
    g.write_text("".join(f"{i};{u};{v}\n" for i, u, v in TWO_SQUARES))
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("1,0\n0,1\n3\n5,6\n")
    b.write_text("6,5\n")

    def call(*argv, code=0):
        assert cli.main([str(x) for x in argv], spark) == code
        return capsys.readouterr().out.splitlines()

    assert sorted(call("bonds", g, "2", "2")) == ["0,1", "0,3", "1,3", "5,6", "5,7", "6,7", "8,9"]
    assert sorted(call("bonds", g, "2", "2", "--brute")) == ["0,1", "0,3", "1,3", "5,6", "5,7", "6,7", "8,9"]
    assert call("check", g, "--cut", "0,1,2") == ["false_not_minimal"]
    assert call("check", g, "--cut", "0,1,3", "--components") == ["3"]
    assert call("check", g, "--cuts", a) == ["FAIL on cut: 3", "1/4"]
    assert call("check", g, "--cuts", a, "--first-failure", "--sample", "2")[-1].endswith("/2")
    assert call("diff", a, b) == ["0,1", "3"] and call("diff", a, "~") == ["0,1", "3", "5,6"]
    assert call("uniq", a) == ["3", "0,1", "5,6"]
    assert call("split", a, "--out", tmp_path / "split") == []
    (tmp_path / "k4.g6").write_text("C~\n")
    assert call("graph6", tmp_path / "k4.g6", "--rows")[:3] == ["0;0;1", "1;0;2", "2;0;3"]
    assert call("differential", tmp_path / "k4.g6", "4", "2-3") == []
    whole = B.two_bonds
    monkeypatch.setattr(B, "two_bonds", lambda labels, m: whole(labels, m).where("g <> 3"))
    wrong = call("differential", "random", "2", "2", "--count", "6", "--nodes", "5", "--edges", "4-6", "--failing", tmp_path / "failing")
    assert wrong and all(x.startswith("3 definition ") for x in wrong)
    assert [p.name for p in (tmp_path / "failing").glob("graph_id=*")] == ["graph_id=3"]
    monkeypatch.undo()
    assert call("dot", g)[-1] == "}"
    assert len(call("random", "6", "7")) >= 7
    assert call("grid", g, "2-2", "2")[0].split()[3] == "7"
    assert call("chains", g, "3", "3")[0].endswith(" 2")
    assert len(call("density", "4", "4", "1", "2", "2")) == 1
    (tmp_path / "n.csv").write_text("7;1;2;roadA;x\n8;2;3;roadB;x\n")
    (tmp_path / "l.csv").write_text("roadA;roadB;f1;f2;f3\n")
    assert call("names", tmp_path / "n.csv", tmp_path / "l.csv") == ["7,8"]
    (tmp_path / "p.log").write_text("1 2 4\n1 2 0\n")
    assert call("paths", tmp_path / "p.log") == ["1 2 4.0"]
    (tmp_path / "r.log").write_text("1\t1\t3\n")
    assert len(call("quartiles", tmp_path / "r.log")) == 4
    (tmp_path / "t.txt").write_text("# c\n3 3 150 120\n")
    assert call("pivot", tmp_path / "t.txt", "--value", "percent") == [r"3 &  &  & 25.0 \\"]
    call("bonds", g, "2", "4-2", code=2)
    call("bonds", tmp_path / "none.csv", "2", "2", code=3)
    call("bonds", g, code=1)


def test_derivations_read_every_edge(spark):
    rows = [(i, 0, 1) for i in range(2100)] + [(3000, 1, 2), (3001, 2, 3)]
    cells = {(r.k, r.m): (r.noncan, r.can) for r in R.derivations(spark.createDataFrame(rows, "id int, src int, dst int"), 3, (3, 3)).collect()}
    assert cells[(3, 3)] == (1, 1)


def test_numbers_as_percent_g_writes_them(spark):
    values = [0.0, 1.0, -2.5, 0.25, 100000.0, 999999.4, 999999.5, 1e6, 1234567.0, 1e-4, 0.00012345678, 9.9999996e-5, 1e-5, 3.14159265, 1e300, 12345.67, 2.0**-20]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(X.general(F.col("v")).alias("t")).collect()] == [f"{v:g}" for v in values]


def test_quartiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000):
        ms = rng.integers(1, 200_000, n)
        log = spark.createDataFrame([(1, int(x), 1) for x in ms], "stage int, ms long, bonds long")
        got = R.quartile_report(log).orderBy("quartile").collect()
        want = np.percentile(ms, [0, 25, 50, 75, 100])
        assert np.allclose([r.low for r in got] + [got[-1].high], want) and sum(r.records for r in got) == n
    none = R.quartile_report(spark.createDataFrame([], "stage int, ms long, bonds long"))
    assert none.count() == 0


def test_order_in_two_levels(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randint(0, 2), rng.randint(-50, 50)) for _ in range(80)})
    df = spark.createDataFrame(rows, "k int, at long").repartition(5)
    got = {(r.k, r.at): (r["__next"], r["__first"]) for r in successor(df, ["k"], "at", width=7).collect()}
    for k, at in rows:
        mine = [b for a, b in rows if a == k]
        assert got[k, at] == (min((b for b in mine if b > at), default=None), mine[0])
    alone = df.select("at").distinct()
    values = sorted({b for _, b in rows})
    assert {r.at: r["__before"] for r in ranked(alone, "at", width=9).collect()} == {v: i for i, v in enumerate(values)}
    sums = {r.at: r["__before"] for r in ranked(alone, "at", width=9, weight=F.col("at")).collect()}
    assert sums == {v: sum(values[:i]) for i, v in enumerate(values)}


def test_checks_by_definition(spark):
    rng = random.Random(5)
    for n in range(60):
        nodes = rng.randint(2, 7)
        edges = [(3 * i, rng.randrange(nodes), rng.randrange(nodes)) for i in range(rng.randint(1, 12))]
        checker = small.CutChecker(*(np.array(c) for c in zip(*edges, strict=True)))
        everything = {v for _, u, w in edges for v in (u, w)}
        for _ in range(20):
            cut = rng.sample([e for e, _, _ in edges], rng.randint(0, min(5, len(edges))))
            part = component_map(edges, everything, frozenset(cut))
            assert checker.check(cut + [1000]) == (len(set(part.values())), all(part[u] != part[v] for e, u, v in edges if e in cut)), (n, edges, cut)


def test_graphs_beyond_two_thousand_edges(spark):
    town = generators.street_grid(spark, 40, 40, seed=1)
    n = town.count()
    assert n > 2000
    base = component_count(town).first()[0]
    ones = {tuple(r.edges) for r in bonds(town, 1, base + 1, "brute").collect()}
    assert ones == {tuple(r.edges) for r in bonds(town, 1, base + 1).collect()} and len(ones) > 200
    found = bonds(town, 3, base + 1)
    assert found.count() == bonds(town, 3, base + 1, exact=True).count() > len(ones)


def test_random_graph_sources(spark):
    for n, low, high in ((9, 30, 36), (9, 36, 36), (12, 0, 0), (30, 100, 120), (2, 1, 1)):
        rows = generators.random_graph(spark, n, low, high, seed=5, connected=False).collect()
        assert low <= len(rows) <= high and len({(r.src, r.dst) for r in rows}) == len(rows)
        assert all(0 <= r.src < r.dst < n for r in rows) and sorted(r.id for r in rows) == list(range(len(rows)))
    graphs = generators.random_graphs(spark, 10, 7, 3, 9, seed=2)
    for g, rows in graphs.toPandas().groupby("graph_id"):
        edges = list(zip(rows["id"], rows["src"], rows["dst"], strict=True))
        assert len(set(component_map(edges, set(range(7)), frozenset()).values())) == 1 and len(set(rows["id"])) == len(rows), g
    assert graphs.select("graph_id").distinct().count() == 10


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf["spark.master"] = "local[4]"
    assert shared_folder(Session()) == Session.conf["spark.checkpoint.dir"]
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert shared_folder(Session()) == "hdfs://x/y"


def test_scratch_tables_go(spark):
    scratch = Scratch(spark)
    kept = scratch.write(spark.range(3))
    assert os.path.isdir(kept.scratch_path)
    scratch.drop(kept)
    assert not os.path.isdir(kept.scratch_path)


def test_entry_without_the_training_data_queries():
    code = "import sys; sys.modules['cutweave.llm.queries'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
