"""Command line: bonds, check, diff, uniq, convert and measure on edge and cut files.

Exit codes: 0 done, 1 usage, 2 a range whose end lies before its start, 3 a file that cannot be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions.columns import as_line
from .functions.scratch import Scratch
from .operators import bonds as B
from .operators import cuts as C
from .operators import reports as R
from .sources import generators, readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cutweave", description="minimal multiway edge cuts on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **flags):
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for flag, options in flags.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **options)
        p.add_argument("--out", help="folder to write to instead of printing")

    yes = {"action": "store_true"}
    command("bonds", "edges", "m", "k", brute=yes, exact=yes)
    command("check", "edges", cuts={}, cut={}, first_failure=yes, sample={"type": int}, components=yes)
    command("diff", "left", "right")
    command("uniq", "cuts")
    command("split", "cuts")
    command("names", "names", "lists")
    command("graph6", "lines", rows=yes)
    command("dot", "edges")
    command("differential", "lines", "m", "k", nodes={"type": int, "default": 8}, edges={"default": "8-14"}, count={"type": int, "default": 100}, seed={"type": int, "default": 0}, failing={})
    command("random", "nodes", "edges", seed={"type": int, "default": 0})
    command("grid", "edges", "m", "k")
    command("chains", "edges", "m", "k")
    command("density", "nodes", "max_edges", "trials", "m", "k")
    command("paths", "log")
    command("quartiles", "log", keep_zero=yes)
    command("pivot", "table", value={"choices": ["secs", "bonds", "percent"], "default": "bonds"})
    return top


def _rows(df: DataFrame, columns: list[str], sep: str) -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value"))


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The lines of the command's output as (value)."""
    text = lambda path: spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    edges = lambda: readers.read_edges(spark, a.edges)
    if a.command == "bonds":
        found = B.bonds(edges(), int(a.m), a.k, "brute" if a.brute else "algebra", a.exact)
        return writers.cut_text(found)
    if a.command == "check":
        cuts = readers.inline_cut(spark, a.cut) if a.cut is not None else readers.read_cuts(spark, a.cuts)
        cuts = C.stride_sample(cuts, a.sample) if a.sample else cuts
        checked = C.check_cuts(edges(), cuts)
        if a.components:
            return _rows(checked.orderBy("line_no"), ["n_components"], " ")
        if a.cut is not None:
            return _rows(checked, ["status"], " ")
        failed = C.first_failure(checked) if a.first_failure else checked.where("status <> 'true'").orderBy("line_no")
        summary = C.fail_summary(checked)
        return failed.select(F.concat(F.lit("FAIL on cut: "), as_line(F.col("edges"))).alias("value")).union(_rows(summary, ["fails", "total"], "/"))
    if a.command == "diff":
        left, right = readers.read_cuts(spark, a.left), readers.read_cuts(spark, a.right)
        return writers.cut_text(C.cut_diff(left, right).orderBy("edges"))
    if a.command == "uniq":
        return writers.cut_text(C.by_size(C.cut_uniq(readers.read_cuts(spark, a.cuts))))
    if a.command == "split":
        writers.write_by_size(spark.read.text(a.cuts), a.out or f"{a.cuts}bySize")
        return None
    if a.command == "names":
        return writers.cut_text(C.names_to_ids(readers.read_names(spark, a.names), readers.name_lists(text(a.lists))).orderBy("line_no"))
    if a.command == "graph6":
        rows = readers.graph6_edges(text(a.lines).select(F.col("line_no").alias("graph_id"), F.col("value").alias("g6")), "row" if a.rows else "col")
        return writers.edge_text(rows.orderBy("graph_id", "id"))
    if a.command == "dot":
        return writers.dot_text(edges()).orderBy("line").select("value")
    if a.command == "differential":
        if a.lines == "random":
            graphs = generators.random_graphs(spark, a.count, a.nodes, *B.parse_k(a.edges), a.seed)
        else:
            graphs = readers.graph6_edges(text(a.lines).select(F.col("line_no").alias("graph_id"), F.col("value").alias("g6"))).drop("n")
        scratch = Scratch(spark)
        graphs = scratch.write(graphs)
        diff = scratch.write(B.differential(graphs, int(a.m), a.k))
        print(f"Graphs retrieved: {graphs.select('graph_id').distinct().count()}", file=sys.stderr)
        if a.failing:
            writers.write_graphs(B.failing_graphs(graphs, diff), a.failing)
        return diff.select(F.concat_ws(" ", "graph_id", "method", as_line(F.col("edges"))).alias("value"))
    if a.command == "random":
        low, high = B.parse_k(a.edges)
        return writers.edge_text(generators.random_graph(spark, int(a.nodes), low, high, a.seed).orderBy("id"))
    if a.command == "grid":
        return _rows(R.km_grid(edges(), readers.parse_bounds(a.m, 1), readers.parse_bounds(a.k, 2)), ["k", "m", "secs", "bonds"], " ")
    if a.command == "chains":
        return _rows(R.derivations(edges(), readers.parse_bounds(a.m, 3)[1], readers.parse_bounds(a.k, 3)), ["k", "m", "noncan", "can"], " ")
    if a.command == "density":
        return _rows(R.density_grid(spark, int(a.nodes), int(a.max_edges), int(a.trials), int(a.m), int(a.k)), ["n_edges", "ms", "bonds"], "\t")
    if a.command == "paths":
        return _rows(R.path_length_profile(readers.path_log(text(a.log))).orderBy("stage", "level"), ["stage", "level", "avg_len"], " ")
    if a.command == "quartiles":
        report = R.quartile_report(readers.runtime_log(text(a.log)), a.keep_zero).orderBy("quartile")
        return writers.quartile_text(report).orderBy("quartile").select("value")
    if a.value == "percent":
        table = R.pivot_table(R.noncanonicity_percent(readers.noncanonicity_table(text(a.table))), "percent")
    else:
        table = R.pivot_table(readers.grid_table(text(a.table)), a.value)
    return writers.tex_rows(table.orderBy("k"), table.columns).select("value")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("cutweave").getOrCreate()
    try:
        out = run(spark, a)
        if out is not None and a.out:
            out.write.mode("overwrite").text(a.out)
        elif out is not None:
            for row in out.toLocalIterator():
                print(row.value)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2 if "range" in str(e) and "empty" in str(e) else 1
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            print(f"no such file: {e}", file=sys.stderr)
            return 3
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
