"""All k-bonds with at most m edges, as joins on cycle-space labels.

A set of edges is a k-bond if it is the set of edges between the k connected parts of a partition. With labels whose XOR over a set is 0
exactly for cuts, 2-bonds are the minimal sets with XOR 0 and come out of equi-joins of halves on their XOR; k-bonds are unions of a
(k-1)-bond and a 2-bond that the rank rule accepts: |C| minus the GF(2) rank of C's labels is k - components(G), and no label is
outside all dependencies. Both sizes are cut down before each join.

Two edges of one label are a 2-bond, so larger 2-bonds have distinct labels: halves are sets of labels, not of edges, and edges are put in at the
end. Halves are built within biconnected blocks, as no minimal cut has edges of two. Frames hold any number of graphs, told apart by `g`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import gf2_rank, has_coloop
from ..functions.scratch import Scratch
from .cuts import combinations, fold_check
from .graph import labelled, labelled_graphs

#: Edges of all 2-bonds (some 100 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_BONDS = 200_000
SALTS = 64


def parse_k(text: str | int) -> tuple[int, int]:
    """'3' -> (3, 3), '2-4' -> (2, 4)."""
    low, dash, high = str(text).partition("-")
    if not low.strip().isdigit() or dash and not high.strip().isdigit():
        raise ValueError(f"not a number or a range of numbers: {text}")
    a, b = int(low), int(high) if dash else int(low)
    if b < a:
        raise ValueError(f"the range {text} is empty")
    return a, b


def _minimal(labels) -> F.Column:
    """XOR 0 and nothing smaller: rank one less than the size, and every label in the dependency."""
    return (gf2_rank(labels) == F.size(labels) - 1) & ~has_coloop(labels)


def _in_order(edges: F.Column, labels: F.Column) -> tuple[F.Column, F.Column]:
    pairs = F.array_sort(F.arrays_zip(edges.alias("e"), labels.alias("l")))
    return F.transform(pairs, lambda s: s["e"]).alias("edges"), F.transform(pairs, lambda s: s["l"]).alias("labels")


def two_bonds(labels: DataFrame, m: int) -> DataFrame:
    """(g, base, edges, labels) of all minimal sets of at most m edges with XOR 0, from (g, id, label, block, base)."""
    one = labels.select("g", "base", F.array("id").alias("edges"), F.array("label").alias("labels"), "label")
    out = [one.where("label = 0" if m > 0 else "false").drop("label")]  # a bridge is in no larger 2-bond
    rest = labels.where("label <> 0").select("g", "base", "block", "id", "label")
    if m > 1:
        pairs = rest.join(rest.select("g", "label", F.col("id").alias("other")), ["g", "label"]).where("id < other")
        out.append(pairs.select("g", "base", F.array("id", "other").alias("edges"), F.array("label", "label").alias("labels")))
    if m < 3:
        return reduce(DataFrame.union, out)
    classes = rest.groupBy("g", "base", "block", "label").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    alone = classes.where("n > 1").isEmpty()  # every label has one edge: edges need not be put in at the end
    halves = {1: classes.select("g", "base", "block", F.array("label").alias("labels"), F.array("id").alias("edges"), F.col("label").alias("x"))}
    for size in range(3, m + 1):
        for half in ((size + 1) // 2, size // 2):
            if half not in halves:  # in order of label
                step = classes.select("g", "block", "label", "id")
                wider = halves[half - 1].join(step, ["g", "block"]).where(F.element_at("labels", -1) < F.col("label"))
                both = F.concat("labels", F.array("label")).alias("labels"), F.concat("edges", F.array("id")).alias("edges")
                halves[half] = wider.select("g", "base", "block", *both, F.col("x").bitwiseXOR(F.col("label")).alias("x"))
        # every set is met once: the larger half has the smaller labels
        right = halves[size // 2].select("g", "block", "x", F.col("labels").alias("more"), F.col("edges").alias("other"))
        found = halves[(size + 1) // 2].join(right, ["g", "block", "x"]).where(F.element_at("labels", -1) < F.get("more", 0))
        found = found.select("g", "base", F.concat("labels", "more").alias("labels"), F.concat("edges", "other").alias("edges"))
        if size > 5:  # distinct labels with XOR 0 that are fewer have no smaller set with XOR 0
            found = found.where(_minimal(F.col("labels")))
        if not alone:
            members, found = rest.select("g", F.col("label").alias("of"), "id"), found.withColumn("edges", F.array().cast("array<int>"))
            for i in range(size):
                found = found.withColumn("of", F.get("labels", i)).join(members, ["g", "of"]).withColumn("edges", F.concat("edges", F.array("id"))).drop("of", "id")
        out.append(found.select("g", "base", *_in_order(F.col("edges"), F.col("labels"))))
    return reduce(DataFrame.union, out)


def _unions(y: DataFrame, x: DataFrame, m: int) -> DataFrame:
    """Distinct unions with at most m edges of a bond of y and a bond of x.

    Pairs whose sizes add up to at most m are matched by size; other pairs must share edges and meet at a shared one.
    """
    few = (x.agg(F.sum(F.size("edges"))).first()[0] or 0) <= BROADCAST_BONDS
    a = y.select("g", "base", F.col("edges").alias("ye"), F.col("labels").alias("yl"))
    b = x.select("g", F.col("edges").alias("xe"), F.col("labels").alias("xl"))
    room = F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(m) - F.size("ye")))
    wide = a.where(F.size("ye") < m).withColumn("sx", F.explode(room))
    small = b.withColumn("sx", F.size("xe"))
    if few:
        apart = wide.join(F.broadcast(small), ["g", "sx"])
    else:  # few sizes make few keys: salt one side, repeat the other
        wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        apart = wide.join(small.withColumn("salt", F.pmod(F.xxhash64("xe"), F.lit(SALTS)).cast("int")), ["g", "sx", "salt"])
    shared_a, shared_b = a.withColumn("e", F.explode("ye")), b.withColumn("e", F.explode("xe"))
    meet = shared_a.join(F.broadcast(shared_b) if few else shared_b, ["g", "e"]).where(F.size("ye") + F.size("xe") > m)
    columns = ["g", "base", "ye", "yl", "xe", "xl"]
    both = apart.select(columns).union(meet.select(columns))
    pair = F.arrays_zip(F.concat("ye", "xe").alias("e"), F.concat("yl", "xl").alias("l"))
    both = both.select("g", "base", F.array_sort(F.array_distinct(pair)).alias("p")).where(F.size("p") <= m)
    both = both.select("g", "base", F.transform("p", lambda s: s["e"]).alias("edges"), F.transform("p", lambda s: s["l"]).alias("labels"))
    return both.dropDuplicates(["g", "edges"])


def _by_labels(labels: DataFrame, m: int, low: int, high: int, scratch: Scratch) -> DataFrame:
    """(g, k, edges) of the k-bonds with low <= k <= high, k at least 2; labels: a written table of two_bonds()' input."""
    least = labels.agg(F.min("base")).first()[0]
    out = [labels.where("false").select("g", "base", F.array("id").alias("edges"))]
    if least is not None and m > 0:
        # `steps` is how often a graph was split on: its bonds have base + steps parts
        first = level = scratch.write(two_bonds(labels, m))
        for steps in range(1, high - least + 1):
            if steps > 1:
                # each level still to come adds an edge at least; results of the last level only need the bound itself
                fits = level.where(F.size("edges") <= m - 1)
                wanted = F.size("labels") - gf2_rank(F.col("labels")) == steps
                level = scratch.write(_unions(fits, first, m).where(wanted).where(~has_coloop(F.col("labels"))))
            out.append(level.where((F.col("base") + steps).between(max(low, 2), high)).select("g", F.col("base") + steps, "edges"))
    return reduce(DataFrame.union, out).select("g", F.col("base").cast("int").alias("k"), "edges")


def bonds(edges: DataFrame, m: int, k: str | int, method: str = "algebra", exact: bool = False, seed: int = 0) -> DataFrame:
    """(k, edges) of all k-bonds with at most m edges; k is a number or a range 'a-b'.

    method: 'algebra' by labels, 'brute' by trying all sets against the definition (small graphs). exact: also checks every result of
    'algebra' against the definition, which rules out false hits of hash accidents (graphs of at most LOCAL_EDGES edges).
    """
    low, high = parse_k(k)
    scratch = Scratch(edges.sparkSession)
    edges = scratch.write(edges.select("id", "src", "dst"))  # worked out once, read often
    if method == "brute":
        return brute_bonds(edges, m, low, high)
    if method != "algebra":
        raise ValueError(f"unknown method {method}")
    labels = scratch.write(labelled(edges, seed).select(F.lit(0).cast("long").alias("g"), "id", "label", "block", "base"))
    found = _by_labels(labels, m, low, high, scratch).select("k", "edges")
    return fold_check(edges, found.withColumnRenamed("k", "claimed")).where("separates AND k = claimed").select("k", "edges") if exact else found


def bonds_of_graphs(graphs: DataFrame, m: int, k: str | int, seed: int = 0) -> DataFrame:
    """(graph_id, k, edges) of every graph of (graph_id, id, src, dst), by the same joins as bonds()."""
    low, high = parse_k(k)
    scratch = Scratch(graphs.sparkSession)
    graphs = scratch.write(graphs.select(F.col("graph_id").cast("long").alias("g"), F.col("id").cast("int").alias("id"), "src", "dst"))
    labels = scratch.write(labelled_graphs(graphs, seed).select("g", "id", "label", "block", "base"))
    return _by_labels(labels, m, low, high, scratch).withColumnRenamed("g", "graph_id")


def brute_bonds(edges: DataFrame, m: int, low: int, high: int) -> DataFrame:
    """(k, edges) by trying every set of 1..m edges: k components left, 2 <= low <= k <= high, and every edge separates."""
    sizes = range(1, min(m, edges.count()) + 1)
    if not sizes:
        return edges.sparkSession.createDataFrame([], "k int, edges array<int>")
    tried = reduce(DataFrame.union, [combinations(edges, s) for s in sizes])
    return fold_check(edges, tried).where(f"separates AND k >= 2 AND k BETWEEN {low} AND {high}").select("k", "edges")


def differential(graphs: DataFrame, m: int, k: str | int) -> DataFrame:
    """(graph_id, method, k, edges): what only the engine, or only the definition, finds on graphs (graph_id, id, src, dst); empty if they agree.

    The engine is bonds_of_graphs(); the definition tries every set of edges, for each graph in one task.
    """
    low, high = parse_k(k)

    def plain(pdf):
        import pandas as pd

        from .reference_methods import by_definition

        rows = list(zip(pdf["id"].tolist(), pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        found = [(pdf["graph_id"].iloc[0], n, list(c)) for n, c in sorted(by_definition(rows, m, low, high))]
        return pd.DataFrame(found, columns=["graph_id", "k", "edges"])

    scratch = Scratch(graphs.sparkSession)
    graphs = scratch.write(graphs.select(F.col("graph_id").cast("long").alias("graph_id"), "id", "src", "dst"))
    schema = "graph_id long, k int, edges array<int>"
    definition = scratch.write(graphs.groupBy("graph_id").applyInPandas(plain, schema))
    engine = scratch.write(bonds_of_graphs(graphs, m, k))
    keys = ["graph_id", "k", "edges"]
    only = lambda a, b, name: a.join(b, keys, "left_anti").select("graph_id", F.lit(name).alias("method"), "k", "edges")
    return only(engine, definition, "engine").union(only(definition, engine, "definition"))


def failing_graphs(graphs: DataFrame, differences: DataFrame) -> DataFrame:
    """The graphs that differential() found differences on, to be kept as test cases."""
    return graphs.join(differences.select("graph_id").distinct(), "graph_id", "left_semi")


def bonds_per_seed(found: DataFrame) -> DataFrame:
    """(k, seed, bonds): how many bonds have each smallest edge."""
    return found.groupBy("k", F.array_min("edges").alias("seed")).agg(F.count("*").alias("bonds"))
