"""Graph operators on an edge table (id, src, dst) of an undirected multigraph.

Graphs of a checked size are worked on in one task; larger ones by joins in rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ranked, successor
from ..functions.scratch import Scratch
from . import small
from .components import connected_components


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def is_small(edges: DataFrame) -> bool:
    return edges.limit(small.LOCAL_EDGES + 1).count() <= small.LOCAL_EDGES


def components(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reached; isolated nodes come from loops or `all_nodes`."""
    known = nodes(edges) if all_nodes is None else nodes(edges).union(all_nodes.select("node")).distinct()
    numbered = edges if "id" in edges.columns else edges.withColumn("id", F.lit(0))
    if is_small(edges):
        found = _local(numbered, small.component_map, "id long, component long")
    else:
        found = connected_components(edges.select("src", "dst"), Scratch(edges.sparkSession))
    return known.join(found, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", F.col("node").cast("long")).alias("component"))


def component_count(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    return components(edges, all_nodes).agg(F.count_distinct("component").alias("n_components"))


def _local(edges: DataFrame, function, schema: str) -> DataFrame:
    """function(pandas graph) in one task; the caller has checked the size."""
    return edges.select("id", "src", "dst", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: function(pdf), schema)


def spanning_forest(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of the minimal spanning forest by edge id (loops never belong to it); the `limit` smallest of them."""
    found = _local(edges, small.forest_ids, "id long") if is_small(edges) else _boruvka(edges)
    found = edges.join(found.select(F.col("id").alias("forest_id")), F.col("id") == F.col("forest_id")).select("id", "src", "dst")
    return found if limit is None else found.orderBy("id").limit(limit)


def _boruvka(edges: DataFrame) -> DataFrame:
    """Every component takes its smallest outgoing id; ids are distinct, so the choices make no cycle."""
    scratch = Scratch(edges.sparkSession)
    live = scratch.write(edges.where("src <> dst").select(F.col("id").cast("long"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")))
    taken = None
    while not live.isEmpty():
        ends = live.select("id", F.col("a").alias("c")).union(live.select("id", F.col("b").alias("c")))
        chosen = scratch.write(ends.groupBy("c").agg(F.min("id").alias("id")).select("id").distinct())
        taken = chosen if taken is None else scratch.write(taken.union(chosen))
        merged = connected_components(live.join(chosen, "id").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
        left, right = merged.toDF("a", "ca"), merged.toDF("b", "cb")
        live = live.join(left, "a", "left").join(right, "b", "left").select("id", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        live = scratch.write(live)
    return taken if taken is not None else live.select("id")


def bfs_hops(edges: DataFrame, sources: list[int], excluded: Column | None = None) -> DataFrame:
    """(node, hops) of the nodes that the sources reach; edges for which `excluded` holds are left out."""
    live = edges if excluded is None else edges.where(~excluded)
    if is_small(live):
        return _local(live, lambda pdf, s=frozenset(sources): small.hops(pdf, set(s)), "node long, hops long")
    scratch = Scratch(edges.sparkSession)
    near = scratch.write(live.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).union(live.select("dst", "src")).distinct())
    seen = scratch.write(near.where(F.col("u").isin(sources)).select(F.col("u").alias("node"), F.lit(0).cast("long").alias("hops")).distinct())
    front, step = seen, 0
    while not front.isEmpty():
        step += 1
        onward = near.join(front, F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        front = scratch.write(onward.join(seen, "node", "left_anti").withColumn("hops", F.lit(step).cast("long")))
        seen = scratch.write(seen.union(front))
    return seen


def shortest_path_length(edges: DataFrame, sources: list[int], targets: list[int], excluded: Column | None = None) -> DataFrame:
    """One row: the least number of edges from a source to a target, null if there is no path."""
    return bfs_hops(edges, sources, excluded).where(F.col("node").isin(targets)).agg(F.min("hops").alias("hops"))


def canonical_path(edges: DataFrame, sources: list[int], targets: list[int], excluded: Column | None = None) -> DataFrame:
    """(pos, id): of the paths with fewest edges from a source to a target, that with the smallest sequence of edge ids; empty if there is none.

    In a large graph the path is walked by one small join per edge, along falling distances to the targets.
    """
    live = edges if excluded is None else edges.where(~excluded)
    if is_small(live):
        return _local(live, lambda pdf, a=frozenset(sources), b=frozenset(targets): small.canonical_path(pdf, set(a), set(b)), "pos long, id long")
    spark = edges.sparkSession
    far = Scratch(spark).write(bfs_hops(live, targets))
    left = far.where(F.col("node").isin(sources)).agg(F.min("hops")).first()[0] or 0
    at, path = [r.node for r in far.where(F.col("node").isin(sources) & (F.col("hops") == left)).collect()], []
    both = live.select("id", F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    both = both.union(both.select("id", "v", "u"))
    while left:
        left -= 1
        onward = both.where(F.col("u").isin(at)).join(far.where(F.col("hops") == left), F.col("v") == F.col("node"))
        best = onward.agg(F.min_by(F.struct("id", "v"), F.struct("id", "v")).alias("b")).first().b
        path.append((len(path), int(best.id)))
        at = [r.v for r in onward.where(F.col("id") == best.id).select("v").distinct().collect()]
    return spark.createDataFrame(path, "pos long, id long")


def make_connected(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """Edges that chain the components by their smallest nodes: (id, src, dst), ids after the largest one."""
    reps = components(edges, all_nodes).select(F.col("component").cast("long").alias("component")).distinct()
    chain = ranked(successor(reps, [], "component").where("__next IS NOT NULL"), "component")
    top = edges.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    number = F.col("top") + 1 + F.col("__before")
    return chain.join(F.broadcast(top)).select(number.cast("int").alias("id"), F.col("component").cast("int").alias("src"), F.col("__next").cast("int").alias("dst"))


def by_colour(rows: DataFrame, colour: str = "colour", item: str = "id") -> DataFrame:
    """(colour, items): the items of each colour in order, joined by ', '; a debugging aid for small graphs."""
    return rows.groupBy(colour).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ", ").alias("items"))


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges whose id is not in `removed` (id)."""
    return edges.join(removed.select("id"), "id", "left_anti")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("id").cast("int")).bitwiseAND(F.lit(9223372036854775807))


_LABELLED = "id int, src int, dst int, label long, block long, base int"


def cycle_labels(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, src, dst, label): random cycle-space labels; the XOR over a set of edges is 0 iff it is a cut, but for accidents of 2^-63.

    Edges outside the minimal spanning forest get a hash; an edge of the forest gets the XOR of the hashes of the edges that leave the
    subtree below it. A loop keeps a hash of its own, so that it is in no cut. Labels are the same whatever the size of the graph.
    """
    return labelled(edges, seed).select("id", "src", "dst", "label")


def labelled(edges: DataFrame, seed: int = 0) -> DataFrame:
    """cycle_labels() with block and base: no minimal cut has edges of two blocks (biconnected blocks; components in large graphs), base is the number of components."""
    hashed = edges.select("id", "src", "dst", _hash(seed).alias("h"))
    if is_small(edges):
        return hashed.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: small.label_graph(pdf), _LABELLED)
    return _labels_by_joins(hashed)


def labelled_graphs(graphs: DataFrame, seed: int = 0) -> DataFrame:
    """The same for every graph of (g, id, src, dst), each of a checked size: (g, id, src, dst, label, block, base)."""
    most = graphs.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > small.LOCAL_EDGES:
        raise ValueError(f"of many graphs each may have at most {small.LOCAL_EDGES} edges; work on large graphs one by one")

    def one(key, pdf):
        out = small.label_graph(pdf)
        out.insert(0, "g", key[0])
        return out

    return graphs.select("g", "id", "src", "dst", _hash(seed).alias("h")).groupBy("g").applyInPandas(one, f"g long, {_LABELLED}")


def _labels_by_joins(hashed: DataFrame) -> DataFrame:
    """Labels from an Euler tour of the minimal forest: rounds grow with the log of its size, whatever its depth.

    Every edge of the forest is two arcs; after an arc into a node comes the node's next arc out, in a circle that is cut at the root. Each
    node's hashes are put on its first arc out. XORs over the rest of the tour come by pointer doubling, and the subtree below an edge
    is what lies between its two arcs.
    """
    scratch = Scratch(hashed.sparkSession)
    hashed = scratch.write(hashed)
    forest = scratch.write(_boruvka(hashed).select(F.col("id").alias("forest_id")))
    where = scratch.write(components(hashed).select(F.col("node").cast("long").alias("node"), "component"))
    on_tree = F.col("id") == F.col("forest_id")
    rest = hashed.join(forest, on_tree, "left_anti")
    plain = rest.where("src <> dst")
    ends = plain.select(F.col("src").cast("long").alias("at"), "h").union(plain.select(F.col("dst").cast("long"), "h"))
    sums = ends.groupBy("at").agg(F.bit_xor("h").alias("s"))
    tree = hashed.join(forest, on_tree, "left_semi").select((F.col("id").cast("long") * 2).alias("arc"), F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    out = successor(tree.select("arc", F.col("u").alias("tail")).union(tree.select(F.col("arc") + 1, "v")), ["tail"], "arc")
    out = out.join(where, F.col("tail") == F.col("node")).join(sums, F.col("tail") == F.col("at"), "left")
    is_end = F.col("__next").isNull() & (F.col("tail") == F.col("component"))
    value = F.when(F.col("arc") == F.col("__first"), F.coalesce("s", F.lit(0))).otherwise(F.lit(0))
    out = scratch.write(out.select("arc", value.alias("value"), F.when(~is_end, F.coalesce("__next", "__first")).alias("turn")))
    after = out.select(F.col("arc").bitwiseXOR(F.lit(1).cast("long")).alias("arc"), F.col("turn").alias("to"))
    jump = scratch.write(out.select("arc", F.col("value").alias("x")).join(after, "arc"))
    while not jump.where("to IS NOT NULL").isEmpty():  # x covers the next 2^round arcs
        far, last = jump.select(F.col("arc").alias("at"), F.col("x").alias("more"), F.col("to").alias("onward")), jump
        wide = jump.join(far, F.col("to") == F.col("at"), "left")
        jump = scratch.write(wide.select("arc", F.col("x").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("x"), F.col("onward").alias("to")))
        scratch.drop(last)
    between = jump.join(out, "arc").groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(F.bit_xor(F.col("x").bitwiseXOR(F.col("value"))).alias("label"))
    known = between.union(rest.select(F.col("id").cast("long"), F.col("h"))).toDF("of", "label")
    base = where.select("component").distinct().count()
    found = hashed.join(known, F.col("id") == F.col("of")).join(where, F.col("src") == F.col("node"))
    return found.select(F.col("id").cast("int").alias("id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "label", F.col("component").alias("block"), F.lit(base).cast("int").alias("base"))
