"""The graph of links: adjacency of records, starts, traversal, nodes and edges for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable
from tautline.operators.check import rank, worst_state
from tautline.operators.closure import closure
from tautline.operators.ranges import spans_overlapping


def node_id(uuid="uuid", layer="layer"):
    return F.concat_ws("@", uuid, layer)


def graph_adjacency(endpoints: DataFrame) -> DataFrame:
    """uuid, layer, to_layer for each layer endpoint whose neighbour has a record of the same uuid."""
    there = endpoints.select("uuid", F.col("layer").alias("to_layer")).distinct()
    return endpoints.filter("kind = 'layer'").select("uuid", "layer", F.col("target_layer").alias("to_layer")).distinct().join(there, ["uuid", "to_layer"], "left_semi")


def graph_starts(selectors: DataFrame, endpoints: DataFrame) -> DataFrame:
    """selectors (selector) -> selector, uuid, layer: '.' the records of the root layer, '*' of all layers, a uuid or its prefix of 8 or more
    characters, or a file."""
    e = endpoints.select("uuid", "layer", F.when(F.col("kind") == "structural", F.col("file")).alias("file")).distinct()
    records = e.select("uuid", "layer").distinct()
    asked = {r.selector for r in selectors.filter("selector in ('.', '*')").distinct().collect()}  # two at most
    root, whole = (records.filter(c if x in asked else "false").select(F.lit(x).alias("selector"), "uuid", "layer") for x, c in ((".", "layer = '.'"), ("*", "true")))
    by_id = selectors.withColumn("p", F.substring("selector", 1, 8)).join(records.withColumn("p", F.substring("uuid", 1, 8)), "p").filter(F.col("uuid").startswith(F.col("selector"))).select("selector", "uuid", "layer")
    by_file = selectors.join(e, F.col("selector") == F.col("file")).select("selector", "uuid", "layer")
    return root.union(whole).union(by_id).union(by_file).distinct()


#: Edges of a chain up to which it is walked within a row.
WALK = 256


def _walked(edges: Column, start: Column, steps: Column) -> Column:
    """Array of (node, depth) of what is reached from start along an array of (src, dst) in so many steps."""
    reached = lambda nodes, depth: F.transform(nodes, lambda x: F.struct(x.alias("node"), depth.cast("int").alias("depth")))

    def step(acc: Column, depth: Column) -> Column:
        known = F.transform(acc["seen"], lambda s: s["node"])
        front = F.array_distinct(F.array_except(F.transform(F.filter(edges, lambda e: F.array_contains(acc["front"], e["src"])), lambda e: e["dst"]), known))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(F.concat(acc["seen"], reached(front, depth)).alias("seen"), front.alias("front")))

    zero = F.struct(reached(F.array(start), F.lit(0)).alias("seen"), F.array(start).alias("front"))
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, step, lambda acc: acc["seen"])


def graph_traverse(starts: DataFrame, adjacency: DataFrame, max_depth: int | None = None) -> DataFrame:
    """starts (uuid, layer) -> root, uuid, layer, depth of every record within max_depth steps (none: any number) of each start. Edges stay within a uuid: a
    chain of up to WALK of them is walked within its row; longer ones go step by step through closure()."""
    counts = durable(adjacency.groupBy("uuid").agg(F.count("*").alias("n")), "chains")
    few = adjacency.join(counts.filter(F.col("n") <= WALK), "uuid", "left_semi")
    chains = few.groupBy("uuid").agg(F.collect_list(F.struct(F.col("layer").alias("src"), F.col("to_layer").alias("dst"))).alias("edges"))
    s = starts.select("uuid", "layer").distinct().join(counts, "uuid", "left").join(chains, "uuid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    steps = F.col("n").cast("int") if max_depth is None else F.least(F.col("n").cast("int"), F.lit(max_depth))
    none = F.array().cast("array<struct<src:string,dst:string>>")
    short = s.filter(F.col("n") <= WALK).select(node_id().alias("root"), "uuid", F.explode(_walked(F.coalesce("edges", none), F.col("layer"), steps)).alias("r")).select("root", "uuid", F.col("r.node").alias("layer"), F.col("r.depth").alias("depth"))
    long = counts.filter(F.col("n") > WALK).select("uuid")
    if long.isEmpty():
        return short
    edges = adjacency.join(long, "uuid", "left_semi").select(node_id().alias("src"), node_id("uuid", "to_layer").alias("dst"))
    first = starts.join(long, "uuid", "left_semi")
    got = closure(first.select(node_id().alias("root"), node_id().alias("node")), edges, max_depth)
    return short.unionByName(got.select("root", F.substring_index("node", "@", 1).alias("uuid"), F.substring_index("node", "@", -1).alias("layer"), "depth"))


def graph_flat(reached: DataFrame, records: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of graph_traverse() with link0, link1 (the ends as written, from records: layer, uuid, link0, link1) and state0, state1 (from
    states: layer, uuid, n, state)."""
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("state")))
    both = states.groupBy("layer", "uuid").agg(at(0).alias("state0"), at(1).alias("state1"))
    full = records.select("layer", "uuid", "link0", "link1").join(both, ["layer", "uuid"], "left")
    return reached.join(full, ["layer", "uuid"], "left").select("root", "uuid", "layer", "depth", "link0", "link1", "state0", "state1")


def graph_nodes(spans: DataFrame, lines: DataFrame, most_lines: int = 100) -> DataFrame:
    """spans (layer, file, uuid, start, end) -> one node for each id file@layer#Lline: id, file, layer, start_line, content (the first
    most_lines lines: a limit of the display), uuid (the smallest)."""
    touched = spans.select("layer", "file", "uuid", "start", F.greatest(F.col("start") + 1, "end").alias("end"))
    hit = spans_overlapping(touched, lines.select("layer", "file", "line", F.col("start").alias("o_start"), (F.col("end") + 1).alias("o_end")), ["layer", "file"])
    hit = hit.withColumn("k", F.row_number().over(Window.partitionBy("layer", "file", "uuid").orderBy("line"))).filter(F.col("k") <= most_lines)
    first = hit.groupBy("layer", "file", "uuid").agg(F.min("line").alias("start_line"))
    shown = first.groupBy("layer", "file", "start_line").agg(F.min("uuid").alias("uuid"))  # one link of each node, before any text is read
    hit = hit.join(shown, ["layer", "file", "uuid"], "left_semi").select("layer", "file", "uuid", "line").join(lines.select("layer", "file", "line", "text"), ["layer", "file", "line"])
    per = hit.groupBy("layer", "file", "uuid").agg(F.min("line").alias("start_line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"))
    content = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    return per.select(F.concat(F.col("file"), F.lit("@"), "layer", F.lit("#L"), F.col("start_line").cast("string")).alias("id"), "file", "layer", "start_line", content.alias("content"), "uuid")


def graph_edges(links: DataFrame) -> DataFrame:
    """links (a, b, uuid, state_a, state_b) -> one undirected edge for each pair of nodes and label (short uuid), with the worst state of each
    side; of states of one rank the greater name."""
    flip = F.col("a") > F.col("b")
    e = links.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.substring("uuid", 1, 8).alias("label"), "uuid", F.when(flip, F.col("state_b")).otherwise(F.col("state_a")).alias("s"), F.when(flip, F.col("state_a")).otherwise(F.col("state_b")).alias("t"))
    worst = lambda c: F.max(F.struct(rank(F.col(c)).alias("rank"), F.coalesce(c, F.lit("NONE")).alias("state")))["state"]
    return e.groupBy("source", "target", "label").agg(worst("s").alias("source_state"), worst("t").alias("target_state"))


def layer_edges(endpoints: DataFrame, states: DataFrame) -> DataFrame:
    """a, b, uuid, state_a, state_b for graph_edges(): the structural sides (side 0 first) of neighbouring records of a chain, each with the worse
    state of its record; states: layer, uuid, n, state."""
    node = endpoints.filter("kind = 'structural'").groupBy("layer", "uuid").agg(F.min_by(F.concat("file", F.lit("@"), "layer", F.lit("#L1")), "n").alias("id"))
    side = node.join(worst_state(states, "layer", "uuid"), ["layer", "uuid"])
    there = side.select(F.col("layer").alias("to_layer"), "uuid", F.col("id").alias("b"), F.col("worst").alias("state_b"))
    return graph_adjacency(endpoints).join(side, ["layer", "uuid"]).join(there, ["to_layer", "uuid"]).select(F.col("id").alias("a"), "b", "uuid", F.col("worst").alias("state_a"), "state_b")


def graph_bipartite(endpoints: DataFrame, adjacency: DataFrame) -> DataFrame:
    """type, source, target, label: edges from link nodes to file and task nodes (labels .0 and .1), dashed ones between records of a chain."""
    label = F.concat(F.lit("."), F.col("n").cast("string"))
    member = endpoints.filter("kind <> 'layer'").select(F.col("kind").alias("type"), node_id().alias("source"), F.when(F.col("kind") == "task", F.concat(F.lit("task "), "task_id")).otherwise(F.concat_ws("@", "file", "layer")).alias("target"), label.alias("label"))
    a, b = node_id(), node_id("uuid", "to_layer")
    chain = adjacency.select(F.lit("chain").alias("type"), F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), F.lit("dashed").alias("label")).distinct()
    return member.unionByName(chain)


def graph_layout(nodes: DataFrame) -> DataFrame:
    """nodes (id, file, layer, start_line) -> id, x (depth of the layer), y (row in the column, one more for each change of file), group."""
    tidy = lambda c: F.regexp_replace(c, "[/.-]", "_")
    n = nodes.withColumn("x", T.layer_depth(F.col("layer"))).withColumn("group", F.concat_ws("_", F.lit("fg"), tidy("file"), tidy("layer")))
    n = n.withColumn("dir", F.regexp_extract("file", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("file", "([^/]*)$", 1))
    folder = ["x", "layer", "dir"]
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    # rows within a file, files within a folder, folders within a column: each level sums up the one below
    files = n.groupBy(*folder, "name", "group").agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*folder).orderBy("name")
    files = files.withColumn("gap", zero(F.col("group") != F.lag("group").over(w)))
    files = files.withColumn("above", F.coalesce(F.sum(F.col("rows") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("gap"))
    folders = files.groupBy(*folder).agg(F.sum(F.col("rows") + F.col("gap")).alias("size"), F.min_by("group", "name").alias("first"), F.max_by("group", "name").alias("last"))
    w = Window.partitionBy("x").orderBy("layer", "dir")
    folders = folders.withColumn("gap", zero(F.col("first") != F.lag("last").over(w)))
    folders = folders.select(*folder, (F.sum(F.col("size") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy(*folder, "name").orderBy("start_line", "id")))
    n = n.join(files.select(*folder, "name", "above"), [*folder, "name"]).join(folders, folder)
    return n.select("id", "x", (F.col("begin") + F.col("above") + F.col("k") - 1).alias("y"), "group")
