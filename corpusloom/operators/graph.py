"""Dependency graphs as node and edge tables; ``keys`` name the graph that a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, lookup

MAX_NODES, MAX_EDGES = 120, 220  # what a drawn graph shows


def _all(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def in_degree(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, in_degree, centrality): in-degree over all other nodes; zero in graphs of one node."""
    n = _all(nodes, keys, F.count("*").alias("_n"))
    d = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = nodes.select(*keys, F.col("relative_path").alias("node")).join(d, [*keys, "node"], "left").fillna(0, ["in_degree"])
    out = lookup(out, n, keys) if keys else out.join(F.broadcast(n))
    return out.select(*keys, "node", "in_degree", F.when(F.col("_n") > 1, F.col("in_degree") / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of each edge once, without edges from a node to itself."""
    both = edges.select(*keys, "src", "dst").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def distances(edges: DataFrame, seeds: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, node, distance): steps from the nearest seed, along edges in either direction.

    One join a level.  The edges are spread by both ends, so a hub's lie in many
    tasks; a level's nodes are broadcast while they are few and otherwise
    repeated over salts.  A level is written to the shared folder, so lineage
    does not grow and lost executors cost one level.  Unreached nodes have no row.
    """
    und = cut(undirected(edges, keys).withColumnRenamed("src", "node"))
    seen = frontier = cut(seeds.select(*keys, "node").distinct().withColumn("distance", F.lit(0)))
    d = 0
    while most is None or d < most:
        d += 1
        step = lookup(und, frontier.select(*keys, "node"), [*keys, "node"], how="inner", salt="dst")
        step = step.select(*keys, F.col("dst").alias("node")).distinct().join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        frontier = cut(step.withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def seeds(scored: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """(keys, node): files with matches; in graphs without any, entry points by name, else the first scanned file."""
    best = F.max(F.when(F.col("lexical_score") > 0, 2).when(fallback, 1).otherwise(0))
    rank = F.when(F.col("lexical_score") > 0, 2).when(fallback, 1).otherwise(0)
    first = F.min_by("relative_path", F.struct("scan_ord", "relative_path"))
    per = _all(scored, keys, best.alias("_best"), first.alias("_first"))
    with_best = lookup(scored, per, keys) if keys else scored.join(F.broadcast(per))
    chosen = (rank == F.col("_best")) & ((F.col("_best") > 0) | (F.col("relative_path") == F.col("_first")))
    return with_best.where(chosen).select(*keys, F.col("relative_path").alias("node"))


def successors(edges: DataFrame, included: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """(keys, node, deps): the first ``most`` included files that each included file imports, in order of path."""
    inc = included.select(*keys, F.col("relative_path").alias("_p"))
    kept = edges.join(inc.withColumnRenamed("_p", "dst"), [*keys, "dst"], "left_semi").join(inc.withColumnRenamed("_p", "src"), [*keys, "src"], "left_semi")
    w = Window.partitionBy(*keys, "src").orderBy("dst")
    few = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return few.groupBy(*keys, F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("deps"))


def induced(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    n = nodes.select(*keys, F.col("relative_path").alias("_p")).distinct()
    return edges.join(n.withColumnRenamed("_p", "src"), [*keys, "src"], "left_semi").join(n.withColumnRenamed("_p", "dst"), [*keys, "dst"], "left_semi")


def total_degree(edges: DataFrame, keys: list[str]) -> DataFrame:
    ends = edges.select(*keys, F.col("src").alias("node")).unionByName(edges.select(*keys, F.col("dst").alias("node")))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def top_graph(ranked: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of one graph that a drawing shows: MAX_NODES best files, MAX_EDGES edges among them."""
    weight = F.when(F.col("priority") == "HIGH", 4).when(F.col("priority") == "MEDIUM", 2).when(F.col("priority") == "LOW", 1).otherwise(0)
    deg = total_degree(edges, [])
    nodes = ranked.join(deg, ranked["relative_path"] == deg["node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("weight", weight)
    nodes = nodes.select("relative_path", "priority", "importance_score", "degree", "weight").orderBy(F.desc("weight"), F.desc("importance_score"), F.desc("degree"), "relative_path").limit(MAX_NODES)
    return nodes, induced(edges, nodes, []).orderBy("src", "dst").limit(MAX_EDGES)


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, ``diagram``: a flow chart of a drawn graph (at most MAX_NODES nodes, MAX_EDGES edges)."""
    ids = nodes.withColumn("_id", F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("importance_score"), F.desc("degree"), "relative_path")) - 1)
    name = F.concat(F.lit("n"), F.col("_id").cast("string"))
    label = F.replace("relative_path", F.lit('"'), F.lit('\\"'))
    lines = ids.select(F.lit(1).alias("_s"), F.col("_id").cast("long").alias("_o"), F.concat(F.lit("  "), name, F.lit('["'), label, F.lit('"]:::'), F.lower("priority")).alias("line"))
    a = ids.select(F.col("relative_path").alias("src"), name.alias("_a"), F.col("_id").alias("_x"))
    b = ids.select(F.col("relative_path").alias("dst"), name.alias("_b"), F.col("_id").alias("_y"))
    arrows = edges.join(a, "src").join(b, "dst").select(F.lit(2).alias("_s"), (F.col("_x") * 1000 + F.col("_y")).cast("long").alias("_o"), F.concat(F.lit("  "), "_a", F.lit(" --> "), "_b").alias("line"))
    head = edges.sparkSession.range(1).select(F.lit(0).alias("_s"), F.lit(0).cast("long").alias("_o"), F.lit("flowchart LR").alias("line"))
    every = head.unionByName(lines).unionByName(arrows)
    return every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_o", "line"))), lambda x: x["line"]), "\n").alias("diagram"))


def file_tree(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, parent, name, depth, is_file, n_files): every folder and file once."""
    parts = F.split("relative_path", "/")
    p = files.select(*keys, "relative_path").distinct().withColumn("_p", parts)
    each = p.select(*keys, "relative_path", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    node = each.select(
        *keys,
        F.array_join(F.slice("_p", 1, F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("_p", 1, F.col("depth") - 1), "/").alias("parent"),
        F.element_at("_p", F.col("depth")).alias("name"),
        "depth",
        (F.col("depth") == F.size("_p")).alias("is_file"),
    )
    return node.groupBy(*keys, "path", "parent", "name", "depth").agg(F.bool_or("is_file").alias("is_file"), F.count("*").alias("n_files"))
