"""Walks over the edge table: ancestors with shortest paths, reachability, neighborhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.scratch import materialize, materialize_counted


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(node, hops)``: everything downstream of ``seeds`` (column ``node``), the seeds included at 0."""
    step = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).where("next is not null")
    front, n = materialize_counted(seeds.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)), "front")
    seen, hops = front, 0
    while n and (max_hops is None or hops < max_hops):
        hops += 1
        new = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        front, n = materialize_counted(new.withColumn("hops", F.lit(hops)), "front")
        seen = seen.unionByName(front)
    return seen


def ancestors(edges: DataFrame, targets: DataFrame, within: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """``(target, ancestor, hops, path)`` for all ``targets`` (column ``target``) in one joint breadth-first walk.

    hops is the shortest distance, path the smallest array of node ids among the shortest paths, from
    ancestor to target. A target is never its own ancestor, not even on a cycle. within: an optional
    table (column ``node``) that walks must stay in, such as what lies downstream of any change.
    """
    step = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("parent")).where("parent is not null").distinct()
    if within is not None:
        step = step.join(within.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
    step = materialize(step, "steps")
    start = targets.select("target").where("target is not null").distinct()
    front, n = materialize_counted(start.select("target", F.col("target").alias("node"), F.array("target").alias("path")), "front")
    levels, hops = [], 0
    while n and (max_hops is None or hops < max_hops):
        hops += 1
        new = front.join(step, "node").where("parent <> target").select("target", F.col("parent").alias("node"), F.concat(F.array("parent"), "path").alias("path"))
        new = new.groupBy("target", "node").agg(F.min("path").alias("path"))
        if levels:  # all earlier levels in one join
            new = new.join(reduce(DataFrame.unionByName, [x.select("target", "node") for x in levels]), ["target", "node"], "left_anti")
        front, n = materialize_counted(new, "front")
        levels.append(front)
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "target string, ancestor string, hops int, path array<string>")
    return reduce(DataFrame.unionByName, [x.select("target", F.col("node").alias("ancestor"), F.lit(i + 1).alias("hops"), "path") for i, x in enumerate(levels)], empty)


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(source, target, path)`` for each distinct pair (columns source, target): one id if both are the same, empty if there is no way."""
    pairs = pairs.select("source", "target").where("source is not null and target is not null").distinct()
    found = ancestors(edges, pairs.select("target"), within=reachable(edges, pairs.select(F.col("source").alias("node"))))
    joined = pairs.join(found.select(F.col("ancestor").alias("source"), "target", "path"), ["source", "target"], "left")
    none = F.array().cast("array<string>")
    return joined.select("source", "target", F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.coalesce("path", none)).alias("path"))


def blast_radius(edges: DataFrame, sources: DataFrame, signaled: DataFrame) -> DataFrame:
    """``(source, downstream, signaled, share, max_hops)``: how far a change on each of ``sources`` (column source) can reach.

    signaled: nodes with symptoms (column node). share is null where nothing lies downstream.
    """
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    below = ancestors(back, sources.select(F.col("source").alias("target"))).select(F.col("target").alias("source"), F.col("ancestor").alias("node"), "hops")
    marked = below.join(signaled.select("node").distinct().withColumn("hit", F.lit(1)), "node", "left")
    counts = marked.groupBy("source").agg(F.count("*").alias("downstream"), F.count("hit").alias("signaled"), F.max("hops").alias("max_hops"))
    joined = sources.select("source").where("source is not null").distinct().join(counts, "source", "left")
    zero = F.lit(0).cast("long")
    out = joined.select("source", F.coalesce("downstream", zero).alias("downstream"), F.coalesce("signaled", zero).alias("signaled"), F.coalesce("max_hops", F.lit(0)).alias("max_hops"))
    return out.withColumn("share", F.try_divide(F.col("signaled").cast("double"), F.col("downstream")))


def first_children(links: DataFrame, front: DataFrame, seen: DataFrame, fanout: int) -> DataFrame:
    """``(seed, node, child)``: of each node of ``front`` (seed, node) its first children by ``place`` in ``links``, ``fanout`` and as many more as its seed has ``seen``.

    The first ``fanout`` new children are among them, however many children a node has.
    """
    met = seen.select("seed", F.col("node").alias("target_id")).join(links, "target_id").select("seed", F.col("source_id").alias("node"))
    known = front.select("seed", "node").join(met, ["seed", "node"]).groupBy("seed", "node").agg(F.count("*").alias("known"))
    asked = front.select("seed", "node").join(known, ["seed", "node"], "left").select("seed", "node", (F.coalesce("known", F.lit(0)) + fanout).cast("int").alias("places"))
    asked = asked.where("places > 0").select("seed", "node", F.explode(F.sequence(F.lit(1), "places")).alias("place"))
    return asked.join(links.select(F.col("source_id").alias("node"), "place", F.col("target_id").alias("child")), ["node", "place"]).select("seed", "node", "child")


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, fanout: int = 8, cap: int = 40) -> DataFrame:
    """``(seed, node, depth)`` around each of ``seeds`` (column node), both directions.

    Per level a node brings in all its parents and its ``fanout`` first children by id that are new;
    at most ``cap`` nodes a seed stay, by depth and then id. The limits are the feature.
    """
    links = edges.select("source_id", "target_id").where("source_id is not null and target_id is not null").distinct()
    links = materialize(links.selectExpr("source_id", "target_id", "row_number() over (partition by source_id order by target_id) as place"), "links")
    seen = materialize(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)), "near")
    front = seen
    for level in range(1, depth + 1):
        up = front.join(links, front["node"] == links["target_id"]).select("seed", F.col("source_id").alias("node"))
        down = first_children(links, front, seen, fanout)
        down = down.join(seen.select("seed", F.col("node").alias("child")), ["seed", "child"], "left_anti")
        down = down.selectExpr("seed", "child as node", "row_number() over (partition by seed, node order by child) as k").where(F.col("k") <= fanout)
        new = up.unionByName(down.select("seed", "node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = materialize(new.withColumn("depth", F.lit(level)), "near")
        seen = seen.unionByName(front)
    ranked = seen.selectExpr("seed", "node", "depth", "row_number() over (partition by seed order by depth, node) as k")
    return ranked.where(F.col("k") <= cap).drop("k")


def inner_edges(edges: DataFrame, members: DataFrame, group: str = "seed") -> DataFrame:
    """``edges`` whose both ends belong to the same group of ``members`` (group, node)."""
    own = members.select(group, "node").distinct()
    first = edges.join(own.withColumnRenamed("node", "source_id"), "source_id")
    return first.join(own.withColumnRenamed("node", "target_id"), [group, "target_id"], "left_semi").select(group, *edges.columns)
