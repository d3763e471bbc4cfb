"""The table of all ancestors with their shortest paths, kept up to date as edges come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.operators.paths import ancestors
from rootspan.scratch import materialize, materialize_counted
from rootspan.sources.versions import KeyedTable

CLOSURE = "target string, node string, hops int, path array<string>"


def whole_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(target, node, hops, path)`` for every node of ``nodes`` (id): itself at 0 and its ancestors."""
    targets = nodes.select(F.col("id").alias("target")).where("target is not null").distinct()
    here = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("hops"), F.array("target").alias("path"))
    return here.unionByName(ancestors(edges, targets).withColumnRenamed("ancestor", "node"))


def closure_changes(closure: DataFrame, new_edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows of the closure that ``new_edges`` (source_id, target_id) add or better, semi-naive: work goes by what the edges touch.

    A better path runs over new edges. What lies below a new edge's end, joined with what lies above its start, gives all that use one of
    them; only rows that came out better are carried over further new edges, so there is a round for each new edge on a path. Better means
    fewer hops, then the smaller path, as in a full walk. Both ends of an edge must be targets of ``closure``.
    """
    links = new_edges.select(F.col("source_id").alias("up"), F.col("target_id").alias("node")).where("up is not null and node is not null and up <> node").distinct()
    links = materialize(links, "links")
    below = materialize(closure.join(links.select("node").distinct(), "node", "left_semi"), "below")
    found: DataFrame | None = None
    for _ in range(max_rounds):
        # parents over a new edge, and whatever is above them by what is known so far
        stepped = below.join(links, "node").select("target", "up", F.col("hops").alias("h"), F.col("path").alias("tail"))
        known = closure if found is None else _better(closure, found)
        heads = known.join(stepped.select(F.col("up").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("up"), "node", F.col("hops").alias("g"), F.col("path").alias("head"))
        made = stepped.join(heads, "up").where("node <> target").select("target", "node", (F.col("h") + 1 + F.col("g")).alias("hops"), F.concat("head", "tail").alias("path"))
        made = made.groupBy("target", "node").agg(F.min(F.struct("hops", "path")).alias("r")).select("target", "node", "r.*")
        old = known.join(made.select("target", "node"), ["target", "node"], "left_semi").select("target", "node", F.struct("hops", "path").alias("was"))
        better = made.join(old, ["target", "node"], "left").where("was is null or struct(hops, path) < was").drop("was")
        better, n = materialize_counted(better, "better")
        if not n:
            break
        found = better if found is None else materialize(_better(found, better), "found")
        below = materialize(better.join(links.select("node").distinct(), "node", "left_semi"), "below")
    else:
        raise RuntimeError(f"paths over new edges did not settle in {max_rounds} rounds")
    return closure.where("false") if found is None else found


def _better(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("target", "node", "hops", "path").unionByName(b.select("target", "node", "hops", "path"))
    return both.groupBy("target", "node").agg(F.min(F.struct("hops", "path")).alias("r")).select("target", "node", "r.*")


class ClosureTable:
    """The closure as a table on file, with the nodes it knows; additions write what they change."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 10):
        self.table = KeyedTable(spark, root, CLOSURE, ["target", "node"], "struct(hops, path)", parts)

    def read(self) -> DataFrame:
        return self.table.read()

    def start(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.table.upsert(whole_closure(nodes, edges), 0)
        self.table.compact()

    def add(self, batch_no: int, nodes: DataFrame, edges: DataFrame) -> None:
        """New nodes and edges; edges whose ends are no nodes, new or known, are left out. Batches count from 1."""
        known = self.read()
        fresh = nodes.select(F.col("id").alias("target")).where("target is not null").distinct().join(known.where("hops = 0").select("target"), "target", "left_anti")
        here = materialize(fresh.select("target", F.col("target").alias("node"), F.lit(0).alias("hops"), F.array("target").alias("path")), "fresh")
        grown = known.unionByName(here)
        own = grown.where("hops = 0")
        linked = edges.join(own.select(F.col("target").alias("source_id")), "source_id", "left_semi").join(own.select(F.col("target").alias("target_id")), "target_id", "left_semi")
        self.table.upsert(here.unionByName(closure_changes(grown, linked)), batch_no)
