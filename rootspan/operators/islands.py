"""Islands of a growing graph: labels as a table on file, only what an addition links is contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.operators.components import connected_components
from rootspan.scratch import materialize
from rootspan.sources.versions import KeyedTable


class IslandTable:
    """``(node, island)`` of all nodes added so far; island is the smallest node id of each.

    A node keeps the label it got first, which is its own id; a second table has the island of each label that is no longer one of its own. An
    addition looks up its edges' ends, contracts the graph of islands that they link, and writes new nodes and the labels whose island
    changes; no member of an island is written again.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 10):
        self.labels = KeyedTable(spark, f"{root}/labels", "node string", ["node"], "node", parts)
        self.roots = KeyedTable(spark, f"{root}/roots", "label string, island string, no long", ["label"], "-no", parts)

    def read(self) -> DataFrame:
        out = self.labels.read().join(self.roots.read().withColumnRenamed("label", "node"), "node", "left")
        return out.select("node", F.coalesce("island", "node").alias("island"))

    def add(self, batch_no: int, nodes: DataFrame, edges: DataFrame) -> None:
        """New nodes (id) and edges (source_id, target_id); known nodes stay, ends that are no nodes become such. Null ids are left out."""
        links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a is not null and b is not null").distinct()
        links = materialize(links, "links")
        ends = links.select(F.explode(F.array("a", "b")).alias("node"))
        fresh = nodes.select(F.col("id").alias("node")).where("node is not null").unionByName(ends).distinct()
        fresh = materialize(fresh.join(self.labels.read(), "node", "left_anti").select("node"), "fresh")
        roots = self.roots.read().select("label", "island")
        home = ends.distinct().join(roots.withColumnRenamed("label", "node"), "node", "left").select("node", F.coalesce("island", "node").alias("island"))
        home = materialize(home, "home")
        between = links.join(home.select(F.col("node").alias("a"), F.col("island").alias("u")), "a").join(home.select(F.col("node").alias("b"), F.col("island").alias("v")), "b")
        joined = connected_components(between.where("u <> v").select("u", "v"), "u", "v").where("node <> component")
        joined = materialize(joined.select(F.col("node").alias("island"), F.col("component").alias("next")), "joined")
        moved = roots.join(joined, "island").select("label", F.col("next").alias("island"))  # labels of islands that are swallowed
        moved = moved.unionByName(joined.select(F.col("island").alias("label"), F.col("next").alias("island")))
        moved = materialize(moved.withColumn("no", F.lit(batch_no).cast("long")), "moved")
        self.labels.upsert(fresh, batch_no)
        self.roots.upsert(moved, batch_no)
