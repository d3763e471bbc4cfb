"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbor, follows those pointers twice and
    contracts the edge table to edges between different trees, so stars vanish in one round and
    chains in a logarithmic number. All joins are between written tables with an exchange on each
    side, which lets adaptive execution split hubs; all groupings combine before they shuffle.

    Null ends are ignored; self loops keep their node. An empty edge table gives an empty result.
    """
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    base = materialize(base, "edges")
    work = base.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    work = materialize(work, "edges")
    labels = base.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = materialize(labels, "labels")
    for _ in range(max_rounds):
        if not work.take(1):
            return labels
        both = work.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent = materialize(parent, "parent")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = materialize(parent.join(up, "p").select("u", F.col("pp").alias("p")), "parent")
        left = parent.select("u", F.col("p").alias("a"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        half = materialize(work.join(left, "u").select("v", "a"), "edges")
        work = half.join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        work = materialize(work, "edges")
        labels = labels.join(parent.select(F.col("u").alias("component"), "p"), "component", "left")
        labels = materialize(labels.select("node", F.coalesce("p", "component").alias("component")), "labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
