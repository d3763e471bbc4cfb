"""Queries on what is kept up to date by additions: keyed diagnoses (I7), the closure (F3), islands (H1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.operators.closure import ClosureTable, whole_closure
from rootspan.operators.islands import IslandTable
from rootspan.plans.causes import case_ctes
from rootspan.plans.fixtures import ISLANDS, WEEK, ctes, views
from rootspan.scratch import materialize, scratch_path
from rootspan.streaming import keyed
from rootspan.streaming.intake import checkpoint_path

QUERIES, ORACLES = {}, {}
PARTS = 3


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


BATCH = "CAST(floor(3.0 * (epoch_us(timestamp) - lo) / (hi - lo + 1)) AS INT)"
BATCHED = f"""{ctes()},
span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
mb AS (SELECT m.*, {BATCH} AS b FROM mutations m, span), sb AS (SELECT s.*, {BATCH} AS b FROM signals s, span),
tops AS (SELECT x.b, max(s.timestamp) AS seen_at FROM (SELECT DISTINCT b FROM sb) x JOIN sb s ON s.b <= x.b GROUP BY x.b),"""
TOUCHED = "SELECT DISTINCT concat(s.node_id, '@', s.b) AS signal_id, s.node_id AS target, n.class AS t_class, t.seen_at, s.b FROM sb s JOIN nodes n ON n.id = s.node_id JOIN tops t ON t.b = s.b " \
    f"WHERE EXISTS (SELECT 1 FROM sb x WHERE x.node_id = s.node_id AND x.b <= s.b AND x.timestamp >= t.seen_at - to_seconds({WEEK}))"


def _by_batch(event: str, case: str) -> str:
    return f"{event}.b <= {case}.b AND {event}.timestamp >= {case}.seen_at - to_seconds({WEEK})"


@query("i7_keyed_state", f"""{BATCHED}{case_ctes(TOUCHED, _by_batch, "mb", "sb")}
SELECT c.target AS target_node, b.node || ' (' || b.mutation_type || ')' AS root_cause, coalesce(array_to_string(b.path, '>'), '') AS causal_path, CAST(c.b AS BIGINT) AS batch,
  round(coalesce(b.confidence, CASE WHEN EXISTS (SELECT 1 FROM mb m WHERE m.b <= c.b AND m.timestamp >= c.seen_at - to_seconds({WEEK})) THEN 0.0 ELSE p.p_failure END), 6) AS confidence
FROM (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY target ORDER BY b DESC) = 1) c LEFT JOIN best b USING (signal_id) LEFT JOIN priors p ON p.class = c.t_class""")
def i7_keyed(spark, d):
    """All events in three batches by time; a node's diagnosis is that of the last batch that touched it and left it a signal inside the window."""
    v = views(spark, d)
    span = spark.read.parquet(f"{d}/events.parquet").agg(F.min(F.col("ts").cast("timestamp")).alias("lo"), F.max(F.col("ts").cast("timestamp")).alias("hi")).first()  # one row
    lo, hi = (F.unix_micros(F.lit(span[k])) for k in ("lo", "hi"))
    batch = F.floor(F.lit(float(PARTS)) * (F.unix_micros("timestamp") - lo) / (hi - lo + 1)).cast("int")
    given = {name: materialize(v[name].withColumn("b", batch), name) for name in ("signals", "mutations")}
    nodes, closure = materialize(v["nodes"], "nodes"), materialize(whole_closure(v["nodes"], v["edges"]), "closure")
    roots = {name: scratch_path(spark, name) for name in given}
    out, checkpoint = keyed.diagnosis_table(spark, scratch_path(spark, "diagnoses")), checkpoint_path(spark, "keyed")
    keyed.keep_state_in_rocks_db(spark)
    batches: list[int] = []
    for b in range(PARTS):
        for name, df in given.items():
            df.where(F.col("b") == b).drop("b").write.mode("append").parquet(roots[name])
        streams = [spark.readStream.schema(given[name].drop("b").schema).parquet(roots[name]) for name in ("signals", "mutations")]
        run = keyed.keep_diagnoses(*streams, nodes, lambda: closure, v["cpts"], v["priors"], out, checkpoint, WEEK).trigger(availableNow=True).start()
        run.awaitTermination()
        batches.append(max((p["batchId"] for p in run.recentProgress), default=-1))
    number = F.when(F.col("batch_no") <= batches[0], 0).when(F.col("batch_no") <= batches[1], 1).otherwise(2).cast("long")
    return out.read().select("target_node", "root_cause", F.array_join("causal_path", ">").alias("causal_path"), number.alias("batch"), F.round("confidence", 6).alias("confidence"))


def _edge_parts(edges: DataFrame) -> list[DataFrame]:
    """Containment first, then the connections of even and of odd customers."""
    far = edges.where("edge_type <> 'containment'")
    odd = F.pmod(F.substring_index("target_id", "/", -1).cast("long"), F.lit(2))
    return [edges.where("edge_type = 'containment'"), far.where(odd == 0), far.where(odd == 1)]


@query("f3_closure_by_additions", ctes() + """,
walk AS (SELECT id AS target, id AS node, 0 AS hops, [id] AS path FROM nodes UNION ALL SELECT w.target, e.source_id, w.hops + 1, list_prepend(e.source_id, w.path) FROM walk w JOIN edges e ON e.target_id = w.node WHERE e.source_id <> w.target)
SELECT target, node, hops, array_to_string(path, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY target, node ORDER BY hops, path) = 1""")
def f3_additions(spark, d):
    v = views(spark, d)
    nodes, parts = materialize(v["nodes"], "nodes"), _edge_parts(materialize(v["edges"], "edges"))
    table = ClosureTable(spark, scratch_path(spark, "closure"))
    table.start(nodes, parts[0])
    for no, part in enumerate(parts[1:], 1):
        table.add(no, nodes.where("false"), part)
    return table.read().select("target", "node", "hops", F.array_join("path", ">").alias("path"))


@query("h1_islands_by_additions", ctes() + ISLANDS + " SELECT node, island FROM island")
def h1_additions(spark, d):
    """The graph nation by nation's edges: nodes with the containment edges in three additions, then the connections in two."""
    v = views(spark, d)
    nodes, parts = materialize(v["nodes"], "nodes"), _edge_parts(materialize(v["edges"], "edges"))
    table = IslandTable(spark, scratch_path(spark, "islands"))
    third = lambda c, k: F.pmod(F.xxhash64(c), F.lit(3)) == k
    for k in range(3):
        table.add(k, nodes if k == 0 else nodes.where("false"), parts[0].where(third("id", k)))
    table.add(3, nodes.where("false"), parts[1])
    table.add(4, nodes.where("false"), parts[2])
    return table.read()
