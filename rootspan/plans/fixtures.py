"""The causal graph that the registered queries work on, derived from the given tables.

The same text serves Spark (with DataFrames in the braces) and DuckDB (with table names), so a query
and its SQL start from the same rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]
WEEK = 7 * 24 * 3600

NODES = """
SELECT concat('region/', r_regionkey) AS id, r_name AS label, 'IdentityProvider' AS class, r_name AS region FROM {region}
UNION ALL SELECT concat('nation/', n_nationkey), n_name, 'Gateway', concat('r', n_regionkey) FROM {nation}
UNION ALL SELECT concat('supplier/', s_suppkey), s_name, 'KeyVault', concat('n', s_nationkey) FROM {supplier}
UNION ALL SELECT concat('customer/', c_custkey), c_name, 'Container', concat('n', c_nationkey) FROM {customer}"""
EDGES = """
SELECT concat(source_id, '>', target_id) AS id, source_id, target_id, edge_type FROM (
  SELECT concat('region/', n_regionkey) AS source_id, concat('nation/', n_nationkey) AS target_id, 'containment' AS edge_type FROM {nation}
  UNION ALL SELECT concat('nation/', s_nationkey), concat('supplier/', s_suppkey), 'containment' FROM {supplier}
  UNION ALL SELECT concat('nation/', c_nationkey), concat('customer/', c_custkey), 'containment' FROM {customer}
  UNION ALL SELECT DISTINCT concat('supplier/', l_suppkey), concat('customer/', o_custkey), 'connection' FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49) e"""
MUTATIONS = """
SELECT concat('m', event_id) AS id, concat('customer/', user_id) AS node_id, 'ImageUpdate' AS mutation_type, 'signup' AS source, ts AS timestamp FROM {events} WHERE event_type = 'signup'
UNION ALL SELECT concat('m', event_id), concat('supplier/', event_id % (SELECT count(*) FROM {supplier})), 'SecretRotation', 'purchase', ts FROM {events} WHERE event_type = 'purchase'
UNION ALL SELECT concat('m', event_id), concat('nation/', event_id % 25), 'CertificateRotation', 'click', ts FROM {events} WHERE event_type = 'click' AND value > 150"""
SIGNALS = """
SELECT concat('s', event_id) AS id, concat('customer/', user_id) AS node_id, CASE WHEN value < 25 THEN 'CrashLoopBackOff' WHEN value < 60 THEN 'AccessDenied_403' ELSE 'TLSError' END AS signal_type,
  value, CASE WHEN value < 25 THEN 'critical' ELSE 'warning' END AS severity, ts AS timestamp FROM {events} WHERE event_type = 'error'"""
CPTS = """
SELECT * FROM (VALUES
  ('Container', 'ImageUpdate', 'CrashLoopBackOff', 0.75e0, 0.03e0), ('Container', 'ImageUpdate', 'TLSError', 0.4e0, 0.05e0), ('Container', 'SecretRotation', 'AccessDenied_403', 0.6e0, 0.05e0),
  ('KeyVault', 'SecretRotation', 'AccessDenied_403', 0.8e0, 0.02e0), ('Gateway', 'CertificateRotation', 'TLSError', 0.85e0, 0.01e0), ('Gateway', 'CertificateRotation', 'AccessDenied_403', 0.3e0, 0.0e0),
  ('Container', 'CertificateRotation', 'TLSError', 0.5e0, 0.04e0), ('IdentityProvider', 'SecretRotation', 'AccessDenied_403', 0.9e0, 0.02e0)) AS t(class, mutation, signal, p_present, p_absent)"""
PRIORS = """
SELECT * FROM (VALUES ('Container', 0.005e0, 240e0), ('KeyVault', 0.001e0, 480e0), ('Gateway', 0.002e0, 720e0), ('IdentityProvider', 0.0005e0, 60e0)) AS t(class, p_failure, half_life_min)"""
ALL = {"nodes": NODES, "edges": EDGES, "mutations": MUTATIONS, "signals": SIGNALS, "cpts": CPTS, "priors": PRIORS}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, edges, mutations, signals, cpts, priors as DataFrames in the shared schemas."""
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    out = {name: spark.sql(text, **{t: df for t, df in given.items() if f"{{{t}}}" in text}) for name, text in ALL.items()}
    none = F.create_map().cast("map<string,string>")
    for name in ("mutations", "signals"):
        out[name] = out[name].withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out["signals"] = out["signals"].withColumn("properties", F.create_map(F.lit("source"), "severity"))
    out["nodes"] = out["nodes"].withColumn("rack_id", F.lit(None).cast("string")).withColumn("properties", none)
    return out


def as_of(v: dict[str, DataFrame], spark: SparkSession, sf_dir: str):
    """The time of the last event: one value."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).first()["t"]


@lru_cache(maxsize=1)
def ctes() -> str:
    """The views as common table expressions for DuckDB, with ``as_of``."""
    names = {t: t for t in TABLES}
    parts = [f"{name} AS ({text.format(**names)})" for name, text in ALL.items()]
    return "WITH RECURSIVE " + ",\n".join([*parts, "as_of AS (SELECT max(ts) AS t FROM events)"])


def inference_ctes(window_s: int, mutations: str = "true") -> str:
    """``ctes`` with the active events, closure, candidates (all of them), best and diagnoses, as plain SQL."""
    return f"""{ctes()},
muts AS (SELECT m.* FROM mutations m, as_of WHERE timestamp >= t - to_seconds({window_s}) AND {mutations}),
sigs AS (SELECT s.* FROM signals s, as_of WHERE timestamp >= t - to_seconds({window_s})),
ev AS (SELECT node_id, max(timestamp) AS latest, list_sort(list(DISTINCT signal_type)) AS types, count(*) AS n_signals FROM sigs GROUP BY node_id),
targets AS (SELECT ev.*, n.class FROM ev JOIN nodes n ON n.id = ev.node_id),
walk AS (
  SELECT node_id AS target, node_id AS node, 0 AS hops, [node_id] AS path FROM targets
  UNION ALL SELECT w.target, e.source_id, w.hops + 1, list_prepend(e.source_id, w.path) FROM walk w JOIN edges e ON e.target_id = w.node WHERE e.source_id <> w.target),
closure AS (SELECT target, node, hops, path FROM walk QUALIFY row_number() OVER (PARTITION BY target, node ORDER BY hops, path) = 1),
pairs AS (
  SELECT c.target, c.node, c.hops, c.path, m.id AS mutation_id, m.mutation_type, m.timestamp AS mutation_ts, n.class AS a_class, t.class AS t_class
  FROM closure c JOIN muts m ON m.node_id = c.node JOIN nodes n ON n.id = c.node JOIN targets t ON t.node_id = c.target),
triples AS (
  SELECT node AS place, mutation_id, mutation_type, mutation_ts, a_class AS class FROM pairs UNION SELECT target, mutation_id, mutation_type, mutation_ts, a_class FROM pairs
  UNION SELECT target, mutation_id, mutation_type, mutation_ts, t_class FROM pairs),
matched AS (
  SELECT t.place, t.mutation_id, t.class, p.half_life_min, ev.latest,
    0.5 * exp(-ln(2.0) / p.half_life_min * (floor(greatest((epoch_us(ev.latest) - epoch_us(t.mutation_ts)) / 1000000.0, 0.0)) / 60.0)) AS prior,
    count(k.signal) AS n, product(CASE WHEN k.p_absent > 0 THEN k.p_present / k.p_absent ELSE 1.0 END) AS ratio, bool_or(k.p_absent <= 0) AS certain
  FROM triples t LEFT JOIN ev ON ev.node_id = t.place LEFT JOIN priors p ON p.class = t.class
  LEFT JOIN cpts k ON k.class = t.class AND k.mutation = t.mutation_type AND list_contains(ev.types, k.signal) GROUP BY ALL),
scores AS (
  SELECT place, mutation_id, class, CASE WHEN latest IS NULL OR half_life_min IS NULL THEN 0.0 WHEN n = 0 THEN 0.1 * prior WHEN certain THEN 1.0
    ELSE prior / (1 - prior) * ratio / (1 + prior / (1 - prior) * ratio) END AS s FROM matched),
candidates AS (
  SELECT p.*, p.node || ' (' || p.mutation_type || ')' AS cause,
    CASE WHEN hops = 0 THEN s3.s WHEN greatest(s1.s, s2.s, s3.s) <= 0 THEN 0.01 ELSE greatest(s1.s, s2.s, s3.s) * pow(0.92, hops) END AS confidence
  FROM pairs p JOIN scores s1 ON s1.place = p.node AND s1.mutation_id = p.mutation_id AND s1.class = p.a_class
  JOIN scores s2 ON s2.place = p.target AND s2.mutation_id = p.mutation_id AND s2.class = p.a_class JOIN scores s3 ON s3.place = p.target AND s3.mutation_id = p.mutation_id AND s3.class = p.t_class),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, hops, mutation_ts DESC, mutation_id) AS rank FROM candidates),
diagnoses AS (
  SELECT t.node_id AS target_node, coalesce(r.confidence, CASE WHEN (SELECT count(*) FROM muts) = 0 THEN coalesce(p.p_failure, 0.005) ELSE 0.0 END) AS confidence, r.cause AS root_cause,
    coalesce(array_to_string(r.path, '>'), '') AS causal_path, t.latest AS timestamp, t.n_signals, t.types AS signal_types, t.class
  FROM targets t LEFT JOIN ranked r ON r.target = t.node_id AND r.rank = 1 LEFT JOIN priors p ON p.class = t.class)"""


#: Islands of the whole graph as plain SQL: every node hangs on one region by containment, so regions that other edges link decide.
ISLANDS = """,
tree AS (SELECT id AS node, id AS root FROM nodes WHERE class = 'IdentityProvider' UNION ALL SELECT e.target_id, t.root FROM tree t JOIN edges e ON e.source_id = t.node AND e.edge_type = 'containment'),
meets AS (SELECT DISTINCT a.root AS x, b.root AS y FROM edges e JOIN tree a ON a.node = e.source_id JOIN tree b ON b.node = e.target_id),
linked AS (SELECT x, y FROM meets UNION SELECT y, x FROM meets),
reach AS (SELECT root AS x, root AS y FROM (SELECT DISTINCT root FROM tree) UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y),
island AS (SELECT t.node, (SELECT min(u.node) FROM tree u JOIN reach r ON r.y = u.root WHERE r.x = t.root) AS island FROM tree t)"""
