"""Queries on the rarer branches of the library: ended containers, automatic links, connections, colors, kinds of causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootspan.operators import alerts as al
from rootspan.operators import graph, inference
from rootspan.plans.fixtures import ALL, NODES, TABLES, WEEK, as_of, ctes, inference_ctes, views
from rootspan.sources import inventory, kubernetes

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def customers(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_custkey", "k")


def _listed(values: list[str | None], index: str):
    """One of ``values`` by a number from 0."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.expr(index) + 1).cast("int"))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


REASONS = [*kubernetes.POD_SIGNALS, "Completed"]
SIGNALS, SEVERITIES = ([*(v[i] for v in kubernetes.POD_SIGNALS.values()), None] for i in (0, 1))


@query("b19_ended_containers", f"""WITH c AS (SELECT c_custkey AS k, concat('k8s://box/ns', c_nationkey, '/pod/p', c_custkey) AS pod FROM customer),
r AS (SELECT pod, k % 9 AS i FROM c WHERE k % 2 = 0 UNION ALL SELECT pod, (k + 3) % 9 FROM c WHERE k % 3 > 0 UNION ALL SELECT pod, (k + 5) % 9 FROM c WHERE k % 5 = 0)
SELECT pod AS node_id, {_sql_list(SIGNALS)}[i + 1] AS signal_type, {_sql_list(SEVERITIES)}[i + 1] AS severity FROM r WHERE i < 8""")
def b19_ended(spark, d):
    """Two containers a pod: the first waits, has ended, or both; the second has ended in every fifth pod."""
    none = F.lit(None).cast("string")
    state = lambda waiting, ended: F.struct(F.struct(F.struct(waiting.alias("reason")).alias("waiting"), F.struct(ended.alias("reason")).alias("terminated")).alias("state"), F.lit(0).cast("long").alias("restartCount"))
    first = state(F.when(F.expr("k % 2 = 0"), _listed(REASONS, "k % 9")), F.when(F.expr("k % 3 > 0"), _listed(REASONS, "(k + 3) % 9")))
    second = state(none, F.when(F.expr("k % 5 = 0"), _listed(REASONS, "(k + 5) % 9")))
    status = F.struct(F.lit("Running").alias("phase"), F.lit(None).cast("array<struct<type:string,status:string>>").alias("conditions"), F.array(first, second).alias("containerStatuses"))
    name = F.struct(F.expr("concat('p', k)").alias("name"), F.lit(None).cast("array<struct<name:string>>").alias("ownerReferences"))
    rows = customers(spark, d).select(F.expr("concat('ns', c_nationkey)").alias("namespace"), name.alias("metadata"), status.alias("status"))
    return kubernetes.k8s_pod_signals(rows, "box", F.lit("2024-01-01").cast("timestamp")).select("node_id", "signal_type", "severity")


@query("b10_private_endpoints", """WITH c AS (SELECT c_custkey AS k, concat('/pe/', c_custkey) AS own FROM customer)
SELECT concat('/net/', k % 7) AS source_id, own AS target_id, 'containment' AS edge_type FROM c UNION ALL SELECT own, concat('/auto/', k), 'dependency' FROM c WHERE k % 2 = 0
UNION ALL SELECT own, concat('/auto/more', k), 'dependency' FROM c WHERE k % 2 = 0 UNION ALL SELECT own, concat('/manual/', k), 'dependency' FROM c WHERE k % 3 = 0""")
def b10(spark, d):
    """Automatic connections on even endpoints, manual ones on every third, both on every sixth."""
    link = lambda text: F.struct(F.struct(F.expr(text).alias("privateLinkServiceId")).alias("properties"))
    parts = F.struct(
        F.struct(F.expr("concat('/Net/', k % 7, '/')").alias("id")).alias("subnet"), F.when(F.expr("k % 2 = 0"), F.array(link("concat('/Auto/', k)"), link("concat('/auto/more', k, '/')"))).alias("privateLinkServiceConnections"),
        F.when(F.expr("k % 3 = 0"), F.array(link("concat('/manual/', k)"))).alias("manualPrivateLinkServiceConnections"),
    )
    rows = customers(spark, d).select(F.expr("concat('/PE/', k)").alias("id"), F.lit("Microsoft.Network/privateEndpoints").alias("type"), parts.alias("properties"))
    return inventory.private_endpoint_edges(rows).select("source_id", "target_id", "edge_type")


CLASSES = [*graph.CLASS_COLORS, "Gateway", None]


@query("h6_every_color", f"""WITH c AS (SELECT c_custkey AS id, {_sql_list(CLASSES)}[CAST(c_custkey % 9 AS INT) + 1] AS class, {_sql_list([*graph.CLASS_COLORS.values(), "white", "white"])}[CAST(c_custkey % 9 AS INT) + 1] AS color FROM customer)
SELECT '  "' || id || '" [label="a \\"b\\" \\\\' || '\\n[' || coalesce(class, '') || ']" style=filled fillcolor="' || color || '"];' AS line FROM c
UNION ALL SELECT '  "' || id || '" -> "x" [style=' || ['solid', 'dashed', 'dotted', 'dashed'][CAST(id % 4 AS INT) + 1] || ' label="' || ['Containment', 'Dependency', 'Connection', 'Dependency'][CAST(id % 4 AS INT) + 1] || '"];' FROM c""")
def h6_colors(spark, d):
    """Every class that has a color, one that has none and none at all; labels with quotes; known and unknown types of edges."""
    c = customers(spark, d).selectExpr("cast(k as string) as id", "k")
    nodes = c.select("id", F.lit('a "b" \\').alias("label"), _listed(CLASSES, "k % 9").alias("class"))
    edges = c.select(F.col("id").alias("source_id"), F.lit("x").alias("target_id"), _listed(["containment", "dependency", "connection", "odd"], "k % 4").alias("edge_type"))
    return graph.dot_lines(nodes, edges)


@query("h9_connections", """WITH r AS (SELECT p_partkey AS k, concat('p', p_partkey) AS id FROM part),
e AS (SELECT concat('p', k + 1) AS source_id, id AS target_id, 'connection' AS edge_type FROM r WHERE k % 2 = 0 UNION ALL SELECT concat('route', k % 10), id, 'connection' FROM r WHERE k % 3 = 0
  UNION ALL SELECT 'env', id, 'containment' FROM r WHERE k % 5 = 0)
SELECT e.*, CASE WHEN source_id IN (SELECT id FROM r) THEN 'box' ELSE 'External' END AS source_class FROM e""")
def h9_connections(spark, d):
    """Connections to the next part and to routes, an environment, no dependencies; empty references are none."""
    near = F.filter(F.array(F.when(F.expr("k % 2 = 0"), F.expr("concat('p', k + 1)")), F.when(F.expr("k % 3 = 0"), F.expr("concat('route', k % 10)")).otherwise(F.when(F.expr("k % 7 = 0"), F.lit("")))), lambda x: x.isNotNull())
    rows = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_partkey", "k").select(
        F.expr("concat('p', k)").alias("id"), F.col("p_name").alias("name"), F.lit("app/box").alias("type"), F.lit("x").alias("location"), F.lit(None).cast("array<string>").alias("depends_on"), near.alias("connections"),
        F.lit(None).cast("string").alias("application"), F.when(F.expr("k % 5 = 0"), "env").alias("environment"),
    )
    nodes, edges = graph.template_graph(rows)
    return edges.join(nodes.select(F.col("id").alias("source_id"), F.col("class").alias("source_class")), "source_id").select("source_id", "target_id", "edge_type", "source_class")


#: Root causes of each kind, ``$k`` for a number, with their label and kind.
CAUSES = [
    ("latent://runner-env/linux (RunnerImageUpdate)", "linux", "runner"), ("latent://flaky-tests (FlakyTestRun)", "flaky-tests", "flaky"), ("latent://github-scorecard (Outage)", "github-scorecard", "security"), ("latent://github-automerge (Outage)", "github-automerge", "automerge"),
    ("latent://registry (Outage)", "registry", "infra"), ("commit://org/repo/abc$k (Revert)", "abc$k Revert", "code"), ("kv$k (SecretRotation)", "kv$k (SecretRotation)", "unknown"), (None, "unknown", "unknown"),
]


def _cause_sql(i: int) -> str:
    values = ["unknown" if c[i] is None else c[i] for c in CAUSES]
    return f"replace({_sql_list(values)}[CAST(c_custkey % 8 AS INT) + 1], '$k', CAST(c_nationkey AS VARCHAR))"


@query("g8_every_cause_type", f"""WITH a AS (SELECT {_cause_sql(0)} AS root_cause, {_cause_sql(2)} AS cause_type, 0.4 + (c_custkey % 60) / 100.0 AS confidence FROM customer)
SELECT root_cause, cause_type, round(max(confidence), 4) AS confidence, count(*) AS count FROM a GROUP BY ALL HAVING max(confidence) >= 0.9""")
def g8_causes(spark, d):
    """Alerts with causes of each kind; groups from a confidence of 0.9 on."""
    cause = F.replace(_listed([c[0] for c in CAUSES], "k % 8"), F.lit("$k"), F.col("c_nationkey").cast("string"))
    alerts = customers(spark, d).select(
        F.expr("concat('c', k)").alias("target_node"), F.expr("cast(0.4 + (k % 60) / 100.0 as double)").alias("confidence"), cause.alias("root_cause"), F.array(F.lit("x")).alias("causal_path"), F.array(F.lit("t")).alias("signal_types"),
        F.lit(1).cast("long").alias("n_signals"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit("normal").alias("action"),
    )
    return al.group_report(al.alert_groups(alerts), 0.9).select("root_cause", "cause_type", "confidence", "count")


#: Knowledge of the size of a real set of layers: 31 classes, up to nine entries each, from the table of parts.
CLASS = "concat('K', CAST(split_part(id, '/', 2) AS INT) % 31)"
MANY = {
    "nodes": f"SELECT id, label, {CLASS} AS class, region FROM ({NODES}) q",
    "cpts": """SELECT class, mutation, signal, max(present) AS p_present, min(absent) AS p_absent FROM (
  SELECT concat('K', p_partkey % 31) AS class, CASE p_partkey % 3 WHEN 0 THEN 'ImageUpdate' WHEN 1 THEN 'SecretRotation' ELSE 'CertificateRotation' END AS mutation,
    CASE p_size % 3 WHEN 0 THEN 'CrashLoopBackOff' WHEN 1 THEN 'AccessDenied_403' ELSE 'TLSError' END AS signal, 0.3e0 + (p_partkey % 60) / 100e0 AS present, 0.01e0 + (p_partkey % 7) / 100e0 AS absent FROM {part}) x GROUP BY class, mutation, signal""",
    "priors": "SELECT class, min(p) AS p_failure, max(h) AS half_life_min FROM (SELECT concat('K', p_partkey % 31) AS class, 0.001e0 + (p_partkey % 9) / 1000e0 AS p, 30e0 + (p_partkey % 12) * 60e0 AS h FROM {part}) x GROUP BY class",
}
MANY_SQL = "WITH RECURSIVE " + ",\n".join([f"{name} AS ({text.format(**{t: t for t in [*TABLES, 'part']})})" for name, text in (ALL | MANY).items()] + ["as_of AS (SELECT max(ts) AS t FROM events)"])


@query("f11_many_classes", inference_ctes(WEEK).replace(ctes(), MANY_SQL) + "SELECT target_node, round(confidence, 6) AS confidence, root_cause, causal_path, class FROM diagnoses")
def f11_many(spark, d):
    """Diagnoses with 31 classes of nodes instead of four, so most ways to score a change occur."""
    given = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in [*TABLES, "part"]}
    v = views(spark, d) | {name: spark.sql(text, **{t: df for t, df in given.items() if f"{{{t}}}" in text}) for name, text in MANY.items()}
    found = inference.diagnose_all(v["nodes"], v["edges"], v["mutations"], v["signals"], v["cpts"], v["priors"], as_of(v, spark, d), WEEK, None, competing=False)
    return found.select("target_node", F.round("confidence", 6).alias("confidence"), "root_cause", F.array_join("causal_path", ">").alias("causal_path"), "class")
