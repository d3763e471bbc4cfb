"""Queries on topology sources (A, B) and streams (I), over inputs made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootspan.operators.inference import closure_for
from rootspan.operators.knowledge import merge_cpt_layers
from rootspan.plans.fixtures import WEEK, as_of, ctes, inference_ctes, views
from rootspan.scratch import materialize, scratch_path
from rootspan.sources import ci, inventory, io, kubernetes, stores, terraform
from rootspan.streaming import intake

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


KINDS = [
    ("Microsoft.Compute/virtualMachines", '{"networkProfile":{"networkInterfaces":[{"id":"/Subs/$1/"}]},"storageProfile":{"osDisk":{"managedDisk":{"id":"/subs/9$0"}},"dataDisks":[{"managedDisk":{"id":"/subs/$2"}}]},"availabilitySet":{"id":"/subs/$3"}}'),
    ("microsoft.network/networkInterfaces", '{"networkSecurityGroup":{"id":"/subs/$1"},"ipConfigurations":[{"properties":{"subnet":{"id":"/subs/$1/subnets/a"},"publicIPAddress":{"id":"/subs/$2"}}}]}'),
    ("microsoft.network/virtualNetworks", '{"subnets":[{"id":"/subs/$0/subnets/A","name":"a","properties":{"networkSecurityGroup":{"id":"/subs/$1"},"natGateway":{"id":"/subs/$2"}}}]}'),
    ("microsoft.containerservice/managedClusters", '{"agentPoolProfiles":[{"vnetSubnetID":"/subs/$8/subnets/a"}]}'),
    ("microsoft.network/loadBalancers", '{"frontendIPConfigurations":[{"properties":{"subnet":{"id":"/subs/$7/subnets/a"},"publicIPAddress":{"id":"/subs/$1"}}}],"backendAddressPools":[{"properties":{"backendIPConfigurations":[{"id":"/subs/$6/ipConfigurations/x"}]}}]}'),
    ("microsoft.network/applicationGateways", '{"gatewayIPConfigurations":[{"properties":{"subnet":{"id":"/subs/$6/subnets/a"}}}]}'),
    ("microsoft.network/privateEndpoints", '{"subnet":{"id":"/subs/$5/subnets/a"},"manualPrivateLinkServiceConnections":[{"properties":{"privateLinkServiceId":"/subs/$1"}}]}'),
    ("microsoft.sql/servers/databases", "{}"),
    ("contoso.things/odd", "{}"),
]


def resources(spark, d):
    """Customers as cloud resources of nine kinds; ``$k`` in a kind's properties is the customer number k further on."""
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as k", "c_name as name", "concat('n', c_nationkey) as n")
    kind, props = (F.element_at(F.array(*[F.lit(x[i]) for x in KINDS]), (F.col("k") % 9 + 1).cast("int")) for i in (0, 1))
    for step in range(9):
        props = F.replace(props, F.lit(f"${step}"), (F.col("k") + step).cast("string"))
    own = F.when(F.col("k") % 9 == 7, F.expr("concat('/Subs/', k + 1, '/databases/', k)")).otherwise(F.expr("concat('/Subs/', k, '/')"))
    identity = F.when(F.col("k") % 9 == 3, F.expr("map(concat('/subs/', k + 1), named_struct('principalId', 'x'))"))
    schema = inventory.PROPERTIES.replace(" struct", ":struct").replace(" array", ":array").replace(", ", ",")
    return rows.select(
        own.alias("id"), "name", kind.alias("type"), F.col("n").alias("location"), F.concat(F.lit("RG"), "n").alias("resourceGroup"), F.lit("sub").alias("subscriptionId"),
        F.from_json(props, f"struct<{schema}>").alias("properties"), F.struct(identity.alias("userAssignedIdentities")).alias("identity"),
    )


def _sub(step: int, tail: str = "") -> str:
    return f"concat('/subs/', k + {step}, '{tail}')"


EXPECTED = [
    (0, "own", _sub(1), "dependency"), (0, "own", "concat('/subs/9', k)", "dependency"), (0, "own", _sub(2), "dependency"), (0, _sub(3), "own", "containment"),
    (1, _sub(1), "own", "dependency"), (1, _sub(1, "/subnets/a"), "own", "containment"), (1, "own", _sub(2), "dependency"),
    (2, "own", "concat(own, '/subnets/a')", "containment"), (2, _sub(1), "concat(own, '/subnets/a')", "dependency"), (2, _sub(2), "concat(own, '/subnets/a')", "dependency"),
    (3, _sub(8, "/subnets/a"), "own", "containment"), (3, _sub(1), "own", "dependency"),
    (4, _sub(7, "/subnets/a"), "own", "containment"), (4, "own", _sub(1), "dependency"), (4, "own", _sub(6), "dependency"),
    (5, _sub(6, "/subnets/a"), "own", "containment"), (6, _sub(5, "/subnets/a"), "own", "containment"), (6, "own", _sub(1), "dependency"), (7, _sub(1), "own", "containment"),
]
RESOURCE_SQL = (
    "WITH r AS (SELECT c_custkey AS k, c_custkey % 9 AS kind, c_nationkey AS n, CASE WHEN c_custkey % 9 = 7 THEN concat('/subs/', c_custkey + 1, '/databases/', c_custkey) ELSE concat('/subs/', c_custkey) END AS own FROM customer),\n"
    + "e AS (" + " UNION ALL ".join(f"SELECT {s} AS source_id, {t} AS target_id, '{kind}' AS edge_type FROM r WHERE kind = {k}" for k, s, t, kind in EXPECTED)
    + " UNION ALL SELECT concat('/subscriptions/sub/resourcegroups/rgn', n), own, 'containment' FROM r),\n"
    + "nodes AS (SELECT own AS id FROM r UNION SELECT concat(own, '/subnets/a') FROM r WHERE kind = 2 UNION SELECT concat('/subscriptions/sub/resourcegroups/rgn', n) FROM r)\n"
)


@query("b1_b13_edges", RESOURCE_SQL + "SELECT DISTINCT source_id, target_id, edge_type, source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) AS kept FROM e")
def b13(spark, d):
    _, kept, dropped = inventory.build_graph(resources(spark, d))
    columns = ["source_id", "target_id", "edge_type"]
    return kept.select(*columns, F.lit(True).alias("kept")).unionByName(dropped.select(*columns, F.lit(False).alias("kept")))


@query("b13_last_node_wins", RESOURCE_SQL + """, cls AS (SELECT *, ['VirtualMachine', 'NetworkInterface', 'VirtualNetwork', 'AKSCluster', 'LoadBalancer', 'Gateway', 'PrivateEndpoint', 'SqlDatabase', 'Odd'][kind + 1] AS class FROM r)
SELECT own AS id, CASE WHEN k % 3 = 0 THEN concat('Aaa ', k) ELSE c_name END AS label, CASE WHEN k % 3 = 0 THEN 'Box' ELSE class END AS class, CASE WHEN k % 3 = 0 THEN 'a' ELSE concat('n', n) END AS region FROM cls JOIN customer ON c_custkey = k
UNION ALL SELECT concat(own, '/subnets/a'), 'a', 'Subnet', concat('n', n) FROM cls WHERE kind = 2
UNION ALL SELECT concat('/subscriptions/sub/resourcegroups/rgn', n), concat('RGn', n), 'ResourceGroup', concat('n', n) FROM r GROUP BY n""")
def b13_nodes(spark, d):
    """Every third resource stands twice; the second row, whose name and region come first in the alphabet, wins."""
    rows = resources(spark, d)
    again = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 = 0").selectExpr("c_custkey as k")
    own = F.when(F.col("k") % 9 == 7, F.expr("concat('/Subs/', k + 1, '/databases/', k)")).otherwise(F.expr("concat('/Subs/', k)"))
    none = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("resourceGroup", "subscriptionId", "properties", "identity")]
    again = again.select(own.alias("id"), F.expr("concat('Aaa ', k)").alias("name"), F.lit("x/box").alias("type"), F.lit("a").alias("location"), *none)
    nodes, _, _ = inventory.build_graph(rows.unionByName(again))
    return nodes.select("id", "label", "class", "region")


@query("b3_resource_types", RESOURCE_SQL + "SELECT own AS id FROM r WHERE kind IN (0, 8)")
def b3_types(spark, d):
    return inventory.filter_resources(resources(spark, d), types=["microsoft.compute/VIRTUALMACHINES", "Contoso.Things/Odd"]).select(inventory.arm_id(F.col("id")).alias("id"))


@query("b3_resource_nodes", RESOURCE_SQL + "SELECT own AS id, ['VirtualMachine', 'NetworkInterface', 'VirtualNetwork', 'AKSCluster', 'LoadBalancer', 'Gateway', 'PrivateEndpoint', 'SqlDatabase', 'Odd'][kind + 1] AS class, concat('n', n) AS region FROM r WHERE n IN (1, 2)")
def b3(spark, d):
    rows = inventory.filter_resources(resources(spark, d), groups=["rgN1", "rgn2"])
    return inventory.resource_nodes(rows).select("id", "class", "region")


def state(spark, d):
    """Suppliers as Terraform resources: subnets, network interfaces that point to them, associations, and dependencies by address."""
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k", "s_nationkey as n")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("azurerm_subnet", "azurerm_network_interface", "azurerm_subnet_route_table_association", "custom_new_thing")]), (F.col("k") % 4 + 1).cast("int"))
    attributes = F.expr("""map_filter(map('id', case when k % 4 = 0 then concat('/Net/', k) end, 'location', concat('n', n), 'subnet_id', case when k % 4 in (1, 2) then concat('/net/', k - k % 4) end,
      'route_table_id', case when k % 4 = 2 then concat('/net/', k - 2 + 4) end), (a, b) -> b is not null)""")
    instance = F.array(F.struct(F.when(F.col("k") % 4 == 3, "i").alias("index_key"), attributes.alias("attributes")))
    depends = F.expr("case when k % 4 = 1 then array(concat('custom_new_thing.r', k + 2), concat('module.m.azurerm_subnet.r', k - 1)) else cast(null as array<string>) end")
    module = F.expr("case when k % 8 = 0 then 'module.m' end")
    one = F.struct(F.lit("managed").alias("mode"), kind.alias("type"), module.alias("module"), F.concat(F.lit("r"), "k").alias("name"), depends.alias("depends_on"), instance.alias("instances"))
    return s.select(F.array(one).alias("resources"))


@query("b14_b17_terraform", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), node AS (SELECT k, CASE k % 4 WHEN 0 THEN concat('/net/', k) WHEN 1 THEN concat('tf://azurerm_network_interface.r', k) ELSE concat('tf://custom_new_thing.r', k, '[i]') END AS id FROM s WHERE k % 4 <> 2),
e AS (SELECT concat('/net/', k - 1) AS source_id, concat('tf://azurerm_network_interface.r', k) AS target_id FROM s WHERE k % 4 = 1 UNION SELECT concat('/net/', k + 2), concat('/net/', k - 2) FROM s WHERE k % 4 = 2)
SELECT 'node' AS kind, id AS a, CASE k % 4 WHEN 0 THEN 'Subnet' WHEN 1 THEN 'NetworkInterface' ELSE 'New_Thing' END AS b FROM node
UNION ALL SELECT CASE WHEN source_id IN (SELECT id FROM node) AND target_id IN (SELECT id FROM node) THEN 'edge' ELSE 'dangling' END, source_id, target_id FROM e""")
def b14(spark, d):
    nodes, edges, dropped = terraform.tf_graph(state(spark, d))
    pair = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("class").alias("b")).unionByName(pair(edges, "edge")).unionByName(pair(dropped, "dangling"))


@query("b14_last_instance_wins", "SELECT concat('/net/', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'late' ELSE concat('z', s_suppkey) END AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'azurerm_disk.a' ELSE concat('azurerm_subnet.r', s_suppkey) END AS address FROM supplier")
def b14_last(spark, d):
    """Every third id stands twice in a state; the later instance, whose address comes first in the alphabet, wins."""
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k")
    one = lambda kind, name, label: F.struct(F.lit("managed").alias("mode"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("module"), name.alias("name"), F.lit(None).cast("array<string>").alias("depends_on"), F.array(F.struct(F.lit(None).cast("string").alias("index_key"), F.create_map(F.lit("id"), F.expr("concat('/net/', k)"), F.lit("name"), label).alias("attributes"))).alias("instances"))
    rows = s.select(F.when(F.col("k") % 3 == 0, F.array(one("azurerm_subnet", F.expr("concat('r', k)"), F.expr("concat('z', k)")), one("azurerm_disk", F.lit("a"), F.lit("late")))).otherwise(F.array(one("azurerm_subnet", F.expr("concat('r', k)"), F.expr("concat('z', k)")))).alias("resources"))
    nodes, _, _ = terraform.tf_graph(rows)
    return nodes.select("id", "label", F.col("properties")["tf_address"].alias("address"))


@query("b16_resolved_modules", """WITH s AS (SELECT s_suppkey AS k FROM supplier), m AS (SELECT max(k) AS m FROM s)
SELECT concat('tf://custom_new_thing.r', k + 2, '[i]') AS source_id, concat('tf://azurerm_network_interface.r', k) AS target_id FROM s, m WHERE k % 4 = 1 AND k + 2 <= m
UNION ALL SELECT concat('/net/', k - 1), concat('tf://azurerm_network_interface.r', k) FROM s WHERE k % 4 = 1 AND (k - 1) % 8 = 0""")
def b16(spark, d):
    return terraform.tf_depends_on_edges(terraform.tf_instances(state(spark, d)), resolve_modules=True).select("source_id", "target_id")


def pods(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    reason = F.element_at(F.array(*[F.lit(x) for x in [*kubernetes.POD_SIGNALS, "Fine"]]), (F.col("c_custkey") % 9 + 1).cast("int"))
    status = F.struct(
        F.expr("case when c_custkey % 5 = 0 then 'Pending' else 'Running' end").alias("phase"), F.expr("case when c_custkey % 2 = 0 then array(named_struct('type', 'a', 'status', 'b')) end").alias("conditions"),
        F.array(F.struct(F.struct(F.struct(reason.alias("reason")).alias("waiting"), F.struct(F.lit(None).cast("string").alias("reason")).alias("terminated")).alias("state"), F.col("c_custkey").alias("restartCount"))).alias("containerStatuses"),
    )
    return c.select(F.expr("concat('ns', c_nationkey)").alias("namespace"), F.struct(F.expr("concat('p', c_custkey)").alias("name"), F.expr("array(named_struct('name', 'rs'))").alias("ownerReferences")).alias("metadata"), status.alias("status"))


POD_REASONS = "[" + ", ".join(f"'{v[0]}'" for v in kubernetes.POD_SIGNALS.values()) + ", NULL]"


@query("b18_b19_kubernetes", f"""
WITH c AS (SELECT c_custkey AS k, concat('k8s://box/ns', c_nationkey, '/pod/p', c_custkey) AS pod, concat('k8s://box/ns', c_nationkey, '/namespace/ns', c_nationkey) AS ns FROM customer), n AS (SELECT concat('k8s://box/ns', n_nationkey, '/namespace/ns', n_nationkey) AS ns FROM nation)
SELECT 'edge' AS kind, '/cloud/box' AS a, ns AS b FROM n UNION ALL SELECT 'edge', ns, pod FROM c UNION ALL SELECT 'signal', pod, {POD_REASONS}[k % 9 + 1] FROM c WHERE {POD_REASONS}[k % 9 + 1] IS NOT NULL
UNION ALL SELECT 'signal', pod, 'PodPending' FROM c WHERE k % 5 = 0 AND k % 2 = 1""")
def b18(spark, d):
    p = pods(spark, d)
    spaces = spark.read.parquet(f"{d}/nation.parquet").selectExpr("concat('ns', n_nationkey) as name")
    _, edges = kubernetes.k8s_topology(spaces, p, "box", "/Cloud/Box")
    signals = kubernetes.k8s_pod_signals(p, "box", F.to_timestamp(F.lit("2024-01-01")))
    return edges.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(signals.select(F.lit("signal").alias("kind"), F.col("node_id").alias("a"), F.col("signal_type").alias("b")))


@query("b18_pod_nodes", """SELECT concat('k8s://box/ns', c_nationkey, '/pod/p', c_custkey) AS id, concat('p', c_custkey) AS label, 'Container' AS class, CASE WHEN c_custkey % 5 = 0 THEN 'Pending' ELSE 'Running' END AS phase, CAST(c_custkey AS VARCHAR) AS restart_count, 'rs' AS owner FROM customer
UNION ALL SELECT concat('k8s://box/ns', n_nationkey, '/namespace/ns', n_nationkey), concat('ns', n_nationkey), 'KubernetesNamespace', NULL, NULL, NULL FROM nation UNION ALL SELECT 'k8s://box', 'box', 'AKSCluster', NULL, NULL, NULL""")
def b18_nodes(spark, d):
    spaces = spark.read.parquet(f"{d}/nation.parquet").selectExpr("concat('ns', n_nationkey) as name")
    nodes, _ = kubernetes.k8s_topology(spaces, pods(spark, d), "box")
    prop = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return nodes.select("id", "label", "class", prop("phase"), prop("restart_count"), prop("owner"))


@query("c11_k8s_events", "WITH t AS (SELECT event_id, user_id, ['" + "', '".join([*kubernetes.EVENT_SIGNALS, *kubernetes.EVENT_MUTATIONS, "Other"]) + "'][event_id % 20 + 1] AS r FROM events) SELECT concat('k8s://box/default/pod/u', user_id) AS node_id, CASE r "
       + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in kubernetes.EVENT_SIGNALS.items()) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kubernetes.EVENT_MUTATIONS.items()) + " END AS event_type, count(*) AS n FROM t WHERE r <> 'Other' GROUP BY ALL")
def c11(spark, d):
    reason = F.element_at(F.array(*[F.lit(x) for x in [*kubernetes.EVENT_SIGNALS, *kubernetes.EVENT_MUTATIONS, "Other"]]), (F.col("event_id") % 20 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(reason.alias("reason"), F.lit("m").alias("message"), F.lit("").alias("lastTimestamp"), F.struct(F.lit(None).cast("string").alias("namespace"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"), F.struct(F.lit("Pod").alias("kind"), F.expr("concat('u', user_id)").alias("name")).alias("involvedObject"))
    signals, changes, _ = kubernetes.k8s_events(rows, "box")
    both = signals.select("node_id", F.col("signal_type").alias("event_type")).unionByName(changes.select("node_id", F.col("mutation_type").alias("event_type")))
    return both.groupBy("node_id", "event_type").agg(F.count("*").alias("n"))


@query("b20_policy_graph", """WITH t AS (SELECT concat('Deny Thing ', o_custkey % 7) AS p, concat('/r/', o_custkey) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT concat('policy://deny-thing-', right(p, 1)) AS policy, r AS resource, (SELECT count(*) FROM t u WHERE u.p = t.p) AS violations FROM t GROUP BY p, r""")
def b20(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('/r/', o_custkey) as resourceId", "o_orderpriority as resourceType", "concat('Deny Thing ', o_custkey % 7) as policyAssignment", "date_format(o_orderdate, 'yyyy-MM-dd') as timestamp", "case when o_orderstatus = 'F' then 'deny' else 'audit' end as effect")
    nodes, edges, _, _ = kubernetes.policy_graph(rows, F.to_timestamp(F.lit("2024-01-01")))
    counts = nodes.select(F.col("id").alias("source_id"), F.col("properties")["violation_count"].cast("long").alias("violations"))
    return edges.join(counts, "source_id").select(F.col("source_id").alias("policy"), F.col("target_id").alias("resource"), "violations")


POLICY = "t AS (SELECT concat('Deny Thing ', o_custkey % 7) AS p, concat('policy://deny-thing-', o_custkey % 7) AS pid, concat('/r/', o_custkey) AS r, o_orderpriority AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F')"


@query("b20_policy_events", f"""WITH {POLICY}
SELECT 'node' AS kind, pid AS a, 'Deny: ' || p AS b, 'DenyPolicy' AS c, array_to_string(list_sort(list(DISTINCT k)), ',') AS d, CAST(NULL AS TIMESTAMP) AS at FROM t GROUP BY p, pid
UNION ALL SELECT 'mutation', pid, 'PolicyEnforcement', CAST(count(*) AS VARCHAR), p, TIMESTAMP '2024-01-01' FROM t GROUP BY p, pid
UNION ALL SELECT 'signal', r, 'PolicyViolation', p, arg_min(k, day || k), CAST(min(day) AS TIMESTAMP) FROM t GROUP BY p, r""")
def b20_events(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('/r/', o_custkey) as resourceId", "o_orderpriority as resourceType", "concat('Deny Thing ', o_custkey % 7) as policyAssignment", "date_format(o_orderdate, 'yyyy-MM-dd') as timestamp", "case when o_orderstatus = 'F' then 'deny' else 'audit' end as effect")
    nodes, _, signals, mutations = kubernetes.policy_graph(rows, F.to_timestamp(F.lit("2024-01-01")))
    prop, at = lambda k: F.col("properties")[k], F.col("timestamp").cast("timestamp_ntz").alias("at")
    out = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("class").alias("c"), prop("resource_types").alias("d"), F.lit(None).cast("timestamp_ntz").alias("at"))
    out = out.unionByName(mutations.select(F.lit("mutation").alias("kind"), F.col("node_id").alias("a"), F.col("mutation_type").alias("b"), prop("violation_count").alias("c"), prop("policy_assignment").alias("d"), at))
    return out.unionByName(signals.select(F.lit("signal").alias("kind"), F.col("node_id").alias("a"), F.col("signal_type").alias("b"), prop("policy").alias("c"), prop("resource_type").alias("d"), at))


def ci_inputs(spark, d):
    from rootspan.plans.functions import runs

    o, j = runs(spark, d)
    log = spark.createDataFrame([], "run_id long, line_no long, line string")
    commits = o.select(F.col("headSha").alias("sha"), F.lit("Fix it").alias("message"), F.lit("someone").alias("author")).distinct()
    return o, j, log, commits


@query("b21_ci_graph", """
WITH b AS (SELECT o_orderkey AS k, left(md5(CAST(o_custkey AS VARCHAR)), 8) AS sha, o_orderpriority AS wf, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'),
j AS (SELECT l_orderkey, concat('job ', l_linenumber) AS n, l_returnflag, CASE WHEN l_tax > 0.04 THEN 'Run lint' ELSE 'Run E2E' END AS s FROM lineitem WHERE l_orderkey % 3 > 0),
f AS (SELECT k, sha, day, n, s FROM b JOIN j ON l_orderkey = k AND l_returnflag = 'R' UNION ALL SELECT k, sha, day, wf, '' FROM b WHERE k NOT IN (SELECT l_orderkey FROM j)),
c AS (SELECT *, CASE WHEN s = 'Run lint' THEN 'LintFailure' ELSE 'TestFailure' END AS t, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM f),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sha, slug, t ORDER BY day, k, n) = 1)
SELECT concat('commit://org/repo/', sha) AS source_id, concat('job://org/repo/', k, '/', slug) AS target_id FROM u UNION ALL SELECT 'latent://flaky-tests', concat('job://org/repo/', k, '/', slug) FROM u WHERE t = 'TestFailure'""")
def b21(spark, d):
    o, j, log, commits = ci_inputs(spark, d)
    return ci.ci_graph(o, j, log, commits, F.to_timestamp(F.lit("1996-01-01")))["edges"].select("source_id", "target_id")


CI_LOG = ["bash: foo: command not found", "AADSTS7000 denied", "connection refused: dial tcp 127.0.0.1", "nothing known"]


def ci_log(spark, d):
    """Two error lines for every second failed order; the first tells what failed."""
    picked = F.element_at(F.array(*[F.lit(x) for x in CI_LOG]), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 2 = 0 and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.concat(F.lit("x ##[error]"), picked).alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("##[error] second").alias("line")))).alias("l"))
    return rows.select("run_id", "l.*")


@query("b21_ci_events", f"""
WITH b AS (SELECT o_orderkey AS k, o_custkey, left(md5(CAST(o_custkey AS VARCHAR)), 8) AS sha, o_orderpriority AS wf, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN {'[' + ', '.join(f"'{x}'" for x in CI_LOG) + ']'}[o_custkey % 4 + 1] END AS err FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'),
j AS (SELECT l_orderkey, concat('job ', l_linenumber) AS n, l_returnflag, CASE WHEN l_tax > 0.04 THEN 'Run lint' ELSE 'Run E2E' END AS s FROM lineitem WHERE l_orderkey % 3 > 0),
f AS (SELECT k, sha, wf, day, err, n, s FROM b JOIN j ON l_orderkey = k AND l_returnflag = 'R' UNION ALL SELECT k, sha, wf, day, err, wf, '' FROM b WHERE k NOT IN (SELECT l_orderkey FROM j)),
c AS (SELECT *, CASE WHEN err LIKE 'AADSTS%' THEN 'AzureAuthFailure' WHEN err LIKE 'bash%' THEN 'CommandNotFound' WHEN err LIKE 'connection%' THEN 'GrpcConnectionRefused' WHEN s = 'Run lint' THEN 'LintFailure' ELSE 'TestFailure' END AS t,
  regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM f),
u AS (SELECT *, concat('job://org/repo/', k, '/', slug) AS job, concat('commit://org/repo/', sha) AS c_id, t IN ('AzureAuthFailure', 'CommandNotFound', 'GrpcConnectionRefused') AS infra FROM c QUALIFY row_number() OVER (PARTITION BY sha, slug, t ORDER BY day, k, n, s) = 1),
steps AS (SELECT *, CASE WHEN s = '' THEN '[]' ELSE '["' || s || '"]' END AS fs, CASE WHEN err IS NULL THEN '[]' ELSE '["' || err || '","second"]' END AS el FROM u)
SELECT 'signal' AS kind, job AS a, t AS b, fs || el AS c, CASE WHEN infra THEN NULL ELSE sha END AS d, CAST(day AS TIMESTAMP) AS at FROM steps
UNION ALL SELECT 'node', job, wf || ': ' || n, 'CIJob', fs, NULL FROM steps
UNION ALL SELECT 'node', c_id, sha || ': Fix it', 'Commit', NULL, NULL FROM u WHERE NOT infra GROUP BY c_id, sha
UNION ALL SELECT 'mutation', c_id, 'CodeChange', NULL, NULL, CAST(min(day) AS TIMESTAMP) FROM u WHERE NOT infra GROUP BY c_id
UNION ALL SELECT 'mutation', 'latent://flaky-tests', 'FlakyTestRun', NULL, NULL, CAST(day AS TIMESTAMP) FROM u WHERE t IN ('TestFailure', 'GrpcConnectionRefused')
UNION ALL SELECT 'mutation', 'latent://runner-env/linux', 'RunnerImageUpdate', NULL, NULL, CAST(day AS TIMESTAMP) FROM u WHERE t IN ('CommandNotFound', 'GrpcConnectionRefused')""")
def b21_events(spark, d):
    o, j, _, commits = ci_inputs(spark, d)
    t = ci.ci_graph(o, j, ci_log(spark, d), commits, F.to_timestamp(F.lit("1996-01-01")))
    none, at = F.lit(None).cast("string"), F.col("timestamp").cast("timestamp_ntz").alias("at")
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    out = t["signals"].select(F.lit("signal").alias("kind"), F.col("node_id").alias("a"), F.col("signal_type").alias("b"), F.concat(prop("failed_steps"), prop("error_lines")).alias("c"), prop("trigger_sha").alias("d"), at)
    out = out.unionByName(t["nodes"].where("id not like 'latent://%'").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("class").alias("c"), prop("failed_steps").alias("d"), F.lit(None).cast("timestamp_ntz").alias("at")))
    return out.unionByName(t["mutations"].select(F.lit("mutation").alias("kind"), F.col("node_id").alias("a"), F.col("mutation_type").alias("b"), none.alias("c"), none.alias("d"), at))


@query("b22_workflow_resources", """WITH w AS (SELECT o_orderkey, ['Release Radius', 'Purge Azure test resources', 'Other'][o_orderkey % 3 + 1] AS w FROM orders)
SELECT concat('j', o_orderkey) AS source_id, CASE w WHEN 'Release Radius' THEN '/subscriptions/s1/providers/microsoft.keyvault/vaults/radius-accounts' ELSE '/subscriptions/s1/resourcegroups/radiusfunctionaltest' END AS target_id FROM w WHERE w <> 'Other'""")
def b22(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('j', o_orderkey) as job", "element_at(array('Release Radius', 'Purge Azure test resources', 'Other'), cast(o_orderkey % 3 + 1 as int)) as workflowName")
    return ci.workflow_resource_edges(rows, spark.createDataFrame(ci.WORKFLOW_RESOURCES, "workflow string, resource string"), "S1").select("source_id", "target_id")


@query("a1_a3_payload_round_trip", ctes() + """SELECT 'node' AS kind, id, label AS a, class AS b, region AS c, concat('from ', id) AS note FROM nodes UNION ALL SELECT 'edge', id, source_id, target_id, edge_type, NULL FROM edges""")
def a1(spark, d):
    v = views(spark, d)
    path = scratch_path(spark, "payload")
    nodes = v["nodes"].withColumn("properties", F.create_map(F.lit("note"), F.concat(F.lit("from "), "id")))
    io.write_graph_payload(nodes, v["edges"], path, document_rows=500)
    nodes, edges = io.read_graph_payload(spark, path, lines=True)
    first = nodes.select(F.lit("node").alias("kind"), "id", F.col("label").alias("a"), F.col("class").alias("b"), F.col("region").alias("c"), F.col("properties")["note"].alias("note"))
    return first.unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_type").alias("c"), F.lit(None).cast("string").alias("note")))


FOUR = "SELECT 'node' AS kind, id, label AS a, class AS b, region AS c, CAST(NULL AS TIMESTAMP) AS at FROM nodes UNION ALL SELECT 'edge', id, source_id, target_id, edge_type, NULL FROM edges"


def four(t):
    """Rows of nodes, edges, signals and mutations as one table."""
    none = F.lit(None).cast("timestamp_ntz").alias("at")
    at = F.col("timestamp").cast("timestamp_ntz").alias("at")
    out = t["nodes"].select(F.lit("node").alias("kind"), "id", F.col("label").alias("a"), F.col("class").alias("b"), F.col("region").alias("c"), none)
    out = out.unionByName(t["edges"].select(F.lit("edge").alias("kind"), "id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_type").alias("c"), none))
    out = out.unionByName(t["signals"].select(F.lit("signal").alias("kind"), "id", F.col("node_id").alias("a"), F.col("signal_type").alias("b"), F.col("severity").alias("c"), at))
    return out.unionByName(t["mutations"].select(F.lit("mutation").alias("kind"), "id", F.col("node_id").alias("a"), F.col("mutation_type").alias("b"), F.col("source").alias("c"), at))


@query("a4_snapshot_round_trip", inference_ctes(WEEK) + FOUR + " UNION ALL SELECT 'signal', id, node_id, signal_type, severity, timestamp FROM sigs UNION ALL SELECT 'mutation', id, node_id, mutation_type, source, timestamp FROM muts")
def a4(spark, d):
    v = views(spark, d)
    path = scratch_path(spark, "snapshot")
    io.save_snapshot(v, path, as_of(v, spark, d), WEEK)
    return four(io.load_snapshot(spark, path))


@query("a2_event_store", ctes() + FOUR + " UNION ALL SELECT 'signal', id, node_id, signal_type, severity, timestamp FROM signals UNION ALL SELECT 'mutation', id, node_id, mutation_type, source, timestamp FROM mutations")
def a2(spark, d):
    """The tables written to a relational store in this JVM's memory and read back in ranges of time. Needs a local master."""
    v = views(spark, d)
    url = f"jdbc:derby:memory:{scratch_path(spark, 'store').rsplit('/', 1)[1]};create=true"
    for name in ("nodes", "edges", "signals", "mutations"):
        table = materialize(v[name].select(*[c for c, t in v[name].dtypes if not t.startswith("map")]), name)
        table.write.format("jdbc").option("url", url).option("dbtable", name).option("createTableColumnTypes", "id VARCHAR(200)").save()
    return four(stores.read_event_store(spark, url, 4))


def files_of(spark, rows, name: str) -> str:
    """Folder of one text file for each (name, text) row; the rows are few and small, as configuration is."""
    path = scratch_path(spark, name)
    for file, text in rows:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{file}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(text.encode()))
        out.close()
    return path


@query("a6_knowledge_layers", """WITH l AS (SELECT 0 AS layer, n_name AS class, 0.01e0 * (n_nationkey + 1) AS p, 30e0 AS half, concat('m', n_nationkey % 3) AS mutation, 0.5e0 AS present FROM nation UNION ALL SELECT 1, r_name, 0.2e0, 5e0, 'm9', 0.9e0 FROM region
  UNION ALL SELECT 1, n_name, 0.5e0, 7e0, concat('m', n_nationkey % 3), 0.75e0 FROM nation WHERE n_nationkey < 5)
SELECT class, mutation, 's' AS signal, present AS p_present, 0.1e0 AS p_absent, p AS p_failure, half AS half_life_min FROM l QUALIFY row_number() OVER (PARTITION BY class ORDER BY layer DESC) = 1""")
def a6(spark, d):
    entry = lambda c, p, half, m, present: f"- class: {c}\n  default_prior: {{P_failure: {p}, decay_half_life_minutes: {half}}}\n  cpts:\n    - {{mutation: {m}, signal: s, table: [[{present}, 0.1], [{1 - present}, 0.9]]}}\n"
    nations = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    regions = spark.read.parquet(f"{d}/region.parquet").select("r_name").collect()  # 5 rows
    base = "".join(entry(r.n_name, 0.01 * (r.n_nationkey + 1), 30, f"m{r.n_nationkey % 3}", 0.5) for r in nations)
    more = "".join(entry(r.r_name, 0.2, 5, "m9", 0.9) for r in regions) + "".join(entry(r.n_name, 0.5, 7, f"m{r.n_nationkey % 3}", 0.75) for r in nations if r.n_nationkey < 5)
    manifest = "layers:\n  - path: base.yaml\n  - path: gone.yaml\n    optional: true\n  - path: more.yaml\n"
    path = files_of(spark, [("manifest.yaml", manifest), ("base.yaml", base), ("more.yaml", more)], "layers")
    cpts, priors = merge_cpt_layers(io.load_cpt_layers(spark, f"{path}/manifest.yaml"))
    return cpts.join(priors, "class")


@query("a7_alert_rules", "SELECT CAST(r_regionkey AS INT) AS rule_no, r_name AS class, 'low' AS action, concat('why ', r_regionkey) AS reason, CASE WHEN r_regionkey % 2 = 0 THEN 0.5e0 END AS min_confidence FROM region")
def a7(spark, d):
    regions = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()  # 5 rows
    text = "rules:\n" + "".join(f"  - {{class: {r.r_name}, action: low, reason: why {r.r_regionkey}{', min_confidence: 0.5' if r.r_regionkey % 2 == 0 else ''}}}\n" for r in regions)
    return io.load_alert_rules(spark, files_of(spark, [("rules.yaml", text)], "rules") + "/rules.yaml").select("rule_no", "class", "action", "reason", "min_confidence")


@query("a8_write_report", "WITH t AS (SELECT concat('c', o_custkey) AS node, list_sort(list(DISTINCT o_orderpriority)) AS kinds, count(*) AS n FROM orders GROUP BY o_custkey) SELECT l.layout, node, CASE WHEN l.layout = 'csv' THEN '[\"' || array_to_string(kinds, '\",\"') || '\"]' ELSE array_to_string(kinds, ';') END AS kinds, n FROM t, (VALUES ('csv'), ('json'), ('parquet')) l(layout)")
def a8(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.expr("concat('c', o_custkey)").alias("node")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("kinds"), F.count("*").alias("n"))
    path, out = scratch_path(spark, "report"), []
    for layout in ("csv", "json", "parquet"):
        io.write_report(t, f"{path}/{layout}", layout)
        rows = spark.read.format(layout).option("header", "true").option("escape", "\"" if layout == "csv" else "\\").load(f"{path}/{layout}") if layout != "csv" else spark.read.option("header", "true").csv(f"{path}/{layout}")
        kinds = F.col("kinds") if layout == "csv" else F.array_join("kinds", ";")
        out.append(rows.select(F.lit(layout).alias("layout"), "node", kinds.alias("kinds"), F.col("n").cast("long").alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a5_normalize_events", "SELECT concat('s', event_id) AS id, concat('u', user_id) AS node_id, CASE WHEN event_id % 3 = 0 THEN 'api' ELSE event_type END AS source, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-06-01' ELSE date_trunc('second', ts) END AS timestamp FROM events")
def a5(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("concat('s', event_id) as id", "concat('u', user_id) as node_id", "'x' as mutation_type", "case when event_id % 3 > 0 then event_type end as source", "case when event_id % 10 = 0 then 'never' when event_id % 5 > 0 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') end as timestamp")
    return io.normalize_events(rows, "mutations", F.to_timestamp(F.lit("2024-06-01"))).select("id", "node_id", "source", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def run_stream(spark, df, name: str):
    """What a stream gives once it has read all there is, as a table in the shared folder."""
    out = scratch_path(spark, name)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", intake.checkpoint_path(spark, name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def landed(spark, df, name: str):
    """A stream over a folder that ``df`` was written to."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("i3_stream_ci_jobs", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'golangci' ELSE 'make' END AS s FROM documents)
SELECT concat('job://org/repo/', doc_id, '/build') AS node_id, CASE WHEN s = 'golangci' THEN 'LintFailure' ELSE 'TestFailure' END AS signal_type FROM t""")
def i3(spark, d):
    body = F.to_json(F.struct(F.lit("completed").alias("action"), F.struct(F.lit("org/repo").alias("full_name")).alias("repository"), F.struct(
        F.col("doc_id").alias("run_id"), F.lit("build").alias("name"), F.lit("abc").alias("head_sha"), F.lit("2024-01-01T00:00:00Z").alias("completed_at"), F.lit("failure").alias("conclusion"),
        F.array(F.struct(F.expr("case when doc_id % 2 = 0 then 'golangci' else 'make' end").alias("name"), F.lit("failure").alias("conclusion"))).alias("steps")).alias("workflow_job")))
    payloads = spark.read.parquet(f"{d}/documents.parquet").select(body.alias("value"))
    return run_stream(spark, intake.stream_ci_jobs(landed(spark, payloads, "payloads")), "jobs").select("node_id", "signal_type")


@query("i4_stream_cloud_events", "SELECT concat('/r/', user_id) AS node_id, CASE WHEN event_type = 'error' THEN 'Degraded' ELSE 'ConfigChange' END AS event_type, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY ALL")
def i4(spark, d):
    value = F.expr("""to_json(array(named_struct('eventType', case when event_type in ('error', 'signup') then 'Microsoft.ResourceHealth.AvailabilityStatusChanged' else 'Microsoft.Resources.ResourceWriteSuccess' end, 'eventTime', '2024-01-01T00:00:00Z',
      'data', named_struct('resourceUri', concat('/R/', user_id), 'operationName', 'X/write', 'resourceType', 'x', 'availabilityStatus', case when event_type = 'error' then 'Degraded' else 'Available' end))))""")
    payloads = spark.read.parquet(f"{d}/events.parquet").select(value.alias("value"))
    mutations, signals = intake.stream_cloud_events(landed(spark, payloads, "payloads"))
    both = run_stream(spark, mutations, "m").select("node_id", F.col("mutation_type").alias("event_type")).unionByName(run_stream(spark, signals, "s").select("node_id", F.col("signal_type").alias("event_type")))
    return both.groupBy("node_id", "event_type").agg(F.count("*").alias("n"))


@query("i8_stream_candidates", ctes() + """, walk AS (SELECT DISTINCT node_id AS target, node_id AS node, 0 AS hops FROM signals JOIN nodes ON nodes.id = node_id UNION SELECT w.target, e.source_id, w.hops + 1 FROM walk w JOIN edges e ON e.target_id = w.node),
closure AS (SELECT target, node, min(hops) AS hops FROM walk GROUP BY ALL)
SELECT s.id AS signal_id, m.id AS mutation_id, c.hops FROM signals s JOIN closure c ON c.target = s.node_id JOIN mutations m ON m.node_id = c.node AND m.timestamp <= s.timestamp AND m.timestamp >= s.timestamp - to_seconds(86400)""")
def i8(spark, d):
    v = views(spark, d)
    targets = v["signals"].select(F.col("node_id").alias("target")).join(v["nodes"].select(F.col("id").alias("target")), "target").distinct()
    closure = closure_for(v["edges"], targets, v["mutations"])
    signals = landed(spark, v["signals"].select("id", "node_id", "signal_type", "timestamp"), "signals")
    mutations = landed(spark, v["mutations"].select("id", "node_id", "mutation_type", "timestamp"), "mutations")
    return run_stream(spark, intake.stream_candidates(signals, mutations, closure), "candidates").select("signal_id", "mutation_id", "hops")


@query("i1_stream_events", """SELECT concat('s', event_id) AS id, concat('u', user_id) AS node_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS signal_type, CASE WHEN event_id % 3 > 0 THEN value END AS value, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS timestamp
FROM events WHERE event_id % 5 IN (0, 1, 2)""")
def i1(spark, d):
    """Inserts of three spellings (or none) count, updates and deletes don't."""
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("concat('s', event_id) as id", "concat('u', user_id) as node_id", "case when event_id % 4 > 0 then event_type end as signal_type", "case when event_id % 3 > 0 then value end as value", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "element_at(array('insert', 'I', cast(null as string), 'update', 'd'), cast(event_id % 5 + 1 as int)) as op")
    path = scratch_path(spark, "events")
    rows.write.json(path)
    out = run_stream(spark, intake.stream_events(spark, path, "signals"), "signals")
    return out.select("id", "node_id", "signal_type", "value", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


RUN_SQL = """WITH r AS (SELECT o_orderkey AS k, left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS sha, ['Unit Tests', 'Scorecard analysis', 'Build'][o_orderkey % 3 + 1] AS wf FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT *, CASE wf WHEN 'Unit Tests' THEN 'UnitTestFailure' WHEN 'Scorecard analysis' THEN 'ScorecardFailure' ELSE 'TestFailure' END AS s, concat('job://org/repo/', k, '/', replace(lower(wf), ' ', '-')) AS job, concat('commit://org/repo/', sha) AS c FROM r)
"""


@query("i2_stream_ci_runs", RUN_SQL + """SELECT 'node' AS kind, job AS a, wf AS b, 'CIJob' AS c FROM t UNION ALL SELECT DISTINCT 'node', c, sha || ': Change things', 'Commit' FROM t WHERE s <> 'ScorecardFailure'
UNION ALL SELECT 'edge', CASE WHEN s = 'ScorecardFailure' THEN 'latent://github-scorecard' ELSE c END, job, 'dependency' FROM t UNION ALL SELECT 'edge', 'latent://flaky-tests', job, 'dependency' FROM t WHERE s <> 'ScorecardFailure'
UNION ALL SELECT 'mutation', c, 'CodeChange', 'gh-webhook/org/repo' FROM t WHERE s <> 'ScorecardFailure' UNION ALL SELECT 'mutation', 'latent://flaky-tests', 'FlakyTestRun', 'gh-webhook/org/repo' FROM t WHERE s <> 'ScorecardFailure'
UNION ALL SELECT 'signal', job, s, 'critical' FROM t""")
def i2(spark, d):
    run = F.struct(F.col("o_orderkey").alias("id"), F.expr("element_at(array('Unit Tests', 'Scorecard analysis', 'Build'), cast(o_orderkey % 3 + 1 as int))").alias("name"), F.expr("md5(cast(cast(o_orderkey as string) as binary))").alias("head_sha"), F.lit("main").alias("head_branch"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-01T01:00:00Z").alias("updated_at"), F.expr("case when o_orderstatus = 'F' then 'failure' else 'success' end").alias("conclusion"), F.lit("push").alias("event"),
        F.struct(F.lit("Change things\nfor good").alias("message"), F.struct(F.lit("dev").alias("name")).alias("author")).alias("head_commit"))
    body = F.to_json(F.struct(F.lit("completed").alias("action"), F.struct(F.lit("org/repo").alias("full_name")).alias("repository"), run.alias("workflow_run")))
    payloads = spark.read.parquet(f"{d}/orders.parquet").select(body.alias("value"))
    root = scratch_path(spark, "runs")
    intake.write_tables(intake.stream_ci_runs(landed(spark, payloads, "payloads")), intake.ci_run_tables, root, intake.checkpoint_path(spark, "runs")).trigger(availableNow=True).start().awaitTermination()
    shape = {"nodes": ("id", "label", "class"), "edges": ("source_id", "target_id", "edge_type"), "mutations": ("node_id", "mutation_type", "source"), "signals": ("node_id", "signal_type", "severity")}
    parts = [spark.read.parquet(f"{root}/{name}").select(F.lit(name[:-1]).alias("kind"), *[F.col(c).alias(to) for c, to in zip(columns, "abc")]) for name, columns in shape.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("i5_stream_k8s_events", "WITH t AS (SELECT user_id, ['BackOff', 'Killing', 'Odd'][event_id % 3 + 1] AS r FROM events) SELECT 'signal' AS kind, concat('k8s://box/default/pod/u', user_id) AS node_id, count(*) AS n FROM t WHERE r = 'BackOff' GROUP BY ALL UNION ALL SELECT 'mutation', concat('k8s://box/default/pod/u', user_id), count(*) FROM t WHERE r = 'Killing' GROUP BY ALL UNION ALL SELECT 'node', concat('k8s://box/default/pod/u', user_id), count(*) FROM t WHERE r = 'BackOff' GROUP BY ALL")
def i5(spark, d):
    reason = F.element_at(F.array(*[F.lit(x) for x in ("BackOff", "Killing", "Odd")]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(reason.alias("reason"), F.lit("m").alias("message"), F.lit("").alias("lastTimestamp"), F.struct(F.lit(None).cast("string").alias("namespace"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"), F.struct(F.lit("Pod").alias("kind"), F.expr("concat('u', user_id)").alias("name")).alias("involvedObject"))
    signals, mutations, nodes = intake.stream_k8s_events(landed(spark, rows, "k8s"), "box")
    parts = [run_stream(spark, df, kind).select(F.lit(kind).alias("kind"), F.col(c).alias("node_id")) for kind, df, c in (("signal", signals, "node_id"), ("mutation", mutations, "node_id"), ("node", nodes, "id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "node_id").agg(F.count("*").alias("n"))


@query("i6_stream_webhooks", """SELECT 'mutation' AS kind, concat('n', o_custkey) AS node_id, 'Deploy' AS type, 'radius' AS c, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT 'signal', concat('n', o_custkey), 'cpu', CASE WHEN o_orderkey % 2 = 0 THEN 'critical' ELSE 'warning' END, CAST(o_orderdate AS TIMESTAMP) FROM orders""")
def i6(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    deploys = rows.selectExpr("to_json(named_struct('target_node_id', case when o_orderkey % 3 > 0 then concat('n', o_custkey) end, 'mutation_type', 'Deploy', 'completed_at', day)) as value")
    fired = rows.selectExpr("to_json(named_struct('target_resource_id', concat('n', o_custkey), 'metric_name', 'cpu', 'metric_value', 1.5e0, 'severity', case when o_orderkey % 2 = 0 then 'critical' end, 'fired_at', day)) as value")
    m = run_stream(spark, intake.stream_deploys(landed(spark, deploys, "deploys")), "m")
    s = run_stream(spark, intake.stream_metric_alerts(landed(spark, fired, "alerts")), "s")
    at = F.col("timestamp").cast("timestamp_ntz").alias("at")
    return m.select(F.lit("mutation").alias("kind"), "node_id", F.col("mutation_type").alias("type"), F.col("source").alias("c"), at).unionByName(s.select(F.lit("signal").alias("kind"), "node_id", F.col("signal_type").alias("type"), F.col("severity").alias("c"), at))


#: Diagnoses at the time of the latest signal.
AT_LAST_SIGNAL = inference_ctes(WEEK).replace("SELECT max(ts) AS t FROM events)", "SELECT max(ts) AS t FROM events WHERE event_type = 'error')")
STREAMED = "SELECT target_node, round(confidence, 6) AS confidence, root_cause, causal_path, n_signals FROM diagnoses"


def streamed(spark, d, arriving: str):
    """Diagnoses of the nodes that the signals of ``arriving`` touch, when the others are in the tables."""
    v = views(spark, d)
    known = {name: materialize(v[name], name) for name in ("nodes", "edges", "mutations", "signals")} | {name: v[name] for name in ("cpts", "priors")}
    known["signals"] = known["signals"].where(f"not ({arriving})")
    out = scratch_path(spark, "diagnoses")
    stream = landed(spark, v["signals"].where(arriving), "signals")
    intake.stream_diagnose(stream, lambda: known, out, intake.checkpoint_path(spark, "diagnose"), WEEK).trigger(availableNow=True).start().awaitTermination()
    found = intake.latest_diagnoses(spark, out)
    return found.select("target_node", F.round("confidence", 6).alias("confidence"), "root_cause", F.array_join("causal_path", ">").alias("causal_path"), "n_signals")


@query("i7_stream_diagnose", AT_LAST_SIGNAL + STREAMED)
def i7(spark, d):
    return streamed(spark, d, "true")


@query("i9_late_signals", AT_LAST_SIGNAL + STREAMED + " WHERE target_node IN (SELECT node_id FROM signals WHERE CAST(substr(id, 2) AS BIGINT) % 7 = 0)")
def i9(spark, d):
    """Every seventh signal arrives late: those older than the window count no more, the younger ones do."""
    return streamed(spark, d, "cast(substr(id, 2) as bigint) % 7 = 0")
