"""Kubernetes pods and events, and policy states → nodes, edges, signals, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.functions.classify import lookup, slug
from rootspan.sources.inventory import make_edge, make_node

# Reasons and what they mean, with severity.
POD_SIGNALS = {
    "CrashLoopBackOff": ("CrashLoopBackOff", "critical"), "ImagePullBackOff": ("ImagePullError", "critical"), "ErrImagePull": ("ImagePullError", "critical"), "OOMKilled": ("OOMKilled", "critical"),
    "Error": ("PodError", "critical"), "CreateContainerConfigError": ("ConfigError", "critical"), "Pending": ("PodPending", "warning"), "Unknown": ("PodUnknown", "warning"),
}
EVENT_SIGNALS = {
    "Failed": ("PodFailed", "critical"), "FailedCreate": ("FailedCreate", "critical"), "FailedScheduling": ("SchedulingFailure", "warning"), "Unhealthy": ("HealthCheckFailed", "warning"),
    "BackOff": ("CrashLoopBackOff", "critical"), "FailedMount": ("VolumeMountFailure", "critical"), "FailedAttachVolume": ("VolumeMountFailure", "critical"), "OOMKilling": ("OOMKilled", "critical"),
    "Evicted": ("PodEviction", "warning"), "FailedGetContainerResourceMetric": ("MetricsUnavailable", "info"),
}
EVENT_MUTATIONS = {
    "Pulled": "ImagePull", "Created": "ContainerCreated", "Started": "ContainerStarted", "Killing": "ContainerStopping", "ScalingReplicaSet": "ScaleEvent",
    "SuccessfulCreate": "PodCreated", "SuccessfulDelete": "PodDeleted", "LeaderElection": "LeaderElection", "Scheduled": "PodScheduled",
}
_STATE = "struct<waiting:struct<reason:string>,terminated:struct<reason:string>>"
PODS = f"namespace string, metadata struct<name:string,ownerReferences:array<struct<name:string>>>, status struct<phase:string,conditions:array<struct<type:string,status:string>>,containerStatuses:array<struct<state:{_STATE},restartCount:long>>>"
EVENTS = "reason string, message string, type string, lastTimestamp string, metadata struct<namespace:string,creationTimestamp:string>, involvedObject struct<kind:string,name:string>"


def k8s_node_id(cluster: str, namespace: Column, kind: str | Column, name: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.concat(F.lit(f"k8s://{cluster}/"), namespace, F.lit("/"), kind, F.lit("/"), name)


def _looked_up(c: Column, values: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    return lookup(c, {k: v[0] for k, v in values.items()}, none), lookup(c, {k: v[1] for k, v in values.items()}, none)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def k8s_topology(namespaces: DataFrame, pods: DataFrame, cluster: str, cluster_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cluster → namespace → pod. namespaces: column name. With ``cluster_id`` the cluster is that cloud resource's node, which is not made here."""
    own = cluster_id.lower() if cluster_id else f"k8s://{cluster}"
    region, fixed = F.lit("kubernetes"), F.create_map(F.lit("source"), F.lit("k8s"))
    space = k8s_node_id(cluster, F.col("name"), "namespace", F.col("name"))
    top = namespaces.limit(0 if cluster_id else 1).select(*make_node(F.lit(own), F.lit(cluster), F.lit("AKSCluster"), region, F.create_map(F.lit("source"), F.lit("k8s"), F.lit("context"), F.lit(cluster))))
    spaces = namespaces.select(*make_node(space, F.col("name"), F.lit("KubernetesNamespace"), region, fixed))
    restarts = F.aggregate(F.coalesce("status.containerStatuses.restartCount", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    pod = k8s_node_id(cluster, F.col("namespace"), "pod", F.col("metadata.name"))
    properties = F.create_map(
        F.lit("source"), F.lit("k8s"), F.lit("phase"), F.coalesce("status.phase", F.lit("Unknown")), F.lit("restart_count"), _text(restarts), F.lit("namespace"), _text(F.col("namespace")),
        F.lit("owner"), F.coalesce(F.try_element_at("metadata.ownerReferences.name", F.lit(1)), F.lit("")),
    )
    nodes = top.unionByName(spaces).unionByName(pods.select(*make_node(pod, F.col("metadata.name"), F.lit("Container"), region, properties)))
    edges = namespaces.select(*make_edge(F.lit(own), space, "containment")).unionByName(pods.select(*make_edge(k8s_node_id(cluster, F.col("namespace"), "namespace", F.col("namespace")), pod, "containment")))
    return nodes, edges


def k8s_pod_signals(pods: DataFrame, cluster: str, as_of: Column) -> DataFrame:
    """A signal for each known reason a pod's containers wait or ended, and for pending pods that nothing was decided about."""
    own = k8s_node_id(cluster, F.col("namespace"), "pod", F.col("metadata.name"))
    statuses = F.coalesce("status.containerStatuses.state", F.array().cast(f"array<{_STATE}>"))
    reasons = F.flatten(F.transform(statuses, lambda s: F.array(s["waiting"]["reason"], s["terminated"]["reason"])))
    rows = pods.select(own.alias("node_id"), F.explode(reasons).alias("reason"))
    kind, severity = _looked_up(F.col("reason"), POD_SIGNALS)
    told = rows.select("node_id", kind.alias("signal_type"), severity.alias("severity"), as_of.alias("timestamp"), F.create_map(F.lit("reason"), "reason").alias("properties")).where("signal_type is not null")
    stuck = pods.where("status.phase = 'Pending' and coalesce(size(status.conditions), 0) <= 0")
    stuck = stuck.select(own.alias("node_id"), F.lit("PodPending").alias("signal_type"), F.lit("warning").alias("severity"), as_of.alias("timestamp"), F.create_map(F.lit("phase"), F.col("status.phase")).alias("properties"))
    return told.unionByName(stuck)


def k8s_events(events: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signals, mutations, nodes)`` of events with a known reason; nodes only for signals. Works on streams too."""
    kind = F.lower(F.coalesce("involvedObject.kind", F.lit("unknown")))
    namespace = F.coalesce("metadata.namespace", F.lit("default"))
    name = F.coalesce("involvedObject.name", F.lit("unknown"))
    at = F.try_to_timestamp(F.coalesce(F.nullif("lastTimestamp", F.lit("")), "metadata.creationTimestamp"))
    rows = events.select("reason", F.coalesce("message", F.lit("")).alias("message"), kind.alias("kind"), namespace.alias("namespace"), name.alias("name"), at.alias("timestamp"))
    rows = rows.withColumn("node_id", k8s_node_id(cluster, F.col("namespace"), F.col("kind"), F.col("name")))
    signal, severity = _looked_up(F.col("reason"), EVENT_SIGNALS)
    detail = lambda n: F.create_map(F.lit("reason"), "reason", F.lit("message"), F.left("message", F.lit(n)), F.lit("namespace"), "namespace", F.lit("kind"), "kind")
    signals = rows.select("node_id", signal.alias("signal_type"), severity.alias("severity"), "timestamp", detail(500).alias("properties"), "name", "kind", "namespace").where("signal_type is not null")
    cls = F.when(F.col("kind") == "pod", "Container").otherwise(F.initcap("kind"))
    nodes = signals.select(*make_node(F.col("node_id"), F.col("name"), cls, F.lit("kubernetes"), F.create_map(F.lit("source"), F.lit("k8s-watch"), F.lit("namespace"), "namespace")))
    change = lookup(F.col("reason"), EVENT_MUTATIONS, F.lit(None).cast("string"))
    changes = rows.where(signal.isNull()).select("node_id", change.alias("mutation_type"), F.lit("k8s-watch").alias("source"), "timestamp", detail(200).alias("properties")).where("mutation_type is not null")
    return signals.drop("name", "kind", "namespace"), changes, nodes


def policy_node_id(name: Column) -> Column:
    return F.concat(F.lit("policy://"), slug(name))


def policy_graph(states: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, signals, mutations)`` of the denied, non-compliant states (columns effect and complianceState, where present, are filtered on)."""
    for name, value in (("effect", "deny"), ("complianceState", "noncompliant")):
        if name in states.columns:
            states = states.where(F.lower(name) == value)
    rows = states.withColumn("policy", F.coalesce("policyAssignment", F.lit("unknown"))).withColumn("pid", policy_node_id(F.col("policy")))
    by = rows.groupBy("pid", "policy").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("resourceType")), ",").alias("types"))
    properties = F.create_map(F.lit("source"), F.lit("azure-policy"), F.lit("policy_assignment"), "policy", F.lit("resource_types"), "types", F.lit("violation_count"), F.col("n").cast("string"), F.lit("latent"), F.lit("true"))
    nodes = by.select(*make_node(F.col("pid"), F.concat(F.lit("Deny: "), "policy"), F.lit("DenyPolicy"), F.lit("azure-policy"), properties))
    pairs = rows.where("coalesce(resourceId, '') <> ''").groupBy("pid", "policy", "resourceId").agg(F.min_by("resourceType", F.struct("timestamp", "resourceType")).alias("resourceType"), F.min("timestamp").alias("timestamp"))
    edges = pairs.select(*make_edge(F.col("pid"), F.col("resourceId")))
    signals = pairs.select(
        F.col("resourceId").alias("node_id"), F.lit("PolicyViolation").alias("signal_type"), F.lit("warning").alias("severity"), F.try_to_timestamp("timestamp").alias("timestamp"),
        F.create_map(F.lit("policy"), "policy", F.lit("effect"), F.lit("deny"), F.lit("resource_type"), "resourceType", F.lit("source"), F.lit("azure-policy")).alias("properties"),
    )
    mutations = by.select(F.col("pid").alias("node_id"), F.lit("PolicyEnforcement").alias("mutation_type"), F.lit("azure-policy").alias("source"), as_of.alias("timestamp"), F.create_map(F.lit("policy_assignment"), "policy", F.lit("violation_count"), F.col("n").cast("string")).alias("properties"))
    return nodes, edges, signals, mutations
