"""Failed CI runs → causal graph and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.functions.classify import classify_failure, commit_headline, commit_id, failed_jobs, is_infra, job_id, latent_cause, mutation_type, slug
from rootspan.functions.classify import error_lines as lines_of
from rootspan.scratch import materialize
from rootspan.sources.inventory import make_node

RUNS = "repo string, databaseId long, headSha string, headBranch string, event string, workflowName string, conclusion string, createdAt string, updatedAt string"
JOBS = "run_id long, name string, conclusion string, steps array<struct<name:string,conclusion:string>>"
# Shared causes of CI failures, label and class.
LATENT_NODES = {
    "latent://azure-oidc": ("Azure OIDC / Federated Credentials", "IdentityProvider"),
    "latent://ghcr.io": ("GitHub Container Registry (GHCR)", "ContainerRegistry"),
    "latent://github-actions-infra": ("GitHub Actions Infrastructure", "CIPlatform"),
    "latent://flaky-tests": ("Flaky / Non-deterministic Tests", "FlakyTest"),
    "latent://runner-env/linux": ("GitHub Runner Environment (Linux)", "RunnerEnvironment"),
    "latent://runner-env/windows": ("GitHub Runner Environment (Windows)", "RunnerEnvironment"),
    "latent://runner-env/macos": ("GitHub Runner Environment (macOS)", "RunnerEnvironment"),
    "latent://github-scorecard": ("GitHub Scorecard / Supply Chain Security", "CIPlatform"),
    "latent://github-automerge": ("GitHub Automerge Infrastructure", "CIPlatform"),
}
# Cloud resources that a workflow works on.
WORKFLOW_RESOURCES = [
    ("Functional Tests (with Cloud Resources)", "resourcegroups/radiusfunctionaltest"),
    ("Functional Tests (with Cloud Resources)", "providers/microsoft.keyvault/vaults/radiuskvvoltest"),
    ("Long-running test on Azure", "resourcegroups/radlrtest00"),
    ("Long-running test on Azure", "providers/microsoft.containerservice/managedclusters/radlrtest00-aks"),
    ("Purge Azure test resources", "resourcegroups/radiusfunctionaltest"),
    ("Release Radius", "providers/microsoft.keyvault/vaults/radius-accounts"),
]
FLAKY = "latent://flaky-tests"


def classified_jobs(runs: DataFrame, jobs: DataFrame, log: DataFrame, commits: DataFrame, since: Column) -> DataFrame:
    """Failed jobs with their signal type, one for each repository, commit, job slug and signal: of the first run.

    commits: sha, message, author. A commit that is not listed has an empty message.
    """
    failed = failed_jobs(runs, jobs, since).join(lines_of(log).withColumnRenamed("run_id", "databaseId"), "databaseId", "left")
    known = commits.select(F.substring("sha", 1, 8).alias("sha8"), commit_headline(F.col("message")).alias("message"), "author").dropDuplicates(["sha8"])
    rows = failed.withColumn("sha8", F.substring("headSha", 1, 8)).join(known, "sha8", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("error_lines", F.coalesce("error_lines", none)).withColumn("message", F.coalesce("message", F.lit(""))).withColumn("author", F.coalesce("author", F.lit("unknown")))
    rows = rows.withColumn("signal_type", classify_failure(F.concat("error_lines", "failed_steps"), F.col("failed_steps"), F.col("workflowName"))).withColumn("job_slug", slug(F.col("job_name")))
    rest = [c for c in rows.columns if c not in ("repo", "sha8", "job_slug", "signal_type")]
    first = rows.groupBy("repo", "sha8", "job_slug", "signal_type").agg(F.min_by(F.struct(*rest), F.struct("createdAt", "databaseId", "job_name", "failed_steps")).alias("r"))
    out = first.select("repo", "sha8", "job_slug", "signal_type", "r.*")
    out = out.withColumn("job", job_id(F.col("repo"), F.col("databaseId"), F.col("job_name"))).withColumn("commit", commit_id(F.col("repo"), F.col("headSha")))
    return out.withColumn("infra", is_infra(F.col("signal_type"))).withColumn("cause", F.when(F.col("infra"), latent_cause(F.col("signal_type"), F.col("job_name"))).otherwise(F.col("commit")))


def workflow_resource_edges(classified: DataFrame, resources: DataFrame, subscription: str) -> DataFrame:
    """Job → cloud resource for the listed workflows; resources: workflow, resource."""
    target = F.lower(F.concat(F.lit(f"/subscriptions/{subscription}/"), "resource"))
    rows = classified.join(resources, classified["workflowName"] == resources["workflow"])
    return rows.select(*_edge(F.col("job"), target))


def _edge(source: Column, target: Column) -> list[Column]:
    return [F.concat(F.lit("edge-"), F.right(source, F.lit(30)), F.lit("-"), F.right(target, F.lit(30))).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit("dependency").alias("edge_type"), F.create_map().cast("map<string,string>").alias("properties")]


def ci_graph(runs: DataFrame, jobs: DataFrame, log: DataFrame, commits: DataFrame, since: Column, subscription: str | None = None) -> dict[str, DataFrame]:
    """``nodes, edges, mutations, signals`` of the failed runs inside the look-back.

    An infrastructure failure comes from a shared node, another from its commit. Plain test failures and refused
    connections have flaky tests as a rival cause. A commit changes once, at its first failing run.
    """
    spark = runs.sparkSession
    rows = materialize(classified_jobs(runs, jobs, log, commits, since), "jobs")
    github = F.lit("github")
    source = F.concat(F.lit("gh-actions/"), "repo")
    text = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))])
    shared = spark.createDataFrame([(k, *v) for k, v in LATENT_NODES.items()], "id string, label string, class string")
    shared = shared.select(*make_node(F.col("id"), F.col("label"), F.col("class"), github, F.create_map(F.lit("latent"), F.lit("true"))))
    job_nodes = rows.select(*make_node(F.col("job"), F.concat("workflowName", F.lit(": "), "job_name"), F.lit("CIJob"), github, F.map_concat(text("databaseId", "workflowName", "job_name", "sha8", "headBranch", "event", "author", "message"), F.create_map(F.lit("failed_steps"), F.to_json("failed_steps")))))
    code = rows.where("not infra")
    first = code.groupBy("commit").agg(F.min_by(F.struct("repo", "sha8", "message", "author", "event", "headBranch", "createdAt"), F.struct("createdAt", "databaseId")).alias("r")).select("commit", "r.*")
    commit_nodes = first.select(*make_node(F.col("commit"), F.concat("sha8", F.lit(": "), F.left("message", F.lit(60))), F.lit("Commit"), github, text("sha8", "headBranch", "author", "event")))
    rival = rows.where("signal_type in ('TestFailure', 'GrpcConnectionRefused')")
    edges = rows.select(*_edge(F.col("cause"), F.col("job"))).unionByName(rival.select(*_edge(F.lit(FLAKY), F.col("job"))))
    if subscription:
        edges = edges.unionByName(workflow_resource_edges(rows, spark.createDataFrame(WORKFLOW_RESOURCES, "workflow string, resource string"), subscription))
    at = F.try_to_timestamp("createdAt").alias("timestamp")
    def change(df: DataFrame, node: Column, kind: Column, *names: str) -> DataFrame:
        return df.select(F.concat(node, F.lit("/"), kind, F.lit("/"), "createdAt").alias("id"), node.alias("node_id"), kind.alias("mutation_type"), source.alias("source"), at, text(*names).alias("properties"))

    mutations = change(first, F.col("commit"), mutation_type(F.col("message"), F.col("author"), F.col("event")), "sha8", "author", "message")
    mutations = mutations.unionByName(change(rows.where("cause like 'latent://runner-env/%'"), F.col("cause"), F.lit("RunnerImageUpdate"), "databaseId")).unionByName(change(rival, F.lit(FLAKY), F.lit("FlakyTestRun"), "databaseId"))
    told = F.map_concat(text("databaseId", "job_name"), F.create_map(F.lit("failed_steps"), F.to_json("failed_steps"), F.lit("error_lines"), F.to_json(F.slice("error_lines", 1, 5))))
    told = F.when(F.col("infra"), told).otherwise(F.map_concat(told, F.create_map(F.lit("trigger_sha"), "sha8")))
    signals = rows.select(F.concat("job", F.lit("/"), "signal_type").alias("id"), F.col("job").alias("node_id"), "signal_type", F.lit(None).cast("double").alias("value"), F.lit("critical").alias("severity"), F.try_to_timestamp("updatedAt").alias("timestamp"), told.alias("properties"))
    return {"nodes": shared.unionByName(job_nodes).unionByName(commit_nodes), "edges": edges, "mutations": mutations, "signals": signals}
