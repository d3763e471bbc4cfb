"""Column functions that classify failures, changes, operations and causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns in order, the first that is found decides; found in any case.
ERROR_PATTERNS = [
    (r"AADSTS\d+|federated identity|Login failed.*az.*exit code|auth-type", "AzureAuthFailure"),
    (r"ErrImagePull|ImagePullBackOff|image.*pull.*fail", "ImagePullError"),
    (r"docker.*push.*fail|oras.*push.*fail", "ImagePushError"),
    (r"command not found|exit code 127", "CommandNotFound"),
    (r"requires a different Python|not in .>=\d", "PythonVersionMismatch"),
    (r"invalid array length|tokeninternal\.go|cannot use .* as type", "GoToolchainError"),
    (r"go\.mod was committed|go\.sum is out of sync|go mod tidy", "GoModCheckFailure"),
    (r"error forwarding port|wincat\.exe.*exit code", "PortForwardError"),
    (r"Fail to read Virtual Memory|sys_metric_stat\.go", "VirtualMemoryError"),
    (r"connection refused.*dial tcp 127\.0\.0\.1|UNAVAILABLE:.*connection error.*connection refused", "GrpcConnectionRefused"),
    (r"timed out|TimeoutException|deadline exceeded|HTTP request timed out", "Timeout"),
    (r"No task list was present|requireChecklist", "ChecklistMissing"),
    (r"helm.*fail|chart.*validation.*fail|no such file.*Chart", "HelmChartError"),
    (r"bicep.*fail|bicep build.*exit status", "BicepBuildError"),
    (r"Remote workflow failed", "RemoteWorkflowFailure"),
    (r"Dependabot encountered an error", "DependabotUpdateFailure"),
    (r"No files were found with the provided path.*No artifacts|Create Artifact Container failed|artifact name.*is not valid", "ArtifactUploadFailure"),
    (r"Scorecard|scorecard|supply.chain.security", "ScorecardFailure"),
    (r"automerge|auto.merge", "AutomergeFailure"),
    (r"lint|golangci|clippy|eslint", "LintFailure"),
    (r"Run make test|Run Unit Tests|unit tests", "UnitTestFailure"),
    (r"Generating tests for.*devcontainer|devcontainers", "DevContainerTestFailure"),
    (r"Process completed with exit code", "TestFailure"),
]
STEP_PATTERNS = [
    (r"disallowed changes in go\.mod|go\.mod.*check|validate go\.mod", "GoModCheckFailure"),
    (r"Check Python|Python.*Examples", "TestFailure"),
    (r"Spin local environment|Setup.*environment|docker-compose", "GrpcConnectionRefused"),
    (r"Build.*dev.container|devcontainer", "DevContainerTestFailure"),
    (r"Run make test$|Run Unit Test", "UnitTestFailure"),
    (r"Run.*integration|test-integration", "TestFailure"),
    (r"Run E2E|e2e test", "TestFailure"),
    (r"Run lint|golangci|clippy|eslint", "LintFailure"),
    (r"Preparing.*cluster|Setup.*AKS|Deploy.*infra", "Timeout"),
]
# Failures of the surroundings, not of the code, and the shared node that causes them.
INFRA_SIGNALS = [
    "AzureAuthFailure", "ImagePullError", "Timeout", "ImagePushError", "RemoteWorkflowFailure", "DependabotUpdateFailure", "ArtifactUploadFailure", "CommandNotFound",
    "PythonVersionMismatch", "GoToolchainError", "PortForwardError", "VirtualMemoryError", "GrpcConnectionRefused", "ScorecardFailure", "AutomergeFailure",
]
LATENT_CAUSES = {
    "AzureAuthFailure": "latent://azure-oidc",
    "ImagePullError": "latent://ghcr.io",
    "ImagePushError": "latent://ghcr.io",
    "Timeout": "latent://github-actions-infra",
    "RemoteWorkflowFailure": "latent://github-actions-infra",
    "ScorecardFailure": "latent://github-scorecard",
    "AutomergeFailure": "latent://github-automerge",
}
# Property paths in order, and change types.
CHANGE_PATHS = {
    "properties.extended.instanceView.powerState": "PowerStateChange",
    "properties.provisioningState": "ProvisioningStateChange",
    "managedBy": "DiskAttachDetach",
    "properties.diskState": "DiskStateChange",
    "properties.LastOwnershipUpdateTime": "DiskAttachDetach",
    "properties.storageProfile": "DiskChange",
    "properties.hardwareProfile": "SKUChange",
    "properties.networkProfile": "NetworkChange",
    "properties.backendAddressPools": "LoadBalancerPoolChange",
    "properties.frontendIPConfigurations": "LoadBalancerFrontendChange",
    "properties.osProfile": "OSConfigChange",
    "properties.virtualMachineProfile.extensionProfile": "VMExtensionChange",
    "sku": "SKUChange",
    "tags": "TagChange",
    "tags.maintenanceafter": "MaintenanceScheduled",
    "properties.siteConfig": "AppConfigChange",
    "properties.httpsOnly": "SecurityConfigChange",
    "properties.minimumTlsVersion": "SecurityConfigChange",
    "properties.publicNetworkAccess": "SecurityConfigChange",
    "properties.containers": "ContainerConfigChange",
    "properties.networkAcls": "NetworkACLChange",
    "properties.accessPolicies": "AccessPolicyChange",
    "identity": "IdentityChange",
    "properties.enableSoftDelete": "SecurityConfigChange",
    "properties.enablePurgeProtection": "SecurityConfigChange",
    "properties.kubernetesVersion": "KubernetesUpgrade",
    "properties.agentPoolProfiles": "NodePoolChange",
    "properties.addonProfiles": "AKSAddonChange",
    "properties.callRateLimit": "RateLimitChange",
    "properties.capabilities": "CapabilityChange",
    "properties.validationsProfile": "ImageValidationChange",
    "properties.publishingProfile": "ImagePublishChange",
    "properties.instances": "RedisInstanceChange",
    "properties.staticIP": "RedisConfigChange",
}
CHANGE_TYPES = {"Create": "ResourceCreate", "Update": "ConfigChange", "Delete": "ResourceDelete"}
NOISY_CHANGES = ["TagChange", "PowerStateChange"]
HEALTH_SIGNALS = {"Unavailable": ("Unavailable", "critical"), "Degraded": ("Degraded", "warning"), "Unknown": ("HealthUnknown", "info")}
# What a write to a kind of resource means.
WRITES = [
    (["virtualmachine"], "VMConfigChange"), (["managedcluster", "kubernetes"], "AKSConfigChange"), (["storageaccount"], "StorageConfigChange"), (["keyvault"], "KeyVaultConfigChange"),
    (["database", "sql"], "DatabaseConfigChange"), (["networkinterface", "virtualnetwork"], "NetworkConfigChange"),
]
# Lines of a log that tell of a failure, and those that only look so.
FAILURE_LINES = r"(?i)--- FAIL:|DONE.*fail|command not found|exit code \d|ERROR:.*Process|invalid|not in .>=|connection refused|panic:|BUILD FAILURE|requires a different|make:.*Error|FAIL\s|Create Artifact.*failed"
SKIP_LINES = r"(?i)pipefail|--noprofile"
STAMP = r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z\s*"


def lookup(c: Column, values: dict[str, str], other: Column) -> Column:
    """The value for a key of ``values``, else ``other``."""
    return reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), reversed(values.items()), other)


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found in ``text`` in any case, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def joined(words: Column) -> Column:
    return F.array_join(F.coalesce(words, F.array().cast("array<string>")), " ")


def classify_failure(error_lines: Column, steps: Column, workflow: Column) -> Column:
    """Signal type of a failed job: by its error lines, steps and workflow, else by its steps alone, else TestFailure."""
    text = F.concat_ws(" ", joined(error_lines), joined(steps), F.coalesce(workflow, F.lit("")))
    return F.coalesce(first_match(text, ERROR_PATTERNS), first_match(joined(steps), STEP_PATTERNS), F.lit("TestFailure"))


def mutation_type(message: Column, author: Column, event: Column) -> Column:
    """Kind of code change, by commit message, author and event."""
    message, low = F.coalesce(message, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    updates = _number(low, r"with\s+(\d+)\s+update", 1)
    versions = r"from\s+v?(\d+)\.\d+\S*\s+to\s+v?(\d+)\.\d+"
    old, new = _number(message, versions, 1), _number(message, versions, 2)
    bot = (
        F.when(low.contains("github-actions"), "DepActionsBump")
        .when(updates >= 5, "DepGroupUpdate")
        .when(new > old, "DepMajorBump")
        .when(new.isNotNull(), "DepMinorBump")
        .when(low.contains("go-dependencies"), "DepGroupUpdate")
        .otherwise("DependencyUpdate")
    )
    human = F.when(low.contains("release") | F.coalesce(event == "release", F.lit(False)), "Release").when(low.contains("revert"), "Revert").otherwise("CodeChange")
    return F.when(F.lower(F.coalesce(author, F.lit(""))).contains("dependabot"), bot).otherwise(human)


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("decimal(38,0)")


def is_infra(signal: Column) -> Column:
    return signal.isin(INFRA_SIGNALS)


def latent_cause(signal: Column, job_name: Column) -> Column:
    """The shared node behind an infrastructure failure: listed ones, else the runner environment of the job's system."""
    low = F.lower(F.coalesce(job_name, F.lit("")))
    system = F.when(low.contains("win") | low.contains("ltsc"), "windows").when(low.contains("macos") | low.contains("darwin"), "macos").otherwise("linux")
    return lookup(signal, LATENT_CAUSES, F.concat(F.lit("latent://runner-env/"), system))


def slug(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def job_id(repo: Column, run_id: Column, job_name: Column) -> Column:
    return F.concat(F.lit("job://"), repo, F.lit("/"), run_id.cast("string"), F.lit("/"), slug(job_name))


def commit_id(repo: Column, sha: Column) -> Column:
    return F.concat(F.lit("commit://"), repo, F.lit("/"), F.substring(sha, 1, 8))


def commit_headline(message: Column) -> Column:
    return F.left(F.substring_index(message, "\n", 1), F.lit(120))


def classify_change(change_type: Column, changed_paths: Column) -> Column:
    """Mutation type of a resource change: of the first changed path that starts with a listed one (the first listed), else of the change type."""
    path = lambda p: reduce(lambda acc, kv: F.when(p.startswith(kv[0]), kv[1]).otherwise(acc), reversed(CHANGE_PATHS.items()), F.lit(None).cast("string"))
    kinds = F.filter(F.transform(F.coalesce(changed_paths, F.array().cast("array<string>")), path), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(kinds, F.lit(1)), lookup(change_type, CHANGE_TYPES, F.lit("ConfigChange")))


def change_mutations(changes: DataFrame, since: Column) -> DataFrame:
    """Mutations from resource changes after ``since``, tag and power-state changes left out."""
    found = changes.select(
        F.lower("resourceId").alias("node_id"), classify_change(F.col("changeType"), F.col("changed_paths")).alias("mutation_type"), F.lit("azure-resource-changes").alias("source"), F.try_to_timestamp("timestamp").alias("timestamp"),
        F.create_map(F.lit("change_type"), F.col("changeType"), F.lit("changed_by"), F.left("changedBy", F.lit(100)), F.lit("client_type"), F.col("clientType"), F.lit("operation"), F.left("operation", F.lit(100)), F.lit("changed_properties"), F.array_join(F.slice("changed_paths", 1, 10), ",")).alias("properties"),
    )
    return found.where((F.col("timestamp") > since) & ~F.col("mutation_type").isin(NOISY_CHANGES) & (F.coalesce("node_id", F.lit("")) != ""))


def health_signals(health: DataFrame) -> DataFrame:
    """Signals from resources that are not available."""
    kind = lookup(F.col("state"), {k: v[0] for k, v in HEALTH_SIGNALS.items()}, F.lit("HealthUnknown"))
    severity = lookup(F.col("state"), {k: v[1] for k, v in HEALTH_SIGNALS.items()}, F.lit("info"))
    at = F.try_to_timestamp(F.coalesce(F.nullif("occurredTime", F.lit("")), "reportedTime"))
    properties = F.create_map(F.lit("state"), F.col("state"), F.lit("reason"), F.col("reason"), F.lit("summary"), F.left("summary", F.lit(500)), F.lit("source"), F.lit("azure-resource-health"))
    return health.where(F.coalesce(F.col("state") != "Available", F.lit(True))).select(F.lower("resourceId").alias("node_id"), kind.alias("signal_type"), severity.alias("severity"), at.alias("timestamp"), properties.alias("properties"))


def classify_operation(operation: Column, resource_type: Column) -> Column:
    """Mutation type of a control-plane operation."""
    op, kind = F.lower(F.coalesce(operation, F.lit(""))), F.lower(F.coalesce(resource_type, F.lit("")))
    write = F.lit("ConfigChange")
    for words, label in reversed(WRITES):
        write = F.when(reduce(lambda a, b: a | b, [kind.contains(w) for w in words]), label).otherwise(write)
    return F.when(op.contains("/delete"), "ResourceDelete").when(op.contains("/write"), write).when(op.contains("/action"), "ResourceAction").otherwise("ConfigChange")


def error_lines(log: DataFrame, limit: int = 15) -> DataFrame:
    """``(run_id, error_lines)``: per run the text after ``##[error]`` of its first ``limit`` such lines that are not blank; log: run_id, line_no, line."""
    found = log.where(F.col("line").contains("##[error]")).withColumn("text", F.trim(F.element_at(F.split("line", r"##\[error\]"), -1))).where("text <> ''")
    numbered = found.selectExpr("run_id", "line_no", "text", "row_number() over (partition by run_id order by line_no) as k").where(F.col("k") <= limit)
    return numbered.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("error_lines"))


def failure_excerpt(log: DataFrame, keep: int = 8, tail: int = 10, tail_keep: int = 5, jobs: int = 5) -> DataFrame:
    """``(run_id, job_id, k, line)``: what a reader of a failed job's log needs, for the first ``jobs`` jobs of a run by id.

    The last ``keep`` lines that tell of a failure, without their time stamps; for a job without any,
    of its last ``tail`` lines the last ``tail_keep`` that are not blank. log: run_id, job_id, line_no, line.
    """
    first = log.select("run_id", "job_id").distinct().selectExpr("run_id", "job_id", "row_number() over (partition by run_id order by job_id) as n").where(F.col("n") <= jobs).drop("n")
    own = log.join(first, ["run_id", "job_id"]).withColumn("text", F.trim(F.regexp_replace("line", STAMP, "")))
    back = "row_number() over (partition by run_id, job_id order by line_no desc) as back"
    told = own.where(F.col("line").rlike(FAILURE_LINES) & ~F.col("line").rlike(SKIP_LINES)).selectExpr("run_id", "job_id", "line_no", "text", back).where(F.col("back") <= keep)
    last = own.selectExpr("run_id", "job_id", "line_no", "line", "text", back).where(F.col("back") <= tail).where(F.trim("line") != "").drop("back")
    last = last.join(told.select("run_id", "job_id").distinct(), ["run_id", "job_id"], "left_anti").selectExpr("run_id", "job_id", "line_no", "text", back).where(F.col("back") <= tail_keep)
    both = told.unionByName(last)
    return both.selectExpr("run_id", "job_id", "row_number() over (partition by run_id, job_id order by line_no) as k", "text as line")


def cause_type(root_cause: Column) -> Column:
    """runner, flaky, security, automerge, infra, code or unknown."""
    rc = F.coalesce(root_cause, F.lit(""))
    return (
        F.when(rc.contains("latent://runner-env"), "runner").when(rc.contains("latent://flaky"), "flaky").when(rc.contains("latent://github-scorecard"), "security").when(rc.contains("latent://github-automerge"), "automerge")
        .when(rc.contains("latent://"), "infra").when(rc.contains("commit://"), "code").otherwise("unknown")
    )


def cause_label(root_cause: Column) -> Column:
    """Short text of a cause: commit and change type, name of a shared node, else as it is."""
    last = F.element_at(F.split(root_cause, "/"), -1)
    sha = F.element_at(F.split(last, " "), 1)
    change = F.regexp_extract(root_cause, r"\(([^()]*)\)$", 1)
    latent = F.element_at(F.split(F.substring_index(root_cause, "latent://", -1), " "), 1)
    return F.when(root_cause.contains("commit://"), F.trim(F.concat_ws(" ", sha, change))).when(root_cause.contains("latent://"), latent).otherwise(root_cause)


def target_label(target: Column) -> Column:
    """Run and job of a job node, else the id."""
    parts = F.split(target, "/")
    return F.when(target.contains("job://"), F.array_join(F.slice(parts, -2, 2), "/")).otherwise(target)


def failed_jobs(runs: DataFrame, jobs: DataFrame, since: Column) -> DataFrame:
    """Failed jobs of failed runs inside the look-back; a run without job rows gets one job named like its workflow."""
    bad = runs.where(F.col("conclusion") == "failure").where(F.try_to_timestamp("createdAt") >= since)
    steps = F.transform(F.filter(F.coalesce("steps", F.array().cast("array<struct<name:string,conclusion:string>>")), lambda s: s["conclusion"] == "failure"), lambda s: s["name"])
    rows = jobs.select(F.col("run_id").alias("databaseId"), F.col("name").alias("job_name"), F.col("conclusion").alias("job_conclusion"), steps.alias("failed_steps"))
    has = rows.select("databaseId").distinct().withColumn("_has", F.lit(True))
    joined_ = bad.join(has, "databaseId", "left").join(rows.where("job_conclusion = 'failure'"), "databaseId", "left")
    keep = F.col("job_name").isNotNull() | F.col("_has").isNull()
    return joined_.where(keep).withColumn("job_name", F.coalesce("job_name", "workflowName")).withColumn("failed_steps", F.coalesce("failed_steps", F.array().cast("array<string>"))).drop("_has", "job_conclusion")


def run_conclusions(runs: DataFrame, since: Column) -> DataFrame:
    """``(conclusion, runs)`` inside the look-back."""
    return runs.where(F.try_to_timestamp("createdAt") >= since).groupBy("conclusion").agg(F.count("*").alias("runs"))
