"""Queries on classification functions (C) over texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootspan.functions import classify as cl

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cases(column: str, patterns: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quoted(p)}, 'i') THEN {quoted(label)}" for p, label in patterns) + " END"


def mapped(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {other} END"


#: Texts that meet each rule, chosen by document number.
SNIPPETS = [
    "AADSTS7000 denied", "ErrImagePull", "docker image PUSH has failed", "bash: foo: command not found", "requires a different Python", "cannot use x as type y", "go mod tidy", "error forwarding port", "Fail to read Virtual Memory",
    "connection refused: dial tcp 127.0.0.1", "deadline exceeded", "requireChecklist", "helm upgrade failed", "bicep build: exit status", "Remote workflow failed", "Dependabot encountered an error", "Create Artifact Container failed",
    "scorecard", "auto-merge", "golangci", "Run Unit Tests", "devcontainers", "Process completed with exit code 1", "nothing known", "Setup the environment", "test-integration", "Deploy some infra",
]
SNIPPET_SQL = "[" + ", ".join(quoted(s) for s in SNIPPETS) + "]"
MESSAGES = [
    "Bump actions in the github-actions group", "Bump the group with 7 updates", "Bump x from 1.2.3 to 2.0.0", "Bump x from v1.2.3 to v1.3.0", "Bump go-dependencies", "Bump y", "Release 1.0", "Revert change", "Fix a bug", "Bump the group with 3 updates",
]
MESSAGE_SQL = "[" + ", ".join(quoted(s) for s in MESSAGES) + "]"


def picked(values: list[str], number: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(number) % len(values) + 1).cast("int"))


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query("c1_classify_failure", f"""WITH t AS (SELECT doc_id, {SNIPPET_SQL}[doc_id % {len(SNIPPETS)} + 1] AS s, text FROM documents), u AS (SELECT doc_id, text || ' ' || s || ' ci' AS whole, s FROM t)
SELECT doc_id, coalesce({cases('whole', cl.ERROR_PATTERNS)}, {cases('s', cl.STEP_PATTERNS)}, 'TestFailure') AS signal_type FROM u""")
def c1(spark, d):
    rows = documents(spark, d).withColumn("s", picked(SNIPPETS, "doc_id"))
    return rows.select("doc_id", cl.classify_failure(F.array("text"), F.array("s"), F.lit("ci")).alias("signal_type"))


@query("c2_mutation_type", f"""WITH t AS (SELECT o_orderkey, {MESSAGE_SQL}[o_orderkey % {len(MESSAGES)} + 1] AS m, o_orderkey % 4 > 0 AS bot, o_orderstatus = 'F' AS rel FROM orders),
x AS (SELECT *, lower(m) AS low, TRY_CAST(regexp_extract(m, 'from\\s+v?(\\d+)\\.\\d+\\S*\\s+to\\s+v?(\\d+)\\.\\d+', 1) AS INT) AS old, TRY_CAST(regexp_extract(m, 'from\\s+v?(\\d+)\\.\\d+\\S*\\s+to\\s+v?(\\d+)\\.\\d+', 2) AS INT) AS new, TRY_CAST(regexp_extract(lower(m), 'with\\s+(\\d+)\\s+update', 1) AS INT) AS n FROM t)
SELECT o_orderkey, CASE WHEN bot THEN CASE WHEN contains(low, 'github-actions') THEN 'DepActionsBump' WHEN n >= 5 THEN 'DepGroupUpdate' WHEN new > old THEN 'DepMajorBump' WHEN new IS NOT NULL THEN 'DepMinorBump' WHEN contains(low, 'go-dependencies') THEN 'DepGroupUpdate' ELSE 'DependencyUpdate' END
  WHEN contains(low, 'release') OR rel THEN 'Release' WHEN contains(low, 'revert') THEN 'Revert' ELSE 'CodeChange' END AS mutation_type FROM x""")
def c2(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("m", picked(MESSAGES, "o_orderkey"))
    author, event = F.expr("case when o_orderkey % 4 > 0 then 'Dependabot[bot]' else 'someone' end"), F.expr("case when o_orderstatus = 'F' then 'release' else 'push' end")
    return rows.select("o_orderkey", cl.mutation_type(F.col("m"), author, event).alias("mutation_type"))


JOBS = ["Build (Windows)", "test darwin", "macOS build", "linux tests", "ltsc image"]
KINDS = [*cl.INFRA_SIGNALS, "TestFailure", "LintFailure"]


@query("c3_c4_infra_and_latent", f"""WITH t AS (SELECT c_custkey, {'[' + ', '.join(quoted(k) for k in KINDS) + ']'}[c_custkey % {len(KINDS)} + 1] AS s, lower({'[' + ', '.join(quoted(k) for k in JOBS) + ']'}[c_custkey % 5 + 1]) AS j FROM customer)
SELECT c_custkey, s IN ({', '.join(quoted(k) for k in cl.INFRA_SIGNALS)}) AS infra, {mapped('s', cl.LATENT_CAUSES, "'latent://runner-env/' || CASE WHEN contains(j, 'win') OR contains(j, 'ltsc') THEN 'windows' WHEN contains(j, 'macos') OR contains(j, 'darwin') THEN 'macos' ELSE 'linux' END")} AS latent FROM t""")
def c34(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("s", picked(KINDS, "c_custkey")).withColumn("j", picked(JOBS, "c_custkey"))
    return rows.select("c_custkey", cl.is_infra(F.col("s")).alias("infra"), cl.latent_cause(F.col("s"), F.col("j")).alias("latent"))


@query("c5_c6_ids_and_headline", r"""SELECT doc_id, 'job://org/repo/' || doc_id || '/' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS job,
  'commit://org/repo/' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS "commit", left(split_part(text, chr(10), 1), 120) AS headline FROM documents""")
def c56(spark, d):
    rows = documents(spark, d)
    repo = F.lit("org/repo")
    return rows.select("doc_id", cl.job_id(repo, F.col("doc_id"), F.col("text")).alias("job"), cl.commit_id(repo, F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("commit"), cl.commit_headline(F.col("text")).alias("headline"))


PATHS = ["tags.maintenanceafter", "sku.name", "properties.provisioningState", "other.thing", "properties.networkProfile.x", "identity.type"]


@query("c7_c8_changes", f"""WITH t AS (SELECT p_partkey, list_filter([[{', '.join(quoted(p) for p in PATHS)}][p_partkey % 6 + 1], [{', '.join(quoted(p) for p in PATHS)}][p_size % 6 + 1]], lambda x: true) AS p, ['Create', 'Update', 'Delete', 'Odd'][p_partkey % 4 + 1] AS k FROM part),
f AS (SELECT p_partkey, k, list_filter(list_transform(p, lambda x: CASE {' '.join(f"WHEN starts_with(x, {quoted(a)}) THEN {quoted(b)}" for a, b in cl.CHANGE_PATHS.items())} END), lambda x: x IS NOT NULL) AS found FROM t),
g AS (SELECT p_partkey, coalesce(found[1], {mapped('k', cl.CHANGE_TYPES, "'ConfigChange'")}) AS mutation_type FROM f)
SELECT concat('part/', p_partkey) AS node_id, mutation_type FROM g WHERE mutation_type NOT IN ('TagChange', 'PowerStateChange') AND p_partkey % 5 IN (0, 2)""")
def c78(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        F.expr("concat('PART/', p_partkey)").alias("resourceId"), picked(["Create", "Update", "Delete", "Odd"], "p_partkey").alias("changeType"), F.array(picked(PATHS, "p_partkey"), picked(PATHS, "p_size")).alias("changed_paths"),
        F.expr("element_at(array('2024-01-02T00:00:00Z', '2024-01-01T00:00:00Z', '2024-03-01T12:00:00Z', '2023-12-31T23:59:59Z', '2020-01-01T00:00:00Z'), cast(p_partkey % 5 + 1 as int))").alias("timestamp"), F.lit("me").alias("changedBy"), F.lit("cli").alias("clientType"), F.lit("write").alias("operation"),
    )
    return cl.change_mutations(rows, F.to_timestamp(F.lit("2024-01-01"))).select("node_id", "mutation_type")


@query("c9_health_signals", "WITH t AS (SELECT s_suppkey, ['Available', 'Unavailable', 'Degraded', 'Unknown', 'Weird'][s_suppkey % 5 + 1] AS s FROM supplier) SELECT concat('s/', s_suppkey) AS node_id, CASE s WHEN 'Unavailable' THEN s WHEN 'Degraded' THEN s ELSE 'HealthUnknown' END AS signal_type, CASE s WHEN 'Unavailable' THEN 'critical' WHEN 'Degraded' THEN 'warning' ELSE 'info' END AS severity FROM t WHERE s <> 'Available'")
def c9(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.expr("concat('S/', s_suppkey)").alias("resourceId"), picked(["Available", "Unavailable", "Degraded", "Unknown", "Weird"], "s_suppkey").alias("state"), F.lit("").alias("reason"), F.lit("x").alias("summary"), F.lit("").alias("occurredTime"), F.lit("2024-01-01T00:00:00Z").alias("reportedTime"))
    return cl.health_signals(rows).select("node_id", "signal_type", "severity")


OPS = ["A/write", "A/delete", "A/start/action", "read"]
TYPES = ["Microsoft.Compute/virtualMachines", "microsoft.containerservice/managedClusters", "x/keyVault", "x/sql", "x/virtualNetworks", "x/storageAccounts", "x/y"]


@query("c10_classify_operation", f"""WITH t AS (SELECT o_orderkey, lower([{', '.join(quoted(o) for o in OPS)}][o_orderkey % 4 + 1]) AS o, lower([{', '.join(quoted(o) for o in TYPES)}][o_custkey % 7 + 1]) AS r FROM orders)
SELECT o_orderkey, CASE WHEN contains(o, '/delete') THEN 'ResourceDelete' WHEN contains(o, '/write') THEN CASE {' '.join('WHEN ' + ' OR '.join(f"contains(r, {quoted(w)})" for w in words) + f' THEN {quoted(label)}' for words, label in cl.WRITES)} ELSE 'ConfigChange' END
  WHEN contains(o, '/action') THEN 'ResourceAction' ELSE 'ConfigChange' END AS mutation_type FROM t""")
def c10(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("o", picked(OPS, "o_orderkey")).withColumn("r", picked(TYPES, "o_custkey"))
    return rows.select("o_orderkey", cl.classify_operation(F.col("o"), F.col("r")).alias("mutation_type"))


def log(spark, d):
    """Document lines as a log: every third carries the error marker."""
    lines = documents(spark, d).select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    return lines.select("run_id", F.lit(1).alias("job_id"), F.col("line_no").cast("long").alias("line_no"), F.expr("case when line_no % 3 = 0 then concat('2024-01-01T00:00:00Z ##[error]', l) when line_no % 7 = 1 then concat('2024-01-01T00:00:00.1Z panic: ', l) else l end").alias("line"))


LOG = "lines AS (SELECT doc_id AS run_id, unnest(range(len(l))) AS line_no, unnest(l) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), lg AS (SELECT run_id, line_no, CASE WHEN line_no % 3 = 0 THEN '2024-01-01T00:00:00Z ##[error]' || l WHEN line_no % 7 = 1 THEN '2024-01-01T00:00:00.1Z panic: ' || l ELSE l END AS line FROM lines)"


@query("c12_error_lines", f"WITH {LOG}, e AS (SELECT run_id, line_no, trim(split_part(line, '##[error]', 2)) AS t FROM lg WHERE contains(line, '##[error]')), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k FROM e WHERE t <> '') SELECT run_id, array_to_string(list(t ORDER BY line_no), '|') AS error_lines FROM k WHERE k <= 15 GROUP BY run_id")
def c12(spark, d):
    return cl.error_lines(log(spark, d)).withColumn("error_lines", F.array_join("error_lines", "|"))


@query("c13_failure_excerpt", f"""WITH {LOG}, own AS (SELECT run_id, line_no, line, trim(regexp_replace(line, {quoted(cl.STAMP)}, '')) AS text FROM lg),
told AS (SELECT * FROM own WHERE regexp_matches(line, {quoted(cl.FAILURE_LINES)}) AND NOT regexp_matches(line, {quoted(cl.SKIP_LINES)}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 8),
ends AS (SELECT * FROM own WHERE run_id NOT IN (SELECT run_id FROM told) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 10),
last AS (SELECT * FROM ends WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 5)
SELECT run_id, 1 AS job_id, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k, text AS line FROM (SELECT * FROM told UNION ALL SELECT * FROM last)""")
def c13(spark, d):
    return cl.failure_excerpt(log(spark, d))


CAUSES = ["latent://runner-env/linux (RunnerImageUpdate)", "latent://flaky-tests (FlakyTestRun)", "latent://github-scorecard (X)", "latent://github-automerge (X)", "latent://ghcr.io (X)", "commit://org/repo/abcdef12 (CodeChange)", "node/1 (X)"]
LABELS = {"latent://runner-env/linux (RunnerImageUpdate)": ("runner", "runner-env/linux"), "latent://flaky-tests (FlakyTestRun)": ("flaky", "flaky-tests"), "latent://github-scorecard (X)": ("security", "github-scorecard"), "latent://github-automerge (X)": ("automerge", "github-automerge"), "latent://ghcr.io (X)": ("infra", "ghcr.io"), "commit://org/repo/abcdef12 (CodeChange)": ("code", "abcdef12 CodeChange"), "node/1 (X)": ("unknown", "node/1 (X)")}


@query("c14_c15_labels", f"""WITH t AS (SELECT event_id, [{', '.join(quoted(c) for c in CAUSES)}][event_id % 7 + 1] AS c FROM events)
SELECT event_id, {mapped('c', {k: v[0] for k, v in LABELS.items()}, "'x'")} AS cause_type, {mapped('c', {k: v[1] for k, v in LABELS.items()}, "'x'")} AS cause, CASE WHEN event_id % 2 = 0 THEN event_id || '/build' ELSE 'vm/' || event_id END AS target FROM t""")
def c1415(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("c", picked(CAUSES, "event_id"))
    target = F.expr("case when event_id % 2 = 0 then concat('job://org/repo/', event_id, '/build') else concat('vm/', event_id) end")
    return rows.select("event_id", cl.cause_type(F.col("c")).alias("cause_type"), cl.cause_label(F.col("c")).alias("cause"), cl.target_label(target).alias("target"))


def runs(spark, d):
    """Orders as CI runs, line items as their jobs."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("'org/repo' as repo", "o_orderkey as databaseId", "md5(cast(cast(o_custkey as string) as binary)) as headSha", "'main' as headBranch", "'push' as event", "o_orderpriority as workflowName", "case when o_orderstatus = 'F' then 'failure' when o_orderstatus = 'O' then 'success' else 'cancelled' end as conclusion", "date_format(o_orderdate, 'yyyy-MM-dd') as createdAt", "date_format(o_orderdate, 'yyyy-MM-dd') as updatedAt")
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 3 > 0").selectExpr("l_orderkey as run_id", "concat('job ', l_linenumber) as name", "case when l_returnflag = 'R' then 'failure' else 'success' end as conclusion", "array(named_struct('name', 'make', 'conclusion', 'success'), named_struct('name', case when l_tax > 0.04 then 'Run lint' else 'Run E2E' end, 'conclusion', 'failure')) as steps")
    return o, line


@query("c17_failed_jobs", """WITH b AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'), j AS (SELECT l_orderkey, concat('job ', l_linenumber) AS n, l_returnflag, CASE WHEN l_tax > 0.04 THEN 'Run lint' ELSE 'Run E2E' END AS s FROM lineitem WHERE l_orderkey % 3 > 0)
SELECT o_orderkey AS run_id, n AS job_name, s AS failed_steps FROM b JOIN j ON l_orderkey = o_orderkey AND l_returnflag = 'R' UNION ALL SELECT o_orderkey, o_orderpriority, '' FROM b WHERE o_orderkey NOT IN (SELECT l_orderkey FROM j)""")
def c17(spark, d):
    o, j = runs(spark, d)
    out = cl.failed_jobs(o, j, F.to_timestamp(F.lit("1996-01-01")))
    return out.select(F.col("databaseId").alias("run_id"), "job_name", F.array_join("failed_steps", ",").alias("failed_steps"))


@query("c18_run_conclusions", "SELECT CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'cancelled' END AS conclusion, count(*) AS runs FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def c18(spark, d):
    return cl.run_conclusions(runs(spark, d)[0], F.to_timestamp(F.lit("1996-01-01")))
