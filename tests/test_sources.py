import json

import pytest
from pyspark.sql import functions as F

from rootspan.operators import graph
from rootspan.schema import EDGES
from rootspan.scratch import scratch_path
from rootspan.sources import io, kubernetes, stores, terraform
from rootspan.sources.inventory import RESOURCES, build_graph
from rootspan.streaming import intake

MANIFEST = "layers:\n  - path: base.yaml\n  - path: gone.yaml\n    optional: true\n  - path: more.yaml\n"
BASE = "- class: A\n  default_prior: {P_failure: 0.1, decay_half_life_minutes: 5}\n  cpts:\n    - {mutation: m, signal: s, table: [[0.5, 0.1], [0.5, 0.9]]}\n"


def test_knowledge_layers_and_rules(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    (tmp_path / "base.yaml").write_text(BASE)
    with pytest.raises(FileNotFoundError):
        io.load_cpt_layers(spark, str(tmp_path / "m.yaml"))
    (tmp_path / "more.yaml").write_text("- class: B\n")
    rows = io.load_cpt_layers(spark, str(tmp_path / "m.yaml")).collect()
    assert [(r.layer_no, r["class"], r.mutation, r.p_absent) for r in rows] == [(0, "A", None, None), (0, "A", "m", 0.1), (2, "B", None, None)]
    assert io.load_cpt_layers(spark, str(tmp_path / "base.yaml")).count() == 2
    (tmp_path / "r.yaml").write_text("rules:\n  - {signal_type: x, action: low, reason: why}\n")
    assert io.load_alert_rules(spark, str(tmp_path / "r.yaml")).first()["action"] == "low"
    assert io.load_alert_rules(spark, str(tmp_path / "none.yaml")).count() == 0


def test_payload_with_absent_fields(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"nodes": [{"id": "a", "properties": {"k": "v"}}, {"id": "b"}], "edges": [{"source_id": "a", "target_id": "b", "edge_type": "odd"}]}, indent=1))
    nodes, edges = io.read_graph_payload(spark, f"file://{tmp_path}/p.json")
    assert nodes.count() == 2 and edges.first()["edge_type"] == "dependency"
    merged, kept, dangling = graph.merge_graphs((nodes, edges), (nodes, edges))
    assert merged.count() == 2 and kept.count() == 1 and dangling.count() == 0
    io.write_report(merged, f"file://{tmp_path}/r", "csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/r").count() == 2


def test_the_last_row_of_the_input_wins_over_files_and_splits(spark, tmp_path):
    """Small old file, large new file, and inside the large one the same ids again and again over many splits."""
    row = lambda i, name: json.dumps({"id": f"/s/{i}", "name": name, "type": "x/y", "location": "l", "resourceGroup": "g", "subscriptionId": "1"})
    (tmp_path / "a.json").write_text("\n".join(row(i, "zz old") for i in range(50)))
    (tmp_path / "b.json").write_text("\n".join(row(i % 50, f"{999 - i:03}" + "-" * 200) for i in range(900)))
    (tmp_path / "c.json").write_text(row(7, "last of all"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        given = spark.read.schema(RESOURCES).json(f"file://{tmp_path}/*.json")
        assert given.rdd.getNumPartitions() > 8
        nodes, _, _ = build_graph(given)
        got = {r.id: r.label[:11] for r in nodes.where("class <> 'ResourceGroup'").collect()}
        renamed = given.select("id", F.col("name").alias("label"), F.lit("A").alias("class"), F.create_map(F.lit("k"), "name").alias("properties"))
        merged, _, _ = graph.merge_graphs((renamed, spark.createDataFrame([], EDGES)))
        both = {r.id: (r.label[:11], r.properties["k"][:11]) for r in merged.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {f"/s/{i}": f"{999 - 850 - i:03}--------" for i in range(50)} | {"/s/7": "last of all"}
    assert got == want and both == {k: (v, v) for k, v in want.items()}


def test_order_column_stands_above_the_place_in_the_input(spark):
    rows = [("/s/1", "new", 2), ("/s/1", "old", 1)]
    df = spark.createDataFrame(rows, "id string, name string, at int")
    for c, kind in (("type", "string"), ("location", "string"), ("resourceGroup", "string"), ("subscriptionId", "string"), ("properties", spark.read.schema(RESOURCES).json(spark.sparkContext.parallelize([])).schema["properties"].dataType), ("identity", "struct<userAssignedIdentities:map<string,struct<principalId:string>>>")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    assert build_graph(df)[0].first()["label"] == "old" and build_graph(df, "at")[0].first()["label"] == "new"


def test_event_store_over_jdbc(spark):
    with pytest.raises(Exception, match="(?i)driver|jdbc|suitable"):
        stores.read_event_store(spark, "jdbc:none://x")["signals"].count()


def test_store_ranges_follow_the_rows(spark):
    url = "jdbc:derby:memory:ranges;create=true"
    at = "timestamp_seconds(1700000000 + case when id % 10 = 0 then id * 1000 else id end)"  # nine of ten in a small part of the time
    events = spark.range(1000).selectExpr("concat('e', chr(39), id) as id", "concat('n', id % 7) as node_id", "'t' as signal_type", f"{at} as timestamp")
    for name, df in (("nodes", events.select("id")), ("edges", events.select("id").limit(1)), ("signals", events), ("mutations", events.withColumn("timestamp", F.when(F.col("node_id") != "n0", F.col("timestamp"))))):
        df.write.format("jdbc").option("url", url).option("dbtable", name).option("createTableColumnTypes", "id VARCHAR(50)").save()
    got = stores.read_event_store(spark, url, 8)
    for name in ("nodes", "signals", "mutations"):
        sizes = [r["count"] for r in got[name].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 and len(sizes) == 8 and max(sizes) < 2.2 * 125, (name, sizes)
    assert got["edges"].count() == 1
    assert stores.high_water_mark(got) is not None
    half = got["signals"].orderBy("timestamp").collect()[500]["timestamp"]
    again = stores.read_event_store(spark, url, 8, since=half)
    assert again["signals"].count() == 500 and again["nodes"].count() == 1000


NASTY = ['a"}', "}}}{{{[[]]", '"edges": [{', "\\", '\\"}', "line\nend}", "", "é}{東京", '{"nodes":[{"id":1}]}']


@pytest.mark.parametrize("split", [60, 1000, 10_000_000])
def test_one_document_by_many_tasks(spark, tmp_path, split):
    nodes = [{"id": f"n{i}", "label": NASTY[i % len(NASTY)] * (1 + i % 3), "properties": {NASTY[(i + 1) % len(NASTY)]: NASTY[(i + 2) % len(NASTY)]}} for i in range(60)]
    edges = [{"id": f"e{i}", "source_id": NASTY[i % len(NASTY)], "target_id": "x", "edge_type": "Containment"} for i in range(40)]
    one = {"version": "1}", "meta": {"nodes": {"id": "no"}, "x": [1, {"y": 2}]}, "nodes": nodes, "tags": [1, "[{"], "other": [{"id": "no", "nodes": [{"id": "no"}]}, {"id": "no"}], "edges": edges, "end": {}}
    two = {"edges": edges[:3], "nodes": []}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(one, ensure_ascii=False) + "\n" + json.dumps(two) + "\n")
    (tmp_path / "c.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = io.read_large_payload(spark, [f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.json", f"file://{tmp_path}/c.json"], "at")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [(r.id, r.label, r.properties) for r in got[0].orderBy("at").collect()] == [(n["id"], n["label"], n["properties"]) for n in nodes] * 2
    assert [(r.id, r.source_id, r.edge_type) for r in got[1].orderBy("at").collect()] == [(e["id"], e["source_id"], "containment") for e in edges * 2 + edges[:3]]


def test_inventory_from_json(spark, tmp_path):
    rows = [{"id": "/S/VM/", "name": "vm", "type": "Microsoft.Compute/VirtualMachines", "location": "eu", "resourceGroup": "g", "subscriptionId": "1", "properties": {"networkProfile": {"networkInterfaces": [{"id": "/s/nic"}]}}}, {"id": "/s/nic", "type": "microsoft.network/networkinterfaces"}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    nodes, edges, dangling = build_graph(spark.read.schema(RESOURCES).json(f"file://{tmp_path}/r.json"))
    assert {r.id: r["class"] for r in nodes.collect()} == {"/s/vm": "VirtualMachine", "/s/nic": "NetworkInterface", "/subscriptions/1/resourcegroups/g": "ResourceGroup"}
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("/s/vm", "/s/nic"), ("/subscriptions/1/resourcegroups/g", "/s/vm")} and dangling.count() == 0


def test_terraform_from_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 4, "resources": [{"mode": "data", "type": "x", "name": "y", "instances": [{}]}, {"mode": "managed", "type": "helm_release", "name": "h", "instances": [{"attributes": {"name": "hh"}}]}]}))
    nodes, edges, _ = terraform.tf_graph(spark.read.schema(terraform.STATE).option("multiLine", "true").json(f"file://{tmp_path}/s.json"))
    assert [(r.id, r.label, r["class"]) for r in nodes.collect()] == [("tf://helm_release.h", "hh", "HelmRelease")] and edges.count() == 0


def test_kubernetes_events(spark):
    rows = [("BackOff", "m", "Warning", "2024-01-01T00:00:00Z", ("ns", None), ("Pod", "p")), ("Killing", "m", "Normal", None, ("ns", "2024-01-01T00:00:00Z"), ("Node", "n")), ("Odd", "", "", None, (None, None), (None, None))]
    signals, changes, nodes = kubernetes.k8s_events(spark.createDataFrame(rows, kubernetes.EVENTS), "box")
    assert [(r.node_id, r.signal_type, r.severity) for r in signals.collect()] == [("k8s://box/ns/pod/p", "CrashLoopBackOff", "critical")]
    assert [(r.node_id, r.mutation_type) for r in changes.collect()] == [("k8s://box/ns/node/n", "ContainerStopping")] and nodes.first()["class"] == "Container"


def once(spark, df, name):
    out = scratch_path(spark, name)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", intake.checkpoint_path(spark, name)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def landed(spark, rows, name):
    path = scratch_path(spark, name)
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(path)
    return path


def texts(spark, path):
    return spark.readStream.schema("value string").text(path)


def test_event_stream_has_defaults(spark):
    path = landed(spark, [{"id": "1", "node_id": "a", "mutation_type": "m", "timestamp": "2024-01-01T00:00:00Z", "op": "insert"}, {"node_id": "b", "mutation_type": "m"}, {"id": "3", "node_id": "c", "op": "delete"}], "events")
    got = {r.node_id: r for r in once(spark, intake.stream_events(spark, path, "mutations"), "m").collect()}
    assert set(got) == {"a", "b"} and got["b"].id and got["b"].timestamp and got["a"].source == "cdc"


def test_ci_run_stream_fills_the_tables(spark):
    run = {"id": 7, "name": "unit tests", "head_sha": "abcdef123456", "head_branch": "main", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T01:00:00Z", "conclusion": "failure", "event": "push", "head_commit": {"message": "Revert it\nmore", "author": {"name": "x"}}}
    rows = [{"action": "completed", "repository": {"full_name": "o/r"}, "workflow_run": run}, {"action": "completed", "repository": {"full_name": "o/r"}, "workflow_run": run | {"conclusion": "success"}}, {"action": "requested"}]
    root = scratch_path(spark, "tables")
    intake.write_tables(intake.stream_ci_runs(texts(spark, landed(spark, rows, "runs"))), intake.ci_run_tables, root, intake.checkpoint_path(spark, "runs")).trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    assert {r.id for r in read("nodes").collect()} == {"job://o/r/7/unit-tests", "commit://o/r/abcdef12"}
    assert {(r.source_id, r.target_id) for r in read("edges").collect()} == {("commit://o/r/abcdef12", "job://o/r/7/unit-tests"), ("latent://flaky-tests", "job://o/r/7/unit-tests")}
    assert {r.mutation_type for r in read("mutations").collect()} == {"Revert", "FlakyTestRun"}
    assert [r.signal_type for r in read("signals").collect()] == ["UnitTestFailure"]


def test_webhook_streams(spark):
    deploys = once(spark, intake.stream_deploys(texts(spark, landed(spark, [{"target_node_id": "a", "mutation_type": "Deployment", "metadata": {"k": "v"}}, {"x": 1}], "deploys"))), "deploys").collect()
    assert [(r.node_id, r.source, r.properties) for r in deploys] == [("a", "radius", {"k": "v"})]
    metrics = once(spark, intake.stream_metric_alerts(texts(spark, landed(spark, [{"target_resource_id": "a", "metric_name": "cpu", "metric_value": 3.5, "fired_at": "2024-01-01T00:00:00Z"}], "metrics"))), "metrics").collect()
    assert [(r.node_id, r.signal_type, r.value, r.severity) for r in metrics] == [("a", "cpu", 3.5, "warning")]


def test_stream_diagnosis_equals_batch(spark):
    from rootspan.operators.inference import diagnose_all
    from rootspan.plans.fixtures import as_of, views

    d = "/root/testdata/sf0.001"
    v = views(spark, d)
    path = scratch_path(spark, "signals")
    v["signals"].coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(v["signals"].schema).parquet(path)
    out = scratch_path(spark, "diagnoses")
    empty = v | {"signals": v["signals"].where("false")}
    intake.stream_diagnose(stream, lambda: empty, out, intake.checkpoint_path(spark, "diagnose"), 7 * 86400).trigger(availableNow=True).start().awaitTermination()
    got = {r.target_node: (round(r.confidence, 9), r.root_cause) for r in intake.latest_diagnoses(spark, out).collect()}
    top = v["signals"].agg(F.max("timestamp").alias("t")).first()["t"]
    want = diagnose_all(v["nodes"], v["edges"], v["mutations"], v["signals"], v["cpts"], v["priors"], top, 7 * 86400, None)
    assert got == {r.target_node: (round(r.confidence, 9), r.root_cause) for r in want.collect()}
    assert as_of(v, spark, d) >= top
