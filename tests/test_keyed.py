"""Keyed state, versioned tables and closures by deltas, each against its plain form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rootspan.operators import inference
from rootspan.operators.closure import ClosureTable, whole_closure
from rootspan.plans.fixtures import views
from rootspan.schema import MUTATIONS, SIGNALS
from rootspan.scratch import scratch_path
from rootspan.sources import io
from rootspan.sources.versions import KeyedTable, last_manifest, read_version, save_version
from rootspan.streaming import keyed

NOW = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


def test_a_failed_save_leaves_the_version_before(spark):
    root = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        read_version(spark, root)
    assert save_version(spark, root, {"a": spark.range(3), "b": spark.range(1)}) == 1
    broken = spark.range(3).withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        save_version(spark, root, {"a": spark.range(9), "b": broken})
    assert {k: v.count() for k, v in read_version(spark, root).items()} == {"a": 3, "b": 1}
    for n in (4, 5, 6):
        save_version(spark, root, {"a": spark.range(n), "b": spark.range(n)})
    assert last_manifest(spark, root)[0] == 4 and read_version(spark, root)["b"].count() == 6


def test_a_failed_snapshot_leaves_the_one_before(spark):
    v = {k: x.limit(20) for k, x in views(spark, "/root/testdata/sf0.001").items()}
    root = scratch_path(spark, "snapshot")
    io.save_snapshot(v, root, NOW - timedelta(days=9999))
    bad = v | {"signals": v["signals"].withColumn("node_id", F.raise_error(F.lit("lost")).cast("string")), "nodes": v["nodes"].limit(1)}
    with pytest.raises(Exception, match="lost"):
        io.save_snapshot(bad, root, NOW - timedelta(days=9999))
    assert {k: x.count() for k, x in io.load_snapshot(spark, root).items()} == {k: 20 for k in ("nodes", "edges", "mutations", "signals")}


def test_keyed_table_merges_and_stays_small(spark):
    t, want = KeyedTable(spark, scratch_path(spark, "keyed"), "k long, v long, no long", ["k"], "-no", parts=3), {}
    assert t.read().count() == 0
    for no in range(6):
        batch = [(k, 100 * no + k, no) for k in range(no, no + 4)]
        t.upsert(spark.createDataFrame(batch, t.schema), no)
        t.upsert(spark.createDataFrame(batch, t.schema), no)  # a batch that ran again
        want |= {k: v for k, v, _ in batch}
        assert {r.k: r.v for r in t.read().collect()} == want
        assert len(last_manifest(spark, t.root)[1]["parts"]) <= 3


@pytest.mark.parametrize("seed", [1, 3])
def test_closure_by_deltas_equals_the_whole_walk(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    edges = [(f"e{i}", r.choice(names), r.choice(names)) for i in range(45)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    nodes = lambda some: frame([(n,) for n in some], "id string")
    shape = "id string, source_id string, target_id string"
    table = ClosureTable(spark, scratch_path(spark, "closure"), parts=2)
    table.start(nodes(names[:16]), frame([e for e in edges[:15] if {e[1], e[2]} <= set(names[:16])], shape))
    seen, known = [e for e in edges[:15] if {e[1], e[2]} <= set(names[:16])], names[:16]
    for no, (a, b) in enumerate([(15, 16), (16, 28), (28, 45)], 1):
        known = names if no > 1 else known
        more = [e for e in edges[a:b] if {e[1], e[2]} <= set(known)]
        table.add(no, nodes(known), frame(edges[a:b] + [("x", "nobody", names[0])], shape))
        seen += more
        assert rows(table.read()) == rows(whole_closure(nodes(known), frame(seen, shape))), no


def plant(seed, batches):
    """Events of a small graph; later batches hold later times, with some late ones and repeats."""
    r = random.Random(seed)
    places = ["tor", "vm1", "vm2", "c1", "c2", "c3", "kv", "ghost"]
    out = []
    for b in range(batches):
        at = lambda: NOW + timedelta(minutes=60 * b + r.randrange(60) - (200 if r.random() < 0.2 else 0))
        changes = [(f"m{b}-{i}", r.choice(places), r.choice(["ImageUpdate", "SecretRotation"]), "api", at(), {}) for i in range(r.randrange(4))]
        signals = [(f"s{b}-{i}", r.choice(places), r.choice(["CrashLoopBackOff", "AccessDenied_403"]), 1.0, "x", at(), {}) for i in range(1 + r.randrange(3))]
        out.append((changes, signals))
    return out


def test_keyed_stream_equals_batches_and_its_state_stays_flat(spark):
    window = 4 * 3600
    classes = {"tor": "ToR", "vm1": "VM", "vm2": "VM", "c1": "Container", "c2": "Container", "c3": "Container", "kv": "KeyVault"}
    nodes = spark.createDataFrame(list(classes.items()), "id string, class string")
    edges = spark.createDataFrame([("tor", "vm1"), ("tor", "vm2"), ("vm1", "c1"), ("vm1", "c2"), ("vm2", "c3"), ("kv", "c1"), ("c3", "tor")], "source_id string, target_id string")
    cpts = spark.createDataFrame([("Container", "ImageUpdate", "CrashLoopBackOff", 0.7, 0.03), ("KeyVault", "SecretRotation", "AccessDenied_403", 0.8, 0.02), ("VM", "ImageUpdate", "CrashLoopBackOff", 0.5, 0.1)], "class string, mutation string, signal string, p_present double, p_absent double")
    priors = spark.createDataFrame([("ToR", 0.001, 30.0), ("VM", 0.002, 60.0), ("Container", 0.005, 60.0), ("KeyVault", 0.001, 240.0)], "class string, p_failure double, half_life_min double")
    given, events = plant(7, 7), {"m": [], "s": []}
    closure = whole_closure(nodes, edges).persist()
    root = {k: scratch_path(spark, k) for k in ("m", "s", "check", "out")}
    keyed.keep_state_in_rocks_db(spark)
    table = keyed.diagnosis_table(spark, root["out"], parts=3)
    want, sizes = {}, []
    for changes, signals in given:
        spark.createDataFrame(changes, MUTATIONS).coalesce(1).write.mode("append").parquet(root["m"])
        spark.createDataFrame(signals, SIGNALS).coalesce(1).write.mode("append").parquet(root["s"])
        streams = [spark.readStream.schema(spark.read.parquet(root[k]).schema).parquet(root[k]) for k in ("s", "m")]
        q = keyed.keep_diagnoses(*streams, nodes, lambda: closure, cpts, priors, table, root["check"], window).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(max((o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]), default=0))
        events["m"] += changes
        events["s"] += signals
        top = max(s[5] for s in events["s"])
        frames = spark.createDataFrame(events["m"], MUTATIONS), spark.createDataFrame(events["s"], SIGNALS)
        found = inference.diagnose_all(nodes, edges, *frames, cpts, priors, top, window, None, competing=False, only=spark.createDataFrame([(s[1],) for s in signals], "target string"))
        want |= {r.target_node: (round(r.confidence, 9), r.root_cause, r.causal_path, r.timestamp) for r in found.collect()}
        assert {r.target_node: (round(r.confidence, 9), r.root_cause, r.causal_path, r.timestamp) for r in table.read().collect()} == want
    assert max(sizes) <= 4 * 9 * 2  # four types at eight places and anywhere, with their timers, however many batches


class Store:
    """A state store of one node that counts how often it is asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_node_costs_one_look_and_one_write_however_many_types_it_knows():
    store, evidence = Store(), keyed.NodeEvidence()
    evidence.init(store)
    row = lambda kind, what, id, us: Row(node="n", kind=kind, what=what, id=id, at=None, us=us)
    events = [row("signal", f"t{i}", "", 10_000_000 + i) for i in range(9)] + [row("change", "a", "m2", 5_000_000), row("change", "a", "m1", 5_000_000), row("change", "a", "m0", 4_000_000)]
    assert list(evidence.handleInputRows(("n",), iter(events), store)) == []
    assert store.calls == ["get", "timer", "update"] and store.timers == [5001]
    store.calls.clear()
    told = list(evidence.handleInputRows(("n",), iter([row("ask", "", "", 0), row("signal", "t1", "", 9_000_000)]), store))
    assert store.calls == ["get"] and len(told) == 11
    assert ("n", "change", "a", "m1", 5_000_000) in told and ("n", "touched", "", "", 9_000_000) in told and ("n", "signal", "t1", "", 10_000_001) in told
    store.calls.clear()
    list(evidence.handleInputRows(("n",), iter([row("change", "b", "m", 2_000_000)]), store))
    assert store.calls == ["get", "timer", "timer", "update"] and store.timers == [2001]
    store.now, store.timers = 6000, []
    list(evidence.handleExpiredTimer(("n",), store, None))
    assert len(store.value[0]) == 9 and store.timers == [10001]
    store.now = 11_000
    list(evidence.handleExpiredTimer(("n",), store, None))
    assert store.value is None
