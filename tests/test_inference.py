"""The golden topology and its scenarios; numbers by hand from the formulas."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rootspan.operators import alerts, factors, graph, inference, knowledge, paths
from rootspan.schema import CPTS, EDGES, LAYERS, MUTATIONS, NODES, PRIORS, RULES, SIGNALS

NOW = datetime(2024, 1, 1, 12)
CLASSES = {"tor": "ToRSwitch", "vm1": "VirtualMachine", "vm2": "VirtualMachine", "c1": "Container", "c2": "Container", "c3": "Container", "c4": "Container", "mi": "ManagedIdentity", "kv": "KeyVault"}
LINKS = [("tor", "vm1"), ("tor", "vm2"), ("vm1", "c1"), ("vm1", "c2"), ("vm2", "c3"), ("vm2", "c4"), ("vm1", "mi"), ("kv", "c1")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(k, k, v, None, None, {}) for k, v in CLASSES.items()], NODES)
    edges = spark.createDataFrame([(f"{a}{b}", a, b, "dependency", {}) for a, b in LINKS], EDGES)
    rows = [
        ("ToRSwitch", "FirmwareUpdate", "heartbeat", 0.9, 0.001), ("VirtualMachine", "MaintenanceReboot", "heartbeat", 0.95, 0.001), ("Container", "ImageUpdate", "CrashLoopBackOff", 0.75, 0.03),
        ("Container", "ConfigChange", "error_rate", 0.65, 0.04), ("ManagedIdentity", "SecretRotation", "AccessDenied_403", 0.85, 0.02), ("KeyVault", "SecretRotation", "AccessDenied_403", 0.8, 0.02),
    ]
    priors = [("ToRSwitch", 0.0008, 15.0), ("VirtualMachine", 0.002, 60.0), ("Container", 0.005, 15.0), ("ManagedIdentity", 0.0005, 240.0), ("KeyVault", 0.001, 480.0)]
    return nodes, edges, spark.createDataFrame(rows, CPTS), spark.createDataFrame(priors, PRIORS)


def run(spark, g, mutations, signals, as_of=NOW, **k):
    nodes, edges, cpts, priors = g
    m = spark.createDataFrame([(f"m{i}", n, t, "api", NOW + timedelta(seconds=s), {}) for i, (n, t, s) in enumerate(mutations)], MUTATIONS)
    s = spark.createDataFrame([(f"s{i}", n, t, None, None, NOW + timedelta(seconds=x), {}) for i, (n, t, x) in enumerate(signals)], SIGNALS)
    out = inference.diagnose_all(nodes, edges, m, s, cpts, priors, as_of, min_confidence=None, **k)
    return {r.target_node: r for r in out.collect()}


def posterior(ratio, prior):
    odds = prior / (1 - prior) * ratio
    return odds / (1 + odds)


def test_true_positive(spark, g):
    r = run(spark, g, [("kv", "SecretRotation", 0)], [("c1", "AccessDenied_403", 10)])["c1"]
    prior = 0.5 * math.exp(-math.log(2) / 480 * 10 / 60)
    assert r.confidence == pytest.approx(posterior(40, prior) * 0.92) and r.confidence == pytest.approx(0.898, abs=1e-3)
    assert r.root_cause == "kv (SecretRotation)" and r.causal_path == ["kv", "c1"] and [c.cause for c in r.competing_causes] == ["kv (SecretRotation)"]


def test_true_negative_keeps_the_prior(spark, g):
    r = run(spark, g, [], [("c1", "AccessDenied_403", 0), ("c3", "error_rate", 0), ("ghost", "x", 0)])
    assert {k: (x.confidence, x.root_cause) for k, x in r.items()} == {"c1": (0.005, None), "c3": (0.005, None)}


def test_red_herring(spark, g):
    r = run(spark, g, [("c3", "ImageUpdate", 0)], [("vm1", "heartbeat", 0), ("vm2", "heartbeat", 0)])
    assert all(x.confidence == 0.0 and x.root_cause is None and x.causal_path == [] for x in r.values())


def test_explaining_away(spark, g):
    r = run(spark, g, [("c1", "ImageUpdate", 0), ("kv", "SecretRotation", 0)], [("c1", "CrashLoopBackOff", 5)])["c1"]
    assert r.root_cause == "c1 (ImageUpdate)" and len(r.competing_causes) == 2 and r.causal_path == ["c1"]


@pytest.mark.parametrize(("minutes", "want"), [(0, 0.9615), (25, 0.8237), (35, 0.7336)])
def test_decay(spark, g, minutes, want):
    r = run(spark, g, [("c1", "ImageUpdate", 0)], [("c1", "CrashLoopBackOff", minutes * 60)])["c1"]
    assert r.confidence == pytest.approx(want, abs=1e-4)


def test_no_match_and_floor(spark, g):
    r = run(spark, g, [("c1", "Odd", 0), ("vm2", "Odd", -3600)], [("c1", "CrashLoopBackOff", 0), ("c3", "x", 0)])
    assert r["c1"].confidence == pytest.approx(0.05)
    assert r["c3"].confidence == pytest.approx(0.1 * 0.25 * 0.92)


def test_window_and_late_changes(spark, g):
    old = run(spark, g, [("c1", "ImageUpdate", -86401)], [("c1", "CrashLoopBackOff", 0)])["c1"]
    assert old.confidence == 0.005
    later = run(spark, g, [("c1", "ImageUpdate", 600)], [("c1", "CrashLoopBackOff", 0)])["c1"]
    assert later.confidence == pytest.approx(0.9615, abs=1e-4)


def test_top_only_keeps_the_best_cause(spark, g):
    changes = [("c1", "ImageUpdate", -s) for s in (900, 30, 4000)] + [("kv", "SecretRotation", -100)]
    full, top = run(spark, g, changes, [("c1", "CrashLoopBackOff", 0)])["c1"], run(spark, g, changes, [("c1", "CrashLoopBackOff", 0)], top_only=True)["c1"]
    assert (full.confidence, full.root_cause) == (top.confidence, top.root_cause) and len(full.competing_causes) == 4 and len(top.competing_causes) == 2


def test_replay_equals_snapshot_at_the_signal(spark, g):
    nodes, edges, cpts, priors = g
    m = spark.createDataFrame([(f"m{i}", n, t, "api", NOW + timedelta(minutes=x), {}) for i, (n, t, x) in enumerate([("c1", "ImageUpdate", 0), ("c1", "ImageUpdate", 20), ("kv", "SecretRotation", -1000), ("tor", "FirmwareUpdate", 5)])], MUTATIONS)
    events = [("c1", "CrashLoopBackOff", 10), ("c1", "AccessDenied_403", 30), ("c4", "heartbeat", 6), ("vm1", "heartbeat", -2000), ("c2", "x", 2)]
    s = spark.createDataFrame([(f"s{i}", n, t, None, None, NOW + timedelta(minutes=x), {}) for i, (n, t, x) in enumerate(events)], SIGNALS)
    for top in (True, False):
        got = {r.signal_id: r for r in inference.replay(nodes, edges, m, s, cpts, priors, top_only=top).collect()}
        for i, (n, _, x) in enumerate(events):
            at = F.col("timestamp") <= NOW + timedelta(minutes=x)
            want = inference.diagnose_all(nodes, edges, m.where(at), s.where(at), cpts, priors, NOW + timedelta(minutes=x), min_confidence=None).where(F.col("target_node") == n).first()
            assert got[f"s{i}"].confidence == pytest.approx(want.confidence) and got[f"s{i}"].root_cause == want.root_cause and got[f"s{i}"].causal_path == want.causal_path


def test_walks_on_a_cycle(spark):
    edges = spark.createDataFrame([(str(i), a, b, "dependency", {}) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), (None, "b")])], EDGES)
    up = {(r.target, r.ancestor): (r.hops, r.path) for r in paths.ancestors(edges, spark.createDataFrame([("a",)], "target string")).collect()}
    assert up == {("a", "c"): (1, ["c", "a"]), ("a", "x"): (1, ["x", "a"]), ("a", "b"): (2, ["b", "c", "a"])}
    kept, dropped = graph.break_cycles(edges)
    assert {(r.source_id, r.target_id) for r in dropped.collect()} == {("a", "b"), ("b", "c"), ("c", "a")} and kept.count() == 2
    got = {(r.source, r.target): r.path for r in paths.shortest_paths(edges, spark.createDataFrame([("x", "c"), ("c", "x"), ("b", "b")], "source string, target string")).collect()}
    assert got == {("x", "c"): ["x", "a", "b", "c"], ("c", "x"): [], ("b", "b"): ["b"]}
    with pytest.raises(ValueError):
        graph.load_graph(spark.createDataFrame([("a",)], "id string"), edges)


def test_islands_of_a_long_chain(spark):
    nodes = spark.range(300).selectExpr("concat('n', lpad(id, 3, '0')) as id")
    edges = spark.range(299).where("id <> 150").selectExpr("concat('n', lpad(id, 3, '0')) as source_id", "concat('n', lpad(id + 1, 3, '0')) as target_id")
    got = {r.node: r.island for r in graph.islands(nodes, edges).collect()}
    assert got == {f"n{i:03}": "n000" if i <= 150 else "n151" for i in range(300)}


def test_layers(spark):
    rows = [(0, 0, -1, "A", 0.1, 30.0, None, None, None, None), (0, 0, 0, "A", None, None, "m", "s", 0.5, 0.1), (1, 0, -1, "A", 0.2, None, None, None, None, None), (1, 0, 0, "A", None, None, "m", "s", 0.6, 0.2), (1, 0, 1, "A", None, None, "m", "t", 0.7, 0.0), (1, 1, 0, "B", None, None, "m", "s", 0.5, 0.5)]
    cpts, priors = knowledge.merge_cpt_layers(spark.createDataFrame(rows, LAYERS))
    assert {(r["class"], r.signal): (r.p_present, r.p_absent) for r in cpts.collect()} == {("A", "s"): (0.6, 0.2), ("A", "t"): (0.7, 0.0), ("B", "s"): (0.5, 0.5)}
    assert {r["class"]: (r.p_failure, r.half_life_min) for r in priors.collect()} == {"A": (0.2, 60.0), "B": (0.005, 60.0)}


def test_factors(spark):
    fa = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.7)], "network_id long, a int, p double")
    fb = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.1), (1, 1, 0, 0.2), (1, 1, 1, 0.8)], "network_id long, a int, b int, p double")
    assert {(r.a, r.b): round(r.p, 6) for r in factors.factor_product(fa, fb).collect()} == {(0, 0): 0.27, (0, 1): 0.03, (1, 0): 0.14, (1, 1): 0.56}
    assert {r.b: round(r.p, 6) for r in factors.marginalize(factors.factor_product(fa, fb), "a").collect()} == {0: 0.41, 1: 0.59}
    seen = spark.createDataFrame([(1, "b", 1)], "network_id long, variable string, value int")
    assert {r.a: round(r.p, 4) for r in factors.posterior([fa, fb], ["a"], seen, ["b"]).collect()} == {0: 0.0508, 1: 0.9492}


def test_same_symptom_two_causes(spark):
    rows = [(f"p{i}", 0.9 if i < 4 else 0.8, "disk (X)" if i < 4 else "deploy (Y)", ["disk", f"p{i}"], NOW, 1, ["HTTP_500"], "Container", []) for i in range(8)] + [("q", 0.0, None, [], NOW, 1, ["Leader"], "Container", [])]
    a = spark.createDataFrame(rows, "target_node string, confidence double, root_cause string, causal_path array<string>, timestamp timestamp, n_signals long, signal_types array<string>, class string, sources array<string>")
    rules = spark.createDataFrame([(0, "Leader", None, None, None, None, None, "suppress", "churn")], RULES)
    groups = alerts.alert_groups(alerts.match_rules(a, rules)).collect()
    assert [(r.root_cause, r["count"]) for r in groups] == [("disk (X)", 4), ("deploy (Y)", 4)]
    assert {r.signal_type: r.causes for r in alerts.group_by_signal_type(a).collect()} == {"HTTP_500": 2, "Leader": 1}


def test_all_marginals_equal_enumeration(spark):
    """Random networks with loops, a part of its own and impossible evidence, against every assignment."""
    import itertools
    import random

    r = random.Random(3)
    names, scopes = list("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d",), ("e", "f")]
    tables, frames = [], []
    for scope in scopes:
        rows = {(k, *x): r.choice([0.0, 0.3, 0.7, 1.0]) + 0.01 * (k > 0) for k in range(3) for x in itertools.product((0, 1), repeat=len(scope))}
        tables.append(rows)
        frames.append(spark.createDataFrame([(*key, p) for key, p in rows.items()], ["network_id", *scope, "p"]))
    evidence = {1: {"d": 1, "e": 0}, 2: {"a": 1}}
    seen = spark.createDataFrame([(k, v, x) for k, known in evidence.items() for v, x in known.items()], "network_id long, variable string, value int")
    want = {}
    for k in range(3):
        for x in itertools.product((0, 1), repeat=6):
            full = dict(zip(names, x))
            p = math.prod(t[(k, *(full[v] for v in scope))] for t, scope in zip(tables, scopes)) * all(full[v] == y for v, y in evidence.get(k, {}).items())
            for v in names:
                want[k, v, full[v]] = want.get((k, v, full[v]), 0.0) + p
    got = {(q.network_id, q.variable, q.value): q.p for q in factors.all_marginals(frames, seen).collect()}
    assert got.keys() == want.keys()
    for (k, v, x), p in got.items():
        total = want[k, v, 0] + want[k, v, 1]
        assert p == pytest.approx(want[k, v, x] / total if total else 0.0), (k, v, x)
    some = {(q.network_id, q.a): q.p for q in factors.posterior(frames, ["a"], seen).collect()}
    assert all(p == pytest.approx(got[k, "a", x]) for (k, x), p in some.items())


def test_group_pages_hold_everyone_in_order(spark):
    rows = [(f"n{i:04}", round((i * 37 % 100) / 100, 2), None if i % 3 else "kv (x)", ["t"], "show") for i in range(500)]
    df = spark.createDataFrame(rows, "target_node string, confidence double, root_cause string, signal_types array<string>, action string").repartition(7)
    pages = alerts.group_pages(df, 20).collect()
    assert all(len(p.members) == p.rows <= 20 for p in pages)
    for cause in ("unknown", "kv (x)"):
        own = sorted((p for p in pages if p.root_cause == cause), key=lambda p: p.page)
        want = sorted(((-c, n) for n, c, g, *_ in rows if (g or "unknown") == cause))
        assert [m.target_node for p in own for m in p.members] == [n for _, n in want] and [p.page for p in own] == list(range(-(-len(want) // 20)))


def test_as_of_scan_in_segments(spark):
    """A hub with most events and points, cut into segments, against a search; the largest key is a segment."""
    import random

    r = random.Random(8)
    place = lambda: "hub" if r.random() < 0.7 else f"n{r.randrange(4)}"
    at = lambda: NOW + timedelta(seconds=r.choice([r.randrange(400), r.randrange(40_000)]))
    events = [(place(), r.choice("xyz"), at(), f"e{i}") for i in range(500)] + [("hub", "x", None, "none")]
    points = [(place(), at()) for _ in range(300)]
    window = 3600
    want = set()
    for node, when in set(points):
        for kind in "xyz":
            found = [(-e[2].timestamp(), e[3], e[2]) for e in events if e[0] == node and e[1] == kind and e[2] is not None and timedelta(0) <= when - e[2] <= timedelta(seconds=window)]
            if found:
                want.add((node, when, kind, min(found)[2], min(found)[1]))
    e, p = spark.createDataFrame(events, "node string, kind string, when timestamp, id string"), spark.createDataFrame(points, "node string, at timestamp")
    for segment in (20, 100_000):
        assert {tuple(x) for x in inference.last_before(p, e, window, segment).collect()} == want
    dated = e.where("when is not null").withColumn("b", F.floor(F.unix_micros("when") / F.lit(window * 1_000_000)))
    asked = p.withColumn("b", F.floor(F.unix_micros("at") / F.lit(window * 1_000_000)))
    cut_e, cut_p, cut = inference._segments(dated, asked, 20)
    sizes = cut_e.select("node", "b", "seg").unionByName(cut_p.select("node", "b", "seg")).groupBy("node", "b", "seg").count()
    assert cut and sizes.agg(F.max("count")).first()[0] <= 60
