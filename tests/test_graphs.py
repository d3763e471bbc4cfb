from datetime import datetime

from pyspark.sql import functions as F

from rootspan.functions import classify
from rootspan.operators import graph, paths
from rootspan.schema import EDGES, MUTATIONS, NODES, SIGNALS

NOW = datetime(2024, 1, 1)


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"{a}-{b}", a, b, "dependency", {}) for a, b in pairs], EDGES)


def slow_neighborhood(pairs, seed, depth, fanout, cap):
    seen, front = {seed: 0}, [seed]
    for level in range(1, depth + 1):
        new = set()
        for n in front:
            new |= {a for a, b in pairs if b == n}
            new |= set(sorted(b for a, b in pairs if a == n and b not in seen)[:fanout])
        front = sorted(new - seen.keys())
        seen |= dict.fromkeys(front, level)
    return dict(sorted(seen.items(), key=lambda x: (x[1], x[0]))[:cap])


def test_neighborhood_against_plain_python(spark):
    pairs = {(f"n{i}", f"n{(i * 7 + j) % 60}") for i in range(60) for j in range(i % 13)} | {(f"n{i}", "hub") for i in range(0, 60, 5)} | {("hub", f"n{i}") for i in range(60)}
    for depth, fanout, cap in ((2, 8, 40), (3, 2, 15), (1, 100, 1000)):
        seeds = spark.createDataFrame([("hub",), ("n3",), ("n59",)], "node string")
        got = {}
        for r in paths.neighborhood(edges_of(spark, sorted(pairs)), seeds, depth, fanout, cap).collect():
            got.setdefault(r.seed, {})[r.node] = r.depth
        assert got == {s: slow_neighborhood(pairs, s, depth, fanout, cap) for s in ("hub", "n3", "n59")}


def test_neighborhood_asks_for_few_children_of_a_hub(spark):
    links = spark.createDataFrame([("hub", f"n{i:04}", i + 1) for i in range(1000)], "source_id string, target_id string, place int")
    seeds = spark.createDataFrame([(f"n{i:04}",) for i in range(1000)], "seed string")
    front, seen = seeds.withColumn("node", F.lit("hub")), seeds.withColumn("node", F.col("seed"))
    found = paths.first_children(links, front, seen, 8)
    assert found.count() == 9000 and found.agg(F.max("child")).first()[0] == "n0008"


def test_alert_subgraph(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "c"), ("c", "k1"), ("c", "k2"), ("y", "z")]
    nodes = spark.createDataFrame([(n, n, "C", None, None, {}) for n in "a b c x k1 k2 y z far".split()], NODES)
    mutations = spark.createDataFrame([("m1", "a", "t", "s", NOW, {}), ("m2", "far", "t", "s", NOW, {}), ("m3", "ghost", "t", "s", NOW, {})], MUTATIONS)
    signals = spark.createDataFrame([("s1", "c", "t", None, None, NOW, {})], SIGNALS)
    members, inner = graph.alert_subgraph(nodes, edges_of(spark, pairs), mutations, signals, NOW, max_children=1)
    assert {(r.cluster, r.node) for r in members.collect()} == {("c", "c"), ("c", "a"), ("c", "b"), ("c", "x"), ("c", "k1"), ("far", "far")}
    assert {(r.source_id, r.target_id) for r in inner.collect()} == {("a", "b"), ("b", "c"), ("x", "c"), ("c", "k1")}


def test_failure_excerpt(spark):
    told = [f"2024-01-01T00:00:00.1Z panic: {i}" if i % 2 else f"line {i}" for i in range(40)] + ["set -o pipefail panic: no"]
    quiet = [f"line {i}" if i % 3 else "  " for i in range(30)]
    rows = [(1, 1, i, x) for i, x in enumerate(told)] + [(1, 2, i, x) for i, x in enumerate(quiet)] + [(1, j, 0, "panic: x") for j in range(3, 9)]
    got = {}
    for r in classify.failure_excerpt(spark.createDataFrame(rows, "run_id long, job_id long, line_no long, line string")).orderBy("job_id", "k").collect():
        got.setdefault(r.job_id, []).append(r.line)
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1] == [f"panic: {i}" for i in range(25, 40, 2)]
    assert got[2] == [x for x in quiet[-10:] if x.strip()][-5:]


def test_literal_classification_cases(spark):
    cases = [("AADSTS700016 wrong", "AzureAuthFailure"), ("exit code 127", "CommandNotFound"), ("Process completed with exit code 1", "TestFailure"), ("", "TestFailure"), ("golangci-lint found", "LintFailure")]
    df = spark.createDataFrame(cases, "text string, want string")
    got = df.select("want", classify.classify_failure(F.array("text"), F.array().cast("array<string>"), F.lit("")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    slugs = spark.createDataFrame([("  Build & Test (x64)! ", "build-test-x64"), ("---", "")], "a string, b string").select(classify.slug(F.col("a")).alias("a"), "b").collect()
    assert all(r.a == r.b for r in slugs)


def _peeled(links):
    """Nodes that stay when nodes without incoming edges are taken away until none is left."""
    left = set(links)
    while True:
        targets = {t for _, t in left}
        keep = {(s, t) for s, t in left if s in targets}
        if keep == left:
            return targets
        left = keep


def test_stuck_nodes_equal_peeling(spark):
    import random

    from rootspan.operators.graph import stuck_nodes

    for seed in range(3):
        r = random.Random(seed)
        links = sorted({(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(r.choice([25, 40, 60]))})
        if seed % 2:
            links = [(s, t) for s, t in links if s < t] + [("n38", "n30")]
        got = {x.node for x in stuck_nodes(spark.createDataFrame(links, "s string, t string")).collect()}
        assert got == _peeled(links), seed


def test_a_deep_chain_with_a_cycle_takes_few_rounds(spark, monkeypatch):
    from rootspan.operators import graph

    rounds, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="table": rounds.append(name) or plain(df, name))
    n = 50_000
    chain = spark.range(n).selectExpr("concat('e', id) as id", "cast(id as string) as source_id", "cast(id + 1 as string) as target_id", "'dependency' as edge_type")
    back = spark.createDataFrame([("back", str(n), str(n - 3), "dependency"), ("tail", str(n), "tail", "dependency")], chain.schema)
    kept, dropped = graph.break_cycles(chain.unionByName(back))
    assert dropped.count() == 5 and kept.count() == n - 3 and rounds.count("pointers") < 40
