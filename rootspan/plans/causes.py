"""Queries on inference and alerts (F, G, E)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.operators import alerts as al
from rootspan.operators import factors, inference, knowledge, paths
from rootspan.plans.fixtures import WEEK, as_of, ctes, inference_ctes, views

DAY = inference.DAY
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def plain_time(c: str = "timestamp") -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def r6(c: str, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


def text(c: str, by: str = ">") -> Column:
    return F.array_join(c, by).alias(c)


def diagnosed(spark: SparkSession, sf_dir: str, window_s: int = WEEK, min_confidence: float | None = None, **options) -> DataFrame:
    v = views(spark, sf_dir)
    return inference.diagnose_all(v["nodes"], v["edges"], v["mutations"], v["signals"], v["cpts"], v["priors"], as_of(v, spark, sf_dir), window_s, min_confidence, **options)


@query("f1_active_signals", ctes() + "SELECT s.id, s.node_id, s.signal_type, s.timestamp FROM signals s, as_of WHERE s.timestamp >= t - to_seconds(86400)")
def f1(spark, d):
    v = views(spark, d)
    return inference.active(v["signals"], as_of(v, spark, d)).select("id", "node_id", "signal_type", plain_time())


@query("f2_signals_by_node", ctes() + "SELECT node_id, max(timestamp) AS latest, array_to_string(list_sort(list(DISTINCT signal_type)), ',') AS types, count(*) AS n_signals FROM signals GROUP BY node_id")
def f2(spark, d):
    return inference.signals_by_node(views(spark, d)["signals"]).select("node_id", plain_time("latest"), text("types", ","), "n_signals")


@query("f3_ancestors", inference_ctes(WEEK) + "SELECT target, node AS ancestor, hops, array_to_string(path, '>') AS path FROM closure WHERE hops > 0")
def f3(spark, d):
    v = views(spark, d)
    targets = inference.active(v["signals"], as_of(v, spark, d), WEEK).select(F.col("node_id").alias("target"))
    return paths.ancestors(v["edges"], targets).select("target", "ancestor", "hops", text("path"))


@query("f4_shortest_paths", inference_ctes(WEEK) + """
SELECT r.id AS source, t.node_id AS target, coalesce(array_to_string(c.path, '>'), '') AS path FROM (SELECT id FROM nodes WHERE class = 'IdentityProvider') r CROSS JOIN targets t
LEFT JOIN closure c ON c.target = t.node_id AND c.node = r.id""")
def f4(spark, d):
    v = views(spark, d)
    targets = inference.active(v["signals"], as_of(v, spark, d), WEEK).select(F.col("node_id").alias("target")).join(v["nodes"].select(F.col("id").alias("target")), "target").distinct()
    roots = v["nodes"].where("class = 'IdentityProvider'").select(F.col("id").alias("source"))  # five stated sources
    pairs = targets.withColumn("source", F.explode(F.array(*[F.lit(r["source"]) for r in roots.collect()])))
    return paths.shortest_paths(v["edges"], pairs).select("source", "target", text("path"))


@query("f5_prior_and_f6_confidence", ctes() + """
SELECT s.id AS signal_id, m.id AS mutation_id, round(p, 6) AS prior, round(CASE WHEN k.p_absent <= 0 THEN 1.0 ELSE p / (1 - p) * (k.p_present / k.p_absent) / (1 + p / (1 - p) * (k.p_present / k.p_absent)) END, 6) AS confidence
FROM (SELECT s.id AS sid, m.id AS mid, 0.5 * exp(-ln(2.0) / 60.0 * (floor(greatest((epoch_us(s.timestamp) - epoch_us(m.timestamp)) / 1000000.0, 0.0)) / 60.0)) AS p FROM signals s JOIN mutations m ON s.node_id = m.node_id) x
JOIN signals s ON s.id = sid JOIN mutations m ON m.id = mid JOIN cpts k ON k.class = 'Container' AND k.mutation = m.mutation_type AND k.signal = s.signal_type""")
def f5(spark, d):
    v = views(spark, d)
    s = v["signals"].select(F.col("id").alias("signal_id"), "node_id", "signal_type", F.col("timestamp").alias("s_ts"))
    m = v["mutations"].select(F.col("id").alias("mutation_id"), "node_id", "mutation_type", F.col("timestamp").alias("m_ts"))
    k = v["cpts"].where("class = 'Container'").select(F.col("mutation").alias("mutation_type"), F.col("signal").alias("signal_type"), "p_present", "p_absent")
    rows = s.join(m, "node_id").join(k, ["mutation_type", "signal_type"]).withColumn("prior", inference.temporal_prior(F.col("m_ts"), F.col("s_ts"), F.lit(60.0)))
    return rows.select("signal_id", "mutation_id", r6("prior"), F.round(inference.lr_confidence(F.col("p_present"), F.col("p_absent"), F.col("prior")), 6).alias("confidence"))


def candidates(spark, d, window_s=WEEK, **options):
    v = views(spark, d)
    now = as_of(v, spark, d)
    return inference.candidate_causes(v["nodes"], v["edges"], inference.active(v["mutations"], now, window_s), inference.active(v["signals"], now, window_s), v["cpts"], v["priors"], **options)


@query("f9_candidate_causes", inference_ctes(WEEK) + "SELECT target, mutation_id, cause, hops, array_to_string(path, '>') AS path, round(confidence, 6) AS confidence FROM candidates")
def f9(spark, d):
    return candidates(spark, d).select("target", "mutation_id", "cause", "hops", text("path"), r6("confidence"))


DIAGNOSIS = "SELECT target_node, round(confidence, 6) AS confidence, root_cause, causal_path, timestamp, n_signals, array_to_string(signal_types, ',') AS signal_types, class FROM diagnoses"


def shown(df: DataFrame) -> DataFrame:
    return df.select("target_node", r6("confidence"), "root_cause", text("causal_path"), plain_time(), "n_signals", text("signal_types", ","), "class")


@query("f10_diagnose", inference_ctes(DAY) + DIAGNOSIS)
def f10(spark, d):
    return shown(diagnosed(spark, d, DAY, competing=False))


@query("f10_no_changes", inference_ctes(WEEK, "false") + DIAGNOSIS)
def f10_none(spark, d):
    v = views(spark, d)
    return shown(inference.diagnose_all(v["nodes"], v["edges"], v["mutations"].where("false"), v["signals"], v["cpts"], v["priors"], as_of(v, spark, d), WEEK, None))


@query("f10_competing", inference_ctes(WEEK) + "SELECT target AS target_node, rank, cause, round(confidence, 6) AS confidence FROM ranked")
def f10_competing(spark, d):
    ranked = inference.top_causes(candidates(spark, d, by_target=True).drop("path"), None)
    return ranked.select(F.col("target").alias("target_node"), F.col("rank").cast("long").alias("rank"), "cause", r6("confidence"))


@query("f11_diagnose_all", inference_ctes(WEEK) + DIAGNOSIS + " WHERE confidence >= 0.3")
def f11(spark, d):
    return shown(diagnosed(spark, d, min_confidence=0.3, competing=False, top_only=True)).orderBy(F.desc("confidence"), "target_node")


def case_ctes(cases: str, active: Callable[[str, str], str], mutations: str = "mutations", signals: str = "signals") -> str:
    """SQL of the best cause of each of ``cases`` (signal_id, target, t_class, seen_at, b) from the events that ``active`` (event, case) lets count."""
    return f"""
cases AS ({cases}),
walk AS (SELECT DISTINCT target, target AS node, 0 AS hops, [target] AS path FROM cases
  UNION ALL SELECT w.target, e.source_id, w.hops + 1, list_prepend(e.source_id, w.path) FROM walk w JOIN edges e ON e.target_id = w.node WHERE e.source_id <> w.target),
closure AS (SELECT target, node, hops, path FROM walk QUALIFY row_number() OVER (PARTITION BY target, node ORDER BY hops, path) = 1),
pairs AS (SELECT c.*, l.node, l.hops, l.path, m.id AS mutation_id, m.mutation_type, m.timestamp AS mutation_ts, n.class AS a_class FROM cases c JOIN closure l USING (target) JOIN {mutations} m ON m.node_id = l.node
  AND {active("m", "c")} JOIN nodes n ON n.id = l.node),
spots AS (SELECT DISTINCT signal_id, seen_at, b, node FROM pairs UNION SELECT DISTINCT signal_id, seen_at, b, target FROM pairs),
ev AS (SELECT p.signal_id, p.node, max(s.timestamp) AS latest, list(DISTINCT s.signal_type) AS types FROM spots p JOIN {signals} s ON s.node_id = p.node AND {active("s", "p")} GROUP BY ALL),
triples AS (SELECT signal_id, node AS place, mutation_id, mutation_type, mutation_ts, a_class AS class FROM pairs UNION SELECT signal_id, target, mutation_id, mutation_type, mutation_ts, a_class FROM pairs
  UNION SELECT signal_id, target, mutation_id, mutation_type, mutation_ts, t_class FROM pairs),
matched AS (SELECT t.signal_id, t.place, t.mutation_id, t.class, p.half_life_min, ev.latest,
    0.5 * exp(-ln(2.0) / p.half_life_min * (floor(greatest((epoch_us(ev.latest) - epoch_us(t.mutation_ts)) / 1000000.0, 0.0)) / 60.0)) AS prior,
    count(k.signal) AS n, product(CASE WHEN k.p_absent > 0 THEN k.p_present / k.p_absent ELSE 1.0 END) AS ratio, bool_or(k.p_absent <= 0) AS certain
  FROM triples t LEFT JOIN ev ON ev.signal_id = t.signal_id AND ev.node = t.place LEFT JOIN priors p ON p.class = t.class
  LEFT JOIN cpts k ON k.class = t.class AND k.mutation = t.mutation_type AND list_contains(ev.types, k.signal) GROUP BY ALL),
scores AS (SELECT *, CASE WHEN latest IS NULL OR half_life_min IS NULL THEN 0.0 WHEN n = 0 THEN 0.1 * prior WHEN certain THEN 1.0 ELSE prior / (1 - prior) * ratio / (1 + prior / (1 - prior) * ratio) END AS s FROM matched),
scored AS (SELECT p.*, CASE WHEN hops = 0 THEN s3.s WHEN greatest(s1.s, s2.s, s3.s) <= 0 THEN 0.01 ELSE greatest(s1.s, s2.s, s3.s) * pow(0.92, hops) END AS confidence FROM pairs p
  JOIN scores s1 ON s1.signal_id = p.signal_id AND s1.place = p.node AND s1.mutation_id = p.mutation_id AND s1.class = p.a_class
  JOIN scores s2 ON s2.signal_id = p.signal_id AND s2.place = p.target AND s2.mutation_id = p.mutation_id AND s2.class = p.a_class
  JOIN scores s3 ON s3.signal_id = p.signal_id AND s3.place = p.target AND s3.mutation_id = p.mutation_id AND s3.class = p.t_class),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY confidence DESC, hops, mutation_ts DESC, mutation_id) = 1)
"""


def _until(event: str, case: str) -> str:
    return f"{event}.timestamp <= {case}.seen_at AND {event}.timestamp >= {case}.seen_at - to_seconds(86400)"


REPLAYED = "SELECT s.id AS signal_id, s.node_id AS target, n.class AS t_class, s.timestamp AS seen_at, 0 AS b FROM signals s JOIN nodes n ON n.id = s.node_id"


@query("f12_replay", f"""{ctes()},{case_ctes(REPLAYED, _until)}
SELECT c.signal_id, c.target AS target_node, c.seen_at AS timestamp, b.node || ' (' || b.mutation_type || ')' AS root_cause, coalesce(array_to_string(b.path, '>'), '') AS causal_path,
  round(coalesce(b.confidence, CASE WHEN EXISTS (SELECT 1 FROM mutations m WHERE m.timestamp <= c.seen_at AND m.timestamp >= c.seen_at - to_seconds(86400)) THEN 0.0 ELSE p.p_failure END), 6) AS confidence
FROM cases c LEFT JOIN best b USING (signal_id) LEFT JOIN priors p ON p.class = c.t_class""")
def f12(spark, d):
    v = views(spark, d)
    out = inference.replay(v["nodes"], v["edges"], v["mutations"], v["signals"], v["cpts"], v["priors"])
    return out.select("signal_id", "target_node", plain_time(), r6("confidence"), "root_cause", text("causal_path"))


@query("f13_top_causes", inference_ctes(WEEK) + "SELECT target, rank, mutation_id, round(confidence, 6) AS confidence FROM ranked WHERE rank <= 3")
def f13(spark, d):
    return inference.top_causes(candidates(spark, d, top_only=3), 3).select("target", F.col("rank").cast("long").alias("rank"), "mutation_id", r6("confidence"))


@query("f17_posterior", """
WITH n AS (SELECT s_suppkey AS k, 0.05 + (s_suppkey % 90) / 100.0 AS a, 0.1 + (s_suppkey % 7) / 10.0 AS b1, 0.05 + (s_suppkey % 11) / 20.0 AS b0, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS seen FROM supplier),
j AS (SELECT k, CASE WHEN seen = 1 THEN a * b1 ELSE a * (1 - b1) END AS p1, CASE WHEN seen = 1 THEN (1 - a) * b0 ELSE (1 - a) * (1 - b0) END AS p0 FROM n)
SELECT CAST(k AS BIGINT) AS network_id, v AS a, round(CASE WHEN v = 1 THEN p1 ELSE p0 END / (p1 + p0), 6) AS p FROM j, (VALUES (0), (1)) t(v)""")
def f17(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as network_id", "0.05e0 + (s_suppkey % 90) / 100.0e0 as pa", "0.1e0 + (s_suppkey % 7) / 10.0e0 as b1", "0.05e0 + (s_suppkey % 11) / 20.0e0 as b0")
    fa = s.selectExpr("network_id", "stack(2, 0, 1 - pa, 1, pa) as (a, p)")
    fab = s.selectExpr("network_id", "stack(4, 0, 0, 1 - b0, 0, 1, b0, 1, 0, 1 - b1, 1, 1, b1) as (a, b, p)")
    seen = s.selectExpr("network_id", "'b' as variable", "case when network_id % 3 = 0 then 0 else 1 end as value")
    return factors.posterior([fa, fab], ["a"], seen, ["b"]).select("network_id", "a", r6("p"))


#: Pairs of variables that a factor joins: two squares with a bridge, so eliminating one links others anew.
LOOPS = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (1, 5)]


def _weight(i: int, j: int, a: str, b: str) -> str:
    return f"(0.05e0 + ((k * {3 * i + 7} + {5 * j} + {i + 2} * {a} + {j + 3} * {b} + {a} * {b} * (k % 7)) % 10) / 10e0)"


@query("f17_junction_tree", f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), x AS (SELECT {', '.join(f'(n >> {i}) & 1 AS v{i}' for i in range(8))} FROM range(256) t(n)),
w AS (SELECT k, {', '.join(f'v{i}' for i in range(8))}, {' * '.join(_weight(i, j, f'v{i}', f'v{j}') for i, j in LOOPS)} AS p FROM s CROSS JOIN x WHERE k % 3 > 0 OR (v6 = 1 AND v2 = 0)),
m AS ({' UNION ALL '.join(f"SELECT k, 'v{i}' AS variable, v{i} AS value, sum(p) AS p FROM w GROUP BY ALL" for i in range(8))})
SELECT CAST(s.k AS BIGINT) AS network_id, variable, CAST(value AS INT) AS value, round(coalesce(p, 0) / sum(coalesce(p, 0)) OVER (PARTITION BY s.k, variable), 6) AS p
FROM s CROSS JOIN (SELECT DISTINCT variable, value FROM m) c LEFT JOIN m USING (k, variable, value)""")
def f17_tree(spark, d):
    """All marginals of networks of eight variables with loops, a network for each supplier; two variables are observed in every third."""
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k")
    both = s.selectExpr("k", "explode(array(named_struct('a', 0, 'b', 0), named_struct('a', 0, 'b', 1), named_struct('a', 1, 'b', 0), named_struct('a', 1, 'b', 1))) as x").select("k", "x.*")
    tables = [both.selectExpr("k as network_id", f"a as v{i}", f"b as v{j}", f"{_weight(i, j, 'a', 'b')} as p") for i, j in LOOPS]
    seen = s.where("k % 3 = 0").selectExpr("k as network_id", "stack(2, 'v6', 1, 'v2', 0) as (variable, value)")
    return factors.all_marginals(tables, seen).select("network_id", "variable", "value", r6("p"))


LAYERS = """
SELECT * FROM (SELECT CAST(c_custkey % 3 AS INT) AS layer_no, CAST(c_custkey AS INT) AS class_pos, 0 AS cpt_pos, concat('c', c_custkey % 11) AS class, CASE WHEN c_custkey % 4 = 0 THEN c_custkey / 100000e0 END AS p_failure,
  CASE WHEN c_custkey % 8 = 0 THEN 30e0 END AS half_life_min, CASE WHEN c_custkey % 5 <> 1 THEN concat('m', c_custkey % 13) END AS mutation, CASE WHEN c_custkey % 5 <> 1 THEN concat('s', c_custkey % 3) END AS signal,
  (c_custkey % 97) / 100e0 AS p_present, (c_custkey % 10) / 100e0 AS p_absent FROM {customer}) x"""


@query("e1_merge_cpt_layers", f"""
WITH l AS ({LAYERS.format(customer='customer')}), k AS (SELECT class, mutation, signal, p_present, p_absent FROM l WHERE mutation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY class, mutation, signal ORDER BY layer_no DESC, class_pos DESC) = 1),
p AS (SELECT class, p_failure, half_life_min FROM l WHERE p_failure IS NOT NULL QUALIFY row_number() OVER (PARTITION BY class ORDER BY layer_no DESC, class_pos DESC) = 1)
SELECT k.class, mutation, signal, p_present, p_absent, coalesce(p_failure, 0.005) AS p_failure, coalesce(half_life_min, 60.0) AS half_life_min,
  round(CASE WHEN p_absent <= 0 THEN -1 ELSE p_present / p_absent END, 6) AS ratio FROM k LEFT JOIN p USING (class)""")
def e1(spark, d):
    layers = spark.sql(LAYERS, customer=spark.read.parquet(f"{d}/customer.parquet"))
    cpts, priors = knowledge.merge_cpt_layers(layers)
    ratio = knowledge.likelihood_ratio(F.col("p_present"), F.col("p_absent"))
    return cpts.join(priors, "class").withColumn("ratio", F.round(F.when(ratio == float("inf"), -1.0).otherwise(ratio), 6))


RULES = """SELECT * FROM (VALUES (0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '/1[0-9]$', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'suppress', 'known'), (1, 'TLSError', NULL, NULL, NULL, NULL, 0.5e0, 'low', 'noise'),
  (2, NULL, 'Container', 'critical', NULL, 0.9e0, NULL, 'normal', 'sure'), (3, NULL, 'KeyVault', NULL, NULL, NULL, NULL, 'suppress', 'never')) AS t(rule_no, signal_type, class, source, pattern, min_confidence, max_confidence, action, reason)"""
ALERTS = inference_ctes(WEEK) + f""",
rules AS ({RULES}), src AS (SELECT node_id, list(DISTINCT severity) AS sources FROM signals GROUP BY node_id),
alerts AS (SELECT g.*, r.rule_no, coalesce(r.action, 'normal') AS action, r.reason FROM diagnoses g JOIN src ON src.node_id = g.target_node LEFT JOIN rules r ON r.rule_no = (
  SELECT min(rule_no) FROM rules q WHERE (q.signal_type IS NULL OR list_contains(g.signal_types, q.signal_type)) AND (q.class IS NULL OR q.class = g.class) AND (q.source IS NULL OR list_contains(src.sources, q.source))
  AND (q.pattern IS NULL OR regexp_matches(g.target_node, q.pattern)) AND (q.min_confidence IS NULL OR g.confidence >= q.min_confidence) AND (q.max_confidence IS NULL OR g.confidence <= q.max_confidence))),
shown AS (SELECT *, coalesce(root_cause, 'unknown') AS grp FROM alerts WHERE action <> 'suppress')
"""


def ruled(spark, d):
    v = views(spark, d)
    rules = spark.sql(RULES)
    return al.match_rules(al.alerts(diagnosed(spark, d, competing=False, top_only=True), v["signals"]), rules)


@query("g2_match_rules", ALERTS + "SELECT target_node, rule_no, action, reason, CASE WHEN action = 'low' THEN 'low' ELSE 'normal' END AS priority FROM alerts")
def g2(spark, d):
    return al.split_low(ruled(spark, d)).select("target_node", "rule_no", "action", "reason", "priority")


@query("g3_suppress", ALERTS + "SELECT target_node, round(confidence, 6) AS confidence FROM alerts WHERE len(list_filter(signal_types, lambda x: x NOT IN ('TLSError', 'CrashLoopBackOff'))) > 0")
def g3(spark, d):
    types = spark.createDataFrame([("TLSError",), ("CrashLoopBackOff",)], "signal_type string")
    return al.suppress(ruled(spark, d), types).select("target_node", r6("confidence"))


@query("g4_alert_groups", ALERTS + """SELECT grp AS root_cause, round(max(confidence), 6) AS confidence, count(*) AS count, CAST(sum(n_signals) AS BIGINT) AS n_signals, array_to_string(list_sort(list_distinct(flatten(list(signal_types)))), ',') AS signal_types,
  arg_min(causal_path, {'o': -confidence, 'n': target_node}) AS causal_path, max(timestamp) AS latest_signal FROM shown GROUP BY grp""")
def g4(spark, d):
    g = al.alert_groups(ruled(spark, d))
    return g.select("root_cause", r6("confidence"), "count", "n_signals", text("signal_types", ","), text("causal_path"), plain_time("latest_signal"))


@query("g4_group_members", ALERTS + "SELECT grp AS root_cause, target_node, round(confidence, 6) AS confidence, array_to_string(list_sort(signal_types), ',') AS signal_types FROM shown")
def g4_members(spark, d):
    return al.alert_members(ruled(spark, d)).select(F.col("group").alias("root_cause"), "target_node", r6("confidence"), text("signal_types", ","))


@query("g4_nested_groups", ALERTS + "SELECT grp AS root_cause, array_to_string(list_sort(list(target_node)), ',') AS affected_nodes, count(*) AS members FROM shown WHERE root_cause IS NOT NULL GROUP BY grp")
def g4_nested(spark, d):
    g = al.alert_groups(ruled(spark, d).where("root_cause is not null"), nested=True)
    return g.select("root_cause", text("affected_nodes", ","), F.size("members").cast("long").alias("members"))


@query("g4_group_pages", ALERTS + """, numbered AS (SELECT grp, target_node, row_number() OVER (PARTITION BY grp ORDER BY round(confidence, 6) DESC, target_node) - 1 AS k FROM shown)
SELECT grp AS root_cause, CAST(k // 5 AS BIGINT) AS page, count(*) AS rows, array_to_string(list(target_node ORDER BY k), ',') AS members FROM numbered GROUP BY ALL""")
def g4_pages(spark, d):
    pages = al.group_pages(ruled(spark, d).withColumn("confidence", F.round("confidence", 6)), 5)
    return pages.select("root_cause", "page", "rows", F.array_join(F.col("members.target_node"), ",").alias("members"))


@query("g6_filter_alerts", ALERTS + "SELECT target_node, round(confidence, 6) AS confidence, timestamp FROM alerts WHERE class = 'Container' AND list_contains(signal_types, 'TLSError')")
def g6(spark, d):
    return al.filter_alerts(ruled(spark, d), "Container", "TLSError", "time").select("target_node", r6("confidence"), plain_time())


@query("g7_group_by_signal_type", ALERTS + "SELECT t AS signal_type, count(DISTINCT target_node) AS alerts, count(DISTINCT coalesce(root_cause, 'unknown')) AS causes FROM (SELECT target_node, root_cause, unnest(signal_types) AS t FROM alerts) GROUP BY t")
def g7(spark, d):
    return al.group_by_signal_type(ruled(spark, d))


@query("g8_group_report", ALERTS + """SELECT grp AS root_cause, grp AS cause, 'unknown' AS cause_type, round(max(confidence), 4) AS confidence, count(*) AS count, array_to_string(list_sort(list_distinct(flatten(list(signal_types)))), ', ') AS signals,
  replace(arg_min(causal_path, {'o': -confidence, 'n': target_node}), '>', ' -> ') AS path, max(timestamp) AS latest_signal FROM shown GROUP BY grp HAVING max(confidence) >= 0.5""")
def g8(spark, d):
    return al.group_report(al.alert_groups(ruled(spark, d))).withColumn("latest_signal", plain_time("latest_signal"))


@query("g9_diagnosis_report", inference_ctes(WEEK) + """, shown AS (SELECT * FROM diagnoses WHERE confidence >= 0.1 ORDER BY confidence DESC, target_node LIMIT 20),
rivals AS (SELECT target, list(cause || ' ' || printf('%.2f', confidence) ORDER BY rank) AS r FROM ranked WHERE rank IN (2, 3) GROUP BY target)
SELECT target_node AS target, root_cause AS cause, round(confidence, 4) AS confidence, coalesce(array_to_string(r, '; '), '') AS competing, target_node FROM shown LEFT JOIN rivals ON target = target_node""")
def g9(spark, d):
    return al.diagnosis_report(diagnosed(spark, d, competing=3), 0.1, 20, 2)  # the cause and two rivals


@query("g10_overview", ctes() + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT class) FROM nodes) AS classes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM mutations) AS mutations, (SELECT count(*) FROM signals) AS signals, (SELECT count(*) FROM cpts) AS cpts")
def g10(spark, d):
    from rootspan.operators.graph import overview

    v = views(spark, d)
    return overview(v["nodes"], v["edges"], v["mutations"], v["signals"], v["cpts"])
