"""Queries on graph operators (C16, D, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootspan.operators import graph, paths
from rootspan.operators.inference import DAY, active
from rootspan.plans.fixtures import ISLANDS, WEEK, as_of, ctes, inference_ctes, views
from rootspan.sources import io

QUERIES, ORACLES = {}, {}
MAP = "map<string,string>"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def order_edges(spark, d):
    """Edges between customers, several a pair, some to customers that don't exist."""
    return orders(spark, d).selectExpr("concat('e', o_orderkey) as id", "concat('c', o_custkey) as source_id", "concat('c', (o_custkey * 7 + o_orderkey) % 2000) as target_id", "case when o_orderkey % 5 = 0 then 'odd' else 'connection' end as edge_type", "o_orderkey as pos")


ORDER_EDGES = "oe AS (SELECT concat('e', o_orderkey) AS id, concat('c', o_custkey) AS source_id, concat('c', (o_custkey * 7 + o_orderkey) % 2000) AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN 'odd' ELSE 'connection' END AS edge_type, o_orderkey AS pos FROM orders)"


@query("c16_node_status", inference_ctes(WEEK) + """SELECT n.id, CASE WHEN s.node_id IS NOT NULL AND m.node_id IS NOT NULL THEN 'alert' WHEN s.node_id IS NOT NULL THEN 'signal' WHEN m.node_id IS NOT NULL THEN 'mutation' ELSE 'normal' END AS status
FROM nodes n LEFT JOIN (SELECT DISTINCT node_id FROM sigs) s ON s.node_id = n.id LEFT JOIN (SELECT DISTINCT node_id FROM muts) m ON m.node_id = n.id""")
def c16(spark, d):
    v = views(spark, d)
    return graph.node_status(v["nodes"], v["signals"], v["mutations"], as_of(v, spark, d), WEEK).select("id", "status")


@query("d1_dedupe_nodes", "SELECT concat('c', o_custkey) AS id, arg_max(o_orderpriority, o_orderkey) AS label, arg_max(o_orderstatus, o_orderkey) AS class FROM orders GROUP BY o_custkey")
def d1(spark, d):
    rows = orders(spark, d).selectExpr("concat('c', o_custkey) as id", "o_orderpriority as label", "o_orderstatus as class", "o_orderkey as pos")
    return graph.dedupe_nodes(rows, "pos").drop("pos")


@query("d2_dedupe_edges", f"WITH {ORDER_EDGES} SELECT source_id, target_id, edge_type, arg_min(id, pos) AS id FROM oe GROUP BY ALL")
def d2(spark, d):
    return graph.dedupe_edges(order_edges(spark, d), "pos").select("source_id", "target_id", "edge_type", "id")


@query("d3_drop_dangling", f"WITH {ORDER_EDGES} SELECT id, target_id IN (SELECT concat('c', c_custkey) FROM customer) AND source_id IN (SELECT concat('c', c_custkey) FROM customer) AS kept FROM oe")
def d3(spark, d):
    nodes = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('c', c_custkey) as id")
    kept, dropped = graph.drop_dangling(nodes, order_edges(spark, d))
    return kept.select("id", F.lit(True).alias("kept")).unionByName(dropped.select("id", F.lit(False).alias("kept")))


MERGE_PARTS = [
    ("SELECT concat('n', n_nationkey) AS id, n_name AS label, 'A' AS class, 'first' AS p_source, concat('r', n_regionkey) AS p_region FROM nation"),
    ("SELECT concat('n', n_nationkey + 5) AS id, CASE WHEN n_nationkey % 2 = 0 THEN concat('late ', n_name) END AS label, 'B' AS class, 'second' AS p_source, CAST(NULL AS STRING) AS p_region FROM nation"),
]


@query("d4_merge_graphs", f"""WITH a AS ({MERGE_PARTS[0]}), b AS ({MERGE_PARTS[1]}), e AS (SELECT DISTINCT concat('n', n_regionkey) AS s, concat('n', n_nationkey) AS t FROM nation UNION SELECT DISTINCT concat('n', n_nationkey), concat('n', n_nationkey + 20) FROM nation)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label, coalesce(b.class, a.class) AS class, coalesce(b.p_source, a.p_source) AS source, a.p_region AS region,
  (SELECT count(*) FROM e WHERE e.s = coalesce(a.id, b.id) AND e.t IN (SELECT id FROM a UNION SELECT id FROM b)) AS out_edges FROM a FULL JOIN b ON a.id = b.id""")
def d4(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    parts = []
    for i, part in enumerate(MERGE_PARTS):
        rows = spark.sql(part.replace("FROM nation", "FROM {nation}"), nation=nation)
        props = F.map_filter(F.create_map(F.lit("source"), "p_source", F.lit("region"), "p_region"), lambda k, v: v.isNotNull())
        nodes = rows.select("id", "label", "class", F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("rack_id"), props.alias("properties"))
        pair = ("concat('n', n_regionkey)", "concat('n', n_nationkey)") if i == 0 else ("concat('n', n_nationkey)", "concat('n', n_nationkey + 20)")
        edges = nation.selectExpr(f"concat('e{i}', n_nationkey) as id", f"{pair[0]} as source_id", f"{pair[1]} as target_id", "'dependency' as edge_type", "cast(map() as map<string,string>) as properties")
        parts.append((nodes, edges))
    nodes, edges, _ = graph.merge_graphs(*parts)
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out_edges"))
    return nodes.join(out, "id", "left").select("id", "label", "class", F.try_element_at("properties", F.lit("source")).alias("source"), F.try_element_at("properties", F.lit("region")).alias("region"), F.coalesce("out_edges", F.lit(0)).alias("out_edges"))


@query("d5_merge_into", f"""WITH {ORDER_EDGES}, base AS (SELECT concat('c', c_custkey) AS id, c_name AS label FROM customer WHERE c_custkey % 2 = 0), fresh AS (SELECT concat('c', c_custkey) AS id, concat('new ', c_name) AS label FROM customer WHERE c_custkey % 3 = 0),
alln AS (SELECT * FROM base UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM base)), typed AS (SELECT source_id, target_id, CASE WHEN edge_type = 'connection' THEN edge_type ELSE 'dependency' END AS edge_type, pos FROM oe),
known AS (SELECT source_id, target_id, edge_type FROM typed WHERE pos % 4 = 0),
added AS (SELECT DISTINCT source_id, target_id, edge_type FROM typed WHERE source_id IN (SELECT id FROM alln) AND target_id IN (SELECT id FROM alln) AND (source_id, target_id, edge_type) NOT IN (SELECT (source_id, target_id, edge_type) FROM known))
SELECT 'node' AS kind, id AS a, label AS b, NULL AS c FROM alln UNION ALL SELECT 'edge', source_id, target_id, edge_type FROM (SELECT * FROM known UNION ALL SELECT * FROM added)
UNION ALL SELECT 'new', CAST((SELECT count(*) FROM fresh WHERE id NOT IN (SELECT id FROM base)) AS VARCHAR), CAST((SELECT count(*) FROM added) AS VARCHAR), NULL""")
def d5(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet")
    node = lambda n, label: ids.where(f"c_custkey % {n} = 0").selectExpr("concat('c', c_custkey) as id", f"{label} as label")
    edges = order_edges(spark, d)
    base = edges.where("pos % 4 = 0").withColumn("edge_type", graph.edge_type_of(F.col("edge_type")))
    nodes, links, counts = graph.merge_into((node(2, "c_name"), base), (node(3, "concat('new ', c_name)"), edges))
    none = F.lit(None).cast("string")
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), none.alias("c"))
    rows = rows.unionByName(links.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_type").alias("c")))
    return rows.unionByName(counts.select(F.lit("new").alias("kind"), F.col("new_nodes").cast("string").alias("a"), F.col("new_edges").cast("string").alias("b"), none.alias("c")))


@query("d6_load_graph", f"""WITH {ORDER_EDGES}, n AS (SELECT concat('c', c_custkey) AS id FROM customer)
SELECT id, source_id, target_id, CASE WHEN edge_type = 'connection' THEN edge_type ELSE 'dependency' END AS edge_type FROM oe WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def d6(spark, d):
    nodes = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('c', c_custkey) as id")
    known, _ = graph.drop_dangling(nodes, order_edges(spark, d))
    return graph.load_graph(nodes, known)[1].select("id", "source_id", "target_id", "edge_type")


@query("d8_evict_expired", ctes() + "SELECT 'signal' AS kind, id FROM signals, as_of WHERE timestamp >= t - to_seconds(172800) UNION ALL SELECT 'mutation', id FROM mutations, as_of WHERE timestamp >= t - to_seconds(172800)")
def d8(spark, d):
    v = views(spark, d)
    tables = io.evict_expired(v, as_of(v, spark, d), 172_800)
    row = lambda name: tables[f"{name}s"].select(F.lit(name).alias("kind"), "id")
    return row("signal").unionByName(row("mutation"))


@query("d7_break_cycles", ctes() + """, g AS (SELECT source_id, target_id, edge_type FROM edges UNION ALL SELECT concat('customer/', c_custkey), concat('supplier/', c_custkey % 5), CASE WHEN c_custkey % 100 = 7 THEN 'dependency' END FROM customer WHERE c_custkey % 50 = 7
  UNION ALL SELECT concat('customer/', c_custkey), NULL, 'dependency' FROM customer WHERE c_custkey % 50 = 8),
loops AS (SELECT DISTINCT e.source_id AS start, e.target_id AS node FROM g e UNION SELECT w.start, e.target_id FROM loops w JOIN g e ON e.source_id = w.node),
cyclic AS (SELECT DISTINCT start AS node FROM loops WHERE start = node), stuck AS (SELECT node FROM cyclic UNION SELECT l.node FROM loops l JOIN cyclic c ON c.node = l.start)
SELECT source_id, target_id, edge_type, coalesce(source_id IN (SELECT node FROM stuck WHERE node IS NOT NULL) AND target_id IN (SELECT node FROM stuck WHERE node IS NOT NULL), false) AS dropped FROM g""")
def d7(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    back = c.where("c_custkey % 50 = 7").selectExpr("concat('x', c_custkey) as id", "concat('customer/', c_custkey) as source_id", "concat('supplier/', c_custkey % 5) as target_id", "case when c_custkey % 100 = 7 then 'dependency' end as edge_type")
    loose = c.where("c_custkey % 50 = 8").selectExpr("concat('y', c_custkey) as id", "concat('customer/', c_custkey) as source_id", "cast(null as string) as target_id", "'dependency' as edge_type")
    kept, dropped = graph.break_cycles(views(spark, d)["edges"].unionByName(back).unionByName(loose))
    row = lambda df, gone: df.select("source_id", "target_id", "edge_type", F.lit(gone).alias("dropped"))
    return row(kept, False).unionByName(row(dropped, True))


@query("h1_islands", ctes() + ISLANDS + " SELECT node, island FROM island")
def h1(spark, d):
    v = views(spark, d)
    return graph.islands(v["nodes"], v["edges"])


STARS = "WITH linked AS (SELECT concat('c', o_custkey) AS a, concat('c', o_custkey // 10 * 10) AS b FROM orders), n AS (SELECT concat('c', c_custkey) AS id, concat('c', c_custkey // 10 * 10) AS hub FROM customer), hubs AS (SELECT b AS hub, least(min(a), b) AS low FROM linked GROUP BY b)\n"


@query("h1_islands_of_orders", STARS + "SELECT n.id AS node, CASE WHEN n.id IN (SELECT a FROM linked) OR n.id IN (SELECT b FROM linked) THEN h.low ELSE n.id END AS island FROM n LEFT JOIN hubs h ON h.hub = n.hub")
def h1_orders(spark, d):
    edges = orders(spark, d).selectExpr("concat('c', o_custkey) as source_id", "concat('c', o_custkey div 10 * 10) as target_id")
    nodes = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('c', c_custkey) as id")
    return graph.islands(nodes, edges)


@query("h2_island_summary", inference_ctes(WEEK) + ISLANDS + """, parts AS (SELECT n.*, i.island, n.id IN (SELECT node_id FROM sigs) AS s, n.id IN (SELECT node_id FROM muts) AS m FROM nodes n JOIN island i ON i.node = n.id)
SELECT island, count(*) AS nodes, array_to_string(list_sort(list(DISTINCT class)), ',') AS classes, count(*) FILTER (WHERE s AND m) AS alerts, count(*) FILTER (WHERE s AND NOT m) AS signals,
  count(*) FILTER (WHERE m AND NOT s) AS mutations, min(id) AS representative FROM parts GROUP BY island""")
def h2(spark, d):
    v = views(spark, d)
    out = graph.island_summary(v["nodes"], v["edges"], v["signals"], v["mutations"], as_of(v, spark, d), WEEK)
    return out.withColumn("classes", F.array_join("classes", ","))


def near_level(level: int) -> str:
    """SQL of one level around the seeds: parents, and the first eight new children of each node."""
    seen, front = f"seen{level - 1}", f"front{level - 1}"
    return f"""
down{level} AS (SELECT f.seed, l.target_id AS node FROM {front} f JOIN links l ON l.source_id = f.node WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.seed = f.seed AND s.node = l.target_id) QUALIFY row_number() OVER (PARTITION BY f.seed, f.node ORDER BY l.target_id) <= 8),
front{level} AS (SELECT DISTINCT seed, node FROM (SELECT f.seed, l.source_id AS node FROM {front} f JOIN links l ON l.target_id = f.node UNION ALL SELECT * FROM down{level}) u WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.seed = u.seed AND s.node = u.node)),
seen{level} AS (SELECT * FROM {seen} UNION ALL SELECT seed, node, {level} FROM front{level})"""


@query("h3_neighborhood", inference_ctes(DAY) + f""", links AS (SELECT DISTINCT source_id, target_id FROM edges), front0 AS (SELECT DISTINCT node_id AS seed, node_id AS node FROM sigs), seen0 AS (SELECT seed, node, 0 AS depth FROM front0),{near_level(1)},{near_level(2)}
SELECT seed, node, depth FROM seen2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 40""")
def h3(spark, d):
    v = views(spark, d)
    seeds = active(v["signals"], as_of(v, spark, d)).select(F.col("node_id").alias("node"))
    return paths.neighborhood(v["edges"], seeds)


@query("h4_alert_subgraph", inference_ctes(DAY) + """, changed AS (SELECT DISTINCT node_id AS node FROM muts WHERE node_id IN (SELECT id FROM nodes)),
children AS (SELECT source_id AS target, target_id AS node FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id IN (SELECT node_id FROM targets)) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_id) <= 5),
parts AS (SELECT node_id AS target, node_id AS node FROM targets UNION ALL SELECT target, unnest(path) FROM closure WHERE hops > 0 AND node IN (SELECT node FROM changed)
  UNION ALL SELECT target, node FROM closure WHERE hops = 1 UNION ALL SELECT * FROM children UNION ALL SELECT NULL, node FROM changed),
members AS (SELECT node, coalesce(max(CASE WHEN target = node THEN node END), min(target), node) AS cluster FROM parts GROUP BY node)
SELECT cluster, node, 'node' AS kind FROM members UNION ALL SELECT source_id, target_id, 'edge' FROM edges WHERE source_id IN (SELECT node FROM members) AND target_id IN (SELECT node FROM members)""")
def h4(spark, d):
    v = views(spark, d)
    members, inner = graph.alert_subgraph(v["nodes"], v["edges"], v["mutations"], v["signals"], as_of(v, spark, d))
    return members.select("cluster", "node", F.lit("node").alias("kind")).unionByName(inner.select(F.col("source_id").alias("cluster"), F.col("target_id").alias("node"), F.lit("edge").alias("kind")))


@query("h5_graph_elements", inference_ctes(WEEK) + ISLANDS + """SELECT 'node' AS kind, n.id, i.island, n.id AS e_id, n.label, n.class, n.region,
  CASE WHEN n.id IN (SELECT node_id FROM sigs) AND n.id IN (SELECT node_id FROM muts) THEN 'alert' WHEN n.id IN (SELECT node_id FROM sigs) THEN 'signal' WHEN n.id IN (SELECT node_id FROM muts) THEN 'mutation' ELSE 'normal' END AS status,
  i.island AS e_island, NULL AS source, NULL AS target, NULL AS edge_type FROM nodes n JOIN island i ON i.node = n.id
UNION ALL SELECT 'edge', e.id, i.island, e.id, NULL, NULL, NULL, NULL, NULL, e.source_id, e.target_id, e.edge_type FROM edges e JOIN island i ON i.node = e.source_id""")
def h5(spark, d):
    v = views(spark, d)
    out = graph.graph_elements(v["nodes"], v["edges"], v["signals"], v["mutations"], as_of(v, spark, d), WEEK)
    e = F.from_json("element", "id string, label string, class string, region string, status string, island string, source string, target string, edge_type string")
    rows = out.withColumn("e", e)
    return rows.select("kind", "id", "island", F.col("e.id").alias("e_id"), "e.label", "e.class", "e.region", "e.status", F.col("e.island").alias("e_island"), "e.source", "e.target", "e.edge_type")


@query("h6_dot_lines", ctes() + r"""SELECT '  "' || id || '" [label="' || label || '\n[' || class || ']" style=filled fillcolor="' || CASE WHEN class = 'Container' THEN 'lightblue' WHEN class = 'KeyVault' THEN 'lightyellow' ELSE 'white' END || '"];' AS line FROM nodes
UNION ALL SELECT '  "' || source_id || '" -> "' || target_id || '" [style=' || CASE edge_type WHEN 'containment' THEN 'solid' WHEN 'connection' THEN 'dotted' ELSE 'dashed' END || ' label="' || upper(left(edge_type, 1)) || substr(edge_type, 2) || '"];' FROM edges""")
def h6(spark, d):
    v = views(spark, d)
    return graph.dot_lines(v["nodes"], v["edges"])


@query("h7_blast_radius", inference_ctes(WEEK) + """, below AS (SELECT DISTINCT node_id AS source, node_id AS node, 0 AS hops FROM muts UNION SELECT b.source, e.target_id, b.hops + 1 FROM below b JOIN edges e ON e.source_id = b.node),
near AS (SELECT source, node, min(hops) AS hops FROM below WHERE node <> source GROUP BY ALL)
SELECT m.node_id AS source, count(n.node) AS downstream, count(s.node_id) AS signaled, CAST(coalesce(max(n.hops), 0) AS INT) AS max_hops, round(CASE WHEN count(n.node) > 0 THEN count(s.node_id) / count(n.node) END, 6) AS share
FROM (SELECT DISTINCT node_id FROM muts) m LEFT JOIN near n ON n.source = m.node_id LEFT JOIN (SELECT DISTINCT node_id FROM sigs) s ON s.node_id = n.node GROUP BY m.node_id""")
def h7(spark, d):
    v = views(spark, d)
    now = as_of(v, spark, d)
    sources = active(v["mutations"], now, WEEK).select(F.col("node_id").alias("source"))
    signaled = active(v["signals"], now, WEEK).select(F.col("node_id").alias("node"))
    return paths.blast_radius(v["edges"], sources, signaled).withColumn("share", F.round("share", 6))


@query("h8_latent_parents", """WITH n AS (SELECT concat('s', s_suppkey) AS id, CASE WHEN s_suppkey % 3 > 0 THEN concat('rack', s_suppkey % 4) END AS rack, CASE WHEN s_suppkey % 2 = 0 THEN concat('z', s_nationkey) END AS zone FROM supplier)
SELECT 'latent://tor/' || rack AS parent, id AS child, 'ToRSwitch' AS class FROM n WHERE rack IS NOT NULL UNION ALL SELECT 'latent://zone/' || zone, id, 'AvailabilityZone' FROM n WHERE zone IS NOT NULL""")
def h8(spark, d):
    zone = F.expr("case when s_suppkey % 2 = 0 then map('zone', concat('z', s_nationkey)) else cast(map() as map<string,string>) end")
    nodes = spark.read.parquet(f"{d}/supplier.parquet").select(F.expr("concat('s', s_suppkey)").alias("id"), F.lit("x").alias("region"), F.expr("case when s_suppkey % 3 > 0 then concat('rack', s_suppkey % 4) end").alias("rack_id"), zone.alias("properties"))
    new_nodes, new_edges = graph.latent_parents(nodes)
    return new_edges.join(new_nodes.select(F.col("id").alias("source_id"), "class"), "source_id").select(F.col("source_id").alias("parent"), F.col("target_id").alias("child"), "class")


@query("h9_template_graph", """WITH r AS (SELECT concat('p', p_partkey) AS id, concat('p', p_partkey * 2) AS dep, concat('a', p_size) AS app FROM part),
e AS (SELECT dep AS source_id, id AS target_id, 'dependency' AS edge_type FROM r UNION ALL SELECT app, id, 'containment' FROM r)
SELECT e.*, CASE WHEN source_id IN (SELECT id FROM r) THEN 'box' ELSE 'External' END AS source_class FROM e""")
def h9(spark, d):
    none = "cast(null as array<string>) as connections"
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('p', p_partkey) as id", "p_name as name", "'app/box' as type", "'x' as location", "array(concat('p', p_partkey * 2)) as depends_on", none, "concat('a', p_size) as application", "cast(null as string) as environment")
    nodes, edges = graph.template_graph(rows)
    return edges.join(nodes.select(F.col("id").alias("source_id"), F.col("class").alias("source_class")), "source_id").select("source_id", "target_id", "edge_type", "source_class")
