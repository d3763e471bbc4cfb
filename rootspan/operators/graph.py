"""Set operations on graphs (node and edge tables), islands, and exports for drawing."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rootspan.operators.components import connected_components
from rootspan.operators.inference import DAY, active
from rootspan.operators.paths import ancestors, inner_edges
from rootspan.schema import EDGE_TYPES
from rootspan.scratch import materialize, materialize_counted
from rootspan.sources.positions import positioned

EDGE_KEY = ["source_id", "target_id", "edge_type"]
#: Fixed values.
REPRESENTATIVE_CLASSES = ["CIPipeline", "AKSCluster", "VirtualMachine", "ResourceGroup"]
EDGE_STYLES = {"containment": "solid", "dependency": "dashed", "connection": "dotted"}
CLASS_COLORS = {
    "ToRSwitch": "lightcoral", "AvailabilityZone": "lightcoral", "PowerDomain": "lightcoral",
    "Container": "lightblue", "VirtualMachine": "lightblue", "ManagedIdentity": "lightyellow", "KeyVault": "lightyellow",
}


def edge_type_of(c: Column) -> Column:
    """Known edge types in lower case, anything else a dependency."""
    return F.when(F.lower(c).isin(EDGE_TYPES), F.lower(c)).otherwise("dependency")


def dedupe_nodes(nodes: DataFrame, order_col: str) -> DataFrame:
    """The last row of each id."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), order_col).alias("r")).select("id", "r.*").select(*nodes.columns)


def dedupe_edges(edges: DataFrame, order_col: str) -> DataFrame:
    """The first row of each (source, target, type)."""
    rest = [c for c in edges.columns if c not in EDGE_KEY]
    return edges.groupBy(*EDGE_KEY).agg(F.min_by(F.struct(*rest), order_col).alias("r")).select(*EDGE_KEY, "r.*").select(*edges.columns)


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: edges whose two ends exist, and the others."""
    ids = nodes.select("id").distinct()
    marked = edges.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    known = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    return marked.where(known).select(*edges.columns), marked.where(~known).select(*edges.columns)


def merge_graphs(*graphs: tuple[DataFrame, DataFrame], order_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, dangling)`` of several graphs: later values win field by field, absent (null) ones don't count.

    properties are merged key by key, a later key wins; a later null value counts. Later means a later graph, and inside
    one a greater ``order_col`` of its tables, which is not kept; without that the place in the input (``input_position``).
    First edge per key, no dangling ones.
    """
    def numbered(df: DataFrame, i: int) -> DataFrame:
        rows = positioned(df, "_place", order_col)
        rows = rows.drop(order_col) if order_col else rows
        return rows.withColumn("_seq", F.struct(F.lit(i).alias("g"), F.col("_place").alias("r"))).drop("_place")

    nodes = materialize(reduce(DataFrame.unionByName, [numbered(n, i) for i, (n, _) in enumerate(graphs)]), "nodes")
    edges = materialize(reduce(DataFrame.unionByName, [numbered(e, i) for i, (_, e) in enumerate(graphs)]), "edges")
    fields = [c for c in nodes.columns if c not in ("id", "_seq", "properties")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in fields]
    merged = nodes.groupBy("id").agg(*newest)
    keys = nodes.select("id", "_seq", F.explode("properties").alias("key", "value")).groupBy("id", "key").agg(F.max_by(F.struct("value"), "_seq").alias("v"))
    props = keys.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v.value")))).alias("properties"))
    columns = [c for c in nodes.columns if c != "_seq"]
    out = materialize(merged.join(props, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>"))).select(*columns), "nodes")
    kept, dropped = drop_dangling(out, dedupe_edges(edges, "_seq").drop("_seq"))
    return out, kept, dropped


def merge_into(base: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, counts)`` of adding ``new``: known nodes stay as they are, an edge is added if its key is new and both ends are known.

    Repeats inside ``new`` are added once (any of the rows). counts: one row, new_nodes and new_edges.
    """
    nodes, edges = base
    fresh = materialize(new[0].dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns), "nodes")
    all_nodes = nodes.unionByName(fresh)
    typed = new[1].withColumn("edge_type", edge_type_of(F.col("edge_type")))
    linked, _ = drop_dangling(all_nodes, typed.dropDuplicates(EDGE_KEY))
    added = materialize(linked.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*edges.columns), "edges")
    counts = fresh.agg(F.count("*").alias("new_nodes")).join(added.agg(F.count("*").alias("new_edges")))
    return all_nodes, edges.unionByName(added), counts


def load_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with edge types normalized; an edge to an unknown node is an error."""
    kept, dropped = drop_dangling(nodes, edges)
    bad = dropped.take(1)
    if bad:
        raise ValueError(f"edge {bad[0]['source_id']} -> {bad[0]['target_id']}: unknown node")
    return nodes, kept.withColumn("edge_type", edge_type_of(F.col("edge_type")))


def _follow(single: DataFrame) -> DataFrame:
    """``(v, p, endless)`` of pointers (v, p): p where each one's chain ends; endless where it never does, on a cycle of pointers or below one.

    Jumps double. While chains that end are left, each jump shortens some, so when none grows shorter the rest are endless.
    """
    ptr, before = materialize(single.select("v", "p"), "pointers"), -1
    while True:
        up = ptr.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        seen = Observation()
        jumped = ptr.select("v", "p").join(up, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p"), F.col("_v").isNotNull().alias("endless"))
        ptr = materialize(jumped.observe(seen, F.coalesce(F.sum(F.col("endless").cast("long")), F.lit(0)).alias("n")), "pointers")
        if seen.get["n"] in (0, before):
            return ptr
        before = seen.get["n"]


def stuck_nodes(links: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node``: what lies on a cycle of ``links`` (s, t; distinct, no nulls) or below one.

    A node with a single parent shares its parent's fate: chains and trees of such nodes fold into one node in a logarithmic number of jumps,
    and one that never ends has a cycle. Then parentless nodes are peeled off, what an end of a found cycle leads to is marked, and
    the folded graph goes on. When nothing changes, every node left has parents that are left: all of them are stuck. Rounds follow the depth only
    where layers of nodes with several parents lie above one another.
    """
    links, n = materialize_counted(links, "links")
    home = materialize(links.select(F.explode(F.array("s", "t")).alias("node")).distinct().withColumn("rep", F.col("node")), "home")
    stuck, spread = [], links.sparkSession.createDataFrame([], links.select(F.col("t").alias("v")).schema)
    for _ in range(max_rounds):
        if not n:
            break
        single = links.groupBy("t").agg(F.count("*").alias("k"), F.min("s").alias("p")).where("k = 1").select(F.col("t").alias("v"), "p")
        ptr = _follow(single)
        endless, folded = ptr.where("endless").select("v"), ptr.where("not endless").select("v", "p")
        home = home.join(folded, home["rep"] == folded["v"], "left").select("node", F.coalesce("p", "rep").alias("rep"))
        home = materialize(home, "home")
        several = links.join(ptr.select(F.col("v").alias("t")), "t", "left_anti").join(folded.select(F.col("v").alias("s"), "p"), "s", "left").select(F.coalesce("p", "s").alias("s"), "t").distinct()
        several = materialize(several, "links")
        found = spread.unionByName(endless)
        marked = materialize(several.join(found.select(F.col("v").alias("s")), "s", "left_semi").select(F.col("t").alias("v")).distinct(), "marked")
        stuck += [endless, marked]
        # a single child of something marked before has been folded into it and shares its name
        left = several.join(marked.select(F.col("v").alias("t")), "t", "left_anti")
        own = several.select(F.col("t").alias("s")).distinct()
        before, (links, n) = n, materialize_counted(left.join(own, "s", "left_semi"), "links")
        spread = marked
        if n == before and not marked.take(1):
            stuck.append(links.select(F.col("t").alias("v")).distinct())
            break
    else:
        raise ValueError(f"the graph did not settle in {max_rounds} rounds")
    every = reduce(DataFrame.unionByName, stuck).select(F.col("v").alias("rep")).distinct() if stuck else home.select("rep").where("false")
    return home.join(every, "rep", "left_semi").select("node")


def break_cycles(edges: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: nodes without incoming edges are peeled off until none is left; edges inside the rest go.

    The rest are the cycles and what lies below them (``stuck_nodes``). Every edge is in one of the two tables, those with null ends
    or type too; a null end is in no cycle.
    """
    links = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).where("s is not null and t is not null").distinct()
    stuck = materialize(stuck_nodes(links, max_rounds).select(F.col("node").alias("_stuck")), "stuck")
    marked = edges.join(stuck.select(F.col("_stuck").alias("_s")), F.col("source_id") == F.col("_s"), "left").join(stuck.select(F.col("_stuck").alias("_t")), F.col("target_id") == F.col("_t"), "left")
    inside = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    return marked.where(~inside).select(*edges.columns), marked.where(inside).select(*edges.columns)


def node_status(nodes: DataFrame, signals: DataFrame, mutations: DataFrame, as_of: datetime | Column, window_s: float = DAY) -> DataFrame:
    """``nodes`` with ``status``: alert (signal and change), signal, mutation or normal inside the window."""
    def ids(df: DataFrame, name: str) -> DataFrame:
        return active(df, as_of, window_s).select(F.col("node_id").alias("id"), F.lit(True).alias(name)).distinct()

    out = nodes.join(ids(signals, "_s"), "id", "left").join(ids(mutations, "_m"), "id", "left")
    s, m = F.col("_s").isNotNull(), F.col("_m").isNotNull()
    return out.withColumn("status", F.when(s & m, "alert").when(s, "signal").when(m, "mutation").otherwise("normal")).select(*nodes.columns, "status")


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, island)``: weakly connected parts of the graph, named by their smallest node id; a node alone is one."""
    linked = connected_components(edges, "source_id", "target_id")
    out = nodes.select(F.col("id").alias("node")).distinct().join(linked, "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("island"))


def island_summary(nodes: DataFrame, edges: DataFrame, signals: DataFrame, mutations: DataFrame, as_of: datetime | Column, window_s: float = DAY) -> DataFrame:
    """``island, nodes, classes, alerts, signals, mutations, representative``, most alerts and largest first.

    representative: the smallest node id of a representative class, else of any.
    """
    parts = node_status(nodes, signals, mutations, as_of, window_s).join(islands(nodes, edges).withColumnRenamed("node", "id"), "id")
    def counted(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, 1).otherwise(0))

    pick = F.struct(F.when(F.col("class").isin(REPRESENTATIVE_CLASSES), 0).otherwise(1).alias("o"), F.col("id"))
    out = parts.groupBy("island").agg(
        F.count("*").alias("nodes"), F.sort_array(F.collect_set("class")).alias("classes"), counted("alert").alias("alerts"),
        counted("signal").alias("signals"), counted("mutation").alias("mutations"), F.min(pick).alias("pick"),
    )
    return out.select("island", "nodes", "classes", "alerts", "signals", "mutations", F.col("pick.id").alias("representative")).orderBy(F.desc("alerts"), F.desc("nodes"), "island")


def alert_subgraph(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, signals: DataFrame, as_of: datetime | Column, window_s: float = DAY, max_children: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, inner)``: around each signaled node (the cluster) itself, the paths from changed ancestors, its parents and up to ``max_children`` children.

    members: (cluster, node) with each node in its first cluster by id; changed nodes of no cluster
    form clusters of their own. inner: the edges between members, whatever their clusters.
    """
    changed = active(mutations, as_of, window_s).select(F.col("node_id").alias("node")).distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    targets = active(signals, as_of, window_s).select(F.col("node_id").alias("target")).distinct().join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    targets, changed = materialize(targets, "targets"), materialize(changed, "changed")
    up = ancestors(edges, targets)
    paths = up.join(changed.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("target", F.explode("path").alias("node"))
    parents = up.where("hops = 1").select("target", F.col("ancestor").alias("node"))
    children = edges.select(F.col("source_id").alias("target"), F.col("target_id").alias("node")).distinct().join(targets, "target", "left_semi")
    children = children.selectExpr("target", "node", "row_number() over (partition by target order by node) as k").where(F.col("k") <= max_children).drop("k")
    own = targets.select("target", F.col("target").alias("node"))
    parts = reduce(DataFrame.unionByName, [own, paths, parents, children, changed.select(F.lit(None).cast("string").alias("target"), "node")])
    members = parts.groupBy("node").agg(F.coalesce(F.max(F.when(F.col("target") == F.col("node"), F.col("node"))), F.min("target"), F.max("node")).alias("cluster"))
    members = materialize(members.select("cluster", "node"), "members")
    inner = inner_edges(edges, members.select(F.lit(0).alias("all"), "node"), "all").drop("all")
    return members, inner


def graph_elements(nodes: DataFrame, edges: DataFrame, signals: DataFrame, mutations: DataFrame, as_of: datetime | Column, window_s: float = DAY, island: str | None = None) -> DataFrame:
    """``(kind, id, island, element)``: a JSON element for each node and edge, with status and island."""
    parts = islands(nodes, edges)
    rows = node_status(nodes, signals, mutations, as_of, window_s).join(parts.withColumnRenamed("node", "id"), "id")
    first = rows.select(F.lit("node").alias("kind"), "id", "island", F.to_json(F.struct("id", "label", "class", "region", "status", "island")).alias("element"))
    links = edges.join(parts.withColumnRenamed("node", "source_id"), "source_id")
    second = links.select(F.lit("edge").alias("kind"), "id", "island", F.to_json(F.struct("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "edge_type")).alias("element"))
    out = first.unionByName(second)
    return out if island is None else out.where(F.col("island") == island)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(line)``: node and edge statements of a drawing: label and class, color by class, style and label by edge type."""
    def chosen(column: str, values: dict[str, str], other: str) -> Column:
        return reduce(lambda acc, kv: F.when(F.col(column) == kv[0], kv[1]).otherwise(acc), values.items(), F.lit(other))

    quoted = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r'(["\\])', r"\\$1")
    first = nodes.select(F.format_string('  "%s" [label="%s\\n[%s]" style=filled fillcolor="%s"];', quoted("id"), quoted("label"), quoted("class"), chosen("class", CLASS_COLORS, "white")).alias("line"))
    second = edges.select(F.format_string('  "%s" -> "%s" [style=%s label="%s"];', quoted("source_id"), quoted("target_id"), chosen("edge_type", EDGE_STYLES, "dashed"), F.initcap(edge_type_of(F.col("edge_type")))).alias("line"))
    return first.unionByName(second)


def latent_parents(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new_nodes, new_edges)``: a shared parent for all nodes of a rack, zone, power domain, subnet or platform.

    Read from rack_id and the properties zone, power_domain, subnet and platform; unknown ones are skipped.
    """
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    kinds = [("tor", "ToRSwitch", F.col("rack_id")), ("zone", "AvailabilityZone", prop("zone")), ("power", "PowerDomain", prop("power_domain")), ("subnet", "SubnetGateway", prop("subnet")), ("platform", "Platform", prop("platform"))]
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("class"), v.alias("name")) for k, c, v in kinds])
    rows = nodes.select("id", "region", F.explode(F.filter(found, lambda x: x["name"].isNotNull() & (x["name"] != ""))).alias("p"))
    rows = rows.select("id", "region", F.concat(F.lit("latent://"), "p.kind", F.lit("/"), "p.name").alias("parent"), "p.class", "p.name")
    none = F.create_map().cast("map<string,string>")
    new_nodes = rows.groupBy("parent").agg(F.first("class").alias("class"), F.first("name").alias("name"), F.min("region").alias("region"))
    new_nodes = new_nodes.select(F.col("parent").alias("id"), F.col("name").alias("label"), "class", "region", F.lit(None).cast("string").alias("rack_id"), none.alias("properties"))
    new_edges = rows.select(F.concat(F.lit("edge-"), "parent", F.lit("-"), "id").alias("id"), F.col("parent").alias("source_id"), F.col("id").alias("target_id"), F.lit("containment").alias("edge_type"), none.alias("properties"))
    return new_nodes, new_edges


def template_graph(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a deployment template.

    resources: id, name, type, location, depends_on array<string>, connections array<string>,
    application, environment. What a resource depends on, its application and environment cause
    it; a connection leads from its source to the resource. References to ids that the template
    does not hold become nodes of class External.
    """
    none = F.create_map().cast("map<string,string>")
    refs = F.array_union(
        F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: F.struct(x.alias("ref"), F.lit("dependency").alias("t"))),
        F.transform(F.coalesce("connections", F.array().cast("array<string>")), lambda x: F.struct(x.alias("ref"), F.lit("connection").alias("t"))),
    )
    owners = F.array(F.struct(F.col("application").alias("ref"), F.lit("containment").alias("t")), F.struct(F.col("environment").alias("ref"), F.lit("containment").alias("t")))
    links = resources.select("id", F.explode(F.filter(F.concat(refs, owners), lambda x: x["ref"].isNotNull() & (x["ref"] != ""))).alias("r"))
    edges = links.select(F.concat(F.lit("edge-"), "r.ref", F.lit("-"), "id").alias("id"), F.col("r.ref").alias("source_id"), F.col("id").alias("target_id"), F.col("r.t").alias("edge_type"), none.alias("properties"))
    known = resources.select("id", F.col("name").alias("label"), F.element_at(F.split("type", "/"), -1).alias("class"), F.col("location").alias("region"), F.lit(None).cast("string").alias("rack_id"), none.alias("properties"))
    missing = edges.select(F.col("source_id").alias("id")).distinct().join(known, "id", "left_anti")
    outside = missing.select("id", F.col("id").alias("label"), F.lit("External").alias("class"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("rack_id"), none.alias("properties"))
    return known.unionByName(outside), edges


def overview(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, signals: DataFrame, cpts: DataFrame) -> DataFrame:
    """One row: counts of all tables and the number of classes."""
    counts = [nodes.agg(F.count("*").alias("nodes"), F.countDistinct("class").alias("classes"))]
    counts += [df.agg(F.count("*").alias(name)) for df, name in ((edges, "edges"), (mutations, "mutations"), (signals, "signals"), (cpts, "cpts"))]
    return reduce(lambda a, b: a.join(b), counts)
