"""Reading and writing graphs, events, knowledge layers, rules, snapshots and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.operators.graph import edge_type_of
from rootspan.operators.inference import DAY, active
from rootspan.schema import EDGES, LAYERS, MUTATIONS, NODES, PAYLOAD, RULES, SIGNALS
from rootspan.scratch import materialize
from rootspan.sources.documents import read_elements
from rootspan.sources.positions import input_position
from rootspan.sources.versions import read_version, save_version


def read_graph_payload(spark: SparkSession, path: str | list[str], lines: bool = False, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of JSON documents with two arrays, one document a file, or one a line; absent fields are null.

    position: name of a further column with each row's place in the input, for ``merge_graphs`` and the like.
    """
    payload = spark.read.schema(PAYLOAD).option("multiLine", str(not lines).lower()).json(path)
    if position is None:
        return payload.select(F.inline("nodes")), payload.select(F.inline("edges")).withColumn("edge_type", edge_type_of(F.col("edge_type")))
    placed = [payload.select(input_position(payload).alias("_at"), F.posexplode(name).alias("_no", "_row")).select("_row.*", F.struct("_at", "_no").alias(position)) for name in ("nodes", "edges")]
    return placed[0], placed[1].withColumn("edge_type", edge_type_of(F.col("edge_type")))


def read_large_payload(spark: SparkSession, path: str | list[str], position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of JSON documents of any size, each read by many tasks; otherwise as ``read_graph_payload``, for one document a file or several."""
    elements = materialize(read_elements(spark, path), "elements")
    place = [] if position is None else [F.struct("file", "no").alias(position)]
    out = []
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        rows = elements.where(F.col("name") == name).select(F.from_json("text", schema).alias("row"), *place)
        out.append(rows.select("row.*", *([position] if position else [])))
    return out[0], out[1].withColumn("edge_type", edge_type_of(F.col("edge_type")))


def write_graph_payload(nodes: DataFrame, edges: DataFrame, path: str, layout: str = "json", document_rows: int = 10_000) -> None:
    """A graph below ``path``. json: documents with two arrays, one a line, that ``read_graph_payload`` reads (``lines=True``); any other layout: a table each.

    A document holds about ``document_rows`` nodes or edges, dealt out by their ids, so none grows with the graph.
    """
    if layout != "json":
        for name, df in (("nodes", nodes), ("edges", edges)):
            df.write.mode("overwrite").format(layout).save(f"{path}/{name}")
        return
    parts = []
    for name, df, schema in (("nodes", nodes, NODES), ("edges", edges, EDGES)):
        have = set(df.columns)
        fields = [f.split(" ", 1) for f in schema.split(", ")]
        row = F.struct(*[(F.col(f) if f in have else F.lit(None)).cast(t).alias(f) for f, t in fields])
        documents = max(1, -(-df.count() // document_rows))
        parts.append(df.select(F.pmod(F.xxhash64("id"), F.lit(documents)).alias("document"), row.alias("row")).groupBy("document").agg(F.collect_list("row").alias(name)))
    parts[0].join(parts[1], "document", "full").drop("document").write.mode("overwrite").json(path)


def evict_expired(tables: dict[str, DataFrame], as_of: datetime | Column, window_s: float = DAY) -> dict[str, DataFrame]:
    """``tables`` with the mutations and signals that are no older than the window; ``window_s`` below zero clears them (later events stay)."""
    return tables | {name: active(tables[name], as_of, window_s) for name in ("mutations", "signals")}


def save_snapshot(tables: dict[str, DataFrame], path: str, as_of: datetime | Column, window_s: float = DAY, keep: int = 2) -> int:
    """Graph and active events as the next version of the four tables below ``path``; its number.

    Nobody sees it before all four are written: a save that fails leaves the version before as it was. ``keep`` versions stay.
    """
    events = {name: active(tables[name], as_of, window_s) for name in ("mutations", "signals")}
    spark = tables["nodes"].sparkSession
    return save_version(spark, path, {name: tables[name] for name in ("nodes", "edges")} | events, keep)


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of the last snapshot that was saved whole; unknown edge types are dependencies."""
    out = read_version(spark, path, {"nodes": NODES, "edges": EDGES, "mutations": MUTATIONS, "signals": SIGNALS})
    return out | {"edges": out["edges"].withColumn("edge_type", edge_type_of(F.col("edge_type")))}


def normalize_events(df: DataFrame, kind: str, as_of: Column, source: str = "api") -> DataFrame:
    """``df`` in the shape of mutations or signals: missing ids are made up, missing times ``as_of``, a missing source ``source``.

    Text times are parsed, unreadable ones count as missing. Missing columns are null; properties stay.
    """
    have = set(df.columns)
    def col(name: str, kind_: str = "string") -> Column:
        return F.col(name).cast(kind_) if name in have else F.lit(None).cast(kind_)

    given = F.col("timestamp") if "timestamp" in have else F.lit(None).cast("timestamp")
    at = F.try_to_timestamp(given) if dict(df.dtypes).get("timestamp") == "string" else given.cast("timestamp")
    head = [F.coalesce(F.nullif(col("id"), F.lit("")), F.uuid()).alias("id"), F.coalesce(col("node_id"), F.lit("")).alias("node_id")]
    properties = F.coalesce(F.col("properties") if "properties" in have else F.lit(None), F.create_map()).cast("map<string,string>").alias("properties")
    when = F.coalesce(at, as_of).alias("timestamp")
    if kind == "mutations":
        return df.select(*head, F.coalesce(col("mutation_type"), F.lit("")).alias("mutation_type"), F.coalesce(col("source"), F.lit(source)).alias("source"), when, properties)
    return df.select(*head, F.coalesce(col("signal_type"), F.lit("")).alias("signal_type"), col("value", "double").alias("value"), col("severity").alias("severity"), when, properties)


def _yaml(spark: SparkSession, path: str):
    import yaml

    return yaml.safe_load(_text(spark, path)) or []


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text, from wherever Spark's readers reach."""
    return spark.read.text(path, wholetext=True).first()["value"]


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def _layer_rows(layer_no: int, classes: list[dict]) -> list[tuple]:
    rows = []
    for class_pos, entry in enumerate(classes):
        prior = entry.get("default_prior") or {}
        p, half = prior.get("P_failure"), prior.get("decay_half_life_minutes")
        head = (entry["class"], None if p is None else float(p), None if half is None else float(half))
        rows.append((layer_no, class_pos, -1, *head, None, None, None, None))
        for cpt_pos, c in enumerate(entry.get("cpts") or []):
            rows.append((layer_no, class_pos, cpt_pos, entry["class"], None, None, c["mutation"], c["signal"], float(c["table"][0][0]), float(c["table"][0][1])))
    return rows


def load_cpt_layers(spark: SparkSession, manifest: str) -> DataFrame:
    """Knowledge layers of a YAML manifest (or the one layer of a flat list) for ``merge_cpt_layers``.

    Paths are relative to the manifest. A missing optional layer is skipped, a missing required one an error.
    """
    data = _yaml(spark, manifest)
    if isinstance(data, list):
        return spark.createDataFrame(_layer_rows(0, data), LAYERS)
    rows: list[tuple] = []
    for no, layer in enumerate(data.get("layers") or []):
        path = f"{manifest.rpartition('/')[0] or '.'}/{layer['path']}"
        try:
            rows += _layer_rows(no, _yaml(spark, path))
        except AnalysisException as error:
            if not _missing(error):
                raise
            if not layer.get("optional"):
                raise FileNotFoundError(f"required layer {path}") from error
    return spark.createDataFrame(rows, LAYERS)


def load_alert_rules(spark: SparkSession, path: str) -> DataFrame:
    """Ordered alert rules of a YAML file; no file, no rules."""
    try:
        listed = dict(_yaml(spark, path)).get("rules") or []
    except AnalysisException as error:
        if not _missing(error):
            raise
        listed = []
    number = lambda r, k: None if r.get(k) is None else float(r[k])
    rows = [(i, r.get("signal_type"), r.get("class"), r.get("source"), r.get("pattern"), number(r, "min_confidence"), number(r, "max_confidence"), r.get("action", "normal"), r.get("reason", "")) for i, r in enumerate(listed)]
    return spark.createDataFrame(rows, RULES)


def write_report(df: DataFrame, path: str, layout: str = "json") -> None:
    """A report table as json, csv or parquet; nested columns become JSON text in csv."""
    flat = [F.to_json(c).alias(c) if layout == "csv" and t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").format(layout).save(path)
