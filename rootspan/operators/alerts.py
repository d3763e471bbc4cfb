"""Alerts, rules and incident groups on top of diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootspan.functions.classify import cause_label, cause_type, target_label
from rootspan.scratch import materialize


def alerts(diagnoses: DataFrame, signals: DataFrame) -> DataFrame:
    """Diagnoses (with no threshold) as alerts: also the sources that reported; in no order."""
    sources = signals.select("node_id", F.try_element_at("properties", F.lit("source")).alias("s")).groupBy(F.col("node_id").alias("target_node")).agg(F.sort_array(F.collect_set("s")).alias("sources"))
    return diagnoses.join(sources, "target_node", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def match_rules(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """``alerts`` with ``rule_no``, ``action`` (normal where no rule fits) and ``reason`` of the first rule whose given fields all fit.

    signal_type: one of the alert's; class: the node's; source: one of the signals'; pattern: found
    in the node id; confidence bounds inclusive. Rules are a small hand-written list: it comes to each alert
    as one array, in its order, so alerts are not shuffled.
    """
    fields = ["rule_no", "action", "reason", "signal_type", "class", "source", "pattern", "min_confidence", "max_confidence"]
    listed = rules.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules"))

    def fits(r: Column) -> Column:
        return (
            (r["signal_type"].isNull() | F.array_contains(F.col("signal_types"), r["signal_type"]))
            & (r["class"].isNull() | (r["class"] == F.col("class")))
            & (r["source"].isNull() | F.array_contains(F.col("sources"), r["source"]))
            & (r["pattern"].isNull() | F.rlike(F.col("target_node"), r["pattern"]))
            & (r["min_confidence"].isNull() | (F.col("confidence") >= r["min_confidence"]))
            & (r["max_confidence"].isNull() | (F.col("confidence") <= r["max_confidence"]))
        )

    first = F.try_element_at(F.filter("_rules", fits), F.lit(1))
    out = alerts.join(F.broadcast(listed), how="cross").withColumn("_rule", first)  # one row
    return out.select(*alerts.columns, F.col("_rule.rule_no").alias("rule_no"), F.coalesce("_rule.action", F.lit("normal")).alias("action"), F.col("_rule.reason").alias("reason"))


def suppress(alerts: DataFrame, types: DataFrame) -> DataFrame:
    """Alerts with at least one signal type that is not in ``types`` (column signal_type)."""
    hidden = types.agg(F.coalesce(F.collect_set("signal_type"), F.array().cast("array<string>")).alias("_hidden"))
    return alerts.join(hidden).where(F.size(F.array_except("signal_types", "_hidden")) > 0).drop("_hidden")


def split_low(alerts: DataFrame) -> DataFrame:
    """``alerts`` with ``priority``: low for rule action low, else normal."""
    return alerts.withColumn("priority", F.when(F.col("action") == "low", "low").otherwise("normal"))


def alert_members(alerts: DataFrame) -> DataFrame:
    """Alerts that are shown, each with its group: the root cause, or ``unknown``."""
    return alerts.where("action <> 'suppress'").withColumn("group", F.coalesce("root_cause", F.lit("unknown")))


def alert_groups(alerts: DataFrame, nested: bool = False) -> DataFrame:
    """One row a root cause: ``root_cause, confidence, count, signal_types, causal_path, latest_signal`` and, nested, ``affected_nodes, members``.

    count is the alerts. Without nesting a group is aggregates alone, whatever its size; its members are those of ``alert_members``.
    """
    order = F.struct((-F.col("confidence")).alias("o"), F.col("target_node"))
    wide = [F.sort_array(F.collect_set("target_node")).alias("affected_nodes"), F.array_sort(F.collect_list(F.struct("target_node", "confidence", "signal_types"))).alias("members")]
    exploded = alert_members(alerts)
    out = exploded.groupBy(F.col("group").alias("root_cause")).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("count"), F.sum("n_signals").alias("n_signals"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signal_types")))).alias("signal_types"),
        F.min_by("causal_path", order).alias("causal_path"), F.max("timestamp").alias("latest_signal"), *(wide if nested else []),
    )
    return out.orderBy(F.desc("confidence"), "root_cause")


def group_pages(alerts: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Members of incident groups in pages: ``root_cause, page, rows, members``, most likely first, at most ``page_rows`` a row.

    Members are numbered by a sort over all groups: each task numbers what it holds of a group, and the counts of the tasks before it, a
    row a task and group, tell where it begins. So a group that holds a third of all alerts is the work of as many tasks as it fills.
    """
    order = [F.col("group"), F.col("negative"), F.col("target_node")]
    rows = alert_members(alerts).select("group", (-F.col("confidence")).alias("negative"), "target_node", "confidence", "signal_types")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    held = sorted_.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = materialize(held.select("group", "part", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("shift")), "held")
    numbered = sorted_.join(held, ["group", "part"]).withColumn("number", F.col("at") - F.col("shift"))
    paged = numbered.groupBy("group", F.floor(F.col("number") / F.lit(page_rows)).cast("long").alias("page"))
    out = paged.agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("number", "target_node", "confidence", "signal_types"))).alias("m"))
    member = lambda x: F.struct(x["target_node"].alias("target_node"), x["confidence"].alias("confidence"), x["signal_types"].alias("signal_types"))
    return out.select(F.col("group").alias("root_cause"), "page", "rows", F.transform("m", member).alias("members"))


def filter_alerts(alerts: DataFrame, node_class: str | None = None, signal_type: str | None = None, by: str = "confidence") -> DataFrame:
    """Alerts of a class and with a signal type, newest (by='time') or most likely first."""
    keep: Column = F.lit(True)
    if node_class is not None:
        keep = keep & (F.col("class") == node_class)
    if signal_type is not None:
        keep = keep & F.array_contains("signal_types", signal_type)
    return alerts.where(keep).orderBy(F.desc("timestamp" if by == "time" else "confidence"), "target_node")


def group_by_signal_type(alerts: DataFrame) -> DataFrame:
    """The plain grouping by symptom: ``signal_type, alerts, causes``."""
    flat = alerts.select("root_cause", "target_node", F.explode("signal_types").alias("signal_type"))
    return flat.groupBy("signal_type").agg(F.countDistinct("target_node").alias("alerts"), F.countDistinct(F.coalesce("root_cause", F.lit("unknown"))).alias("causes"))


def group_report(groups: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Groups from ``min_confidence`` on with label and type of their cause, most likely first."""
    shown = groups.where(F.col("confidence") >= min_confidence)
    return shown.select(
        cause_label(F.col("root_cause")).alias("cause"), cause_type(F.col("root_cause")).alias("cause_type"), F.round("confidence", 4).alias("confidence"), "count",
        F.array_join("signal_types", ", ").alias("signals"), F.array_join("causal_path", " -> ").alias("path"), F.col("latest_signal"), "root_cause",
    ).orderBy(F.desc("confidence"), "root_cause")


def diagnosis_report(diagnoses: DataFrame, min_confidence: float = 0.5, limit: int = 20, competing: int = 2) -> DataFrame:
    """The ``limit`` most likely diagnoses as text rows, with the first ``competing`` rivals."""
    rivals = F.slice("competing_causes", 2, competing)
    text = F.array_join(F.transform(rivals, lambda x: F.concat(x["cause"], F.lit(" "), F.format_number(x["confidence"], 2))), "; ")
    return diagnoses.where(F.col("confidence") >= min_confidence).select(
        target_label(F.col("target_node")).alias("target"), cause_label(F.col("root_cause")).alias("cause"), F.round("confidence", 4).alias("confidence"), text.alias("competing"), "target_node"
    ).orderBy(F.desc("confidence"), "target_node").limit(limit)
