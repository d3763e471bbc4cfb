"""Diagnoses from keyed state: each node's evidence in the state store, the closure as a table, the latest diagnosis of each node as another.

Signals and changes go to the state of their node, which keeps the latest time of each type and lets it go when the watermark
passes. A signal also asks: its node, and by the closure all that lies upstream of it, give out what they know. So a batch
costs its own events and the ancestors of the nodes it touches, however many changes have come before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from rootspan.operators.inference import DAY, rank_order, scored
from rootspan.schema import DEFAULT_P_FAILURE
from rootspan.scratch import materialize
from rootspan.sources.versions import KeyedTable

#: The key that stands for all nodes: when a signal and a change came last, anywhere.
ANYWHERE = "\x00any"
ROW = "node string, kind string, what string, id string, at timestamp"
TOLD = "node string, kind string, what string, id string, us bigint"
DIAGNOSES = "target_node string, confidence double, root_cause string, causal_path array<string>, timestamp timestamp, class string, as_of timestamp, batch_no long"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of what a task has read, the latest event of each node, kind and type, and one question a node: little of a hub's rows is shuffled."""
    for rows in batches:
        rows = rows[rows["node"].notna() & rows["at"].notna()]
        events = rows[rows["kind"] != "ask"]
        last = events.assign(node=ANYWHERE, what="", id="").drop_duplicates(["kind", "at"])
        told = pd.concat([events, last]).sort_values(["at", "id"], ascending=[False, True], kind="stable").drop_duplicates(["node", "kind", "what"])
        asked = rows[rows["kind"] == "ask"].sort_values("at", ascending=False, kind="stable").drop_duplicates("node")
        general = asked.head(1).assign(node=ANYWHERE)
        yield pd.concat([told, asked, general])


class NodeEvidence(StatefulProcessor):
    """State of a node: for each kind (signal, change) and type the latest time, with the smallest id at it.

    All of it is one value, with the time of the node's timer, so that a node costs one look into the store and, if it has learned
    something, one write; a timer is set when there is none or one that is too late, and else left until it fires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "kinds array<string>, whats array<string>, ids array<string>, ats array<bigint>, wake bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, touched, changed = False, None, False
        known, wake = self._known()
        for row in rows:
            if row.kind == "ask":
                asked = True
                continue
            if row.kind == "signal":
                touched = row.us if touched is None else max(touched, row.us)
            was = known.get((row.kind, row.what))
            if was is None or (-row.us, row.id) < (-was[0], was[1]):
                known[row.kind, row.what] = (row.us, row.id)
                changed = True
        if changed:
            self._keep(known, wake)
        if asked:
            for (kind, what), (us, event) in known.items():
                yield Row(node=key[0], kind=kind, what=what, id=event, us=us)
            if touched is not None:
                yield Row(node=key[0], kind="touched", what="", id="", us=touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark stands a window before the latest event: what is older can count no more."""
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        known, _ = self._known()
        known = {own: value for own, value in known.items() if value[0] >= limit}
        if known:
            self._keep(known, None)
        else:
            self.latest.clear()
        return iter([])

    def _known(self) -> tuple[dict, int | None]:
        value = self.latest.get()
        if value is None:
            return {}, None
        kinds, whats, ids, ats, wake = value
        return dict(zip(zip(kinds, whats), zip(ats, ids))), wake

    def _keep(self, known: dict, wake: int | None) -> None:
        first = min(us for us, _ in known.values()) // 1000 + 1
        if wake is None or first < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            wake = first
        self.latest.update(([k for k, _ in known], [w for _, w in known], [i for _, i in known.values()], [us for us, _ in known.values()], wake))

    def close(self) -> None:
        pass


def stream_evidence(signals: DataFrame, mutations: DataFrame, closure: DataFrame, window_s: int = DAY) -> DataFrame:
    """``node, kind, what, id, at``: in each batch what the nodes know that its signals touch, and the nodes upstream of them.

    kind: signal or change, for the latest of each type; touched, for a node with a signal in the batch. The state of a node has one entry for each
    type of signal and change inside the window. Events older than the window when they come are dropped by the watermark.
    """
    heard = signals.select(F.col("node_id").alias("node"), F.lit("signal").alias("kind"), F.col("signal_type").alias("what"), F.lit("").alias("id"), F.col("timestamp").alias("at"))
    changed = mutations.select(F.col("node_id").alias("node"), F.lit("change").alias("kind"), F.col("mutation_type").alias("what"), "id", F.col("timestamp").alias("at"))
    asked = signals.select(F.col("node_id").alias("target"), F.col("timestamp").alias("at")).join(closure.select("target", "node"), "target")
    asked = asked.select("node", F.lit("ask").alias("kind"), F.lit("").alias("what"), F.lit("").alias("id"), "at")
    rows = heard.unionByName(changed).unionByName(asked).mapInPandas(_combined, ROW).withWatermark("at", f"{window_s} seconds")
    told = rows.withColumn("us", F.unix_micros("at")).groupBy("node").transformWithState(NodeEvidence(), TOLD, "Update", "EventTime")
    return told.select("node", "kind", "what", "id", F.timestamp_micros("us").alias("at"))


def diagnosed(evidence: DataFrame, classes: DataFrame, closure: DataFrame, cpts: DataFrame, priors: DataFrame, batch_no: int, window_s: float = DAY) -> DataFrame | None:
    """Diagnoses of the touched nodes of one batch of ``stream_evidence``, as of the latest signal anywhere; None without any signal."""
    top = evidence.where((F.col("node") == ANYWHERE) & (F.col("kind") == "signal")).agg(F.max("at").alias("t")).first()["t"]  # one value
    if top is None:
        return None
    live = evidence.where(F.col("at") >= F.lit(top).cast("timestamp") - F.make_dt_interval(secs=F.lit(window_s).cast("decimal(18,6)")))
    any_change = F.lit(bool(live.where((F.col("node") == ANYWHERE) & (F.col("kind") == "change")).take(1)))
    signals = live.where((F.col("kind") == "signal") & (F.col("node") != ANYWHERE)).groupBy("node").agg(F.max("at").alias("latest"), F.sort_array(F.collect_set("what")).alias("types"))
    changes = live.where((F.col("kind") == "change") & (F.col("node") != ANYWHERE)).select("node", F.col("what").alias("mutation_type"), F.col("id").alias("mutation_id"), F.col("at").alias("mutation_ts"))
    touched = evidence.where((F.col("kind") == "touched") & (F.col("node") != ANYWHERE)).select("node").distinct()
    targets = touched.join(signals, "node").join(classes, "node").select(F.col("node").alias("target"), F.col("class").alias("t_class"), F.col("types").alias("t_types"), F.col("latest").alias("t_latest"))
    pairs = closure.join(targets, "target").join(changes, "node").join(classes.withColumnRenamed("class", "a_class"), "node")
    near = signals.select("node", F.col("types").alias("a_types"), F.col("latest").alias("a_latest"))
    found = scored(pairs.join(near, "node", "left"), cpts, priors).withColumn("cause", F.concat("node", F.lit(" ("), "mutation_type", F.lit(")")))
    best = found.groupBy("target").agg(F.min_by(F.struct("confidence", "cause", "path"), rank_order()).alias("best"))
    rows = targets.join(best, "target", "left").join(priors.select(F.col("class").alias("t_class"), "p_failure"), "t_class", "left")
    prior = F.when(any_change, 0.0).otherwise(F.coalesce("p_failure", F.lit(DEFAULT_P_FAILURE)))
    return rows.select(
        F.col("target").alias("target_node"), F.coalesce("best.confidence", prior).alias("confidence"), F.col("best.cause").alias("root_cause"), F.coalesce("best.path", F.array().cast("array<string>")).alias("causal_path"),
        F.col("t_latest").alias("timestamp"), F.col("t_class").alias("class"), F.lit(top).cast("timestamp").alias("as_of"), F.lit(batch_no).cast("long").alias("batch_no"),
    )


def diagnosis_table(spark: SparkSession, root: str, parts: int = 10) -> KeyedTable:
    """The latest diagnosis of each node."""
    return KeyedTable(spark, root, DIAGNOSES, ["target_node"], "-batch_no", parts)


def keep_diagnoses(
    signals: DataFrame, mutations: DataFrame, nodes: DataFrame, closure: Callable[[], DataFrame], cpts: DataFrame, priors: DataFrame, out: KeyedTable, checkpoint: str, window_s: int = DAY
) -> DataStreamWriter:
    """A writer that keeps ``out`` (``diagnosis_table``) at the latest diagnosis of each node that a signal has touched.

    signals and mutations are streams; a batch's events count together, whatever their order in it. The reference time of a batch is
    the latest signal so far; a node's diagnosis stands as it was when a signal last touched it. closure: gives the ancestor table
    (``ClosureTable.read`` or a fixed one), for the paths at each batch; the questions go by the table as it is when the stream starts. Nodes that
    the closure doesn't hold, and signals older than the window, touch nothing. The session has to keep its state in RocksDB
    (``keep_state_in_rocks_db``).
    """
    classes = nodes.select(F.col("id").alias("node"), "class")

    def each(batch: DataFrame, no: int) -> None:
        found = diagnosed(materialize(batch, "evidence"), classes, closure(), cpts, priors, no, window_s)
        if found is not None:
            out.upsert(found, no)

    return stream_evidence(signals, mutations, closure(), window_s).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)


def keep_state_in_rocks_db(spark: SparkSession) -> None:
    """Sets the session's state store to the one that keyed state needs; streams that started before keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
