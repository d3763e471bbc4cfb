"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one representative a group.

Equal vectors of a label meet in one row with their number first. Cells are fitted on a bounded
sample (``sample_rows``); every vector is assigned. A vector lies in its own cell and visits each
cell of a smaller number whose border is near enough: with d the difference of the two centroids, a
partner at cosine t on the far side needs t (y·d) + sqrt(1 - t²) (z·d) >= 0 for its unit offset z,
which some z meets if sqrt(1 - t²) |d'| >= -t (y·d) with d' what y leaves of d; no pair is lost. A smaller
``reach`` counts only that many times |d'| / sqrt(dimensions), which is quicker and may lose pairs. Each pair
is looked at in one cell only, so links are counted once.

Cells of more than ``cell_rows`` rows are compared block by block, each pair of blocks in a task of
its own. Tasks give link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import column, hash_sample, mapped
from rootspan.operators.components import connected_components
from rootspan.scratch import materialize

#: REACH is a quick choice for callers that can do with a recall of about 0.99 (tests); the default loses nothing.
THRESHOLD, REACH = 0.93, 3.0
#: Rows that cells are fitted on, at least and for each cell; rows a cell holds on average; most cells; rows compared as one block.
SAMPLE_ROWS, CELL_SAMPLE, CELL_TARGET, MAX_CELLS, CELL_ROWS = 4096, 32, 2048, 1024, 8192
#: Rows whose cells are looked up together.
STEP = 512


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        digests, vectors = [], []
        for label, x in zip(column(batch, "label").to_pylist(), column(batch, "embedding").to_pylist()):
            v = None if label is None or x is None or any(y is None for y in x) else np.array(x, dtype=np.float64) + 0.0
            if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                digests.append(None)
                vectors.append(None)
                continue
            v = v / np.abs(v).max()  # so squares neither overflow nor vanish
            raw = (v / np.sqrt(v @ v)).tobytes()
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            vectors.append(raw)
        uids = np.arange(uid, uid + batch.num_rows)
        uid += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(uids), column(batch, "vec_id"), column(batch, "label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["uid", "vec_id", "label", "digest", "vec"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums**2).sum(axis=1))
        centroids = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centroids)
    return centroids


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float, reach: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each row of x, and which cells it lies in: its own, and the smaller ones within reach (None: all that can hold a partner)."""
    if len(x) > STEP:
        parts = [cells_of(x[i : i + STEP], centroids, threshold, reach) for i in range(0, len(x), STEP)]
        return np.concatenate([own for own, _ in parts]), np.concatenate([inside for _, inside in parts])
    s = x @ centroids.T
    own = s.argmax(axis=1)
    toward = s - s[np.arange(len(x)), own][:, None]
    apart2 = np.maximum(0, 2 - 2 * centroids @ centroids.T)[own]
    off = np.sqrt(np.maximum(0, apart2 - toward**2)) * (1.0 if reach is None else min(1.0, reach / np.sqrt(x.shape[1])))
    inside = threshold * toward + np.sqrt(1 - threshold**2) * off >= -1e-9
    inside &= np.arange(len(centroids)) <= own[:, None]
    inside[np.arange(len(x)), own] = True
    return own, inside


def _cells(centroids: dict[int, np.ndarray], threshold: float, reach: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = column(batch, "vec").to_pylist()
            for size in sorted({len(r) for r in raw}):
                at = np.array([i for i, r in enumerate(raw) if len(r) == size])
                x = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.float64).reshape(len(at), -1)
                known = centroids.get(x.shape[1])
                own, inside = cells_of(x, known, threshold, reach) if known is not None else (np.zeros(len(at), np.int64), np.ones((len(at), 1), bool))
                rows, cells = np.nonzero(inside)
                got = batch.take(pa.array(at[rows]))
                yield pa.RecordBatch.from_arrays([column(got, "node"), column(got, "label"), column(got, "mult"), column(got, "vec"), pa.array(np.full(len(rows), x.shape[1])), pa.array(cells), pa.array(cells == own[rows])], ["node", "label", "mult", "vec", "size", "cell", "home"])

    return run


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the 0/1 matrix joins; near[i, j] links left[i] to right[j], nodes may be in both.

    Rows and columns are searched in turn, whole fronts at a time; one link for each row or column that is found.
    """
    out: list[tuple[int, int]] = []
    new_row, new_col = near.any(axis=1), near.any(axis=0)
    while new_row.any():
        rows = np.flatnonzero(new_row)[:1]
        new_row[rows] = False
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & new_col)
            new_col[cols] = False
            out += zip(left[rows[near[np.ix_(rows, cols)].argmax(axis=0)]].tolist(), right[cols].tolist())
            rows = np.flatnonzero(near[:, cols].any(axis=1) & new_row) if len(cols) else cols
            new_row[rows] = False
            if len(rows):
                out += zip(left[rows].tolist(), right[cols[near[np.ix_(rows, cols)].argmax(axis=1)]].tolist())
    return out


def _compare(threshold: float, step: int = 512):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "home", "node"], ascending=[True, False, True], ignore_index=True)
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(len(pdf), -1)
        node, mult, home, block = (pdf[c].to_numpy() for c in ("node", "mult", "home", "block"))
        first, second = block == block[0], block == block[-1]
        same = block[0] == block[-1]
        one_pair = pdf["r"].iloc[0] == pdf["s"].iloc[0]
        degree, links = np.zeros(len(pdf), dtype=np.int64), []
        if not (same and not one_pair):  # two blocks of which one is empty have nothing to compare
            a, b = np.flatnonzero(first), np.flatnonzero(second)
            near = np.zeros((len(a), len(b)), dtype=bool)
            for at in range(0, len(a), step):
                rows = a[at : at + step]
                got = x[rows] @ x[b].T >= threshold
                near[at : at + step] = got & (home[rows][:, None] | home[b][None, :])
            if same:
                np.fill_diagonal(near, False)
                degree[a] = near @ mult[b]
            else:
                degree[a] = near @ mult[b]
                degree[b] = near.T @ mult[a]
            links = _forest(near, node[a], node[b])
        got = degree > 0
        return pd.concat([pd.DataFrame({"a": node[got], "b": pd.array([None] * int(got.sum()), dtype="Int64"), "n": degree[got]}), pd.DataFrame({"a": pd.array([p for p, _ in links], dtype="Int64"), "b": pd.array([q for _, q in links], dtype="Int64"), "n": pd.array([0] * len(links), dtype="Int64")})])

    return run


def embedding_groups(
    vectors: DataFrame, threshold: float = THRESHOLD, reach: float | None = None, sample_rows: int = SAMPLE_ROWS, cell_target: int = CELL_TARGET, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and their cosine in double precision is ``threshold``
    or more. n_links counts the other rows linked directly, copies included; component_id is the
    smallest vec_id reachable; kept is true where they are equal. A null label, and a vector that is
    null, empty, zero or has null or non-finite components, links with nothing; so do vectors of
    different length. Null vec_ids keep a row that is not kept, with the smallest known vec_id of its
    group. Repeated rows count as vectors of their own. Other columns are not read. Empty in, empty out.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(mapped(vectors, _keyed, "uid long, vec_id long, label string, digest binary, vec binary"), "vectors")
    unique = rows.where("digest is not null").groupBy("label", "digest").agg(F.min("uid").alias("node"), F.count("*").alias("mult"), F.min("vec_id").alias("first"), F.first("vec").alias("vec"))
    unique = materialize(unique, "unique")
    by_label = unique.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    stats = by_label.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("label_rows")).first()  # the label a row is in, on average
    wanted = min(max_cells, max(1, round((stats["label_rows"] or 0) / cell_target)))
    sample_rows = max(sample_rows, CELL_SAMPLE * wanted)
    sample = hash_sample(unique.select(F.xxhash64("digest").alias("key"), "vec"), "key", sample_rows, int(stats["n"] or 0)).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in sample:
        by_size.setdefault(len(r["vec"]) // 8, []).append(bytes(r["vec"]))
    centroids = {k: spherical_kmeans(x := np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1), min(wanted, len(x))) for k, v in by_size.items()}
    placed = mapped(unique.select("node", "label", "mult", "vec"), _cells(centroids, threshold, reach), "node long, label string, mult long, vec binary, size long, cell long, home boolean")
    placed = materialize(placed, "cells")
    sizes = placed.groupBy("label", "size", "cell").agg(F.when(F.count("*") <= cell_rows, 1).otherwise(F.ceil(2 * F.count("*") / F.lit(cell_rows))).cast("long").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    member = placed.join(sizes, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    pairs = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("r", F.least("block", "other")).withColumn("s", F.greatest("block", "other")).drop("blocks", "other")
    found = pairs.groupBy("label", "size", "cell", "r", "s").applyInPandas(_compare(threshold), "a long, b long, n long")
    found = materialize(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b is not null"), "a", "b")
    known = unique.select("label", "digest", "node", "mult", "first").join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    known = materialize(known.join(counts, "node", "left").select("label", "digest", "root", "first", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "known")
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = materialize(known.join(least, "root").select("label", "digest", "n_links", "component_id"), "named")
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
