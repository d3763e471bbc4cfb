"""Hard negatives of anchor vectors: exact integer products by Strassen's recursion, heaps that merge over tiles.

Anchors and candidates are dealt to blocks of bounded size by a hash of their row number, and each pair of
an anchor block and a candidate strip is a group of its own, so no label and no vector, however common,
makes a group large. Inside a group the strip is cut into tiles; each tile's scores are one recursive product
of int64 matrices, and what the tile offers an anchor goes into a heap of k rows, held as arrays. Heaps of
different groups merge in Spark by the same order. A first pass, inside labels, finds the positives; a
second, over all rows, fills a heap for each anchor and positive with what falls into the positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootspan.llm.common import column, mapped
from rootspan.scratch import materialize

#: Rows a candidate strip and an anchor block hold on average; rows and anchors of one product; sides up to which a product is plain.
STRIP_ROWS, ANCHOR_ROWS, TILE, LEAF = 4096, 2048, (512, 1024), 24
#: A scaled vector's squares sum to less than this, so scores times 20 fit into 64 bits.
NORM_LIMIT = 2.0**56
NOTHING = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices of any shape: seven half-size products a level, odd sides padded with zeros.

    Sums may wrap on the way; whatever fits int64 comes out exact, as int64 arithmetic is that of a ring.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    m2, k2, n2 = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m | k | n) & 1:
        a = np.pad(a, ((0, 2 * m2 - m), (0, 2 * k2 - k)))
        b = np.pad(b.T, ((0, 2 * n2 - n), (0, 2 * k2 - k))).T  # keeps columns contiguous
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m2, 2 * n2), dtype=np.int64)
    out[:m2, :n2] = p1 + p4 - p5 + p7
    out[:m2, n2:] = p3 + p5
    out[m2:, :n2] = p2 + p4
    out[m2:, n2:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The k best (score, id) of each row: higher scores first, then smaller ids. Offers come in the order of their ids."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NOTHING)
        self.ids = np.zeros((rows, k), dtype=np.int64)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a column for each of ``ids`` (ascending), NOTHING where a row gets none; it is used up."""
        alive = np.flatnonzero((scores > self.scores[at][:, -1:]).any(axis=1))
        if not len(alive):
            return
        got, rows, own, tops = scores[alive], np.arange(len(alive)), [], []
        for _ in range(min(self.k, len(ids))):
            best = got.argmax(axis=1)  # the first of equal ones, so the smallest id
            own.append(ids[best])
            tops.append(got[rows, best].copy())
            got[rows, best] = NOTHING
        held_s, held_i = self.scores[at][alive], self.ids[at][alive]
        s, i = np.concatenate([held_s, np.stack(tops, 1)], axis=1), np.concatenate([held_i, np.stack(own, 1)], axis=1)
        order = np.argsort(~s, axis=1, kind="stable")[:, : self.k]  # ~s falls as s rises and cannot overflow; held ones are of smaller ids
        where = np.arange(*at.indices(len(self.scores)))[alive]
        self.scores[where], self.ids[where] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, score and id of all that is held."""
        rows, places = np.nonzero(self.scores != NOTHING)
        return rows, self.scores[rows, places], self.ids[rows, places]


def _scaled(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = column(batch, "embedding")
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            good = np.isfinite(flat) & (np.abs(flat) < 2.0**28)
            whole = np.where(good, flat, 0).astype("<i8")
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            rows: list[tuple] = []
            for i, (vec_id, label) in enumerate(zip(column(batch, "vec_id").to_pylist(), column(batch, "label").to_pylist())):
                part = slice(ends[i - 1] if i else 0, ends[i])
                if there[i] and vec_id is not None and label is not None and good[part].all() and (flat[part] ** 2).sum() < NORM_LIMIT:
                    rows.append((uid + i, vec_id, label, part.stop - part.start, whole[part].tobytes()))
            uid += batch.num_rows
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["uid", "vec_id", "label", "size", "vec"])

    return run


def scaled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``uid, vec_id, label, size, vec`` of the rows that take part: each component x as floor(scale * x), 64-bit integers one after the other."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return mapped(given, _scaled(scale), "uid long, vec_id long, label long, size long, vec binary")


def _matrix(rows: pa.Table) -> np.ndarray:
    raw = rows.column("vec").to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<i8").reshape(len(raw), -1) if raw else np.zeros((0, 0), dtype=np.int64)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _tiles(anchors: pa.Table, strip: pa.Table) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of each tile; ``strip`` is sorted by id."""
    a, b = _matrix(anchors), _matrix(strip)
    for j in range(0, len(b), TILE[1]):
        for i in range(0, len(a), TILE[0]):
            rows, cols = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            yield rows, cols, strassen(a[rows], b[cols].T)


def _positives(k: int):
    def run(anchors: pa.Table, strip: pa.Table) -> pa.Table:
        strip = strip.sort_by("vec_id")
        own, uids, ids = _numbers(anchors, "uid"), _numbers(strip, "uid"), _numbers(strip, "vec_id")
        heaps = Heaps(len(own), k)
        for rows, cols, scores in _tiles(anchors, strip):
            heaps.offer(rows, np.where(own[rows][:, None] == uids[cols], NOTHING, scores), ids[cols])
        row, score, found = heaps.found()
        return pa.table({"anchor": own[row], "score": score, "vec_id": found})

    return run


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def run(anchors: pa.Table, strip: pa.Table) -> pa.Table:
        strip = strip.sort_by("vec_id")
        own, label = _numbers(anchors, "uid"), _numbers(anchors, "label")
        ids, labels = _numbers(strip, "vec_id"), _numbers(strip, "label")
        wanted = anchors.column("positives").to_pylist()
        most = max(map(len, wanted), default=0)
        given = np.array([len(w) for w in wanted])
        scores_of = np.array([w + [0] * (most - len(w)) for w in wanted], dtype=np.int64).reshape(len(wanted), most)
        heaps = [Heaps(len(own), k) for _ in range(most)]
        for rows, cols, scores in _tiles(anchors, strip):
            other = label[rows][:, None] != labels[cols]
            below, above = low[1] * scores, high[1] * scores
            for p, heap in enumerate(heaps):
                bound = scores_of[rows, p][:, None]
                fits = other & (given[rows] > p)[:, None] & (low[0] * bound <= below) & (above <= high[0] * bound)
                heap.offer(rows, np.where(fits, scores, NOTHING), ids[cols])
        parts = []
        for p, heap in enumerate(heaps):
            row, score, found = heap.found()
            parts.append(pa.table({"anchor": own[row], "place": np.full(len(row), p + 1, dtype=np.int32), "score": score, "vec_id": found}))
        empty = pa.table({"anchor": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
        return pa.concat_tables([empty, *parts])

    return run


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long")


def _in_blocks(anchors: DataFrame, rows: DataFrame, keys: list[str], strip_rows: int, anchor_rows: int):
    """Anchors and rows of equal ``keys`` as a cogroup for each pair of an anchor block and a strip."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sizes = materialize(sizes.select(*keys, _blocks(F.col("n"), strip_rows).alias("strips"), _blocks(F.col("m"), anchor_rows).alias("blocks")), "sizes")
    deal = lambda blocks, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(blocks)).cast("long")
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = anchors.join(sizes, keys).withColumn("block", deal("blocks", 1)).withColumn("strip", every("strips")).drop("blocks", "strips")
    right = rows.join(sizes, keys).withColumn("strip", deal("strips", 2)).withColumn("block", every("blocks")).drop("blocks", "strips")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both sides come from one table
    group = [*keys, "block", "strip"]
    return left.groupBy(*group).cogroup(right.groupBy(*group))


def _best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merged heaps: the first k of each key with their ``rank``; each task keeps no more than k of a key before rows move."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), scale: float = 256.0,
    strip_rows: int = STRIP_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``vectors`` (vec_id, embedding, label) where ``is_anchor``.

    Scores are inner products of floor(scale * component). An anchor's positives are its first other rows
    of the same label, by score and then smaller vec_id. Each positive gets the first rows of another label
    whose score is at least low and at most high times the positive's, both fractions of whole numbers, compared exactly.

    Rows with a null vec_id, label or vector or a null or non-finite component take no part; nor do those whose scaled squares sum to
    2^56 or more, as their scores needn't fit. Vectors of different length don't meet; all scores of empty vectors are 0. Repeated rows count
    each: as anchors with rows of their own, and as each other's positives. An anchor without positives, or a positive without a row in
    its window, has no rows. Other columns are not read. Empty in, empty out.

    Work is anchors times rows, as asked for; each anchor block meets each strip once a pass.
    """
    rows = materialize(scaled_vectors(vectors, scale), "scaled")
    anchors = rows.where(is_anchor)
    same = _in_blocks(anchors, rows, ["label", "size"], strip_rows, anchor_rows).applyInArrow(_positives(positives), "anchor long, score long, vec_id long")
    best = materialize(_best(same, ["anchor"], positives).withColumnRenamed("rank", "place"), "positives")
    lists = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("positives"))
    asked = materialize(anchors.join(lists.withColumnRenamed("anchor", "uid"), "uid"), "anchors")
    around = _in_blocks(asked, rows, ["size"], strip_rows, anchor_rows).applyInArrow(_negatives(negatives, low, high), "anchor long, place int, score long, vec_id long")
    hard = _best(around, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score")
    out = hard.join(named, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The contract's mining: each vec_id divisible by 50 is an anchor; where it is divisible by 7 the label is one on, modulo 10."""
    label = F.col("label").cast("long")
    moved = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return mine_hard_negatives(moved, F.col("vec_id") % 50 == 0)
