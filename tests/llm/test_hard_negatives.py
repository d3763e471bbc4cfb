import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootspan.llm.hard_negatives import NOTHING, Heaps, every_fiftieth, mine_hard_negatives, strassen
from rootspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow(rows):
    """(vec_id, embedding, label) by plain sorting, as the contract says it."""
    part = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(y is None or not math.isfinite(y) for y in x):
            continue
        part.append((vec_id, [math.floor(256 * y) for y in x], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, x, label) in enumerate(part):
        if a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), v, other) for j, (v, y, other) in enumerate(part) if j != i and len(y) == len(x)]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for ps, pos, _ in [r for r in scored if r[2] == label][:5]:
            hits = [r for r in scored if r[2] != label and 50 * ps <= 100 * r[0] <= 95 * ps][:3]
            out += [(a, pos, k + 1, neg, ps, ns) for k, (ns, neg, _) in enumerate(hits)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_against_sorting(spark):
    want = slow([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    df = QUERIES["op13_hard_negatives"](spark, SF)
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert got(df) == want and want


def plant(seed, n, dim, labels=10):
    """Few distinct components, so ties abound; a third of the rows share a label; repeats of rows."""
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(dim)], 3 if r.random() < 0.33 else r.randrange(labels)) for i in range(n)]
    return rows + [rows[0], rows[50], rows[7], rows[7]]


@pytest.mark.parametrize("sizes", [{}, {"strip_rows": 13, "anchor_rows": 2}])
def test_ties_repeats_and_hot_labels(spark, sizes):
    rows = plant(5, 430, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert got(mine_hard_negatives(df.withColumn("label", label), F.col("vec_id") % 50 == 0, **sizes)) == slow(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = plant(9, 160, 4) + [(200, None, 1), (250, [1.0, None, 1.0, 1.0], 1), (300, [nan] * 4, 1), (350, [inf, 1.0, 1.0, 1.0], 3), (400, [1.0] * 4, None), (450, [], 3), (500, [], 4), (501, [], 3), (550, [1.0, 2.0], 3), (-50, [1.0] * 4, 3), (-100, [0.0] * 4, 3), (None, [1.0] * 4, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clash = df.withColumn("anchor_id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("uid", F.lit(None)).withColumn("VEC", F.lit(2))
    assert got(every_fiftieth(clash)) == slow(rows)
    assert got(every_fiftieth(df.limit(0))) == []


def test_scores_that_fit_no_long_take_no_part(spark):
    rows = [(0, [1e300, 1.0], 1), (50, [2.0, 1.0], 1), (1, [2.0, 2.0], 1), (2, [1.5, 1.5], 2), (3, [1e9, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(every_fiftieth(df)) == slow([rows[1], rows[2], rows[3]])


def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (3, 5, 7), (65, 33, 129), (64, 64, 64), (100, 1, 40), (31, 200, 2), (0, 4, 3), (4, 0, 3)]:
        a, b = r.integers(-(2**27), 2**27, (m, k)), r.integers(-(2**27), 2**27, (k, n))
        assert (strassen(a, b, 3) == a.astype(object) @ b.astype(object)).all() if k else not strassen(a, b, 3).any()


def test_heaps_merge():
    r = np.random.default_rng(2)
    scores = r.integers(0, 6, (9, 60))
    scores[r.random((9, 60)) < 0.2] = NOTHING
    heaps = Heaps(9, 4)
    for j in range(0, 60, 7):
        heaps.offer(slice(0, 5), scores[:5, j : j + 7].copy(), np.arange(j, min(j + 7, 60)))
        heaps.offer(slice(5, 20), scores[5:, j : j + 7].copy(), np.arange(j, min(j + 7, 60)))
    row, score, ids = heaps.found()
    for i in range(9):
        want = sorted((-int(s), k) for k, s in enumerate(scores[i]) if s != NOTHING)[:4]
        assert [(-s, k) for s, k in zip(score[row == i].tolist(), ids[row == i].tolist())] == want
