import math
import random
import time

import numpy as np
import pytest

from rootspan.llm import embedding_dedup
from rootspan.llm.embedding_dedup import embedding_groups

SF = "/root/testdata/sf0.001"


def slow(rows, threshold=0.93):
    """All pairs in double precision; rows: (vec_id, embedding, label)."""
    def good(x, label):
        return label is not None and x is not None and len(x) and all(y is not None and math.isfinite(y) for y in x) and any(x)

    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, x, l1), (_, y, l2) = rows[i], rows[j]
            if l1 == l2 and good(x, l1) and good(y, l2) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((vec_id, links[i], min(ids, default=None), vec_id is not None and vec_id == min(ids)))
    return sorted(out, key=repr)


def got(df, **k):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(df, **k).collect()), key=repr)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(df) == slow([(r.vec_id, r.embedding, r.label) for r in df.collect()])


@pytest.mark.parametrize("options", [{}, {"cell_rows": 12, "cell_target": 10, "reach": 99.0}])
def test_planted_groups(spark, options):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(8):
        center = rng.normal(size=16)
        for _ in range(9):
            rows.append((len(rows), (center + rng.normal(size=16) * 0.3).tolist(), g % 3))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(200 + i, [x * 3 for x in rows[1][1]], rows[1][2]) for i in range(2)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **options) == slow(rows)


def test_recall_at_the_threshold(spark):
    """Partners at a cosine just above the threshold, in random directions: the recall against brute force."""
    rng, d, t = np.random.default_rng(4), 64, 0.935
    x = rng.normal(size=(1500, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = t * x + math.sqrt(1 - t * t) * z
    centroids = embedding_dedup.spherical_kmeans(x, 24)
    hx, ix = embedding_dedup.cells_of(x, centroids, 0.93, embedding_dedup.REACH)
    hy, iy = embedding_dedup.cells_of(y, centroids, 0.93, embedding_dedup.REACH)
    at = np.arange(len(x))
    found = np.where(hx <= hy, iy[at, hx], ix[at, hy])
    assert found.mean() > 0.99
    hx, ix = embedding_dedup.cells_of(x, centroids, 0.93, 8.0)
    hy, iy = embedding_dedup.cells_of(y, centroids, 0.93, 8.0)
    assert np.where(hx <= hy, iy[at, hx], ix[at, hy]).all()


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (None, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 1.0], 0)]
    rows += [(9, [float("inf"), 1.0, 1.0], 0), (10, v, 1), (11, [1e300, 2e300, 3e300], 0), (12, [1.0, 2.0], 0), (13, [-0.0, 2.0], 0), (14, [0.0, 2.0], 0), (0, [-1.0, -2.0, -3.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, digest string, cell int")
    want = {(r[0], r[1], r[2], r[3]) for r in slow([r for r in rows if r[0] != 11])}
    result = got(df)
    assert (11, 4, 1, False) in result and (0, 0, 0, True) in result and (None, 4, 1, False) in result
    assert {r[0] for r in result} == {r[0] for r in want} | {11}
    assert all(r[1:] == (0, r[0], True) for r in result if r[0] in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert got(df.limit(0)) == []


def test_label_types(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice("ab")) for i in range(40)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")) == slow(rows)


def test_few_directions_lose_nothing(spark):
    """Vectors that vary in few of their dimensions, where partners lean to another cell: all links, in many cells."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24)) * np.array([1.0] * 4 + [0.03] * 20)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    links = (y @ y.T >= 0.93).sum(axis=1) - 1
    found = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_target=60).collect()
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(links.tolist()))


def test_forest_of_a_dense_block():
    rng = np.random.default_rng(2)
    for size, share in ((40, 0.02), (40, 0.3), (60, 0.01)):
        near = rng.random((size, size + 5)) < share
        left, right = np.arange(size), np.arange(1000, 1005 + size)
        links = embedding_dedup._forest(near, left, right)

        def groups(pairs):
            root = {}

            def find(a):
                while root.setdefault(a, a) != a:
                    a = root[a]
                return a

            for a, b in pairs:
                root[find(a)] = find(b)
            out = {}
            for a in root:
                out.setdefault(find(a), set()).add(a)
            return sorted(map(sorted, out.values()))

        assert groups(links) == groups([(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(near))])
    began = time.time()
    assert len(embedding_dedup._forest(np.ones((4000, 4000), dtype=bool), np.arange(4000), np.arange(4000))) <= 8000
    assert time.time() - began < 5
