import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rootspan.llm import substring_dedup
from rootspan.llm.substring_dedup import LENGTH, NO_ID, remove_repeats

SF = "/root/testdata/sf0.001"


def slow(rows):
    """Every string of fifty bytes with the smallest doc_id it starts in."""
    first = {}
    data = [((NO_ID if i is None else i), i, (t or "").encode()) for i, t in rows]
    for d, _, t in data:
        for p in range(len(t) - LENGTH + 1):
            s = t[p : p + LENGTH]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, i, t in data:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - LENGTH + 1):
            if first[t[p : p + LENGTH]] < d:
                gone[p : p + LENGTH] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **k):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **k).collect()), key=repr)


def test_triggers_belong_to_the_string():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab ") for _ in range(400)) + b"x" * 200
    piece, lo, n, h, phrase = substring_dedup.triggers([text, b"short", text[100:300]])
    assert n[piece == 0].sum() == len(text) - LENGTH + 1 and n[piece == 2].sum() == 200 - LENGTH + 1 and not (piece == 1).any()
    whole = {int(a) + i: int(x) for a, c, x in zip(lo[piece == 0], n[piece == 0], h[piece == 0]) for i in range(c)}
    part = {int(a) + i: int(x) for a, c, x in zip(lo[piece == 2], n[piece == 2], h[piece == 2]) for i in range(c)}
    assert all(part[p] == whole[p + 100] for p in part)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(df) == slow([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("options", [{}, {"group_phrases": 1, "group_triggers": 200}])
def test_random_mixtures(spark, options):
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 160))) for _ in range(14)] + ["ab" * 60, "x" * 130]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(3) :] for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(i, parts[0] + parts[i % 5] + str(i)) for i in range(200, 230)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, part int").repartition(5)
    assert got(df, **options) == slow(rows)


def test_long_text_in_segments(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(2, text), (1, text[700:1500]), (3, text[:60] + text[1000:]), (0, text[2000:2049])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), segment=333) == slow(rows)


def test_nulls_repeats_and_empty(spark):
    long = "the quick brown fox jumps over the lazy dog and then it does so again and again"
    rows = [(1, None), (2, ""), (None, long), (None, long + " x"), (3, long), (3, long), (3, "y " + long), (4, long[:49]), (5, long[:50]), (2, "z" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == slow(rows)
    assert got(df.limit(0)) == []


def test_suffix_ranks_are_the_order_of_fifty_bytes():
    rng = random.Random(3)
    data = b"".join(rng.choice([b"ab", b"c", b"x" * 60, b"abab" * 20]) for _ in range(60))
    rank = substring_dedup.suffix_ranks(np.frombuffer(data, dtype=np.uint8))
    strings = [data[p : p + LENGTH] for p in range(len(data) - LENGTH + 1)]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert rank.tolist() == [order[s] for s in strings]


def test_constant_and_periodic_texts(spark):
    noise = "".join(random.Random(5).choices("abcdefgh ", k=400))
    line = "one line of a log, sixty bytes long, again and again, so so.\n"
    rows = [(3, "a" * 3000), (1, "a" * 70 + noise), (2, "ab" * 900), (4, noise[:80] + "ba" * 300), (5, line * 40), (6, noise + line * 3), (7, line * 90 + "a" * 49), (8, "a" * 5000), (0, "xyz" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"segment": 500}, {"group_phrases": 1}):
        assert got(df, **options) == slow(rows)


def test_constant_text_leaves_few_entries(spark):
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2], "part": [0, 0], "text": [b"a" * 3_000_000, b"abc" * 1_000_000]})
    rows = list(substring_dedup._parse(1, substring_dedup.SEGMENT)(iter([batch])))
    assert sum(abs(n) for r in rows for n in r.column(1).to_pylist()) < 200


def test_task_remembers_phrases(spark):
    """A passage of many batches of one task is settled there: its later documents leave spans, not entries."""
    passage = "".join(random.Random(9).choices("abcdefgh ", k=900)).encode()
    batches = [pa.RecordBatch.from_pydict({"doc": [10 * i, 10 * i + 1], "part": [0, 0], "text": [passage] * 2}) for i in range(6)]
    rows = [n for r in substring_dedup._parse(1, substring_dedup.SEGMENT)(iter(batches)) for n in r.column(1).to_pylist()]
    assert sum(n for n in rows if n > 0) == rows[1] and rows[1] > 20
