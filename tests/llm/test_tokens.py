import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from rootspan.llm import packing, token_counts
from rootspan.llm.common import byte_bpe, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "!", "!!!", "a<|endoftext|>b", "naïve café   x", "a" * 30000, " " * 5000, "é" * 7000, "x 1 " * 3000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizers(spark, reference):
    encoding = byte_bpe(tokenizer_path("byte_bpe_50k.tiktoken"), packing.SPECIAL_END)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts + ODD:
        assert encoding.encode(text or "", allowed_special="all") == reference(text)


def test_pieces():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def fewest(lengths, capacity):
    """Exact minimum by search, for a handful of items."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def test_bound_never_exceeds_the_minimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([7, 10, 24])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        least = fewest(lengths, capacity)
        bound = packing.bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets, fill = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= least <= len(fill)
        assert fill.max() <= capacity and fill.sum() == sum(lengths)


def checked(rows, reference, texts, capacity):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*reference(text), 0], dtype="<u4")
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        assert sorted(pieces[doc_id]) == want
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n for p in places.values() for _, n in p)
    counts = np.bincount([n for p in places.values() for _, n in p], minlength=capacity + 1)
    assert total == sum(len(reference(t)) + 1 for t in texts.values())
    return len(places), packing.bin_bound(counts, capacity)


def test_packing_round_trip(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, group_pieces=40).collect()  # several groups, so documents are exchanged
    used, bound = checked(rows, reference, texts, packing.CAPACITY)
    assert bound <= used <= bound + 1
    report = packing.packing_report(packing.pack_documents(df)).first()
    assert report["sequences"] >= report["bound"]


def test_packing_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("None", 1)]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0
    assert packing.pack_documents(df.limit(0)).count() == 0


def slow_scan(ids, end):
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + [(n, False)] * (n > 0)


def test_scan_stitches_blocks(spark):
    rng = random.Random(4)
    files = {f"f{i}": [rng.choice([1, 2, 9]) for _ in range(rng.randrange(0, 40))] for i in range(12)} | {"ends": [9] * 9, "one": [1] * 30}
    df = spark.createDataFrame([(k, np.array(v, dtype="<u2").tobytes()) for k, v in files.items()] + [("none", None)], "file string, content binary")
    for block in (1, 3, 7, 100):
        got = defaultdict(list)
        for r in token_counts.count_tokens(df, end_id=9, width=2, block_tokens=block).collect():
            got[r.file].append((r.ordinal, r.n_tokens, r.ended))
        for k, v in files.items():
            assert [x[1:] for x in sorted(got[k])] == slow_scan(v, 9), (k, block)
            assert [x[0] for x in sorted(got[k])] == list(range(len(got[k])))
        assert "none" not in got


def test_document_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, kind string").repartition(3)
    encoding = byte_bpe(tokenizer_path("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(df, block_tokens=1000).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in texts.items()}


def test_counts_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 2), (1, 0), (1, 1), (1, 1)], key=str)
    assert token_counts.document_token_counts(df.limit(0)).count() == 0


LONG = ["a" + " " * 1_000_000 + "b", "\n" * 2_000_000, "x \t" + "\u00a0" * 1_500_000, " " * 5_000_000 + "z", "w" * 10_000_000, "a<|endoftext|>" + " " * 1_200_000]
BROKEN = [b"ab\xff\xfe cd", b"\xe2\x82", b"\xc3(" * 5]


def odd_table(spark):
    rows = [(i, t.encode()) for i, t in enumerate(LONG)] + [(100 + i, b) for i, b in enumerate(BROKEN)]
    return spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, text binary").repartition(3).selectExpr("doc_id", "cast(text as string) text"), rows


def test_any_text_has_the_ids_of_tokenizers(spark, reference):
    df, rows = odd_table(spark)
    want = {i: np.array([*reference(b.decode("utf-8", "replace")), 0], dtype="<u4") for i, b in rows}
    got = defaultdict(list)
    for r in packing.token_pieces(df).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, ids in want.items():
        assert sorted(got[i]) == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]
    counts = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(df).collect()}
    assert {i: n for i, n in counts.items() if i != 5} == {i: len(ids) - 1 for i, ids in want.items() if i != 5}
    assert counts[5] > len(want[5])  # here the end id's name is ordinary text


def test_ranges_and_whole_files_agree(spark, tmp_path):
    rng = random.Random(6)
    files = {f"f{i}": [rng.choice([1, 2, 9]) for _ in range(rng.randrange(0, 90))] for i in range(6)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    for block in (1, 5, 64):
        got = defaultdict(list)
        for r in token_counts.count_file_tokens(spark, f"file://{tmp_path}", 9, 2, block).collect():
            got[r.file.rsplit("/", 1)[1]].append((r.ordinal, r.n_tokens, r.ended))
        for name, ids in files.items():
            assert [x[1:] for x in sorted(got[name])] == slow_scan(ids, 9)
    assert not token_counts.readable_by_range("viewfs://store/x")
