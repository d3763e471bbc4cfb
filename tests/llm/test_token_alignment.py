import base64
import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootspan.llm.common import tokenizer_path
from rootspan.llm.queries import QUERIES
from rootspan.llm.token_alignment import Csr, align_documents, common_groups, gustavson, incidence, overlap_links, pair_counts, token_links, transposed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    """Both tokenizers as the contract names them: text → [(id, bytes)], by other libraries than the operator's on side A."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in keep)}
    back = {c: b for b, c in chars.items()}
    vocab = {i: bytes(back[c] for c in t) for t, i in json.load(open(tokenizer_path("byte_bpe_50k.json")))["model"]["vocab"].items() if all(c in back for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda text: ([(i, vocab[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(text)])


def slow(rows, sides):
    """Byte by byte; rows: (doc_id, text)."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = sides(text) if text else ([], [])
        if b"".join(t for _, t in a) != (" " + (text or "")).encode() or b"".join(t for _, t in b) != (" " + (text or "")).encode():
            a = b = []
        own_a, own_b = [k for k, (_, t) in enumerate(a) for _ in t], [k for k, (_, t) in enumerate(b) for _ in t]
        links = sorted(set(zip(own_a, own_b)))
        ends = [{sum(len(t) for _, t in side[: k + 1]) for k in range(len(side))} for side in (a, b)] if len(a) < 400 else [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
        cuts, groups, parts, at = ends[0] & ends[1], [], [[], []], [0, 0]
        for cut in sorted(cuts):
            group = []
            for s, side in enumerate((a, b)):
                ids, got = [], at[s]
                while got < cut:
                    ids.append(str(side[len(parts[s])][0]))
                    got += len(side[len(parts[s])][1])
                    parts[s].append(1)
                at[s] = got
                group.append(ids)
            groups.append(group)
        counts.update((a[i][0], b[j][0]) for i, j in links)
        text_of = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        docs.append((doc_id, len(a), len(b), len(groups), [(a[i][0], b[j][0]) for i, j in links], hashlib.sha256(text_of.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((d, n_a, n_b, n_g, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), sha, shared) for d, n_a, n_b, n_g, links, sha, shared in docs), key=repr), counts, most


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_bytes(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = QUERIES["op12_token_alignment"](spark, SF)
    assert dict(df.dtypes)["count_sum"] == "bigint" and df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(df) == slow(rows, sides)[0]


ODD = [
    (1, "The quick <|endoftext|> fox <s> jumped </s> <unk> <0x41>"), (2, None), (3, ""), (4, " "), (5, "   two  spaces \n\n\t tabs  "), (6, "naïve café – 東京 🎉 ﬁne ½ ▁ mark"), (7, "東京🎉" * 40), (8, "aaaa" * 500),
    (9, "x"), (9, "x"), (None, "no id here"), (10, "\x00\x01 nul"), (11, "internationalisation, antidisestablishmentarianism!"), (12, " leading"), (13, "word " * 3000), (14, "ＦＵＬＬ ｗｉｄｔｈ"),
]


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 100, "block_links": 40}])
def test_odd_texts(spark, sides, sizes):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("KEYS", F.lit("x")).withColumn("n_a", F.lit(-1)).repartition(3)
    assert got(align_documents(df, **sizes)) == slow(ODD, sides)[0]


def test_malformed_and_empty(spark):
    df = spark.sql("select 1L doc_id, cast(x'61FF62' as string) text")
    assert got(align_documents(df)) == [(1, 0, 0, 0, 0, 0, 0, "", 0)]
    assert got(align_documents(df.limit(0))) == []


def test_white_space_too_long_for_the_fast_encoder(spark):
    df = spark.createDataFrame([(1, "a" + " " * 1_100_000 + "b")], "doc_id long, text string")
    row = align_documents(df).first()
    assert row.n_links == 0 or row.n_links >= max(row.n_a, row.n_b)


def test_counts_and_links(spark, sides):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    _, counts, most = slow(ODD, sides)
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pair_counts(df).collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}
    rows = token_links(df, slice_bytes=64).collect()
    assert Counter((r.a_id, r.b_id) for r in rows) == counts
    one = sorted((r.a_place, r.b_place, r.bytes, r.group_no) for r in rows if r.doc_id == 11)
    a, b = sides(ODD[12][1])
    spans = [np.cumsum([0] + [len(t) for _, t in side]) for side in (a, b)]
    want = [(i, j, min(spans[0][i + 1], spans[1][j + 1]) - max(spans[0][i], spans[1][j])) for i in range(len(a)) for j in range(len(b))]
    assert [r[:3] for r in one] == [w for w in want if w[2] > 0] and [r[3] for r in one] == sorted(r[3] for r in one)


def dense(m):
    out = np.zeros((len(m.starts) - 1, m.width), int)
    out[m.rows(), m.columns] = 1 if m.values is None else m.values
    return out


def test_products():
    r = np.random.default_rng(4)
    for _ in range(20):
        m, k, n = r.integers(1, 12, 3)
        x, y = r.random((m, k)) < 0.4, r.random((k, n)) < 0.4
        a, b = (Csr(np.concatenate([[0], np.cumsum(z.sum(1))]), np.nonzero(z)[1], z.shape[1]) for z in (x, y))
        assert (dense(gustavson(a, b)) == x.astype(int) @ y.astype(int)).all()
        assert (dense(transposed(a)) == x.T).all()
    ends_a, ends_b = np.array([2, 5, 9, 12]), np.array([1, 5, 7, 8, 12])
    parts = [np.concatenate(z) for z in zip(*overlap_links(ends_a, ends_b, step=3))]
    whole = dense(incidence(ends_a)) @ dense(incidence(ends_b)).T
    assert (np.stack(parts[:2]) == np.stack(np.nonzero(whole))).all() and (parts[2] == whole[np.nonzero(whole)]).all()
    groups = common_groups(ends_a, ends_b)
    shared = gustavson(*groups.matrices())
    assert groups.of_a.tolist() == [0, 0, 1, 1] and groups.of_b.tolist() == [0, 0, 1, 1, 1]
    assert np.diff(shared.starts).tolist() == groups.partners().tolist() == [2, 2, 3, 3]
    assert (dense(shared) > 0)[whole > 0].all()
