import random
from itertools import combinations, product

import numpy as np
import xxhash

from rootspan.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_print(text):
    """The contract word for word, bit by bit."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, max_bits=3):
    prints = {i: slow_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= max_bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_cycle_of_segments_covers_every_error_pattern():
    for e in product(range(4), repeat=4):
        if sum(e) <= 3:
            assert any(e[i] == 0 and e[(i + 1) % 4] <= 1 for i in range(4)), e


def test_golay_code_is_perfect_and_neighbours_share_an_index():
    patterns, count = simhash.error_patterns()
    assert count.sum() == 1 + 23 + 253 + 1771 + 8855
    assert all(bin(int(p)).count("1") <= 3 for p in patterns[:, 0])
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index, real = simhash.nearby_codewords(words)
    for bit in range(23):
        other, there = simhash.nearby_codewords(words ^ (1 << bit))
        for i in range(len(words)):
            assert set(index[i][real[i]]) & set(other[i][there[i]])


def test_forest_joins_what_is_connected():
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(5):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = np.array(sorted(prints), dtype=np.uint64)
    a, b = simhash.forest(prints)
    assert len(a) < len(prints)
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        assert find(int(x)) != find(int(y))
        root[find(int(x))] = find(int(y))
    for x, y in combinations([int(p) for p in prints], 2):
        if bin(x ^ y).count("1") <= 3:
            assert find(x) == find(y)


def test_small_fixture_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(200, 400))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for t in texts[:4]:
        for _ in range(10):
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, " \n\t"), (len(rows) + 4, "One Two"), (len(rows) + 5, "one\ttwo"), (len(rows) + 6, "É two THREE"), (len(rows) + 7, "é two three")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    want = slow_components(rows)
    for limit in (4096, 4):  # the second sends buckets through blocks
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df, bucket_limit=limit).collect()}
        assert got == want


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, key long"
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2), (None, None, None)], schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    kept = simhash.near_dedup(df)
    assert kept.count() == 4 and kept.columns == df.columns
    more = df.unionByName(spark.createDataFrame([(9, "A b c d", 3)], schema))
    assert simhash.near_dedup(more).where("doc_id = 9").count() == 0


def test_near_dedup_is_jaccard_by_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(60, 300))))
        texts.append(base)
        for edits in (1, 2, 4, 8, 16):
            copy = list(base)
            for at in rng.integers(0, len(base), edits):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(copy)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (1002, "one two three"), (1003, "One two  three"), (1004, "one two four")]
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").lower().split()) for i, t in docs)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    differing = 0
    for a, b in combinations(sets, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            differing += sets[a] != sets[b]
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert differing > 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == {i: find(i) for i in sets}
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == {i for i in sets if find(i) == i}


def written_rows(monkeypatch):
    """Row counts of all tables that simhash writes from now on."""
    seen, write = [], simhash.materialize

    def counted(df, name="table"):
        out = write(df, name)
        seen.append((out.count(), name))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    return seen


def family(n, shared=350, own=75):
    """Texts that have most of their words in common, but not enough of them."""
    return [" ".join([f"w{i}" for i in range(shared)] + [f"own{k}x{i}" for i in range(own)]) for k in range(n)]


def test_a_family_that_is_not_alike_enough_makes_no_table_of_its_pairs(spark, monkeypatch):
    texts = family(200)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7] + " more", texts[150] + " words"])], "doc_id long, text string")
    seen = written_rows(monkeypatch)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == {i: i for i in range(200)} | {200: 7, 201: 150}
    assert max(seen)[0] <= 202 * simhash.BANDS  # a band of all of them has 20,000 pairs


def test_families_in_blocks_and_band_by_band_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [t.split() for t in family(60, 200, 40)]
    for k in range(60):
        copy = list(texts[k])
        copy[int(rng.integers(0, 200))] = "changed"
        texts.append(copy)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: i % 60 for i in range(120)}
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want
    monkeypatch.setattr(simhash, "FAMILY", 20)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want


def test_near_dedup_takes_its_first_pairs_from_the_fingerprints(spark):
    base = [f"w{i}" for i in range(4000)]
    changed = ["new", *base[1:]]
    prints = [simhash.set_print(simhash.shingle_set(" ".join(w).encode())) for w in (base, changed)]
    assert prints[0].bit_count() and (prints[0] ^ prints[1]).bit_count() <= 3 and simhash.set_print(simhash.shingle_set(b"")) == 0
    signed = [int(np.uint64(p).astype(np.int64)) for p in (prints[0], prints[0] ^ 0b101, prints[0], prints[0] ^ 0xFFFF0000)]
    sets = spark.createDataFrame([(7, signed[0]), (3, signed[1]), (9, signed[2]), (1, signed[3])], "key long, fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.print_pairs(sets).collect()}
    assert got == {frozenset((7, 9)), frozenset((7, 3))}
