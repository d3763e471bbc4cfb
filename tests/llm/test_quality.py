import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rootspan.llm import ngrams, quality

SF = "/root/testdata/sf0.01"


def slow_model(texts, order=4):
    """Interpolated modified Kneser-Ney with dictionaries: a function (context tuple, symbol) -> p."""
    top = Counter()
    for t in texts:
        s = [0] * (order - 1) + quality.symbols_of(t).tolist()
        for i in range(order - 1, len(s)):
            top[tuple(s[i - order + 1 : i + 1])] += 1
    counts = [top]
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    cuts, totals = [], []
    for level in counts:
        n = Counter(min(c, 5) for c in level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts.append([min(k - 0.01, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)])
        by = defaultdict(lambda: [0, 0.0])
        for g, c in level.items():
            by[g[:-1]][0] += c
            by[g[:-1]][1] += min(c, cuts[-1][min(c, 3) - 1])
        totals.append(by)

    def p(context, symbol):
        k = len(context)
        lower = p(context[1:], symbol) if k else 1 / quality.ALPHABET
        if context not in totals[k]:
            return lower
        total, cut = totals[k][context]
        c = counts[k][context + (symbol,)]
        return (c - (min(c, cuts[k][min(c, 3) - 1]) if c else 0)) / total + cut / total * lower

    return p


def test_model_against_dictionaries(spark):
    texts = ["The cat sat on the mat.", "a cat, a hat; 12 bats!", "éà the that cat", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    table = quality.fit_model(df)
    p = slow_model(texts)
    rng = np.random.default_rng(0)
    picks = [quality.codes_of([t])[0] for t in texts] + [rng.integers(0, quality.ALPHABET**4, 300)]
    for code in np.concatenate(picks):
        digits = [int(code) // quality.ALPHABET**k % quality.ALPHABET for k in (3, 2, 1, 0)]
        assert math.isclose(2.0 ** -float(table[code]), p(tuple(digits[:3]), digits[3]), rel_tol=1e-4)
    sums = (2.0 ** -table.astype(float)).reshape(-1, quality.ALPHABET).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_held_out_labels(spark):
    """Trained on even documents' labels, judged on the odd ones."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge_quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = {(r.quality, r.toxic): r.kept for r in judged.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert got[1, 0] >= 0.99 and got[0, 0] <= 0.25


def test_perplexity_by_hand(spark):
    docs = spark.createDataFrame([(1, "abab", "en", 9), (2, "ab", "en", 9), (3, None, None, 9), (4, "", "fr", 9), (None, "zz", "en", 9), (2, "ab", "en", 9)], "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs, labels).collect()
    assert len(rows) == 6
    p = slow_model(["abab"])
    for r in rows:
        if r.doc_id in (1, 2):
            s = [0, 0, 0] + quality.symbols_of("abab" if r.doc_id == 1 else "ab").tolist()
            bits = [-math.log2(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))]
            assert math.isclose(r.perplexity, 2 ** (sum(bits) / len(bits)), rel_tol=1e-4)
        if r.doc_id in (3, 4):
            assert r.keep and r.perplexity == 1.0
    assert quality.judge_quality(docs.limit(0), labels).count() == 0
    free = quality.judge_quality(docs, labels.limit(0)).collect()
    assert len(free) == 6 and all(r.keep for r in free)


def test_joins_give_the_same_perplexity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    levels = quality.fit_levels(quality.trusted_texts(docs, labels))
    by_joins = {r.doc_id: r.perplexity for r in quality.perplexity_by_joins(docs, levels).collect()}
    for r in quality.with_bits(docs.select("doc_id", "lang", "text"), quality.dense_model(levels)).collect():
        assert math.isclose(by_joins[r.doc_id], 2 ** (r.scored["bits"] / r.scored["chars"]), rel_tol=1e-3)


def test_scripts_beyond_latin(spark):
    """A model of Russian and Greek words tells shuffled letters from words."""
    rng = np.random.default_rng(4)
    words = {"ru": "это слово и ещё одно слово для примера который стоит здесь без всякого смысла но по правилам языка".split(), "el": "αυτό είναι ένα παράδειγμα με λέξεις που μένουν ίδιες και δείχνουν τη γλώσσα".split()}
    rows = [(i, lang, " ".join(rng.choice(words[lang], 60))) for lang in words for i in range(1000 * len(lang), 1000 * len(lang) + 60)]
    rows = [(k, lang, t) for k, (_, lang, t) in enumerate(rows)]
    bad = [(1000 + k, lang, "".join(rng.permutation(list(t)))) for k, lang, t in rows[::4]]
    docs = spark.createDataFrame(rows + bad, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.judge_quality(docs, labels).collect()}
    assert sum(keep[k] for k, _, _ in rows) >= 0.97 * len(rows) and not any(keep[k] for k, _, _ in bad)


def test_keep_good_passes_other_columns(spark):
    rows = [(1, "ab ab", "en", 1, "x"), (2, None, None, 2, "y"), (2, None, None, 2, "y"), (None, "ab", "en", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, scored int, threshold string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.keep_good(docs, labels)
    assert got.dtypes == docs.dtypes and {tuple(r) for r in got.collect()} >= set(rows[:2]) and quality.keep_good(docs.limit(0), labels).count() == 0


def test_characters_are_not_folded(spark):
    """Digits, capitals and letters of other scripts are symbols of their own; the perplexity is that of dictionaries over code points."""
    docs = spark.createDataFrame([(1, "A1 Β2 A1 Β2 é", "en"), (2, "A1 Β2", "en"), (3, "B3 Γ4", "en"), (4, "\U0001f600é", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality.judge_quality(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    size = np.bincount([int(quality.symbols_of(chr(c))[0]) for c in range(0x110000) if not 0xD800 <= c < 0xE000], minlength=quality.ALPHABET)
    size[45:] += np.bincount([(c % 11) for c in range(0xD800, 0xE000)], minlength=11)
    t = "\0\0\0A1 Β2 A1 Β2 é"
    counts = [Counter(t[i - 3 : i + 1] for i in range(3, len(t)))]
    for _ in range(3):
        counts.insert(0, Counter(g[1:] for g in counts[0]))

    def p(g):
        if not g:
            return 0.0
        level = counts[len(g) - 1]
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cut = [min(k - 0.01, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]
        less = lambda c: min(c, cut[min(c, 3) - 1]) if c else 0
        lower = p(g[1:]) if len(g) > 1 else 1 / quality.ALPHABET / size[int(quality.symbols_of(g)[0])]
        near = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        return (level[g] - less(level[g])) / sum(near.values()) + sum(map(less, near.values())) / sum(near.values()) * lower if near else lower

    for r in docs.collect():
        s = "\0\0\0" + r.text
        bits = [-math.log2(max(p(s[i - 3 : i + 1]), 1e-12)) for i in range(3, len(s))]
        assert math.isclose(got[r.doc_id], 2 ** (sum(bits) / len(bits)), rel_tol=1e-4)
    assert got[3] > 10 * got[2]


def test_a_block_asks_for_an_ngram_once(spark):
    """26 MB of text in one task: one list of n-grams for all of it, and frames that don't hold more than a few MB."""
    docs = spark.range(0, 24, 1, 1).select("id", F.lit("en").alias("lang"), F.expr("repeat('the cat sat on a mat. ', 50000)").alias("text"))
    asked = ngrams.mapped(docs.select("text"), ngrams._dictionaries, "block long, context long, symbol long").select("context", "symbol")
    assert asked.count() == asked.distinct().count() > 0
    assert ngrams.mapped(docs, ngrams._packed, "block long, rows binary").count() >= 8
    levels = ngrams.fit(docs.limit(1).select(F.col("text").cast("binary").alias("text"), F.lit(0).alias("half")))
    got = ngrams.with_bits(docs, levels, "scored", "text").select("id", "scored.chars", "scored.bits2").collect()
    assert {r.id for r in got} == set(range(24)) and {r.chars for r in got} == {1_100_000} and len({round(r.bits2, 3) for r in got}) == 1
