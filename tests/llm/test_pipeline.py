"""Each stage against a plain version on what its predecessor kept."""

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from rootspan.llm import decontaminate, packing, quality
from rootspan.llm.common import table
from rootspan.scratch import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def smallest_of_similar(texts):
    """Smallest ids of the components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by all pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        size = min(5, len(words))
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(materialize(stage(spark, states[-1], SF), name))
    for before, after in zip(states[:4], states[1:5]):
        assert after.dtypes == docs.dtypes and after.count() <= before.count()
    given, good, single, clean, masked = (rows(s) for s in states[:5])
    keep = {r.doc_id: r.keep for r in quality.judge_quality(docs, table(spark, SF, "labels")).collect()}
    assert set(good) == {i for i in given if keep[i]}
    assert set(single) == smallest_of_similar({i: r.text for i, r in good.items()})
    leaked = {r.doc_id for r in decontaminate.find_leaks(states[2], table(spark, SF, "benchmark")).collect()}
    words = {i: " ".join(re.findall(r"\w+", r.text.lower())) for i, r in single.items()}
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, SF, "benchmark").collect()]
    assert set(clean) == set(single) - leaked
    assert all(i in leaked for i, t in words.items() if any(x in t for x in items))
    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert not re.search(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r.text)
        assert r.n_chars == len(r.text) and (r.text == clean[i].text or "<secret>" in r.text)
    got, fill = defaultdict(int), defaultdict(int)
    for r in states[5].collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert set(got) == set(masked) and max(fill.values()) <= packing.CAPACITY
    counts = np.bincount([r.length for r in states[5].collect()], minlength=packing.CAPACITY + 1)
    assert len(fill) <= packing.bin_bound(counts, packing.CAPACITY) + 1


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, malformed UTF-8, clashing column names and an empty table go through every stage."""
    text = "A plain text of several words that says nothing bad and goes on for a while, as texts do."
    rows = [(1, text), (1, text), (None, text + " More."), (2, None), (3, ""), (3, ""), (4, "x" * 200_000), (5, text + " token=abcdefabcdef1234")]
    df = spark.createDataFrame([(i, t, "en", len(t or ""), *range(8)) for i, t in rows], "doc_id long, text string, lang string, n_chars long, leaked int, scored int, threshold int, component_id int, key int, LANG_OF_LIMIT int, band int, spans int")
    bad = spark.createDataFrame([(6, bytearray(b"caf\xff\xfe word"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text", "'en' lang", "9L n_chars", *[f"{k} {c}" for k, c in enumerate(df.columns[4:])])
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        one = [(1, 1, 0)] if name == "labels" else [(1, "an item that is nowhere to be found in any text here")]
        spark.createDataFrame(one, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (df.unionByName(bad), df.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = materialize(stage(spark, docs, f"file://{tmp_path}"), name)
            assert docs.dtypes == df.dtypes and docs.count() <= n
        ids = {r.doc_id for r in docs.collect()}
        assert n == 0 or {1, None, 2} <= ids and not docs.where("text like '%abcdefabcdef1234%'").count()
        packed = corpus_pipeline.STAGES[4][1](spark, docs, f"file://{tmp_path}")
        assert {r.doc_id for r in packed.collect()} == ids
