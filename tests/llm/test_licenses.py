import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rootspan.llm.license_rules import rules
from rootspan.llm.licenses import BASE, Finding, detect, license_spans, resolve, scan, scan_licenses, words_of
from rootspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    """The contract, word by word: n_words, places, labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def by_pairs(found):
    """Overlaps resolved by comparing all pairs, best first."""
    kept = []
    for f in sorted(found, key=lambda f: (f.rule.priority, f.start - f.end, f.start, f.rule.number)):
        inside = lambda a, b: b.start <= a.start and a.end <= b.end
        if not any(inside(f, k) or inside(k, f) for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f.start, f.end, f.rule.number))


def slow(doc_id, text):
    n, hits, first, last, own = base(text)
    words = words_of((text or "").encode())
    kept = by_pairs(detect(words, b" ".join(words), gated=False))
    labels = sorted({f.rule.label for f in kept} | set(filter(None, own.split(","))))
    return doc_id, n, hits, first, last, own, ",".join(labels), max([f.rule.weight for f in kept] + [0.95] * (hits > 0), default=0.0), len(kept)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_plain_search(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    df = QUERIES["op11_licenses"](spark, SF)
    assert df.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert got(df) == sorted((slow(r.doc_id, r.text) for r in rows), key=repr)
    assert any(r.base_labels for r in df.collect())


ODD = [
    (1, None), (2, ""), (3, " \n\t.,;"), (4, "UNDER THE MIT LICENSE; under-the_mit/license. Apache License, Version 2.0; CC BY-NC 4.0"), (5, "under the mit licenses"), (6, "sunder the mit license"), (7, "cc by nc cc by nc"),
    (8, "ünder the MİT license — under the mit license x under the mit license"), (9, "Mit freundlichen Grüßen, mit Lizenz"), (9, "Mit freundlichen Grüßen, mit Lizenz"), (None, "SPDX-License-Identifier: GPL-3.0-or-later"), (10, "x" * 300_000 + " under the mit license"),
    (11, "licensed under the Apache License, Version 2.0. All rights reserved. " * 3000), (12, "This work is licensed under the GNU General Public License, version 3"),
]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("labels", F.lit("x")).withColumn("Score", F.lit(1)).repartition(3)
    short = [(d, t) for d, t in ODD if d != 11]
    assert got(scan_licenses(df.where("doc_id is null or doc_id <> 11"))) == sorted((slow(d, t) for d, t in short), key=repr)
    row = scan_licenses(df.where("doc_id = 11")).first()
    assert (row.n_base, row.labels, row.n_findings) == (3000, "apache-2,reserved", 6000)
    assert got(scan_licenses(df.limit(0))) == []
    bad = spark.sql("select 1L doc_id, cast(x'FF20756E64657220746865206D6974206C6963656E7365FE' as string) text")
    assert scan_licenses(bad).first().n_words == 5


def test_labels_of_known_statements(spark):
    known = {
        "Licensed under the Apache License, Version 2.0": "apache-2", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "Licensed under CC BY-NC 4.0": "cc-by-nc", "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "see http://www.gnu.org/licenses/lgpl-3.0.html": "lgpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl", "distributed under the GNU GPL v2 or later": "gpl-2", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "This is free and unencumbered software released into the public domain.": "unlicense", "Copyright (c) 2020 A. B. All rights reserved.": "reserved", "They came with a license to fish.": "", "The open server has a common font.": "",
    }
    for text, want in known.items():
        assert ",".join(sorted({f.rule.label for f in scan(text.encode()).findings})) == want, text
    rows = license_spans(spark.createDataFrame([(1, "Hello, Licensed under CC BY-NC 4.0 there")], "doc_id long, text string")).collect()
    assert [(r.start, r.end, r.label, r.words) for r in rows] == [(1, 8, "cc-by-nc", "licensed under cc by nc 4 0")]


def test_overlaps_resolve_as_by_pairs():
    r, listed = random.Random(6), rules()
    for _ in range(300):
        found = []
        for _ in range(r.randrange(12)):
            start = r.randrange(12)
            found.append(Finding(start, start + r.randrange(1, 8), r.choice(listed)))
        assert resolve(found) == by_pairs(list(dict.fromkeys(found)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_whatever_a_rule_finds_holds_a_keyword(data):
    for rule in rules():
        words = data.draw(st.from_regex(re.compile(rule.text.encode().replace(b"[^ ]+", b"[a-z]{1,3}")), fullmatch=True)).split()
        assert rule.keywords & set(words), (rule, words)


def test_rules_are_many_and_ordered():
    listed = rules()
    assert len(listed) > 250 and [r.priority for r in listed] == sorted(r.priority for r in listed)
    assert {k.decode() for k in BASE} == set(PHRASES)
