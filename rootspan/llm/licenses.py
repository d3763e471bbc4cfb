"""License scan: ordered signature rules over the words of a text, gated by keywords, with overlaps resolved.

A text becomes its words, in lower case and with one space between. The words it holds select the rules that can find
anything; only those run. Findings are spans of words. Where one span contains another, the rule of the higher priority stays, among
equals the longer span, then the earlier rule; what only overlaps in part stays. Three base phrases are looked for apart from this.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, mapped
from rootspan.llm.license_rules import Rule, rules

#: Phrases whose places are counted, with their labels.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
_SIGNS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
_FOLD = bytes.maketrans(_SIGNS + bytes(range(65, 91)), b" " * len(_SIGNS) + bytes(range(97, 123)))


class Finding(NamedTuple):
    """Words ``start`` to ``end`` (exclusive) and the rule that found them."""

    start: int
    end: int
    rule: Rule


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: digits, letters and whatever is beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


class _Places:
    """Word numbers of byte offsets in ``text``, asked for in ascending order."""

    def __init__(self, text: bytes):
        self.text, self.at, self.word = text, 0, 0

    def __call__(self, offset: int) -> int:
        self.word += self.text.count(b" ", self.at, offset)
        self.at = offset
        return self.word


def base_places(text: bytes) -> list[tuple[int, str]]:
    """``(word, label)`` of each place of a base phrase in words with single spaces."""
    out, framed = [], b" " + text + b" "
    for phrase, label in BASE.items():
        place, at = _Places(text), framed.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((place(at), label))
            at = framed.find(b" " + phrase + b" ", at + 1)
    return out


@lru_cache(maxsize=1)
def _index() -> tuple[list[Rule], list, dict[bytes, list[int]]]:
    """The rules, their patterns, and the rules of each keyword."""
    listed = rules()
    by_word: dict[bytes, list[int]] = {}
    for rule in listed:
        for word in rule.keywords:
            by_word.setdefault(word, []).append(rule.number)
    return listed, [rule.pattern() for rule in listed], by_word


def detect(words: list[bytes], text: bytes, gated: bool = True) -> list[Finding]:
    """What the rules find, overlaps and all; ``gated=False`` runs every rule."""
    listed, patterns, by_word = _index()
    chosen = sorted({n for w in by_word.keys() & set(words) for n in by_word[w]}) if gated else range(len(listed))
    out = []
    for n in chosen:
        place = _Places(text)
        for m in patterns[n].finditer(text):
            start = place(m.start())
            out.append(Finding(start, start + m[0].count(b" ") + 1, listed[n]))
    return out


def resolve(found: list[Finding]) -> list[Finding]:
    """Findings without those that contain, or lie in, one of a higher priority, or lie in another of their own."""
    kept: list[Finding] = []
    starts: list[int] = []
    reach: list[int] = []
    nearest: list[int] = []
    for priority in sorted({f.rule.priority for f in found}):
        top = -1
        for f in sorted((f for f in found if f.rule.priority == priority), key=lambda f: (f.start, -f.end, f.rule.number)):
            before, after = bisect_right(starts, f.start), bisect_left(starts, f.start)
            inside = before and reach[before - 1] >= f.end  # one that starts no later ends no earlier
            around = after < len(starts) and nearest[after] <= f.end  # one that starts no earlier ends no later
            if f.end > top and not inside and not around:
                kept.append(f)
                top = f.end
        ordered = sorted(kept, key=lambda f: f.start)
        starts = [f.start for f in ordered]
        reach = list(accumulate((f.end for f in ordered), max))
        nearest = list(accumulate((f.end for f in reversed(ordered)), min))[::-1]
    return sorted(kept, key=lambda f: (f.start, f.end, f.rule.number))


class Scan(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]
    findings: list[Finding]
    score: float


def scan(text: bytes) -> Scan:
    """The whole scan of one UTF-8 text. score: the weight of the best rule that stays, a base phrase counting as a grant; 0 without any."""
    words = words_of(text)
    joined = b" ".join(words)
    base, kept = base_places(joined), resolve(detect(words, joined))
    return Scan(len(words), base, kept, max([f.rule.weight for f in kept] + [0.95] * bool(base), default=0.0))


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_findings long"
FOUND = "doc_id long, start long, end long, label string, priority int, rule int, words string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    for batch in bounded(batches, "text"):
        yield [(d, t or b"") for d, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist())]


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _texts(batches):
        rows = []
        for doc_id, text in texts:
            s = scan(text)
            places, own = [w for w, _ in s.base], {label for _, label in s.base}
            labels = own | {f.rule.label for f in s.findings}
            rows.append((doc_id, s.n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), s.score, len(s.findings)))
        yield _record(rows, SCANNED)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _texts(batches):
        rows = []
        for doc_id, text in texts:
            words = words_of(text)
            for f in resolve(detect(words, b" ".join(words))):
                rows.append((doc_id, f.start, f.end, f.rule.label, f.rule.priority, f.rule.number, b" ".join(words[f.start : f.end]).decode("utf-8", "replace")))
        yield _record(rows, FOUND)


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_findings`` for every row of ``docs`` (doc_id, text).

    n_base counts the places of the base phrases, first_word and last_word are the first and last of them (words from 0), null
    without one. labels holds those of the rules and the base ones, sorted, joined by commas; a rule's finding never takes a base label away.
    score: between 0 and 1, how plainly the best finding speaks.

    A null or empty text has no words and no labels. Malformed UTF-8 counts as letters. Texts of any length are scanned whole. Null and
    repeated doc_ids keep their rows. Other columns are not read. Empty in, empty out.
    """
    return mapped(_given(docs), _scanned, SCANNED)


def license_spans(docs: DataFrame) -> DataFrame:
    """A row for each finding that stays: ``doc_id, start, end, label, priority, rule, words``; places count words, end is exclusive."""
    return mapped(_given(docs), _spans, FOUND)
