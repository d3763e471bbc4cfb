"""Exact repeats of fifty bytes across documents, by prefix-free parsing.

*Triggers.* A place is a trigger if its ``K``-gram has the smallest rolling hash (leftmost on ties)
among the K-grams of some string of ``LENGTH`` bytes. Every such string has exactly one trigger, and
it depends on the string alone, so equal strings have equal triggers at equal places. Triggers cut a
text into overlapping phrases: a phrase is the union of the strings that share a trigger, a run of
up to ``LENGTH - K + 1`` starts. No phrase is a prefix of another with the same trigger and number of
starts, and what a whole phrase can tell never needs the text.

*Parse.* The parse is each document's list of (trigger, phrase) hashes. Shuffled by trigger and sorted
by trigger, phrase and document, its first document of a phrase keeps it and later ones lose it whole.
That settles all but the phrases of triggers with several different ones, where strings repeat in part.

*Dictionary.* Of those the bytes are fetched. Each trigger's phrases get a suffix array by prefix
doubling up to ``LENGTH`` bytes; combined with the order of documents it gives the corpus order
(trigger, suffix, document), cut across tasks by trigger. Suffixes with a common prefix of ``LENGTH``
stand together, and all but those of the first document go. A trigger whose phrases would outweigh a
task's usual share (``GROUP_PHRASES``) is dealt out by suffix instead and Spark sorts and
combines these; both ways give the same rows. Order between suffixes of different triggers decides nothing
and is that of the triggers' hashes.

*Hot passages.* Copies of a phrase at most ``LENGTH`` bytes apart in a document are one entry with an
extent, so constant and periodic texts give few. A phrase that an earlier document of the batch or of the task's
earlier batches has is settled at once, so a passage that a third of all documents share leaves about one entry
a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, mapped
from rootspan.scratch import materialize

LENGTH, K = 50, 20
#: Bytes of text that are settled together, that are hashed together, and after which a long text is cut.
BATCH, CHUNK, SEGMENT = 4 << 20, 1 << 18, 1 << 18
#: Triggers a group of the first shuffle holds on average; least and most phrases of a trigger above which they
#: go by suffix; share of phrases that are usually looked into.
GROUP_TRIGGERS, GROUP_PHRASES, LOOKED_INTO = 1 << 18, (500, 20_000), 0.04
#: Repeated phrases of earlier batches that a task remembers; those forgotten only leave more entries.
REMEMBERED = 1 << 18
#: Bytes of phrases whose suffixes are sorted together, and of texts that a task of the later shuffles reads.
SORTED, TASK_BYTES = 4 << 20, 64 << 20
NO_ID = (1 << 63) - 1
PLACE = np.uint64((1 << 24) - 1)
MARKS = "kind int, doc long, part int, h long, lo long, n long, extent long"


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for one batch."""
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(CHUNK + SEGMENT + 4 * LENGTH, factor, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def triggers(pieces: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of each run of starts with one trigger: piece, first start, number of starts, hashes of trigger and phrase."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    starts = np.maximum(sizes - length + 1, 0)
    empty = np.zeros(0, np.int64)
    if not starts.any():
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    up, down = _powers()
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[raw] * up[: len(raw)], out=sums[1:])
    grams = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    least = (_mixed(grams) & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    window, width = length - k + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        rest = window - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    piece = np.repeat(np.arange(len(pieces)), starts)
    at = np.arange(len(piece)) + np.repeat(begin - (np.cumsum(starts) - starts), starts)
    chosen = (least[at] & PLACE).astype(np.int64)
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
    lo, n, place = at[first], np.diff(first, append=len(at)), chosen[first]
    phrase = (sums[lo + n + length - 1] - sums[lo]) * down[lo]
    return piece[first], lo - begin[piece[first]], n, _mixed(grams[place] + np.uint64(k)), _mixed(phrase ^ (n.astype(np.uint64) << np.uint64(57)))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte of all, which packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


PARSE = "pid long, size long, h binary, phrase binary, doc_no binary, lo binary, n binary, extent binary, docs binary, parts binary"


@dataclass
class Entries:
    """Phrases of documents: row of the batch, first start, starts, hashes of trigger and phrase, and by how much later the last of joined copies starts."""

    row: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    h: np.ndarray
    phrase: np.ndarray
    extent: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [self.row, self.lo, self.n, self.h, self.phrase, self.extent]

    def take(self, at: np.ndarray) -> Entries:
        return Entries(*(c[at] for c in self.columns()))

    def key(self) -> np.ndarray:
        return self.h ^ (self.phrase * np.uint64(0xD6E8FEB86659FD93))

    def joined(self) -> Entries:
        """By phrase, then row and place; copies at most LENGTH apart in a row are one entry.

        What is removed of a phrase is a run of its starts, which covers LENGTH - 1 bytes beyond its last; so it covers all bytes
        from the first copy's to the last one's.
        """
        e = self.take(np.lexsort((self.lo, self.row, self.key())))
        if not len(e.lo):
            return e
        end = e.lo + e.extent
        apart = (e.h[1:] != e.h[:-1]) | (e.phrase[1:] != e.phrase[:-1]) | (e.row[1:] != e.row[:-1]) | (e.lo[1:] - end[:-1] > LENGTH)
        first = np.flatnonzero(np.concatenate([[True], apart]))
        last = np.append(first[1:], len(e.lo)) - 1
        out = e.take(first)
        out.extent = end[last] - out.lo
        return out


def _together(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate(c) for c in zip(*(x.columns() for x in parts))))


class Memory:
    """First documents of phrases that repeated in earlier batches of a task."""

    def __init__(self):
        self.key = self.h = self.phrase = np.zeros(0, np.uint64)
        self.doc = np.zeros(0, np.int64)

    def first(self, key: np.ndarray, h: np.ndarray, phrase: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """``doc``, or a smaller one that is remembered for the phrase."""
        if not len(self.key):
            return doc
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = (self.h[at] == h) & (self.phrase[at] == phrase)
        return np.where(known, np.minimum(doc, self.doc[at]), doc)

    def add(self, key: np.ndarray, h: np.ndarray, phrase: np.ndarray, doc: np.ndarray) -> None:
        key, h, phrase, doc = (np.concatenate([new, old])[:REMEMBERED] for new, old in ((key, self.key), (h, self.h), (phrase, self.phrase), (doc, self.doc)))
        self.key, at = np.unique(key, return_index=True)  # of one key the newest stays
        self.h, self.phrase, self.doc = h[at], phrase[at], doc[at]


def _parse(groups: int, segment: int):
    """Texts → the entries of each batch, packed by group of triggers; entries settled inside the task have size below zero."""
    names = [x.split()[0] for x in PARSE.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 8]

    def packed(pid: int, sign: int, e: Entries, docs: np.ndarray, parts: np.ndarray) -> list:
        used, local = np.unique(e.row, return_inverse=True)
        extent = _planes(e.extent, 8) if e.extent.any() else b""
        return [pid, sign * len(e.lo), _planes(e.h, 8), _planes(e.phrase, 8 if sign < 0 else 5), _planes(local, 4), _planes(e.lo, 8), _planes(e.n, 1), extent, _planes(docs[used].view(np.uint64), 8), _planes(parts[used].astype(np.uint64), 4)]

    def settled_spans(e: Entries) -> Entries:
        """Starts of entries as spans, those that touch joined; their number stands where the phrase's hash does."""
        e = e.take(np.lexsort((e.lo, e.row)))
        end = np.maximum.accumulate(e.lo + e.n + e.extent + (e.row << 44)) - (e.row << 44)
        first = np.flatnonzero(np.concatenate([[True], (e.row[1:] != e.row[:-1]) | (e.lo[1:] > end[:-1])]))
        size = end[np.append(first[1:] - 1, len(end) - 1)] - e.lo[first]
        none = np.zeros(len(first), np.int64)
        return Entries(e.row[first], e.lo[first], none, none.view(np.uint64), size.astype(np.uint64), none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in bounded(batches, "text", BATCH):
            docs = column(batch, "doc").to_numpy(zero_copy_only=False)
            parts = column(batch, "part").to_numpy(zero_copy_only=False)
            found: list[Entries] = []
            pieces, owner, offset, held = [], [], [], 0
            for i, text in enumerate(column(batch, "text").to_pylist()):
                for at in range(0, len(text or b""), segment):
                    piece = text[at : at + segment + LENGTH - 1]
                    if len(piece) < LENGTH:
                        continue
                    if pieces and held + len(piece) > CHUNK:
                        found.append(_entries(pieces, owner, offset))
                        pieces, owner, offset, held = [], [], [], 0
                    pieces.append(piece)
                    owner.append(i)
                    offset.append(at)
                    held += len(piece)
            if pieces:
                found.append(_entries(pieces, owner, offset))
            if not found:
                continue
            e = _together(found).joined()
            doc = docs[e.row]
            new = np.flatnonzero(np.concatenate([[True], (e.h[1:] != e.h[:-1]) | (e.phrase[1:] != e.phrase[:-1])]))
            key, first = e.key()[new], np.minimum.reduceat(doc, new)
            known = memory.first(key, e.h[new], e.phrase[new], first)
            gone = doc > np.repeat(known, np.diff(new, append=len(doc)))
            again = np.logical_or.reduceat(gone, new)
            memory.add(key[again], e.h[new][again], e.phrase[new][again], known[again])
            rows = []
            if gone.any():
                rows.append(packed(int(e.h[np.argmax(gone)] % np.uint64(groups)), -1, settled_spans(e.take(gone)), docs, parts))
            left = e.take(~gone)
            pid = (left.h % np.uint64(groups)).astype(np.int64) * 2 + (left.extent > 0)  # entries with an extent go in rows of their own
            order = np.lexsort((left.h, pid))
            left, pid = left.take(order), pid[order]
            cuts = np.flatnonzero(np.diff(pid, prepend=-1))
            for s, t in zip(cuts, np.append(cuts[1:], len(pid))):
                rows.append(packed(int(pid[s]) // 2, 1, left.take(slice(s, t)), docs, parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _entries(pieces: list[bytes], owner: list[int], offset: list[int]) -> Entries:
    piece, lo, n, h, phrase = triggers(pieces)
    at = lo + np.array(offset, dtype=np.int64)[piece]
    return Entries(np.array(owner, dtype=np.int64)[piece], at, n, h, phrase & np.uint64((1 << 40) - 1), np.zeros(len(lo), np.int64)).joined()


def _settle(group_phrases: int):
    """A group's entries in corpus order → kind 0: starts that are removed; 1: phrases to look into; 2: the same for large triggers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for row in pdf.itertuples(index=False):
            size = abs(row.size)
            local = _unplanes(row.doc_no, size, 4).astype(np.int64)
            docs = _unplanes(row.docs, len(row.docs) // 8, 8).view(np.int64)[local]
            parts = _unplanes(row.parts, len(row.parts) // 4, 4).astype(np.int64)[local]
            lo = _unplanes(row.lo, size, 8).astype(np.int64)
            none = np.zeros(size, np.int64)
            if row.size < 0:
                out.append(marks(0, docs, parts, none, lo, _unplanes(row.phrase, size, 8).astype(np.int64), none))
                continue
            extent = _unplanes(row.extent, size, 8).astype(np.int64) if row.extent else none
            got = (_unplanes(row.h, size, 8), _unplanes(row.phrase, size, 5), docs, parts, lo, _unplanes(row.n, size, 1).astype(np.int64), extent)
            for to, x in zip(cols, got):
                to.append(x)
        if not cols[0]:
            return pd.concat(out)
        h, phrase, doc, part, lo, n, extent = (np.concatenate(c) for c in cols)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = hs[1:] == hs[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if len(order):
            order = order[np.lexsort((doc[order], phrase[order], h[order]))]
            h, phrase, doc, part, lo, n, extent = (c[order] for c in (h, phrase, doc, part, lo, n, extent))
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], phrase[1:] != phrase[:-1]])
            first = doc[np.flatnonzero(new)]
            gone = doc > first[np.cumsum(new) - 1]
            out.append(marks(0, doc[gone], part[gone], np.zeros(int(gone.sum()), np.int64), lo[gone], (n + extent)[gone], np.zeros(int(gone.sum()), np.int64)))
            trigger = np.cumsum(new_h) - 1
            by_phrase = trigger[np.flatnonzero(new)]
            heads = np.flatnonzero(np.diff(by_phrase, prepend=-1))
            phrases = np.diff(heads, append=len(by_phrase))
            open_ = (phrases > 1) & (np.minimum.reduceat(first, heads) < np.maximum.reduceat(first, heads))
            keep = ~gone & open_[trigger]
            many = np.bincount(trigger, weights=keep)[trigger] > group_phrases
            for kind, at in ((1, keep & ~many), (2, keep & many)):
                out.append(marks(kind, doc[at], part[at], h[at].view(np.int64), lo[at], n[at], extent[at]))
        return pd.concat(out) if out else marks(0, *[np.zeros(0, np.int64)] * 6)

    return run


def marks(kind: int, doc, part, h, lo, n, extent) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int32), "doc": doc, "part": part.astype(np.int32), "h": h, "lo": lo, "n": n, "extent": extent})


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts made smaller for their shuffle, with size and digest."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in bounded(batches, "text"):
        texts = [t or b"" for t in column(batch, "text").to_pylist()]
        arrays = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([pack.compress(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "doc"), column(batch, "part"), *arrays], ["doc_id", "doc", "part", "n_bytes", "sha256", "packed"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each phrase asked for."""
    names = ["kind", "h", "doc", "part", "lo", "extent", "bytes"]
    for batch in bounded(batches, "packed", 1 << 20):
        for doc, part, packed, asked in zip(*(column(batch, c).to_pylist() for c in ("doc", "part", "packed", "asked"))):
            text = zstandard.ZstdDecompressor().decompress(packed)
            for at in range(0, len(asked), 50_000):
                some = asked[at : at + 50_000]
                cols = [[q["kind"] for q in some], [q["h"] for q in some], [doc] * len(some), [part] * len(some), [q["lo"] for q in some], [q["extent"] for q in some]]
                cols.append([text[q["lo"] : q["lo"] + q["n"] + LENGTH - 1] for q in some])
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes from each place of ``data`` on, by prefix doubling: 8, 16, 32, and then two overlapping 32s."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    rank = np.unique(np.ascontiguousarray(words).view(">u8").ravel(), return_inverse=True)[1].astype(np.uint64)
    for have, step in ((8, 8), (16, 16), (32, LENGTH - 32)):
        pairs = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    return rank.astype(np.int64)


def repeated_starts(trigger: np.ndarray, doc: np.ndarray, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first start, number) of each run of starts whose suffix an earlier document's phrase of the same trigger has.

    The suffixes of all phrases in the order trigger, suffix, document; LENGTH bytes in common make neighbors one group.
    """
    sizes = np.array([len(p) for p in phrases], dtype=np.int64)
    starts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(phrases)), starts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    rank = suffix_ranks(np.frombuffer(b"".join(phrases), dtype=np.uint8))[inner + np.repeat(np.cumsum(sizes) - sizes, starts)]
    order = np.lexsort((doc[owner], rank, trigger[owner]))
    t, r = trigger[owner[order]], rank[order]
    group = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])]))
    d = doc[owner[order]]
    gone = np.zeros(len(owner), dtype=bool)
    gone[order] = d > np.repeat(d[group], np.diff(group, append=len(d)))
    at = np.flatnonzero(gone)
    run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(run)
    return owner[at[first]], inner[at[first]], np.diff(first, append=len(at))


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by trigger → removed starts, whole triggers at a time."""

    def looked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        h, doc, part, lo, extent = (np.concatenate([column(x, c).to_numpy(zero_copy_only=False) for x in held]) for c in ("h", "doc", "part", "lo", "extent"))
        row, start, n = repeated_starts(h, doc, [p for x in held for p in column(x, "bytes").to_pylist()])
        cols = [pa.array(doc[row]), pa.array(part[row].astype(np.int32)), pa.array(lo[row] + start), pa.array(n + extent[row])]
        return pa.RecordBatch.from_arrays(cols, ["doc", "part", "lo", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in bounded(batches, "bytes", SORTED):
        h = column(batch, "h").to_numpy(zero_copy_only=False)
        if held and size >= SORTED:
            cut = int(np.searchsorted(h, column(held[-1], "h")[-1].as_py(), side="right"))
            if cut < len(h):
                yield looked([*held, batch.slice(0, cut)] if cut else held)
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += int(pc.sum(pc.binary_length(column(batch, "bytes"))).as_py() or 0)
    if held:
        yield looked(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of the removed starts' strings."""
    for batch in bounded(batches, "packed", 1 << 20):
        out: list[list] = [[] for _ in range(3)]
        for size, sha256, packed, removed in zip(*(column(batch, c).to_pylist() for c in ("n_bytes", "sha256", "packed", "removed"))):
            spans: list[list[int]] = []
            for r in sorted((r["lo"], r["lo"] + r["n"] + LENGTH - 1) for r in removed or []):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            if spans:
                text = zstandard.ZstdDecompressor().decompress(packed)
                edges = [0, *(x for s in spans for x in s), size]
                sha256 = hashlib.sha256(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest()
            for to, x in zip(out, (sum(b - a for a, b in spans), len(spans), sha256)):
                to.append(x)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, group_triggers: int = GROUP_TRIGGERS, group_phrases: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Removed is each byte covered by a string of 50 bytes that also starts in a document with a smaller
    doc_id. A null text is empty. A null doc_id counts as larger than all others; rows with the same
    doc_id, or with null ones, take nothing from each other, whether their texts differ or not. Other
    columns are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    given = _numbered(docs)
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    triggers_in_all = total * 2 / (LENGTH - K + 2)
    groups = max(1, int(triggers_in_all / group_triggers))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / TASK_BYTES))
    if group_phrases is None:
        group_phrases = int(min(max(GROUP_PHRASES[0], triggers_in_all * LOOKED_INTO / partitions), GROUP_PHRASES[1]))
    entries = mapped(given.select("doc", "part", "text"), _parse(groups, segment), PARSE)
    settled = materialize(entries.groupBy("pid").applyInPandas(_settle(group_phrases), MARKS), "marks")
    texts = mapped(given.select("doc_id", "doc", "part", "text"), _pack_texts, "doc_id long, doc long, part int, n_bytes long, sha256 string, packed binary").repartition(partitions, "doc", "part")
    spans = settled.where("kind = 0").select("doc", "part", "lo", "n").unionByName(_partial_repeats(settled, texts, partitions))
    removed = spans.groupBy("doc", "part").agg(F.collect_list(F.struct("lo", "n")).alias("removed"))
    cut = texts.join(removed, ["doc", "part"], "left").select("doc_id", "n_bytes", "sha256", "packed", "removed")
    return mapped(cut, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, doc, part``: different texts of one doc_id get numbers; with unique ids there are none, and all are 0."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    shared = given.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("doc")
    shared = materialize(shared, "shared")
    if not shared.take(1):
        return given.withColumn("part", F.lit(0))
    versions = given.select("doc", "text").join(shared, "doc", "left_semi").select("doc", F.sha2("text", 256).alias("version")).distinct()
    numbered = versions.selectExpr("doc", "version", "cast(row_number() over (partition by doc order by version) as int) as part")
    given = given.withColumn("version", F.sha2("text", 256)).join(materialize(numbered, "versions"), ["doc", "version"], "left")
    return given.drop("version").withColumn("part", F.coalesce("part", F.lit(0)))


def _partial_repeats(settled: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """``doc, part, lo, n``: removed starts of phrases that repeat in part."""
    asked = settled.where("kind > 0").groupBy("doc", "part").agg(F.collect_list(F.struct("kind", "h", "lo", "n", "extent")).alias("asked"))
    wanted = texts.join(asked, ["doc", "part"]).select("doc", "part", "packed", "asked")
    fetched = mapped(wanted, _fetch, "kind int, h long, doc long, part int, lo long, extent long, bytes binary")
    some = fetched.where("kind = 1").select("h", "doc", "part", "lo", "extent", "bytes").repartition(partitions, "h").sortWithinPartitions("h", "doc")
    spans = mapped(some, _look_up, "doc long, part int, lo long, n long")
    if not settled.where("kind = 2").take(1):
        return spans
    starts = F.sequence(F.lit(1), F.octet_length("bytes") - (LENGTH - 1))
    suffix = fetched.where("kind = 2").select("doc", "part", "lo", "extent", F.posexplode(F.transform(starts, lambda i: F.substring("bytes", i, F.lit(LENGTH)))).alias("i", "suffix"))
    suffix = suffix.select("doc", "part", (F.col("lo") + F.col("i")).alias("lo"), "extent", F.unhex(F.substring(F.sha2("suffix", 256), 1, 32)).alias("suffix"))
    suffix = materialize(suffix, "suffixes")
    least = suffix.groupBy("suffix").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("suffix", "first")
    dealt = suffix.join(materialize(least, "suffixes"), "suffix").where("doc > first")
    return spans.unionByName(dealt.select("doc", "part", "lo", (F.col("extent") + 1).alias("n")))
