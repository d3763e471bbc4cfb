"""Two tokenizers' tokens aligned by the bytes they share: sparse incidence products, counted over the whole corpus.

Each side is a 0/1 matrix of tokens by bytes in compressed sparse rows. Gustavson's row product A·Bᵀ has an
entry for each pair of tokens that overlap, and its value is how many bytes they share. Offsets where tokens of
both sides end cut both sequences into groups; the product of the two token-group matrices links what shares a
group, and its row sizes alone count those links, so a group however long costs only its tokens.

Texts are encoded once. Documents go by in blocks of bounded numbers of links; a block leaves a row for each document, with
its distinct id pairs, and a dictionary of its pairs. Only dictionaries are summed and joined with the corpus-wide
counts, so what is shuffled is a block's distinct pairs, not every document's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, byte_bpe, column, mapped, token_ids, tokenizer_path
from rootspan.scratch import materialize

#: Bytes of text aligned at once, bytes of one product, links after which a block is closed.
SLICE_BYTES, PRODUCT_BYTES, BLOCK_LINKS = 1 << 20, 1 << 20, 2_000_000


class Csr(NamedTuple):
    """A sparse matrix by rows: those of row i are ``columns[starts[i]:starts[i + 1]]``, ascending; values of None are ones."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes: token i holds the bytes from the end of the one before it to ``ends[i]``."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(n), n)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.columns, kind="stable")
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))]), m.rows()[order], len(m.starts) - 1)


def gustavson(a: Csr, b: Csr) -> Csr:
    """a·b for 0/1 matrices: each row of a adds up the rows of b that its entries name."""
    many = np.diff(b.starts)[a.columns]
    total = int(many.sum())
    before = np.cumsum(many) - many
    key = np.repeat(a.rows(), many) * b.width + b.columns[np.arange(total) + np.repeat(b.starts[a.columns] - before, many)]
    if total and (np.diff(key) < 0).any():
        key = np.sort(key, kind="stable")
    first = np.flatnonzero(np.diff(key, prepend=-1))
    rows, columns = np.divmod(key[first], max(b.width, 1))
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(a.starts) - 1))]), columns, b.width, np.diff(np.append(first, total)))


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray, step: int = PRODUCT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(token of A, token of B, bytes shared)`` of every overlapping pair, the rows of A in parts of about ``step`` bytes."""
    at, n = 0, len(ends_a)
    while at < n:
        begin = int(ends_a[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends_a, begin + step, "right")))
        end = int(ends_a[stop - 1])
        low, high = int(np.searchsorted(ends_b, begin, "right")), int(np.searchsorted(ends_b, end, "left")) + 1
        links = gustavson(incidence(ends_a[at:stop] - begin), transposed(incidence(np.minimum(ends_b[low:high], end) - begin)))
        yield links.rows() + at, links.columns + low, links.values
        at = stop


class Groups(NamedTuple):
    """Groups of two token sequences over the same bytes: group of each token, and whether a token is its group's last."""

    of_a: np.ndarray
    of_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def matrices(self) -> tuple[Csr, Csr]:
        """Tokens of A by groups, and groups by tokens of B."""
        n = int(self.last_a.sum())
        a, b = (Csr(np.arange(len(of) + 1), of, n) for of in (self.of_a, self.of_b))
        return a, transposed(b)

    def partners(self) -> np.ndarray:
        """For each token of A the tokens of B in its group: the row sizes of the product of ``matrices``, without its entries."""
        a, b = self.matrices()
        return np.diff(b.starts)[a.columns]


def common_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> Groups:
    last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    return Groups(np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, last_a, last_b)


@lru_cache(maxsize=2)
def _pieces(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=2)
def byte_tokens(ranks_path: str) -> pa.Array:
    """Bytes of each id of a byte-level vocabulary."""
    encoding = byte_bpe(ranks_path)
    known = {i: t for t, i in encoding._mergeable_ranks.items()}
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.binary())


@lru_cache(maxsize=2)
def piece_tokens(model_path: str) -> pa.Array:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, byte pieces are their byte."""
    model = _pieces(model_path)
    return pa.array([bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())], pa.binary())


@lru_cache(maxsize=2)
def _digits(n_a: int, n_b: int) -> pa.Array:
    """An id with the sign behind it: A inside a group, A last, B inside, B last."""
    return pa.array([f"{i}{sign}".encode() for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)], pa.binary())


def _joined(parts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of a binary array one after another, and where each begins and the last ends."""
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    return memoryview(parts.buffers()[2] or b"").cast("B")[: offsets[-1]], offsets


def _encoded(texts: list[bytes | None], ranks_path: str, model_path: str) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Ids of both sides for each text; None for those without tokens."""
    model, encoding, tokens_a, tokens_b = _pieces(model_path), byte_bpe(ranks_path), byte_tokens(ranks_path), piece_tokens(model_path)
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for raw in texts:
        if not raw:
            out.append(None)
            continue
        text = raw.decode("utf-8", "replace")
        try:
            a = encoding.encode_to_numpy(" " + text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        except ValueError:  # too much white space in a run for it
            a = np.array(token_ids(" " + text, ranks_path), dtype=np.int64)
        b = np.array(model.encode(text, num_threads=1), dtype=np.int64)
        whole = b" " + raw
        same = all(_joined(pc.take(tokens, pa.array(ids)))[0] == whole for tokens, ids in ((tokens_a, a), (tokens_b, b)))
        out.append((a, b) if same else None)
    return out


class Aligned(NamedTuple):
    """Several documents' tokens one after another, with the bytes at which they end."""

    docs: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def align(texts: list[bytes | None], ranks_path: str, model_path: str) -> Aligned:
    """The tokens of the texts that have any; ``docs`` names their places among ``texts``."""
    got = _encoded(texts, ranks_path, model_path)
    docs = [i for i, x in enumerate(got) if x is not None]
    empty = [np.zeros(0, np.int64)]
    a, b = (np.concatenate([*empty, *[got[i][side] for i in docs]]) for side in (0, 1))
    sizes = [pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in (byte_tokens(ranks_path), piece_tokens(model_path))]
    lengths = [np.array([len(got[i][side]) for i in docs], dtype=np.int64) for side in (0, 1)]
    return Aligned(np.array(docs, dtype=np.int64), a, b, *lengths, np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b]))


def group_digests(x: Aligned, groups: Groups, n_a: int, n_b: int) -> list[str]:
    """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    ends_a, ends_b = np.cumsum(np.bincount(groups.of_a)), np.cumsum(np.bincount(groups.of_b))  # tokens up to each group's end
    picks = np.empty(len(x.a) + len(x.b), dtype=np.int64)
    picks[np.arange(len(x.a)) + np.concatenate([[0], ends_b])[groups.of_a]] = x.a + n_a * groups.last_a
    picks[np.arange(len(x.b)) + ends_a[groups.of_b]] = x.b + n_b * groups.last_b + 2 * n_a
    text, at = _joined(pc.take(_digits(n_a, n_b), pa.array(picks)))
    stops = np.cumsum(x.n_a + x.n_b)
    return [hashlib.sha256(text[at[i] : at[j] - 1]).hexdigest() for i, j in zip((stops - x.n_a - x.n_b).tolist(), stops.tolist())]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, many = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, many = every[order], many[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(many, first) if len(first) else many


BLOCKS = "block long, uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, keys binary, counts binary"
_TYPES = [pa.int64()] * 8 + [pa.string(), pa.binary(), pa.binary()]


def _scan(ranks_path: str, model_path: str, slice_bytes: int, block_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        block, uid = partition << 32, partition << 40
        n_a, n_b = len(byte_tokens(ranks_path)), len(piece_tokens(model_path))
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        keys, counts, links = [], [], 0

        def dictionary() -> pa.RecordBatch:
            k, n = _summed(keys, counts)
            row = [block, None, None, None, None, None, None, None, None, k.tobytes(), n.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names)

        for batch in bounded(batches, "text", slice_bytes):
            x = align(column(batch, "text").cast(pa.binary()).to_pylist(), ranks_path, model_path)
            groups = common_groups(x.ends_a, x.ends_b)
            found = [(p, q) for p, q, _ in overlap_links(x.ends_a, x.ends_b)]
            token_a, token_b = (np.concatenate([np.zeros(0, np.int64), *[f[side] for f in found]]) for side in (0, 1))
            stops = np.cumsum(x.n_a)
            key = x.a[token_a] * n_b + x.b[token_b]
            places = np.searchsorted(token_a, np.concatenate([[0], stops])) if len(stops) else np.zeros(1, np.int64)
            partners, lasts = np.concatenate([[0], np.cumsum(groups.partners())]), np.concatenate([[0], np.cumsum(groups.last_a)])
            digests = group_digests(x, groups, n_a, n_b) if len(stops) else []
            rows = [[block, uid + i, d, 0, 0, 0, 0, 0, "", b"", b""] for i, d in enumerate(column(batch, "doc_id").to_pylist())]
            uid += batch.num_rows
            for k, i in enumerate(x.docs.tolist()):
                own, many = np.unique(key[places[k] : places[k + 1]], return_counts=True)
                begin, stop = int(stops[k] - x.n_a[k]), int(stops[k])
                rows[i][3:] = [int(x.n_a[k]), int(x.n_b[k]), int(lasts[stop] - lasts[begin]), int(places[k + 1] - places[k]), int(partners[stop] - partners[begin]), digests[k], own.astype("<i8").tobytes(), many.astype("<i4").tobytes()]
                keys.append(own)
                counts.append(many)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_TYPES)], names)
            if keys:
                merged = _summed(keys, counts)
                keys, counts, links = [merged[0]], [merged[1]], links + len(key)
            if links >= block_links:
                yield dictionary()
                keys, counts, links, block = [], [], 0, block + 1
        if keys:
            yield dictionary()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, keys, counts in zip(column(batch, "block").to_pylist(), column(batch, "keys").to_pylist(), column(batch, "counts").to_pylist()):
            k, n = np.frombuffer(keys, dtype="<i8"), np.frombuffer(counts, dtype="<i8")
            for at in range(0, len(k), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), block)), pa.array(k[part]), pa.array(n[part])], ["block", "key", "n"])


def _weighed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums over each document's links, by its block's dictionary with the corpus-wide counts."""
    order = np.argsort(known.column("key").to_numpy())
    keys, total, best = (known.column(c).to_numpy()[order] for c in ("key", "total", "best"))
    raw = [docs.column(c).to_pylist() for c in ("keys", "counts")]
    sums, bests = [], []
    for own, many in zip(*raw):
        at, many = np.searchsorted(keys, np.frombuffer(own, dtype="<i8")), np.frombuffer(many, dtype="<i4").astype(np.int64)
        sums.append(int((total[at] * many).sum()))
        bests.append(int(many[best[at]].sum()))
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256")).append_column("n_group_links", docs.column("n_group_links"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long"


def _scanned(docs: DataFrame, ranks_path: str | None, model_path: str | None, slice_bytes: int, block_links: int) -> tuple[DataFrame, int]:
    ranks_path, model_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"), model_path or tokenizer_path("piece_bpe_32k.model")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(mapped(given, _scan(ranks_path, model_path, slice_bytes, block_links), BLOCKS), "aligned"), len(piece_tokens(model_path))


def _counted(scanned: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Each block's pairs, and every pair with its count in the corpus and whether it is its B id's highest."""
    pairs = mapped(scanned.where("uid is null").select("block", "keys", "counts"), _unpacked, "block long, key long, n long")
    total = pairs.groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key") % width)
    total = materialize(total, "totals")
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return pairs, total.join(most, "b").select("key", "total", (F.col("total") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, slice_bytes: int = SLICE_BYTES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``a_id, b_id, count, best``: how many links of the corpus hold a pair of ids, and whether that is the B id's highest count. The table from which embeddings can be carried over."""
    scanned, width = _scanned(docs, ranks_path, model_path, slice_bytes, block_links)
    _, known = _counted(scanned, width)
    return known.select(F.floor(F.col("key") / F.lit(width)).cast("long").alias("a_id"), (F.col("key") % width).alias("b_id"), F.col("total").alias("count"), "best")


def align_documents(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, slice_bytes: int = SLICE_BYTES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links`` for every row of ``docs`` (doc_id, text).

    A is the byte-level vocabulary over a space and the text, B the piece vocabulary over the text, which puts the space there itself;
    special tokens' strings in a text are plain text. n_group_links: pairs of tokens of A and B that share a group.

    Texts that are null or empty, hold malformed UTF-8, or whose joined tokens of either side differ from a space and the text (as where
    the piece model folds signs) have no tokens: zeros and an empty digest. Texts of any length are aligned whole. Null and repeated
    doc_ids keep their rows, and each repeat counts in the corpus. Other columns are not read. Empty in, empty out.
    """
    scanned, width = _scanned(docs, ranks_path, model_path, slice_bytes, block_links)
    pairs, known = _counted(scanned, width)
    looked = pairs.select("block", "key").join(known, "key").select(F.col("block").alias("at"), "key", "total", "best")
    rows = scanned.where("uid is not null")
    return rows.groupBy("block").cogroup(looked.groupBy("at")).applyInArrow(_weighed, ALIGNED)


LINKS = "doc_id long, a_place long, b_place long, a_id long, b_id long, bytes long, group_no long"


def _link_rows(ranks_path: str, model_path: str, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINKS.split(", ")]
        for batch in bounded(batches, "text", slice_bytes):
            x = align(column(batch, "text").cast(pa.binary()).to_pylist(), ranks_path, model_path)
            groups = common_groups(x.ends_a, x.ends_b)
            doc_ids = column(batch, "doc_id").take(pa.array(x.docs))
            doc = np.repeat(np.arange(len(x.docs)), x.n_a)
            begin_a, begin_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
            begin_g = groups.of_a[begin_a] if len(x.docs) else begin_a
            for p, q, shared in overlap_links(x.ends_a, x.ends_b, slice_bytes // 16):
                d = doc[p]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d)), *map(pa.array, (p - begin_a[d], q - begin_b[d], x.a[p], x.b[q], shared, groups.of_a[p] - begin_g[d]))], names)

    return run


def token_links(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each overlapping pair of tokens: ``doc_id, a_place, b_place, a_id, b_id, bytes, group_no``; places and groups from 0 in their document, bytes those shared."""
    ranks_path, model_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"), model_path or tokenizer_path("piece_bpe_32k.model")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(given, _link_rows(ranks_path, model_path, slice_bytes), LINKS)
