"""Documents packed into fixed-length token sequences: best-fit decreasing with certified bounds.

Pieces are dealt to groups of bounded size by a hash. A group packs itself best-fit decreasing and
gets a lower bound for its number of bins from dual feasible functions. Bins that no repacking can
better stay; a group with a gap, and the emptiest bins of every group (each group rounds up by part
of a bin), give their documents to the next round, where they meet those of other groups and are
packed again. The pool shrinks by a large factor each round; when one group holds it all, or a
round certifies every group, the rest is final.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, decoded, mapped, token_ids, tokenizer_path
from rootspan.scratch import materialize

CAPACITY, DOCUMENT_END, SPECIAL_END = 2048, 0, 50256
#: Pieces a group holds on average; a task packs one group at a time.
GROUP_PIECES = 3000
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else the remainder first, then full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(ranks_path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in bounded(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), decoded(column(batch, "text"))):
                ids = token_ids(text, ranks_path, SPECIAL_END)
                ids.append(DOCUMENT_END)
                ids = np.array(ids, dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row = (uid, doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for to, x in zip(rows, row):
                        to.append(x)
                    uid += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """A row for each piece of each document: ``uid`` (unique), doc_id, piece, start, length, ids_crc32.

    The encoder gives the ids of ``byte_bpe_50k.json`` with ``add_special_tokens=False``; a literal
    ``<|endoftext|>`` in a text is that special token, as there. Malformed UTF-8 counts as U+FFFD.
    """
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pieces(ranks_path, capacity), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fill.

    The open bins are kept by free room; a bit per room tells which rooms occur, so the tightest fit
    is the lowest set bit from the item's length on.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, fill = 0, []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        rooms[room - n].append(b)
        present |= 1 << (room - n)
    return bins, offsets, np.array(fill, dtype=np.int64)


def bin_bound(counts: np.ndarray, capacity: int, steps: int = 24) -> int:
    """Fewest bins that items with ``counts[length]`` can need, by two families of dual feasible functions.

    A function f with sum f(x) <= 1 for whatever fits one bin bounds the bins by the sum of f over
    all items. For e up to half a bin: f = 1 above capacity - e, 0 below e, else x / capacity. For k:
    f = x / capacity where (k + 1) x / capacity is whole, else its floor over k.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    weight, number = np.cumsum(counts * x), np.cumsum(counts)
    e = np.arange(1, capacity // 2 + 1)
    middle = weight[capacity - e] - weight[e - 1]
    above = number[capacity] - number[capacity - e]
    best = max(best, int((above + -(-middle // capacity)).max(initial=0)))
    for k in range(1, steps):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        total = int((counts * np.where(whole, x * k, scaled // capacity * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def _pack(capacity: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)  # so a task that runs again decides the same
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = np.zeros(len(fill), dtype=bool)
        if not last:
            order = np.argsort(fill, kind="stable")
            loose[order[: 4 * (gap + 1)]] = True
            loose &= fill < capacity
        return pdf.assign(bin=bins, offset=offsets, gap=gap, free=loose[bins])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, max_rounds: int = 6) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to capacity, ``uid`` is unique.

    Full pieces take a sequence each. The rest goes through rounds of packing; see the module's text.
    """
    own = pieces.columns
    pieces = materialize(pieces, "pieces")
    full = pieces.where(F.col("length") >= capacity)
    done = [full.select(*own, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool = pieces.where(F.col("length") < capacity)
    n = pool.count()
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    for round_no in range(max_rounds):
        if not n:
            break
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or round_no == max_rounds - 1
        dealt = pool.select(*own, F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)).cast("long").alias("group"))
        packed = dealt.groupBy("group").applyInPandas(_pack(capacity, last), f"{types}, group long, bin long, offset long, gap long, free boolean")
        packed = materialize(packed, "packed")
        number = F.lit(round_no << 56) + F.shiftleft("group", 24) + F.col("bin")
        done.append(packed.where("not free").select(*own, number.alias("sequence_id"), "offset"))
        pool = packed.where("free").select(*own)
        n = 0 if last else pool.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used and tokens; by lengths alone, so its input to the driver has at most ``capacity`` rows."""
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"))
    by_length = packed.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_length:
        counts[r["length"]] = r["count"]
    return used.withColumn("bound", F.lit(bin_bound(counts, capacity)))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single end id, malformed UTF-8 counts as U+FFFD. Null and repeated doc_ids keep their rows. Only texts of
    more than ``capacity`` tokens are cut, into full pieces after a first that may be shorter. Other
    columns of ``docs`` are not read. Empty in, empty out.
    """
    packed = pack_pieces(token_pieces(docs, capacity, ranks_path), capacity, group_pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
