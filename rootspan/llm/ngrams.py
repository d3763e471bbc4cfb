"""A modified Kneser-Ney model of characters, as count tables that are sharded by n-gram; texts are scored by joins with them.

A symbol is a code point plus one, 0 the start of a text; an n-gram is the pair of its context, up to three symbols of 21 bits, and
its last symbol, so no two n-grams share a key. Neither counts nor model are gathered anywhere. Texts are
dealt to blocks: a block's distinct n-grams, far fewer than its characters, meet the count tables in joins, and their
probabilities meet the block's texts, which travel in small compressed frames, in a cogroup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, decoded, mapped
from rootspan.llm.symbols import ALPHABET, members, symbol_table
from rootspan.scratch import materialize

ORDER, BITS = 4, 21
#: The models of all trusted documents and of those outside either half.
WHOLE, HALVES = 2, (0, 1)
MODELS = (*HALVES, WHOLE)
#: Characters that are coded together, bytes of text of a frame and of a block (a multiple of a frame), and rows of a batch.
STEP, FRAME, BLOCK, ROWS = 1 << 19, 2 << 20, 32 << 20, 1 << 16

#: By order from one: ``(model, context, symbol, p)``, the discounted share of seen n-grams, and ``(model, context, gamma)``, the weight of the lower order.
Levels = list[tuple[DataFrame, DataFrame]]


def _distinct(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pair stands among the distinct ones, which follow by first occurrence, and those."""
    at, contexts = pd.factorize(context)
    at, pairs = pd.factorize(at.astype(np.int64) << BITS | symbol)
    return at, contexts[pairs >> BITS], pairs & (1 << BITS) - 1


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of every character of all texts in a row, and each text's number of characters."""
    pad = ORDER - 1
    whole = np.frombuffer("".join("\0" * pad + t for t in texts).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64) + 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + pad) - (sizes + pad)
    real = np.ones(len(whole), dtype=bool)
    for k in range(pad):
        whole[begin + k], real[begin + k] = 0, False
    context = np.zeros(max(0, len(whole) - pad), dtype=np.int64)
    for k in range(pad):
        context = context << BITS | whole[k : k + len(context)]
    real = real[pad:]
    return context[real], whole[pad:][real], sizes


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``STEP`` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= STEP:
            yield run
            run, n = [], 0
    if run:
        yield run


def _tallied(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and symbols of the texts' distinct n-grams, and how often each occurs."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for run in _slices(texts):
        at, context, symbol = _distinct(*_coded(run)[:2])
        parts.append((context, symbol, np.bincount(at)))
    contexts, symbols, counts = (np.concatenate(x) for x in zip(*parts))
    at, context, symbol = _distinct(contexts, symbols)
    n = np.zeros(len(context), np.int64)
    np.add.at(n, at, counts)
    return context, symbol, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        half = column(batch, "half").to_numpy(zero_copy_only=False)
        texts = decoded(column(batch, "text"))
        for h in HALVES:
            context, symbol, n = _tallied([t for t, x in zip(texts, half) if x == h])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), h, np.int32)), pa.array(context), pa.array(symbol), pa.array(n)], ["half", "context", "symbol", "n"])


def of_models(found: DataFrame) -> DataFrame:
    """``(model, context, symbol, n)`` of counts with ``half``: of all, and for each half of those outside it."""
    models = found.select(F.explode(F.array(F.lit(WHOLE), 1 - F.col("half"))).alias("model"), "context", "symbol", "n")
    return models.groupBy("model", "context", "symbol").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> Levels:
    """The model of columns ``text`` (binary) and ``half``; ``opened`` makes them from the batches of ``texts``, in the tasks that count."""
    count = _count if opened is None else lambda batches: _count(opened(batches))
    return kneser_ney(of_models(mapped(texts, count, "half int, context long, symbol long, n long")))


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts ``(model, d1, d2, d3)`` for counts of one, two, and three or more, from the counts of counts; a row a model."""
    n = counts.groupBy("model").agg(*[F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    cuts = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        cuts.append(F.when(F.col(f"n{k}") > 0, F.least(F.lit(k - 0.01), F.greatest(F.lit(0.05), d))).otherwise(0.5 * k).alias(f"d{k}"))
    return n.select("model", *cuts)


def _nearest(k: int, base: int) -> Column:
    """The last ``k`` symbols of a context."""
    return F.col("context") if base**k >= 1 << 63 else F.col("context") % F.lit(base**k)


def kneser_ney(counts: DataFrame, order: int = ORDER, base: int = 1 << BITS) -> Levels:
    """Shares and weights by order from counts ``(model, context, symbol, n)``; a context's symbols are its digits in ``base``.

    Below the highest order a count is the number of different symbols seen before the n-gram.
    """
    levels: list[DataFrame] = [materialize(counts, "counts")]
    for k in range(order - 1, 0, -1):
        lower = levels[0].groupBy("model", _nearest(k - 1, base).alias("context"), "symbol").agg(F.count("*").alias("n"))
        levels.insert(0, materialize(lower, "counts"))
    out = []
    for level in levels:
        cuts = F.broadcast(discounts(level))  # three rows
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        split = level.join(cuts, "model").withColumn("cut", F.least(cut, F.col("n").cast("double")))
        contexts = materialize(split.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts")), "contexts")
        shares = split.join(contexts.select("model", "context", "total"), ["model", "context"]).select("model", "context", "symbol", ((F.col("n") - F.col("cut")) / F.col("total")).alias("p"))
        out.append((materialize(shares, "shares"), contexts.select("model", "context", (F.col("cuts") / F.col("total")).alias("gamma"))))
    return out


def interpolated(seen: DataFrame, lowest: Column, levels: Levels, base: int, models: list[int]) -> DataFrame:
    """``seen`` (context, symbol) with ``p<model>`` for each of ``models``: each order's share plus its context's weight of the order below, by joins; ``lowest`` is that below all."""
    out = seen.select("context", "symbol", *[lowest.alias(f"p{m}") for m in models])
    for k, (shares, weights) in enumerate(levels, 1):
        only = lambda name, to: [F.max(F.when(F.col("model") == m, F.col(name))).alias(f"{to}{m}") for m in models]
        share = shares.groupBy(F.col("context").alias("near"), "symbol").agg(*only("p", "share"))
        weight = weights.groupBy(F.col("context").alias("near")).agg(*only("gamma", "gamma"))
        out = out.withColumn("near", _nearest(k - 1, base)).join(share, ["near", "symbol"], "left").join(weight, "near", "left")
        out = out.select("context", "symbol", *[(F.coalesce(f"share{m}", F.lit(0.0)) + F.coalesce(f"gamma{m}", F.lit(1.0)) * F.col(f"p{m}")).alias(f"p{m}") for m in models])
    return out


def unseen(symbol: str) -> Column:
    """Probability of a character below all n-grams: even over the kinds of characters, then even inside the kind."""
    p = 1 / (ALPHABET * np.maximum(members(), 1))
    small = F.array(*[F.lit(float(p[k])) for k in symbol_table()[:128]])
    others = F.array(*[F.lit(float(x)) for x in p[45:]])
    point = F.col(symbol) - 1
    return F.when(point < 128, F.get(small, point.cast("int"))).otherwise(F.get(others, (point % (ALPHABET - 45)).cast("int")))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in runs of about ``FRAME`` bytes of text with the number of their block, which hangs on the task and the bytes before a row alone."""
    task, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        cuts = np.flatnonzero(np.diff(starts // FRAME, prepend=-1))
        for begin, end in zip(cuts, [*cuts[1:], len(sizes)]):
            yield task + int(starts[begin] // BLOCK), batch.slice(int(begin), int(end - begin))


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, frames in groupby(_frames(batches), key=lambda x: x[0]):
        context = symbol = np.zeros(0, np.int64)
        for _, frame in frames:
            more = _tallied(decoded(column(frame, "text")))
            _, context, symbol = _distinct(np.concatenate([context, more[0]]), np.concatenate([symbol, more[1]]))
        for k in range(0, len(context), ROWS):
            part = context[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(symbol[k : k + ROWS])], ["block", "context", "symbol"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for block, frame in _frames(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, frame.schema, options=options) as out:
            out.write_batch(frame)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])


class _Dictionary:
    """A block's n-grams in order, to find those of its texts."""

    def __init__(self, found: pa.Table):
        context, symbol = (found.column(c).to_numpy() for c in ("context", "symbol"))
        self.contexts, at = np.unique(context, return_inverse=True)
        pairs = at << BITS | symbol
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.bits = [found.column(f"bits{m}").to_numpy()[order] for m in MODELS]

    def places(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for known in (self.contexts, self.pairs):
            at = np.searchsorted(known, context)
            if len(context) and (not len(known) or (known[np.minimum(at, len(known) - 1)] != context).any()):
                raise ValueError("the documents were not the same when they were read again; write them to a table first")
            context = at << BITS | symbol
        return at


def _scored(name: str, keep: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        if not packed.num_rows:
            raise ValueError("the documents were not the same when they were read again; write them to a table first")
        out, known = [], _Dictionary(found)
        for frame in packed.column("rows").to_pylist():
            rows = pa.ipc.open_stream(frame).read_all()
            lengths, bits = [np.zeros(0, np.int64)], [[np.zeros(0)] for _ in MODELS]
            for texts in _slices(decoded(rows.column("text").combine_chunks())):  # one run after the other, so that a block takes no more memory than its n-grams and rows
                context, symbol, sizes = _coded(texts)
                at, context, symbol = _distinct(context, symbol)
                place, ends = known.places(context, symbol), np.cumsum(sizes)
                for of, told in zip(known.bits, bits):
                    sums = np.concatenate([[0.0], of[place].astype(float)[at]]).cumsum()
                    told.append(sums[ends] - sums[ends - sizes])
                lengths.append(sizes)
            lang = pc.fill_null(rows.column("lang").cast(pa.string()), "").combine_chunks()
            scored = pa.StructArray.from_arrays([lang, *(pa.array(np.concatenate(x)) for x in (lengths, *bits))], ["lang", "chars", *(f"bits{m}" for m in MODELS)])
            out.append(pa.table([*(rows.column(c) for c in keep), scored], names=[*keep, name]))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def with_bits(docs: DataFrame, levels: Levels, name: str = "scored", drop: str | None = None) -> DataFrame:
    """``docs`` (all columns but ``drop``) with ``name``: a struct of lang ('' for null), chars, and ``bits<model>``, the text's total -log2 probability under each model.

    ``docs`` is read twice and has to give the same rows in the same order, as tables on file do; a difference is an error.
    """
    seen = materialize(mapped(docs.select("text"), _dictionaries, "block long, context long, symbol long"), "dictionaries")
    p = materialize(interpolated(seen.select("context", "symbol").distinct(), unseen("symbol"), levels, 1 << BITS, list(MODELS)), "probabilities")
    bits = [(-F.log2(F.greatest(f"p{m}", F.lit(1e-12)))).cast("float").alias(f"bits{m}") for m in MODELS]
    found = seen.join(p.select("context", "symbol", *bits), ["context", "symbol"]).select("block", "context", "symbol", *[f"bits{m}" for m in MODELS])
    packed = mapped(docs, _packed, "block long, rows binary")
    keep = [f for f in docs.schema.fields if f.name != drop]
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    told = f"`{name}` struct<lang: string, chars: bigint, {', '.join(f'bits{m}: double' for m in MODELS)}>"
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored(name, [f.name for f in keep]), own + told)
