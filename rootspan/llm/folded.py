"""The Kneser-Ney model over an alphabet folded to 56 symbols, as one dense table: small enough for brute force.

No query uses it; ``quality`` counts and scores real characters. The tests hold the counts, discounts and joins of
``ngrams``, which don't depend on the alphabet, against this table and against dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, decoded, mapped
from rootspan.llm.ngrams import HALVES, ORDER, WHOLE, Levels, interpolated, kneser_ney, of_models
from rootspan.llm.symbols import ALPHABET, symbol_table
from rootspan.scratch import materialize

#: Bytes of text that are coded together.
STEP = 2 << 20


def symbols_of(text: str) -> np.ndarray:
    """The text's symbols, one a code point."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(points < 1 << 16, symbol_table()[points & 0xFFFF], 45 + points % (ALPHABET - 45)).astype(np.int32)


def codes_of(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of all texts in a row, each text after ``order - 1`` starts (symbol 0), and each text's number of codes."""
    pad = order - 1
    parts: list[np.ndarray] = []
    for text in texts:
        parts += [np.zeros(pad, np.int32), symbols_of(text)]
    sizes = np.array([len(x) for x in parts[1::2]], dtype=np.int64)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    codes = np.zeros(max(0, len(symbols) - pad), dtype=np.int32)
    for k in range(order):
        codes = codes * np.int32(ALPHABET) + symbols[k : k + len(codes)]
    real = np.ones(len(symbols), dtype=bool)
    begin = np.cumsum(sizes + pad) - (sizes + pad)
    for k in range(pad):
        real[begin + k] = False
    return codes[real[pad:]], sizes


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in bounded(batches, "text", STEP):
            half = column(batch, "half").to_numpy(zero_copy_only=False)
            texts = decoded(column(batch, "text"))
            for h in HALVES:
                codes, _ = codes_of([t for t, x in zip(texts, half) if x == h], order)
                if len(codes):
                    seen, n = np.unique(codes, return_counts=True)  # no second array of the alphabet's size
                    totals.setdefault(h, np.zeros(ALPHABET**order, dtype=np.uint32))[seen] += n.astype(np.uint32)
        for h, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), h, np.int32)), pa.array(seen), pa.array(total[seen].astype(np.int64))], ["half", "gram", "n"])

    return run


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(model, context, symbol, n)`` over columns ``text`` and ``half``: of all rows, and for each half of those outside it."""
    found = mapped(texts.select(F.col("half").cast("int").alias("half"), "text"), _count(order), "half int, gram long, n long")
    return of_models(found.select("half", F.floor(F.col("gram") / ALPHABET).alias("context"), (F.col("gram") % ALPHABET).alias("symbol"), "n"))


def dense(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """-log2 p of every n-gram of the highest order: each order's share plus its context's weight of the order below."""
    p = np.full(ALPHABET, 1 / ALPHABET, dtype=np.float32)
    for k, (gram, share, context, gamma) in enumerate(levels, 1):
        weight = np.ones(ALPHABET ** (k - 1), dtype=np.float32)
        weight[context] = gamma
        p = np.repeat(weight, ALPHABET) * (p if k == 1 else np.tile(p, ALPHABET))
        p[gram] += share.astype(np.float32)
    return -np.log2(np.maximum(p, 1e-12))


def dense_model(levels: Levels, model: int = WHOLE) -> np.ndarray:
    got = []
    for shares, weights in levels:
        s, w = shares.where(F.col("model") == model).toPandas(), weights.where(F.col("model") == model).toPandas()  # at most ALPHABET ** order rows
        gram = s["context"].to_numpy(np.int64) * ALPHABET + s["symbol"].to_numpy(np.int64)
        got.append((gram, s["p"].to_numpy(float), w["context"].to_numpy(np.int64), w["gamma"].to_numpy(float)))
    return dense(got)


def fit_levels(trusted: DataFrame, order: int = ORDER) -> Levels:
    """The count tables' shares and weights from column ``text`` (string) of ``trusted``; ``half`` tells the halves apart, if there is one."""
    half = F.col("half") if "half" in trusted.columns else F.lit(0)
    return kneser_ney(gram_counts(trusted.select(half.alias("half"), F.col("text").cast("binary").alias("text")), order), order, ALPHABET)


def fit_model(trusted: DataFrame, order: int = ORDER) -> np.ndarray:
    """The dense model of column ``text`` (string) of ``trusted``; uniform if there is no text."""
    return dense_model(fit_levels(trusted, order))


def _grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", STEP):
            codes, sizes = codes_of(decoded(column(batch, "text")), order)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pairs, n = np.unique(doc * ALPHABET**order + codes, return_counts=True)
            doc, gram = np.divmod(pairs, ALPHABET**order)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(doc)), pa.array(gram), pa.array(n)], ["doc_id", "gram", "n"])

    return run


def perplexity_by_joins(docs: DataFrame, levels: Levels, order: int = ORDER) -> DataFrame:
    """``doc_id, perplexity`` for each doc_id of ``docs`` with a text, by joins of n-grams with the sharded count tables; nothing is broadcast.

    Rows that share a doc_id count as one text. The result is that of the dense table (tests).
    """
    grams = materialize(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _grams(order), "doc_id long, gram long, n long"), "grams")
    seen = grams.select(F.floor(F.col("gram") / ALPHABET).alias("context"), (F.col("gram") % ALPHABET).alias("symbol")).distinct()
    seen = materialize(interpolated(seen, F.lit(1 / ALPHABET), levels, ALPHABET, [WHOLE]), "seen")
    seen = seen.select((F.col("context") * ALPHABET + F.col("symbol")).alias("gram"), F.col(f"p{WHOLE}").alias("p"))
    scored = grams.join(seen, "gram").groupBy("doc_id").agg(F.sum(-F.log2(F.greatest("p", F.lit(1e-12))) * F.col("n")).alias("bits"), F.sum("n").alias("chars"))
    return scored.select("doc_id", F.pow(F.lit(2.0), F.col("bits") / F.col("chars")).alias("perplexity"))


def _score(model: Broadcast, order: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in bounded(batches, "text", STEP):
            codes, sizes = codes_of(decoded(column(batch, "text")), order)
            sums = np.concatenate([[0.0], np.cumsum(table[codes], dtype=np.float64)])
            ends = np.cumsum(sizes)
            lang = pc.fill_null(column(batch, "lang").cast(pa.string()), "")
            scored = pa.StructArray.from_arrays([lang, pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], ["lang", "chars", "bits"])
            yield pa.RecordBatch.from_arrays([*batch.columns, scored], [*batch.schema.names, name])

    return run


def with_bits(docs: DataFrame, model: np.ndarray | Broadcast, name: str = "scored", order: int = ORDER) -> DataFrame:
    """``docs`` with ``name``: a struct of lang ('' for null), chars and bits, each text's size and total -log2 probability; no shuffle.

    model: a dense table of ALPHABET ** order numbers of 4 bytes, or its broadcast.
    """
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, _score(shared, order, name), f"{own}, `{name}` struct<lang: string, chars: bigint, bits: double>")
