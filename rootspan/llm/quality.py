"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters as they are, of order four (``ngrams``). Its counts come from all trusted documents of the
corpus; counts, continuation counts and discounts are Spark aggregations and joins over count tables that are sharded by
n-gram, and documents get their perplexity by joins with those tables.

A document's score is its mean negative log2 probability per character, drawn towards the trusted
mean by ``SHRINK`` characters so that a few words don't decide. A language's threshold is the ``QUANTILE``
of its trusted documents' scores, each under a model of the other half of the trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm import ngrams
from rootspan.llm.common import bounded, column, fresh, mapped
from rootspan.llm.folded import codes_of, dense_model, fit_levels, fit_model, perplexity_by_joins, symbols_of, with_bits  # noqa: F401
from rootspan.llm.ngrams import HALVES, WHOLE
from rootspan.llm.symbols import ALPHABET  # noqa: F401
from rootspan.scratch import materialize

#: One trusted document in a thousand may be lost; the weight of the mean in characters; documents a language needs for a threshold of its own.
QUANTILE, SHRINK, LEAST_TRUSTED = 0.999, 60, 20
#: Bytes of text that are packed together.
STEP = 2 << 20
#: Bits that tell most documents apart from trusted ones before any text moves: 8 MB.
SIEVE = 1 << 26


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that a label calls good and none calls bad or toxic."""
    agreed = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return agreed.where("q = 1 and t = 0").select("doc_id")


def sieve(ids: DataFrame) -> np.ndarray:
    """Bytes with the bit of each doc_id's hash set: 8 MB whatever the corpus; what it lets through too much, a join finds."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SIEVE)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(SIEVE // 8, np.uint8)
    for bucket, bits in rows:
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _small(sieve: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in bounded(batches, "text"):
            at = column(batch, "at").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((sieve.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            packed = [pack.compress(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "packed"])

    return run


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in bounded(batches, "packed", STEP // 2):
        texts = [unpack.decompress(t) for t in column(batch, "packed").to_pylist()]
        others = [c for c in batch.schema.names if c != "packed"]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in others), pa.array(texts, pa.binary())], [*others, "text"])


def _trusted_packed(reference: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, half, packed`` of the trusted documents.

    Labels grow with the corpus, so the texts, made smaller, meet them in one shuffle at any size; most that nobody trusts stay where they are.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    shared = reference.sparkSession.sparkContext.broadcast(sieve(trusted))
    texts = reference.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    texts = texts.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)))
    packed = mapped(texts, _small(shared), "doc_id long, lang string, packed binary").join(trusted.hint("merge"), "doc_id", "left_semi")
    return packed.select("doc_id", "lang", half().alias("half"), "packed")


def trusted_texts(reference: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, half, text`` of the trusted documents."""
    full = mapped(_trusted_packed(reference, labels), _full, "doc_id long, lang string, half int, text binary")
    return full.withColumn("text", F.col("text").cast("string"))


def half() -> Column:
    """The half of the trusted documents that a doc_id is in."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).cast("int")


@dataclass
class Judge:
    """A fitted model's mean with its thresholds: ``by_lang`` (lang, threshold) where a language has enough trusted documents, else ``everywhere``."""

    mean: float
    everywhere: float
    by_lang: DataFrame | None
    shrink: int

    def score(self, scored: str = "scored") -> Column:
        at = F.col(f"`{scored}`")
        return (at[f"bits{WHOLE}"] + F.lit(float(self.mean * self.shrink))) / (at["chars"] + self.shrink)

    def threshold(self, df: DataFrame, name: str, scored: str = "scored") -> DataFrame:
        """``df`` with ``name``, the threshold of its language; languages with one of their own are few, but that is for Spark to see."""
        key = fresh("lang_of_limit", df.columns)
        limits = self.by_lang.select(F.col("lang").alias(key), F.col("threshold").alias(name))
        joined = df.join(limits, F.col(f"`{scored}`")["lang"] == F.col(key), "left").drop(key)
        return joined.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(float(self.everywhere))))

    def keep(self, threshold: str, scored: str = "scored") -> Column:
        return (F.col(f"`{scored}`")["chars"] == 0) | (self.score(scored) <= F.col(f"`{threshold}`"))


def set_judge(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shrink: int = SHRINK, least_trusted: int = LEAST_TRUSTED) -> Judge:
    """The thresholds from what models of one half say of the other: ``scored`` (doc_id, scored) of the documents that the labels speak of."""
    own = F.when(half() == HALVES[0], F.col(f"scored.bits{HALVES[0]}")).otherwise(F.col(f"scored.bits{HALVES[1]}"))
    held = scored.where("doc_id is not null and scored.chars > 0").select("doc_id", "scored", own.alias("own"))
    held = materialize(held.join(trusted_ids(labels), "doc_id", "left_semi").select("scored.lang", "scored.chars", "own"), "held_out")
    mean = held.agg((F.sum("own") / F.sum("chars")).alias("m")).first()["m"] or 0.0
    judge = Judge(mean, float("inf"), None, shrink)
    marks = held.select("lang", ((F.col("own") + F.lit(float(mean * shrink))) / (F.col("chars") + shrink)).alias("s"))

    def limit(*by: str) -> DataFrame:
        return marks.groupBy(*by).agg(F.percentile_approx("s", F.lit(quantile), F.lit(10_000)).alias("threshold"), F.count("*").alias("n"))

    whole = limit().first()["threshold"]
    judge.everywhere = float("inf") if whole is None else whole
    judge.by_lang = materialize(limit("lang").where(F.col("n") >= least_trusted).select("lang", "threshold"), "thresholds")
    return judge


def _judged(docs: DataFrame, labels: DataFrame, reference: DataFrame | None, name: str, drop: str | None, **options) -> tuple[DataFrame, Judge]:
    """``docs`` with the struct ``name`` of ``ngrams.with_bits``, written, and the judge of them."""
    levels = ngrams.fit(_trusted_packed(docs if reference is None else reference, labels).select("half", "packed"), _full)  # one Python worker a task
    scored = materialize(ngrams.with_bits(docs, levels, name, drop), "scored")
    told = scored if reference is None else materialize(ngrams.with_bits(reference.select("doc_id", "lang", "text"), levels, name, "text"), "scored")
    return scored, set_judge(told.select("doc_id", F.col(f"`{name}`").alias("scored")), labels, **options)


def judge_quality(docs: DataFrame, labels: DataFrame, reference: DataFrame | None = None, **options) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, score, threshold, keep`` for every row of ``docs``.

    labels: doc_id, quality, toxic. reference: the documents that the labels speak of (``docs`` itself
    if not given); trusted ones among them train the model. A language with fewer than
    ``least_trusted`` trusted documents uses the threshold over all languages; with no trusted
    document at all everything is kept. A null or empty text has perplexity 1 and is kept, as nothing
    speaks against it. Null doc_ids and languages and repeated rows keep their rows; a null language
    counts as an empty one, malformed UTF-8 as U+FFFD. Other columns are not read. Empty in, empty out.
    """
    scored, judge = _judged(docs.select("doc_id", "lang", "text"), labels, reference, "scored", "text", **options)
    judged = judge.threshold(scored, "threshold")
    perplexity = F.pow(F.lit(2.0), F.col(f"scored.bits{WHOLE}") / F.greatest("scored.chars", F.lit(1)))
    return judged.select(
        "doc_id", F.col("scored.lang").alias("lang"), F.col("scored.chars").alias("n_chars"), perplexity.alias("perplexity"),
        judge.score().alias("score"), "threshold", judge.keep("threshold").alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, reference: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; see ``judge_quality`` for nulls, repeats and empty tables.

    Columns of any other name pass through.
    """
    scored = fresh("scored", docs.columns)
    found, judge = _judged(docs, labels, reference, scored, None, **options)
    limit = fresh("threshold", [*docs.columns, scored])
    judged = judge.threshold(found, limit, scored)
    return judged.where(judge.keep(limit, scored)).select(*[f"`{c}`" for c in docs.columns])
