"""What the corpus operators share: table access, batches of bounded size, a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step in a Python task holds at most, unless a single text is longer.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` (string or binary) holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(array: pa.Array, null: int = -1) -> np.ndarray:
    """An integer column as numpy, nulls as ``null``."""
    return array.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the batches of each partition; a worker gives unused memory back when a partition ends, as it lives on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: str, limit: int, n: int) -> DataFrame:
    """At most ``limit`` of the ``n`` rows of ``df``: those of the smallest ``key``, a column of uniform 64-bit hashes.

    Rows that can hardly be among them go before any are gathered, so what is sorted doesn't grow with ``df``.
    """
    share = min(1.0, 2 * (limit + 100) / max(n, 1))
    few = df if share == 1.0 else df.where(F.col(key) < int(share * (1 << 64)) - (1 << 63))
    return few.orderBy(key).limit(limit)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def decoded(texts: pa.Array) -> list[str]:
    """Texts as Python strings: null is empty, and bytes that are no UTF-8 (Spark strings may hold them) become U+FFFD."""
    return ["" if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


@lru_cache(maxsize=4)
def byte_bpe(ranks_path: str, end_id: int | None = None):
    """A byte-level BPE encoder from a rank file; gives the ids of the library ``tokenizers`` on the same vocabulary, several times faster.

    end_id: the id of ``<|endoftext|>`` if that string in a text counts as the special token.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    special = {} if end_id is None else {"<|endoftext|>": end_id}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _vocabulary(path: str, special: bool):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special
    return whole


def token_ids(text: str, ranks_path: str, end_id: int | None = None) -> list[int]:
    """Ids of a text of any length and kind.

    The fast encoder gives up on runs of about a million white-space characters; such a text goes to ``tokenizers`` with the
    vocabulary file beside the rank file, whose ids are the same.
    """
    encoding = byte_bpe(ranks_path, end_id)
    try:
        return encoding.encode(text, allowed_special="all", disallowed_special=())  # encode_ordinary would end the process instead of raising
    except ValueError:
        return _vocabulary(ranks_path.removesuffix(".tiktoken") + ".json", end_id is not None).encode(text, add_special_tokens=False).ids
