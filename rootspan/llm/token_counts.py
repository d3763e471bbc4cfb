"""Token counts from flat token files: a vectorised search for the end-of-document id, stitched by a prefix scan.

A token file is nothing but ids of a fixed width, one document after the other, each followed by the
end id; no index tells where documents start. The scan reads files in blocks, finds the end ids of a
block in one numpy pass, and gives for each block its tokens, end ids and inner document lengths. A
prefix scan over a file's blocks then carries the tokens since the last end id and the number of
documents so far into each block, so documents that cross blocks come out whole. Blocks are ranges of
bytes that tasks read by themselves, so a file of any size is read by many tasks; only where the file
system is one that pyarrow doesn't open do tasks get whole files from Spark's reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, decoded, mapped, token_ids, tokenizer_path
from rootspan.scratch import materialize, materialize_alone, scratch_path

END_ID, WIDTH = 50256, 2
#: Tokens that the scan looks at in one step, and bytes of ids after which a writing task opens a new file.
BLOCK_TOKENS, FILE_BYTES = 1 << 18, 16 << 20
BLOCKS = "file string, block long, tokens long, ends long, last_end long, first_end long, inner array<long>"


def _encode(ranks_path: str, width: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: list[tuple[int, bytes]] = []
        shard, size, seq = 0, 0, 0

        def rows(values: list[bytes], kind: str, shards: list[int], seqs: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array([kind] * len(values)), pa.array(shards, pa.int32()), pa.array(seqs, pa.int64())], ["value", "kind", "shard", "seq"])

        for batch in bounded(batches, "text"):
            values, shards, seqs = [], [], []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), decoded(column(batch, "text"))):
                ids = np.array(token_ids(text, ranks_path), dtype=f"<u{width}").tobytes()
                if size and size + len(ids) > file_bytes:
                    shard, size = shard + 1, 0
                values.append(ids)
                shards.append(shard)
                seqs.append(seq)
                order.append((shard, b"" if doc_id is None else str(doc_id).encode()))
                size, seq = size + len(ids) + width, seq + 1
            yield rows(values, "ids", shards, seqs)
        if order:
            yield rows([x for _, x in order], "order", [s for s, _ in order], list(range(len(order))))

    return run


def write_token_files(docs: DataFrame, path: str, ranks_path: str | None = None, end_id: int = END_ID, width: int = WIDTH, file_bytes: int = FILE_BYTES) -> None:
    """Write ``docs`` as flat token files below ``path`` (kind=ids), and in files of the same names the order of doc_ids (kind=order).

    Both kinds come from the same task, so they agree whatever runs again. Spark's text writer puts
    the raw ids of a document in a line; the line separator is the end id. No text encodes to it.
    """
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = mapped(texts, _encode(ranks_path, width, file_bytes), "value binary, kind string, shard int, seq long")
    rows = rows.sortWithinPartitions("kind", "shard", "seq").select(F.col("value").cast("string"), "kind", "shard")
    separator = end_id.to_bytes(width, "little").decode("latin-1")
    rows.write.partitionBy("kind", "shard").option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, content)`` of every file below ``path``; files are held whole by a task, so keep them to tens of MB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")


def token_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """``(file, at, size)`` for each range of ``range_bytes`` of every file below ``path``, in any order; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("file", "length", F.explode(starts).alias("at"))
    return ranges.select("file", "at", F.least(F.lit(range_bytes), F.col("length") - F.col("at")).alias("size")).repartition("file", "at")


def readable_by_range(path: str) -> bool:
    """Whether tasks can open files below ``path`` by themselves."""
    try:
        return fs.FileSystem.from_uri(path)[0].get_file_info(fs.FileSystem.from_uri(path)[1]).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, OSError):
        return False


def _summary(file: str, block: int, ids: np.ndarray, end_id: int) -> pa.RecordBatch:
    """One row: what the stitching needs to know of a block."""
    ends = np.flatnonzero(ids == end_id)
    row = [file, block, len(ids), len(ends), int(ends[-1]) if len(ends) else None, int(ends[0]) if len(ends) else None, (np.diff(ends) - 1).tolist()]
    types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["file", "block", "tokens", "ends", "last_end", "first_end", "inner"])


def _whole(file: str, size: int, width: int) -> None:
    if size % width:
        raise ValueError(f"{file}: its length is no multiple of {width} bytes")


def _range_blocks(end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, size in zip(*(column(batch, c).to_pylist() for c in ("file", "at", "size"))):
                _whole(file, size, width)
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as f:
                    data = f.read_at(size, at)
                yield _summary(file, at, np.frombuffer(data, dtype=f"<u{width}"), end_id)

    return run


def _content_blocks(end_id: int, width: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(column(batch, "file"), column(batch, "content")):
                data = content.as_buffer()
                if data is None or not data.size:
                    continue
                _whole(file, data.size, width)
                ids = np.frombuffer(data, dtype=f"<u{width}")
                for at in range(0, len(ids), block_tokens):
                    yield _summary(file.as_py(), at, ids[at : at + block_tokens], end_id)

    return run


def stitched(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, n_tokens, ended)`` from the blocks of files: a prefix scan over their summaries, then each block's own lengths."""
    blocks = materialize(blocks, "blocks")
    by_place = Window.partitionBy("file").orderBy("block")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    scan = blocks.drop("inner").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    scan = scan.withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    scan = scan.withColumn("since", F.coalesce(F.max(F.col("base") + F.col("last_end")).over(before) + 1, F.lit(0)))
    scan = scan.withColumn("is_last", F.lead("block").over(by_place).isNull())
    inner = blocks.where("ends > 1").select("file", "block", F.posexplode("inner").alias("k", "n_tokens"))
    inner = inner.join(scan.where("ends > 1").select("file", "block", "ordinal"), ["file", "block"])
    inner = inner.select("file", (F.col("ordinal") + F.col("k") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    crossing = F.col("base") + F.col("first_end") - F.col("since")
    first = scan.where("ends > 0").select("file", "ordinal", crossing.alias("n_tokens"), F.lit(True).alias("ended"))
    rest_from = F.when(F.col("ends") > 0, F.col("base") + F.col("last_end") + 1).otherwise(F.col("since"))
    rest = scan.where("is_last").select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), (F.col("base") + F.col("tokens") - rest_from).alias("n_tokens"), F.lit(False).alias("ended"))
    return first.unionByName(inner).unionByName(rest.where("n_tokens > 0"))


def count_tokens(files: DataFrame, end_id: int = END_ID, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, ordinal, n_tokens, ended)``: the documents of flat token files, in order from 0.

    files: ``(file, content)``. n_tokens: without the end id; ended: false for tokens after the last end id, which count as a last document. A null or
    empty file has no documents; two end ids in a row hold an empty one between them. A file whose length is no multiple of ``width`` raises.
    """
    return stitched(mapped(files.select("file", "content"), _content_blocks(end_id, width, block_tokens), BLOCKS))


def count_file_tokens(spark: SparkSession, path: str, end_id: int = END_ID, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The same for every file below ``path``, of any size; each task reads ranges of ``block_tokens`` ids."""
    if readable_by_range(path):
        return stitched(mapped(token_ranges(spark, path, block_tokens * width), _range_blocks(end_id, width), BLOCKS))
    return count_tokens(read_token_files(spark, path), end_id, width, block_tokens)


def _order(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(column(batch, "file").to_pylist(), column(batch, "content").to_pylist()):
                ids = (content or b"").split(separator)[:-1]
                got = pa.array([int(x) if x else None for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), got], ["file", "ordinal", "doc_id"])

    return run


def document_token_counts(docs: DataFrame, ranks_path: str | None = None, end_id: int = END_ID, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row of ``docs``, through flat token files in the shared folder.

    A null or empty text has 0 tokens, malformed UTF-8 counts as U+FFFD. Null and repeated doc_ids keep their rows. Other
    columns of ``docs`` are not read. Empty in, empty out. The token files go when the counts are written.
    """
    spark = docs.sparkSession

    def counted() -> DataFrame:
        path = scratch_path(spark, "tokens")
        write_token_files(docs, path, ranks_path, end_id, width)
        key = F.regexp_extract("file", r"(shard=\d+/part-\d+)", 1)
        written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        if written.isEmpty():
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens")).limit(0)
        counts = count_file_tokens(spark, f"{path}/kind=ids", end_id, width, block_tokens).withColumn("key", key)
        order = mapped(read_token_files(spark, f"{path}/kind=order"), _order(end_id.to_bytes(width, "little")), "file string, ordinal long, doc_id long").withColumn("key", key)
        return order.join(counts.select("key", "ordinal", "n_tokens"), ["key", "ordinal"]).select("doc_id", "n_tokens")

    return materialize_alone(spark, counted, "counts")
