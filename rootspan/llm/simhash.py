"""Near-duplicate documents by SimHash fingerprints, found through Golay-code fuzzy keys.

A fingerprint is cut into four segments of 16 bits. Of at most three differing bits, spread over
four segments, some segment has none; a clean segment i whose successor i + 1 (around the cycle) has
at most one error always exists. With one clean segment the other three have one error each. With
two that touch, the first will do; with two that don't, each has another successor, and only one of
those can have two errors. With three clean ones, two touch. So four keys suffice, each an exact
segment joined with a *fuzzy* one.

The fuzzy part pads a segment to 23 bits and decodes it with the perfect Golay code [23, 12, 7]. A
word's indices are those of all codewords within distance four: its own, and five more if that one
is at distance three. Words that differ in one bit share an index: the second's own codeword is
within three of it, hence within four of the first.

Work that grows: distinct fingerprints only (copies meet in one row), about 21 keys each, one
shuffle by key. A bucket is compared inside its task and gives a spanning forest, never all pairs;
a bucket above ``bucket_limit`` goes to a second shuffle in blocks, every pair of blocks in a task of
its own.

``near_dedup`` goes by another rule, a Jaccard similarity of 0.8 or more of 5-word shingles. Such pairs differ
in about ten bits, beyond what these keys find, so it has keys of its own (``similar_groups``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import bounded, column, mapped
from rootspan.operators.components import connected_components
from rootspan.scratch import materialize

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
SEGMENTS, WIDTH = 4, 16
SET_WORDS, BANDS, BAND_ROWS = 5, 40, 5
#: Numbers of a sketch, sixteen minima each, and how many of the minima may differ.
SKETCH_WORDS, SKETCH_MISSES = 13, 74
#: Sets of a family that are compared all with all, and of a block of it.
FAMILY, BLOCK = 4096, 64
GOLAY_POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes | None, block: int = 1 << 15) -> int:
    """64-bit SimHash of a text's 3-word shingles; 0 for a null or wordless text.

    ``bytes.lower`` and ``bytes.split`` touch exactly A-Z and the ASCII white space of the contract.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
        total = 1
    else:
        hashes = (xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in zip(words, words[1:], words[2:]))
        total = len(words) - 2
    ones = np.zeros(64, dtype=np.int64)
    while got := list(islice(hashes, block)):
        bits = np.unpackbits(np.array(got, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        prints = np.array([fingerprint(t) for t in column(batch, "text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's 64 bits as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return mapped(texts, _fingerprints, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the Golay polynomial: 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns of weight four or less, and how many there are."""
    patterns = np.zeros((2048, 6), dtype=np.int64)
    count = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(syndrome(np.array([e]))[0]) if weight < 2 else _syndrome_of(bits)
            patterns[s, count[s]] = e
            count[s] += 1
    return patterns, count


@lru_cache(maxsize=1)
def _unit_syndromes() -> list[int]:
    return [int(x) for x in syndrome(1 << np.arange(23))]


def _syndrome_of(bits: tuple[int, ...]) -> int:
    out = 0
    for b in bits:
        out ^= _unit_syndromes()[b]
    return out


def nearby_codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the Golay codewords within distance four, six columns, and which columns count."""
    patterns, count = error_patterns()
    s = syndrome(segment)
    return (segment[:, None] ^ patterns[s]) >> 11, np.arange(6) < count[s][:, None]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row each belongs to: number of the pair, exact segment, index of the next segment."""
    segments = [(prints >> np.uint64(WIDTH * i) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for i in range(SEGMENTS)]
    keys, rows = [], []
    for i in range(SEGMENTS):
        index, real = nearby_codewords(segments[(i + 1) % SEGMENTS] << (23 - WIDTH))
        exact = (i << 28) + (segments[i] << 12)
        keys.append((exact[:, None] + index)[real])
        rows.append(np.nonzero(real)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = column(batch, "fp").to_numpy(zero_copy_only=False)
        keys, rows = fuzzy_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], ["key", "fp"])


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected among distinct ``prints``; one fewer than members at most."""
    left, a, b = prints.astype(np.uint64), [], []
    queue: list[np.ndarray] = []
    while len(left) or queue:
        if not queue:
            queue, left = [left[:1]], left[1:]
        seed = queue.pop()
        near = np.bitwise_count(left ^ seed[0]) <= max_bits
        if near.any():
            found, left = left[near], left[~near]
            a.append(np.repeat(seed, len(found)))
            b.append(found)
            queue += [found[i : i + 1] for i in range(len(found))]
    if not a:
        return left[:0], left[:0]
    return np.concatenate(a), np.concatenate(b)


def _rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])


def _bucket_links(bucket_limit: int, max_bits: int):
    """Runs of equal keys in a sorted partition → links; members of runs above the limit pass on as (key, fp, true)."""

    def small_runs(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(starts, append=len(keys))
        links: list[tuple[np.ndarray, np.ndarray]] = []
        narrow = np.repeat(sizes <= 6, sizes)
        for step in range(1, min(6, len(keys))):
            at = np.flatnonzero((keys[:-step] == keys[step:]) & narrow[:-step])
            x, y = prints[at], prints[at + step]
            near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
            links.append((x[near], y[near]))
        for s, n in zip(starts[sizes > 6], sizes[sizes > 6]):
            links.append(forest(np.unique(prints[s : s + n]), max_bits))
        a = np.concatenate([x for x, _ in links]) if links else prints[:0]
        b = np.concatenate([y for _, y in links]) if links else prints[:0]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        return _rows(pairs[0], pairs[1], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, column(batch, "key").to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if hot is not None:
                n = int(np.searchsorted(keys, hot, side="right"))
                if n:
                    yield _rows(keys[:n], prints[:n], True)
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                hot = None
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield small_or_hot(keys[:last], prints[:last])
                yield from passed(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
            if len(keys) > bucket_limit:
                hot = keys[0]
                yield _rows(keys, prints, True)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield small_or_hot(keys, prints)
            yield from passed(keys, prints)

    def wide(keys: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(starts, append=len(keys))
        return np.repeat(sizes > bucket_limit, sizes)

    def small_or_hot(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        keep = ~wide(keys)
        return small_runs(keys[keep], prints[keep]) if keep.any() else _rows(prints[:0], prints[:0], False)

    def passed(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        big = wide(keys)
        if big.any():
            yield _rows(keys[big], prints[big], True)

    return run


def _block_links(max_bits: int):
    def run(pdf):
        a, b = forest(np.unique(pdf["fp"].to_numpy().view(np.uint64)), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that join all those within ``max_bits`` (3 at most).

    prints: column ``fp``, distinct. The links span each bucket's groups; their transitive closure is that of all pairs.
    """
    if max_bits > 3:
        raise ValueError("the keys find up to three differing bits")
    spark = prints.sparkSession
    keyed = mapped(prints.select("fp"), _keys, "key long, fp long")
    keyed = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    found = materialize(mapped(keyed, _bucket_links(bucket_limit, max_bits), "a long, b long, hot boolean"), "links")
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = materialize(hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket_limit // 2)).alias("blocks")), "hot")
    if sizes.take(1):
        member = hot.join(sizes, "key").withColumn("r", F.pmod(F.xxhash64("fp"), "blocks"))
        pairs = member.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = pairs.select("key", "fp", F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s"))
        links = links.unionByName(pairs.groupBy("key", "r", "s").applyInPandas(_block_links(max_bits), "a long, b long"))
    return links.distinct()


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    component_id is the smallest doc_id reachable through links, the document itself included. Null
    and wordless texts have fingerprint zero and link like any other. Rows with a null doc_id keep
    a row; they pass links on, and get the smallest known doc_id, or null if there is none. Repeated
    rows stay repeated. Other columns of ``docs`` are not read. Empty in, empty out.
    """
    hashed = materialize(with_fingerprints(docs), "fingerprints")
    prints = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    groups = connected_components(fingerprint_links(prints, max_bits, bucket_limit), "a", "b")
    known = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    known = materialize(known, "prints")
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = materialize(known.join(least, "root").select("fp", "component_id"), "prints")
    joined = hashed.join(named, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct hashes, in order, of a text's 5-word shingles; a shorter text is one shingle, a wordless one has none."""
    words = (text or b"").lower().split()
    size = min(SET_WORDS, len(words))
    runs = zip(*(words[i:] for i in range(size)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in runs), dtype=np.uint64))


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS + BAND_ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[: BANDS * BAND_ROWS], odd[BANDS * BAND_ROWS :]


def minima(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """The set's minima under ``BANDS`` times ``BAND_ROWS`` multiplicative hashes; none for the empty set."""
    if not len(shingles):
        return shingles
    by, _ = _multipliers()
    least = np.full(len(by), ~np.uint64(0))
    for i in range(0, len(shingles), block):
        least = np.minimum(least, (shingles[i : i + block, None] * by).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of ``BAND_ROWS`` minima."""
    _, mix = _multipliers()
    return (least.reshape(BANDS, BAND_ROWS) * mix[:-1]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * mix[-1] if len(least) else least


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each of the minima, sixteen to a number."""
    few = np.zeros(SKETCH_WORDS * 16, dtype=np.uint64)
    few[: len(least)] = (least >> np.uint64(8)) & np.uint64(15)
    return (few.reshape(SKETCH_WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _alike(a: str, b: str) -> str:
    """Whether two sketches differ in few enough of their minima, as a condition of a join.

    At a similarity of 0.8 a minimum's four bits differ with a chance of 0.1875; more than ``SKETCH_MISSES`` of 200 do so in less than 1 of
    10^9 cases. Of pairs at 0.6 half go, of those at 0.5 all but 1 in 300.
    """
    parts = []
    for i in range(SKETCH_WORDS):
        x = f"({a}[{i}] ^ {b}[{i}])"
        parts.append(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)")
    return f"({' + '.join(parts)}) <= {SKETCH_MISSES}"


def set_print(shingles: np.ndarray, block: int = 1 << 15) -> int:
    """64-bit SimHash of a set of shingle hashes; 0 for the empty set."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), block):
        ones += np.unpackbits(shingles[i : i + block].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        ids, prints, sizes, keys, sketches = [], [], [], [], []
        for text in column(batch, "text").to_pylist():
            found = shingle_set(text)
            least = minima(found)
            ids.append(_set_id(found))
            prints.append(set_print(found))
            sizes.append(len(found))
            keys.append(band_keys(least))
            sketches.append(sketch(least))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _signed(ids), _signed(prints), pa.array(sizes, pa.int64()), _lists(keys), _lists(sketches)], ["doc_id", "key", "fp", "n", "bands", "sketch"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents that share a doc_id, only those whose set is the one asked for."""
    unpack = zstandard.ZstdDecompressor()
    for batch in bounded(batches, "packed", 1 << 19):
        sets = [shingle_set(unpack.decompress(t)) for t in column(batch, "packed").to_pylist()]
        keys = _signed([_set_id(x) for x in sets])
        kept = [i for i, (k, want) in enumerate(zip(keys.to_pylist(), column(batch, "key").to_pylist())) if k == want]
        if kept:
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept)), _lists([sets[i] for i in kept])], ["key", "shingles"])


def _near_sizes(m: str, n: str) -> str:
    """Sets whose sizes differ by more than a fifth can't be similar enough."""
    return f"5 * least({m}, {n}) >= 4 * greatest({m}, {n})"


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in bounded(batches, "text"):
        packed = [pack.compress(t or b"") for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _fetched(texts: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, shingles)`` of the sets asked for, written once: one shuffle of the texts, made smaller."""
    wanted = materialize(keys.select("key").distinct().join(sets, "key"), "wanted")
    packed = mapped(texts, _small, "doc_id long, packed binary")
    found = packed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("key", "packed")
    return materialize(mapped(found, _shingles, "key long, shingles array<long>"), "shingles")


def _similar(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: numbers of sets) whose sets have a Jaccard similarity of 0.8 or more, from the sets themselves."""
    pairs = materialize(pairs, "pairs")
    left, right = (found.select(F.col("key").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")
    return materialize(both.where("9 * size(array_intersect(of_a, of_b)) >= 4 * (size(of_a) + size(of_b))").select("a", "b"), "links")


def _bridges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a group (``left`` tells the first; all rows are of it in a block's meeting with itself) that join different roots; fewer than there are roots.

    Sketches tell which pairs can be similar enough, the sets themselves decide.
    """
    pdf = pdf.sort_values("left", ascending=False, kind="stable")
    keys, roots, sets = pdf["key"].to_numpy(), pdf["root"].to_numpy(), pdf["shingles"].to_numpy()
    sketches, sizes = np.array([*pdf["sketch"]], dtype=np.int64).view(np.uint64), np.array([len(x) for x in sets])
    cut = int(pdf["left"].sum())
    above = {r: r for r in roots.tolist()}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for i in range(cut):
        begin = i + 1 if cut == len(keys) else cut
        near = begin + np.flatnonzero((roots[begin:] != roots[i]) & (5 * np.minimum(sizes[begin:], sizes[i]) >= 4 * np.maximum(sizes[begin:], sizes[i])))
        x = sketches[near] ^ sketches[i]
        x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
        near = near[np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= SKETCH_MISSES]
        for j in near.tolist():
            a, b = top(roots[i]), top(roots[j])
            if a != b and 9 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * (sizes[i] + sizes[j]):
                above[b] = a
                out.append((keys[i], keys[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _rest_links(placed: DataFrame, sketches: DataFrame, found: DataFrame) -> DataFrame:
    """Links between members (band, key, root) of a band that are in different components; each pair is compared inside a task, so no table has a row a pair.

    Bands that share members are one family, and its sets meet in blocks, each pair of blocks in a group of its own: a set travels once for each block of
    its family, 40 times at most. A family of more than ``FAMILY`` sets is compared band by band instead.
    """
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("key").alias("head")).where("lo < hi").select("band", "head")
    rest = materialize(placed.join(materialize(mixed, "mixed"), "band"), "rest")
    family = connected_components(rest.select("head", "key"), "head", "key").select(F.col("node").alias("key"), F.col("component").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("n"))
    family = materialize(family.join(sizes, "family"), "family")
    own = rest.select("key", "root").distinct().join(family.where(F.col("n") <= FAMILY), "key")
    own = own.select("key", "root", F.lit(False).alias("by_band"), F.col("family").alias("unit"), F.least(F.ceil(F.col("n") / BLOCK), F.lit(40)).alias("blocks"))
    wide = rest.join(family.where(F.col("n") > FAMILY).select("key"), "key", "left_semi")
    wide = wide.join(wide.groupBy("band").agg(F.ceil(F.count("*") / FAMILY).alias("blocks")), "band").select("key", "root", F.lit(True).alias("by_band"), F.col("band").alias("unit"), "blocks")
    dealt = materialize(own.unionByName(wide).withColumn("r", F.pmod(F.xxhash64("key"), "blocks")), "dealt")
    whole = dealt.join(sketches, "key").join(found, "key").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = whole.select("by_band", "unit", F.least("r", "s").alias("low"), F.greatest("r", "s").alias("high"), (F.col("r") <= F.col("s")).alias("left"), "key", "root", "sketch", "shingles")
    return materialize(whole.groupBy("by_band", "unit", "low", "high").applyInPandas(_bridges, "a long, b long"), "links")


def print_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets`` (key, fp) that the Golay keys find: the smallest sets of fingerprints that differ in three bits or fewer, and each set with the smallest of its fingerprint."""
    heads = materialize(sets.groupBy("fp").agg(F.min("key").alias("head")), "prints")
    near = fingerprint_links(heads.select("fp"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"of_{x}")) for x in ("a", "b"))
    across = near.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return materialize(across.unionByName(sets.join(heads, "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))), "near_prints")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``: components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

    The sets' SimHash fingerprints come first: pairs that the Golay keys find within three bits are verified and linked. Pairs at 0.8 differ in about ten bits, so
    further candidates share a band of minima; a pair at 0.8 shares none of the 40 in 1 of 8 million cases, a
    closer one less often. Sketches of all minima, compared inside the join, tell which of them can be similar enough, and
    those are verified on the sets themselves. Of what the fingerprints have left apart, first the members of a band meet the band's smallest set only, each set the one it shares
    most bands with before the others; what that leaves in several components meets pair by pair inside tasks (``_rest_links``).
    Equal sets (equal 64-bit hashes of them) are one from the start, wordless texts among them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hashed = materialize(mapped(texts, _bands, "doc_id long, key long, fp long, n long, bands array<long>, sketch array<long>"), "bands")
    sets = materialize(hashed.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "sets")
    sketches = sets.select("key", "sketch")
    banded = materialize(hashed.select("key", "n", F.explode("bands").alias("band")).distinct(), "banded")
    shared = banded.groupBy("band").agg(F.min(F.struct("key", "n")).alias("lead"), F.max("key").alias("last")).where("lead.key < last")
    members = materialize(banded.join(materialize(shared.select("band", "lead"), "shared"), "band"), "members")
    stars = members.where(f"key <> lead.key and {_near_sizes('n', 'lead.n')}").groupBy(F.col("lead.key").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("m"))
    first, second = (sketches.select(F.col("key").alias(x), F.col("sketch").alias(f"s_{x}")) for x in ("a", "b"))
    stars = materialize(stars.join(first, "a").join(second, "b").where(_alike("s_a", "s_b")).select("a", "b", "m"), "stars")
    prints = print_pairs(sets)
    found = _fetched(texts, sets.select("key", "first"), members.select("key").unionByName(prints.select(F.explode(F.array("a", "b")).alias("key"))))
    links = _similar(found, prints)
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    root = lambda x: groups.select(F.col("key").alias(x), F.col("component").alias(f"r_{x}"))
    apart = lambda pairs: pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b"))
    stars = materialize(apart(stars).select("a", "b", "m"), "stars")
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct(F.col("m"), -F.col("a"))).alias("a")).select("a", "b")
    links = links.unionByName(_similar(found, nearest))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    links = links.unionByName(_similar(found, apart(stars).select("a", "b")))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    placed = members.where("key <> lead.key").join(groups, "key", "left").select("band", "key", F.coalesce("component", "key").alias("root"))
    links = links.unionByName(_rest_links(materialize(placed, "placed"), sketches, found))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    known = materialize(sets.select("key", "first").join(groups, "key", "left").select("key", "first", F.coalesce("component", "key").alias("root")), "sets")
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = materialize(known.join(least, "root").select("key", "component_id"), "sets")
    return hashed.join(named, "key").select("doc_id", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each of the ``similar_groups``: the one whose doc_id is the smallest.

    Rows with a null doc_id stay. Of rows that repeat the smallest doc_id all stay. Null, empty and wordless texts are one group.
    Columns of any other name pass through. Empty in, empty out.
    """
    drop = similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
