"""Benchmark passages in documents, re-parameterised ones included. DataFrame operations only.

Texts become templates: numbers, units after numbers and names (capitalised words inside a sentence)
are replaced by typed placeholders, the rest is lower-cased words. Windows of ``WINDOW`` template
words are hashed and joined with those of the benchmark; matches of a document and an item that lie
on one diagonal (document position less item position) are counted. Where enough match, the values
behind the placeholders of the matched windows decide: a leak maps each of the item's values to one value
throughout, be it the same or another.

Beside them go windows of the plain words, case folded: capitals decide what counts as a name, so a copy in
another case has other templates. Enough plain windows on one diagonal are a leak as well, whatever the
values say, unless these contradict each other and most of the matched template windows are not verbatim.

The corpus is read into windows once, for all window sizes. The benchmark's distinct window hashes (two longs a row) go to every task
by broadcast if they are at most ``BROADCAST_ROWS``; beyond that two bit sieves of them do, of a fixed size each, and what these let through meets
the items' windows by a join of Spark's choice. So only windows with a known hash, or few others, are shuffled. Items of equal texts are one until the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm.common import fresh
from rootspan.scratch import materialize

WINDOW, MIN_WINDOWS, BROADCAST_ROWS = 8, 6, 1_000_000
#: Bits of a hash that tell its place in a sieve: 64 million bits, in a million rows at most.
SIEVE = 26
UNITS = ["cm", "cents", "days", "dollars", "euros", "feet", "ft", "g", "grams", "h", "hours", "inches", "kg", "km", "l", "lb", "liters", "litres", "m", "meters", "metres", "mg", "miles", "min", "minutes", "ml", "mm", "months", "percent", "pounds", "s", "seconds", "weeks", "years"]
#: Possessive: nothing follows that a shorter match could serve, and Java goes through such a run in a loop, where a greedy one takes a frame of the stack for each word.
NUMBER = r" [0-9][0-9.]*+(?: [0-9][0-9.]*+)*+"
UNIT = f"# ({'|'.join(UNITS)}) "
NAME = r"([^ .])((?: \p{Lu}\p{L}*+)++)"


def marked(text: Column) -> Column:
    """Words with single marks for sentence ends: every other sign is a space, a point stays only inside a word."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}.!?]+", " "), F.lit(" "))
    return F.regexp_replace(flat, r"[.!?]+ ", " . ")


def numbers_out(s: Column) -> Column:
    return F.regexp_replace(s, NUMBER, " #")


def units_out(s: Column) -> Column:
    return F.regexp_replace(s, UNIT, "# % ")


def template(text: Column) -> Column:
    """The template words of a text: lower-cased words, ``#`` number, ``%`` unit, ``@`` name."""
    return template_words(marked(text))


def template_words(flat: Column) -> Column:
    s = F.regexp_replace(units_out(numbers_out(flat)), NAME, "$1 @")
    return _words(F.lower(s))


def plain_words(flat: Column) -> Column:
    """The words of a marked text, case folded (capitals first: they have no sharp s)."""
    return _words(F.lower(F.upper(flat)))


def _words(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(s, r"(?: \.)+ ", " "), " +"), lambda w: w != "")


def both_words(df: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each: its template words, and (``verbatim``) its plain words."""
    flat = evaluated(df, "flat", marked(F.col("text")), *keep)
    kinds = [F.struct(F.lit(False).alias("verbatim"), template_words(F.col("flat")).alias("words")), F.struct(F.lit(True).alias("verbatim"), plain_words(F.col("flat")).alias("words"))]
    return flat.select(*keep, F.explode(F.array(*kinds)).alias("k")).select(*keep, "k.*")


def evaluated(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and ``name``: ``value`` is computed once a row here, where a projection could be merged into those that follow and repeat it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def windows(df: DataFrame, sizes: list[int], keys: list[str], pos: str) -> DataFrame:
    """``keys, pos, hash``: a hash for each run of each of ``sizes`` of the ``words`` of ``df``, positions from 0; runs of other lengths have other hashes."""
    hashed = evaluated(df.where(F.size("words") >= min(sizes)), "hashes", F.transform("words", lambda w: F.xxhash64(w)), *keys)

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("hashes") - (size - 1))
        runs = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice("hashes", i, size)).alias("hash")))
        return F.when(F.size("hashes") >= size, runs)

    found = of(sizes[0]) if len(sizes) == 1 else F.flatten(F.filter(F.array(*[of(n) for n in sizes]), lambda x: x.isNotNull()))
    return hashed.select(*keys, F.explode(found).alias("w")).select(*keys, F.col("w.at").alias(pos), F.col("w.hash").alias("hash"))


def sieved(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose ``hash`` is not in ``known``: two sieves by separate bits of it, each at most 2^(SIEVE - 6) rows of 64 bits, which bounds the broadcasts."""
    for shift in (0, SIEVE):
        place = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << SIEVE) - 1))
        word, bit = F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {shift}) & 63 as int))")
        words = materialize(known.select(word, bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits")), "sieve")
        df = df.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
    return df


def one_of_equals(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(item_id, text)`` of one item of all whose texts are equal, and ``(item, item_id)``: which items each of them, as a struct, stands for."""
    texts = benchmark.groupBy("item_id").agg(F.sort_array(F.collect_set(F.coalesce("text", F.lit("")))).alias("texts"))
    texts = materialize(texts, "texts")
    first = materialize(texts.groupBy("texts").agg(F.min(F.struct("item_id")).alias("item")), "items")
    return first.select("item.item_id", F.explode("texts").alias("text")), materialize(texts.join(first, "texts").select("item", "item_id"), "equals")


def slots(text: Column, words: Column) -> Column:
    """``(pos, kind, value)`` of each placeholder: the values in order of appearance, zipped with their positions."""
    first = marked(text)
    second = numbers_out(first)
    third = units_out(second)
    found = {
        "#": F.regexp_extract_all(first, F.lit(f"({NUMBER})"), 1),
        "%": F.regexp_extract_all(second, F.lit(UNIT), 1),
        "@": F.transform(F.regexp_extract_all(third, F.lit(NAME), 2), lambda v: F.lower(v)),
    }
    return F.concat(*[_placed(words, kind, values) for kind, values in found.items()])


def _placed(words: Column, kind: str, values: Column) -> Column:
    at = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(kind), i)), lambda i: i.isNotNull())
    return F.zip_with(at, values, lambda p, v: F.struct(p.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.trim(v).alias("value")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_windows: int = MIN_WINDOWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, n_slots, n_changed`` for each leak of an item into a document.

    n_windows: template windows of the item found on the best diagonal, at least ``min_windows`` or all that
    the item has; ties go to the smaller diagonal. Where these don't make a leak but the verbatim ones
    do, n_windows and item_windows count windows of plain words. An item of fewer than ``window`` words
    is one window of its own length, an item without words is never found. n_slots: placeholders
    compared in matched template windows, n_changed: of them with another value. Rows that share a doc_id
    (or item_id) are judged together, nulls as one more id. Null texts are empty. Other columns are not
    read. Empty in, empty out.
    """
    first, members = one_of_equals(benchmark)
    if (found := _leaks(docs, first, window, min_windows, broadcast_rows)) is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, n_windows long, item_windows long, n_slots long, n_changed long")
    return found.join(members, "item").select("doc_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed")


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, min_windows: int, broadcast_rows: int) -> DataFrame | None:
    """``find_leaks`` with a struct ``item`` in place of item_id; None where no item has a word."""
    items = both_words(benchmark, "item_id", "text").where(F.size("words") > 0)
    items = materialize(items.withColumn("n_window", F.least(F.size("words"), F.lit(window))), "items")
    sizes = sorted(r["n_window"] for r in items.select("n_window").distinct().collect())  # window numbers at most
    doc_id, item_id = F.struct("doc_id").alias("doc"), F.struct("item_id").alias("item")
    texts = docs.select("doc_id", "text")
    worded = both_words(texts, "doc_id")
    if not sizes:
        return None
    own = [windows(items.where(F.col("n_window") == n), [n], ["item_id", "verbatim"], "item_pos") for n in sizes]
    own = materialize(reduce(DataFrame.unionByName, own).select(item_id, "verbatim", "item_pos", "hash").distinct(), "windows")
    known = materialize(own.select("hash", "verbatim").distinct(), "known")
    here = windows(worded, sizes, ["doc_id", "verbatim"], "doc_pos")
    here = here.join(F.broadcast(known), ["hash", "verbatim"]) if known.count() <= broadcast_rows else sieved(here, known)
    hits = here.join(own, ["hash", "verbatim"]).select(doc_id, "item", "verbatim", "doc_pos", "item_pos")
    found = hits.withColumn("diagonal", (F.col("doc_pos") - F.col("item_pos")).cast("long"))
    by = found.groupBy("doc", "item", "verbatim", "diagonal").agg(F.collect_set("item_pos").alias("at")).withColumn("n_windows", F.size("at").cast("long"))
    best = by.groupBy("doc", "item", "verbatim").agg(F.min(F.struct((-F.col("n_windows")).alias("o"), "diagonal", "n_windows", "at")).alias("b")).select("doc", "item", "verbatim", "b.diagonal", "b.n_windows", "b.at")
    wide = items.groupBy(item_id, "verbatim").agg(F.max(F.size("words") - F.col("n_window") + 1).cast("long").alias("item_windows"), F.max("n_window").alias("n_window"))
    enough = materialize(best.join(wide, ["item", "verbatim"]).where(F.col("n_windows") >= F.least(F.lit(min_windows), F.col("item_windows"))), "likely")
    likely, copies = enough.where("not verbatim").drop("verbatim"), enough.where("verbatim")
    some = materialize(likely.select(F.col("doc.doc_id").alias("key"), F.lit(True).alias("hit")).distinct(), "likely")
    again = texts.join(some, F.col("doc_id").eqNullSafe(F.col("key"))).select("doc_id", "text")
    again = evaluated(again, "words", template(F.col("text")), "doc_id", "text")
    doc_slots = again.select(doc_id, F.explode(slots(F.col("text"), F.col("words"))).alias("s")).select("doc", F.col("s.pos").alias("doc_pos"), F.col("s.kind").alias("doc_kind"), F.col("s.value").alias("doc_value"))
    item_slots = items.where("not verbatim").select(item_id, F.explode(slots(F.col("text"), F.col("words"))).alias("s")).select("item", F.col("s.pos").alias("item_pos"), "s.kind", F.col("s.value").alias("item_value"))
    compared = likely.join(item_slots.distinct(), "item").where("exists(at, p -> item_pos between p and p + n_window - 1)").withColumn("doc_pos", F.col("item_pos") + F.col("diagonal"))
    compared = compared.join(doc_slots.distinct(), ["doc", "doc_pos"]).where("kind = doc_kind")
    by_value = compared.groupBy("doc", "item", "kind", "item_value").agg(F.countDistinct("doc_value").alias("values"), F.count("*").alias("n"), F.sum(F.when(F.col("doc_value") != F.col("item_value"), 1).otherwise(0)).alias("changed"))
    verdict = by_value.groupBy("doc", "item").agg(F.max("values").alias("values"), F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed"))
    judged = likely.join(verdict, ["doc", "item"], "left").select("doc", "item", "n_windows", "item_windows", "n_slots", "n_changed", (F.coalesce("values", F.lit(1)) == 1).alias("consistent"))
    copied = copies.select("doc", "item", F.col("n_windows").alias("n_copied"), F.col("item_windows").alias("item_copied"))
    out = judged.join(copied, ["doc", "item"], "full").where("consistent or n_copied is not null and (n_windows is null or 2 * n_copied >= n_windows)")
    zero, consistent = F.lit(0).cast("long"), F.coalesce("consistent", F.lit(False))
    counts = [F.when(consistent, F.col(own)).otherwise(F.col(copy)).alias(own) for own, copy in (("n_windows", "n_copied"), ("item_windows", "item_copied"))]
    return out.select("doc.doc_id", "item", *counts, F.coalesce("n_slots", zero).alias("n_slots"), F.coalesce("n_changed", zero).alias("n_changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents into which a benchmark item leaked; see ``find_leaks`` for nulls and empty tables.

    All rows of a leaked doc_id go, repeats and null ids too. Columns of any other name pass through.
    """
    name = fresh("leaked", docs.columns)
    found = _leaks(docs.select("doc_id", "text"), one_of_equals(benchmark)[0], WINDOW, MIN_WINDOWS, BROADCAST_ROWS)
    if found is None:
        return docs
    leaked = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "leaked")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'item', item_id, coalesce(text, '') FROM benchmark),
first AS (SELECT kind, id, regexp_replace(' ' || regexp_replace(text, '[^\p{L}\p{N}.!?]+', ' ', 'g') || ' ', '[.!?]+ ', ' . ', 'g') AS s1 FROM texts),
second AS (SELECT *, regexp_replace(s1, ' [0-9][0-9.]*(?: [0-9][0-9.]*)*', ' #', 'g') AS s2 FROM first),
third AS (SELECT *, regexp_replace(s2, '# (@UNITS@) ', '# % ', 'g') AS s3 FROM second),
worded AS (
  SELECT *, false AS verbatim, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(s3, '([^ .])((?: \p{Lu}\p{L}*)+)', '\1 @', 'g')), '(?: \.)+ ', ' ', 'g'), ' +'), lambda w: w <> '') AS words FROM third
  UNION ALL SELECT *, true, list_filter(string_split_regex(regexp_replace(lower(upper(s1)), '(?: \.)+ ', ' ', 'g'), ' +'), lambda w: w <> '') FROM third),
items AS (SELECT *, least(len(words), 8) AS n_window FROM worded WHERE kind = 'item' AND len(words) > 0),
item_windows AS (
  SELECT DISTINCT id AS item_id, verbatim, n_window, pos - 1 AS item_pos, array_to_string(words[pos:pos + n_window - 1], ' ') AS win
  FROM (SELECT id, verbatim, n_window, words, unnest(range(1, len(words) - n_window + 2)) AS pos FROM items)),
doc_windows AS (
  SELECT id AS doc_id, verbatim, n_window, pos - 1 AS doc_pos, array_to_string(words[pos:pos + n_window - 1], ' ') AS win
  FROM (SELECT id, verbatim, n_window, words, unnest(range(1, len(words) - n_window + 2)) AS pos FROM worded, (SELECT DISTINCT n_window FROM items) WHERE kind = 'doc')),
diagonals AS (
  SELECT doc_id, item_id, verbatim, doc_pos - item_pos AS diagonal, count(DISTINCT item_pos) AS n_windows, list(DISTINCT item_pos) AS at
  FROM doc_windows JOIN item_windows USING (n_window, win, verbatim) GROUP BY doc_id, item_id, verbatim, doc_pos - item_pos),
best AS (SELECT * FROM diagonals QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, verbatim ORDER BY n_windows DESC, diagonal) = 1),
enough AS (
  SELECT b.*, w.item_windows, w.n_window FROM best b
  JOIN (SELECT id, verbatim, max(len(words) - n_window + 1) AS item_windows, max(n_window) AS n_window FROM items GROUP BY id, verbatim) w ON w.id = b.item_id AND w.verbatim = b.verbatim
  WHERE b.n_windows >= least(6, w.item_windows)),
likely AS (SELECT * FROM enough WHERE NOT verbatim),
copies AS (SELECT * FROM enough WHERE verbatim),
slot_lists AS (
  SELECT kind, id, unnest([
    {'mark': '#', 'at': list_filter(list_transform(words, lambda w, i: CASE WHEN starts_with(w, '#') THEN i - 1 END), lambda x: x IS NOT NULL), 'vals': regexp_extract_all(s1, ' [0-9][0-9.]*(?: [0-9][0-9.]*)*')},
    {'mark': '%', 'at': list_filter(list_transform(words, lambda w, i: CASE WHEN starts_with(w, '%') THEN i - 1 END), lambda x: x IS NOT NULL), 'vals': regexp_extract_all(s2, '# (@UNITS@) ', 1)},
    {'mark': '@', 'at': list_filter(list_transform(words, lambda w, i: CASE WHEN starts_with(w, '@') THEN i - 1 END), lambda x: x IS NOT NULL), 'vals': list_transform(regexp_extract_all(s3, '([^ .])((?: \p{Lu}\p{L}*)+)', 2), lambda v: lower(v))}]) AS s
  FROM worded WHERE NOT verbatim AND (kind = 'item' OR id IN (SELECT doc_id FROM likely))),
slots AS (SELECT DISTINCT kind, id, mark, pos, trim(val) AS val FROM (SELECT kind, id, s.mark AS mark, unnest(s.at) AS pos, unnest(s.vals) AS val FROM slot_lists)),
by_value AS (
  SELECT l.doc_id, l.item_id, i.mark, i.val, count(DISTINCT d.val) AS vals, count(*) AS n, sum(CASE WHEN d.val <> i.val THEN 1 ELSE 0 END) AS changed
  FROM likely l JOIN slots i ON i.kind = 'item' AND i.id = l.item_id AND len(list_filter(l.at, lambda p: i.pos BETWEEN p AND p + l.n_window - 1)) > 0
  JOIN slots d ON d.kind = 'doc' AND d.id = l.doc_id AND d.pos = i.pos + l.diagonal AND d.mark = i.mark GROUP BY l.doc_id, l.item_id, i.mark, i.val),
verdict AS (SELECT doc_id, item_id, max(vals) AS vals, sum(n) AS n_slots, sum(changed) AS n_changed FROM by_value GROUP BY doc_id, item_id),
judged AS (SELECT l.doc_id, l.item_id, l.n_windows, l.item_windows, v.n_slots, v.n_changed, coalesce(v.vals, 1) = 1 AS consistent FROM likely l LEFT JOIN verdict v ON v.doc_id = l.doc_id AND v.item_id = l.item_id)
SELECT coalesce(j.doc_id, c.doc_id) AS doc_id, coalesce(j.item_id, c.item_id) AS item_id, CASE WHEN coalesce(consistent, false) THEN j.n_windows ELSE c.n_windows END AS n_windows,
  CAST(CASE WHEN coalesce(consistent, false) THEN j.item_windows ELSE c.item_windows END AS BIGINT) AS item_windows, CAST(coalesce(j.n_slots, 0) AS BIGINT) AS n_slots, CAST(coalesce(j.n_changed, 0) AS BIGINT) AS n_changed
FROM judged j FULL JOIN copies c ON c.doc_id = j.doc_id AND c.item_id = j.item_id
WHERE coalesce(consistent, false) OR c.doc_id IS NOT NULL AND (j.doc_id IS NULL OR 2 * c.n_windows >= j.n_windows)
""".replace("@UNITS@", "|".join(UNITS))
