"""JSON documents of any size, read by byte ranges: one graph payload in one file is the work of many tasks.

The text source splits a file at closing braces, wherever its ranges fall. What a piece does to the state of a JSON reader (inside a
string or not, how deep) is known for either state it may begin in; prefix sums over pieces, and over blocks of a file, tell
which it was. Objects that end at depth two are the elements of the document's arrays; the pieces of each meet by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootspan.scratch import materialize

#: ``"name": [ {``: where an array of objects begins, up to its first object.
_ARRAY = r'"((?:[^"\\]|\\.)*+)"\s*+:\s*+\[\s*+\{'


def _structure(text: Column, inside: bool) -> Column:
    """``text`` (without escapes) without its strings, if it begins outside or inside of one."""
    if inside:
        text = F.when(F.contains(text, F.lit('"')), F.regexp_replace(text, r'^[^"]*+"', "")).otherwise("")
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*+"', ""), r'"[^"]*+$', "")


def _change(structure: Column, closed: Column) -> Column:
    """What a piece adds to the depth; ``closed``: whether the brace at its end counts."""
    many = lambda signs: F.length(structure) - F.length(F.translate(structure, signs, ""))
    return (many("{[") - many("]") - closed.cast("int")).cast("long")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, row, text``: the document cut after each closing brace, which is not in ``text``."""
    read = spark.read.option("lineSep", "}").text(path)
    row = F.monotonically_increasing_id()  # ascends inside a block, which one task reads
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"), F.col("value").alias("text"))


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, no, name, text``: the JSON text of each object that stands in an array of the topmost object, the array's name, and its number in the file.

    Files hold one such document or several, one after another. Strings may hold braces, quotes and line ends of any kind; a single element
    has to fit a task. A file that is no JSON gives whatever its braces say. Text goes through two shuffles by block and one by element.
    """
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    marked = _pieces(spark, path).withColumn("bare", bare).withColumn("quotes", F.length("bare") - F.length(F.translate("bare", '"', "")))
    parity = F.col("quotes") % 2
    marked = marked.select("file", "block", "row", "text", parity.alias("flips"), _change(_structure(F.col("bare"), False), parity == 0).alias("out"), _change(_structure(F.col("bare"), True), parity == 1).alias("in"))
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    told = marked.withColumn("was", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    told = told.withColumn("d0", F.when(F.col("was") == 0, F.col("out")).otherwise(F.col("in"))).withColumn("d1", F.when(F.col("was") == 0, F.col("in")).otherwise(F.col("out")))
    told = materialize(told.drop("out", "in"), "pieces")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a file has blocks
    blocks = told.groupBy("file", "block").agg((F.sum("flips") % 2).alias("flips"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    blocks = materialize(blocks.select("file", "block", "inside", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base")), "blocks")
    deep = told.join(blocks, ["file", "block"]).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    deep = deep.withColumn("depth", F.col("base") + F.coalesce(F.sum("d").over(before), F.lit(0)))
    outside = (F.col("was") + F.col("inside") + F.col("flips")) % 2 == 0
    deep = deep.withColumn("last", (outside & (F.col("depth") + F.col("d") == 2)).cast("long"))
    deep = deep.withColumn("n", F.coalesce(F.sum("last").over(before), F.lit(0)))
    deep = materialize(deep.select("file", "block", "row", "text", "depth", "last", "n"), "deep")
    ends = deep.groupBy("file", "block").agg(F.sum("last").alias("ends"))
    ends = materialize(ends.select("file", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("first")), "ends")
    piece = F.struct("block", "row", "depth", "text")
    parts = deep.join(ends, ["file", "block"]).groupBy("file", (F.col("first") + F.col("n")).alias("no")).agg(F.max("last").alias("whole"), F.array_sort(F.collect_list(piece)).alias("p")).where("whole = 1")
    # text before the element proper can only be in pieces that begin above it; the last of these opens it
    begin = F.array_max(F.transform("p", lambda x, i: F.when(x["depth"] <= 2, i)))
    text = F.concat(F.array_join(F.transform(F.filter("p", lambda x, i: i >= begin), lambda x: x["text"]), "}"), F.lit("}"))
    parts = parts.select("file", "no", text.alias("text"), F.element_at("p", begin + 1)["depth"].alias("depth"))
    follows = (F.col("depth") == 2) & F.rlike(F.col("text"), F.lit(r"^\s*+,?\s*+\{"))  # in the array of the one before
    name = F.when(~follows, F.regexp_extract("text", _ARRAY, 1))
    body = F.when(follows, F.regexp_replace("text", r"^\s*+,?\s*+\{", "{")).otherwise(F.regexp_replace("text", r"(?s)^.*?" + _ARRAY, "{"))
    parts = materialize(parts.select("file", "no", name.alias("name"), body.alias("text")), "elements")
    arrays = parts.where("name is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "name"))).alias("arrays"))  # an entry for each array of a document
    last = F.try_element_at(F.filter("arrays", lambda a: a["no"] <= F.col("no")), F.lit(-1))
    return parts.drop("name").join(arrays, "file").select("file", "no", last["name"].alias("name"), "text")
