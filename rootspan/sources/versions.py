"""Tables that change as a whole or not at all: each version in folders of its own, and a manifest written last that names them.

A reader looks for the manifest with the greatest number and reads what that names, so a save that fails midway, or a reader that comes
in between, sees the version before. Manifests are small JSON files beside the tables; paths in them are relative.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):
    """Spark's file system for ``path``, and the path as it wants it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def last_manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest manifest below ``root``; ``(0, {})`` if there is none."""
    files, place = _files(spark, f"{root}/{MANIFESTS}")
    if not files.exists(place):
        return 0, {}
    numbers = [int(name.removesuffix(".json")) for s in files.listStatus(place) if (name := s.getPath().getName()).endswith(".json")]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{root}/{MANIFESTS}/{max(numbers):012}.json", wholetext=True).first()["value"]
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, root: str, content: dict, number: int) -> None:
    """Make ``content`` the manifest with this number; it is an error if another writer has taken the number."""
    final = f"{root}/{MANIFESTS}/{number:012}.json"
    files, draft = _files(spark, f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    place = spark._jvm.org.apache.hadoop.fs.Path(final)
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise RuntimeError(f"version {number} of {root} has been written by another")


def save_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 2) -> int:
    """Write ``tables`` as the next version and commit it; of the older ones ``keep`` - 1 stay, for readers that have begun."""
    number, _ = last_manifest(spark, root)
    folder = f"v{number + 1:012}-{uuid.uuid4().hex[:8]}"  # one that a failed save has left is never written over
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    commit(spark, root, {"tables": {name: f"{folder}/{name}" for name in tables}}, number + 1)
    files, place = _files(spark, root)
    for s in files.listStatus(place):
        name = s.getPath().getName()
        if name.startswith("v") and "-" in name and int(name[1:].split("-")[0]) <= number + 1 - keep:
            delete(spark, f"{root}/{name}")
    return number + 1


def read_version(spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version."""
    number, content = last_manifest(spark, root)
    if not number:
        raise FileNotFoundError(f"no version has been saved below {root}")
    out = {}
    for name, path in content["tables"].items():
        reader = spark.read.schema(schemas[name]) if schemas and name in schemas else spark.read
        out[name] = reader.parquet(f"{root}/{path}")
    return out


class KeyedTable:
    """A table with one row for each key, changed by small batches: a base and a few further parts, merged as they are read.

    Of the rows of a key the one with the smallest ``best`` (an expression over the columns) counts. Each change writes its own
    rows only; after ``parts`` of them base and parts become a new base, so a read looks at the base and at most that many parts. A
    batch that is written again under its number takes the place of its first try.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], best: str, parts: int = 10):
        self.spark, self.root, self.schema, self.keys, self.best, self.parts = spark, root.rstrip("/"), schema, keys, best, parts

    def _named(self, content: dict) -> list[str]:
        return [x for x in (content.get("base"), *(p["path"] for p in content.get("parts", []))) if x]

    def read(self) -> DataFrame:
        """One row a key."""
        _, content = last_manifest(self.spark, self.root)
        paths = [f"{self.root}/{p}" for p in self._named(content)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if not content.get("parts"):
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        merged = rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.expr(self.best)).alias("_row"))
        return merged.select(*self.keys, "_row.*").select(*rows.columns)

    def upsert(self, rows: DataFrame, batch_no: int) -> None:
        """Add ``rows``, in the columns of the schema."""
        number, content = last_manifest(self.spark, self.root)
        before = [p for p in content.get("parts", []) if p["batch"] != batch_no]
        path = f"part-{batch_no:012}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{path}")
        content = {"base": content.get("base"), "parts": [*before, {"batch": batch_no, "path": path}]}
        commit(self.spark, self.root, content, number + 1)
        if len(content["parts"]) > self.parts:
            self.compact()

    def compact(self) -> None:
        """Base and parts as a new base; what it took the place of goes."""
        number, content = last_manifest(self.spark, self.root)
        base = f"base-{number + 1:012}-{uuid.uuid4().hex[:8]}"
        self.read().write.parquet(f"{self.root}/{base}")
        commit(self.spark, self.root, {"base": base, "parts": []}, number + 1)
        for path in self._named(content):
            delete(self.spark, f"{self.root}/{path}")
        for old in range(max(1, number - 3 * self.parts), number - self.parts):
            delete(self.spark, f"{self.root}/{MANIFESTS}/{old:012}.json")
