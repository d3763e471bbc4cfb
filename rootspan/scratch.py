"""Tables that cut lineage: written once to the cluster's shared folder and read back.

A written table survives the loss of any executor, unlike a local checkpoint, and gives
the optimizer real sizes for what follows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the one of ``sc.setCheckpointDir``; a temporary one only on a local master.

    On a cluster without either this raises: what executors write to their own disks, nobody else reads.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rootspan-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """The written table and its number of rows, counted while it is written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables written inside are deleted at the end, whether it fails or not, but for those whose path is put into the list."""
    begin, keep = len(_WRITTEN), []
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        for path in set(_WRITTEN[begin:]) - set(keep):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN[begin:] = keep


def materialize_alone(spark: SparkSession, make, name: str = "table") -> DataFrame:
    """The table that ``make()`` describes, written, and whatever scratch tables it took on the way deleted."""
    with passing(spark) as keep:
        df = make()
        path = scratch_path(spark, name)
        df.write.parquet(path)
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)
