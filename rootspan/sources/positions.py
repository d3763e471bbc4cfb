"""Where a row stands in its input, so that "the last row wins" means the last of the input and not of some task.

Spark deals the splits of files to tasks by size, so the order of tasks says nothing. The position is that of the file:
its path, the byte at which the split begins, and the order inside the split, in which one task reads it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = "file string, block long, row long"


def from_files(df: DataFrame) -> bool:
    """Whether rows of ``df`` still know the file they come from: a table as read, or projections and filters of it."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    return True


def input_position(df: DataFrame) -> Column:
    """``(file, block, row)`` of each row, in the order of file paths and then of the file's lines or records.

    Take it before anything that moves rows between tasks. Rows without a file, as of a local table, have an empty path and their place in
    the table's partitions.
    """
    row = F.monotonically_increasing_id().alias("row")  # ascends inside a split, whatever else the task reads
    if from_files(df):
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row)
    return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), row)


def positioned(df: DataFrame, name: str, order_col: str | None = None) -> DataFrame:
    """``df`` with its order in the column ``name``: that of ``order_col`` if given, else the place in the input."""
    return df.withColumn(name, F.col(order_col) if order_col else input_position(df))
