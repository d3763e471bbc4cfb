"""Every registered query of the library itself, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rootspan.plans import branches, causes, functions, graphs, inputs, kept, topology

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return causes.QUERIES | graphs.QUERIES | functions.QUERIES | topology.QUERIES | inputs.QUERIES | kept.QUERIES | branches.QUERIES


def oracle_sql() -> dict[str, str]:
    return causes.ORACLES | graphs.ORACLES | functions.ORACLES | topology.ORACLES | inputs.ORACLES | kept.ORACLES | branches.ORACLES
