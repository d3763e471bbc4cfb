"""Knowledge tables: how likely a change makes a symptom, by class of node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.schema import DEFAULT_HALF_LIFE, DEFAULT_P_FAILURE


def merge_cpt_layers(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cpts, priors)`` from layered rows; later layers win.

    An entry is replaced by (class, mutation, signal). A prior is replaced whole, only by rows that
    give ``p_failure``; a half-life that such a row leaves out is the default, not the earlier one.
    A class without any prior gets the defaults. Within a layer the later row wins.
    """
    at = F.struct("layer_no", "class_pos", "cpt_pos")
    cpts = layers.where("mutation is not null and signal is not null").groupBy("class", "mutation", "signal").agg(F.max_by(F.struct("p_present", "p_absent"), at).alias("p"))
    given = F.when(F.col("p_failure").isNotNull(), at)
    priors = layers.groupBy("class").agg(F.max_by(F.struct("p_failure", "half_life_min"), given).alias("p"))
    priors = priors.select("class", F.coalesce("p.p_failure", F.lit(DEFAULT_P_FAILURE)).alias("p_failure"), F.coalesce("p.half_life_min", F.lit(DEFAULT_HALF_LIFE)).alias("half_life_min"))
    return cpts.select("class", "mutation", "signal", "p.p_present", "p.p_absent"), priors


def likelihood_ratio(p_present: Column, p_absent: Column) -> Column:
    """p_present / p_absent; infinite where p_absent is 0 or less."""
    return F.when(p_absent <= 0, F.lit(float("inf"))).otherwise(F.try_divide(p_present, p_absent))
