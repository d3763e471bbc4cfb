"""Exact posteriors for many small networks that share one template: factors as long tables.

A factor is a table of network_id, an integer column per variable and ``p``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.scratch import materialize

MAX_WIDTH = 20


def variables(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c not in ("network_id", "p")]


def condition(factor: DataFrame, evidence: DataFrame) -> DataFrame:
    """``factor`` with p = 0 where an observed variable has another value; evidence: network_id, variable, value."""
    out = factor
    for v in variables(factor):
        seen = evidence.where(F.col("variable") == v).select("network_id", F.col("value").alias("_seen"))
        out = out.join(seen, "network_id", "left")
        out = out.withColumn("p", F.when(F.col("_seen").isNotNull() & (F.col("_seen") != F.col(v)), 0.0).otherwise(F.col("p"))).drop("_seen")
    return out.select(*factor.columns)


def factor_product(f: DataFrame, g: DataFrame) -> DataFrame:
    """The product over the union of variables, network by network."""
    shared = [v for v in variables(f) if v in variables(g)]
    both = f.join(g.withColumnRenamed("p", "_q"), ["network_id", *shared])
    names = sorted({*variables(f), *variables(g)})
    return both.select("network_id", *names, (F.col("p") * F.col("_q")).alias("p"))


def marginalize(f: DataFrame, variable: str) -> DataFrame:
    """``f`` with a variable summed out; unchanged if it has none of that name."""
    rest = [v for v in variables(f) if v != variable]
    return f if variable not in variables(f) else f.groupBy("network_id", *rest).agg(F.sum("p").alias("p"))


def min_fill_order(scopes: list[set[str]], last: set[str] = frozenset()) -> list[str]:
    """All variables of ``scopes`` but ``last``, as they are best eliminated: next the one that links the fewest of its neighbors anew, then has the fewest, then by name."""
    near: dict[str, set[str]] = {}
    for scope in scopes:
        for v in scope:
            near.setdefault(v, set()).update(scope - {v})
    out = []
    while rest := [v for v in near if v not in last]:
        fill = lambda v: sum(b not in near[a] for a, b in combinations(sorted(near[v]), 2))
        best = min(rest, key=lambda v: (fill(v), len(near[v]), v))
        for a in near[best]:
            near[a] = (near[a] | near[best]) - {a, best}
        del near[best]
        out.append(best)
    return out


def posterior(factors: list[DataFrame], query: list[str], evidence: DataFrame, order: list[str] | None = None) -> DataFrame:
    """P(query | evidence) of every network; ``order`` lists the other variables as they are eliminated, by default by least fill.

    A network whose evidence is impossible keeps p = 0. Refuses products over more than MAX_WIDTH variables.
    """
    order = min_fill_order([set(variables(f)) for f in factors], set(query)) if order is None else order
    work = [condition(f, evidence) for f in factors]
    for v in order:
        touched, rest = [f for f in work if v in variables(f)], [f for f in work if v not in variables(f)]
        if touched:
            if len({x for f in touched for x in variables(f)}) > MAX_WIDTH:
                raise ValueError(f"eliminating {v} joins more than {MAX_WIDTH} variables")
            work = [*rest, marginalize(reduce(factor_product, touched), v)]
    joint = reduce(factor_product, work).groupBy("network_id", *query).agg(F.sum("p").alias("p"))
    total = joint.groupBy("network_id").agg(F.sum("p").alias("_t"))
    return joint.join(total, "network_id").select("network_id", *query, F.when(F.col("_t") == 0, F.col("p")).otherwise(F.col("p") / F.col("_t")).alias("p"))


def all_marginals(factors: list[DataFrame], evidence: DataFrame) -> DataFrame:
    """``network_id, variable, value, p``: the posterior of every variable of every network, by one pass up and one down a junction tree.

    The tree is that of elimination by least fill: a bucket for each variable holds the factors that it is the first of, and what a bucket
    sums up goes to the first bucket among its other variables. Going down, a bucket gives each of those below it the product of all else it has, so
    nothing is divided. Each message is one join and one aggregation by network. A network whose evidence is
    impossible has p = 0 throughout. Refuses products over more than MAX_WIDTH variables.
    """
    scopes = [set(variables(f)) for f in factors]
    order = min_fill_order(scopes)
    place = {v: i for i, v in enumerate(order)}
    own: dict[str, list[DataFrame]] = {v: [] for v in order}
    loose = []  # factors and messages without a variable
    for f in (condition(f, evidence) for f in factors):
        first = min(variables(f), key=place.__getitem__, default=None)
        (loose if first is None else own[first]).append(f)
    parent: dict[str, str] = {}
    up: dict[str, DataFrame] = {}
    below: dict[str, list[str]] = {v: [] for v in order}
    whole: dict[str, DataFrame] = {}
    for v in order:
        parts = own[v] + [up[c] for c in below[v]]
        if len({x for f in parts for x in variables(f)}) > MAX_WIDTH:
            raise ValueError(f"eliminating {v} joins more than {MAX_WIDTH} variables")
        whole[v] = materialize(reduce(factor_product, parts), "bucket")
        up[v] = materialize(marginalize(whole[v], v), "message")
        rest = variables(up[v])
        if rest:
            parent[v] = min(rest, key=place.__getitem__)
            below[parent[v]].append(v)
        else:
            loose.append(up[v])
    down: dict[str, DataFrame] = {}
    out = []
    for v in reversed(order):
        belief = whole[v] if v not in down else factor_product(whole[v], down[v])
        sums = belief.groupBy("network_id", F.col(v).cast("int").alias("value")).agg(F.sum("p").alias("p"))
        out.append(sums.select("network_id", F.lit(v).alias("variable"), "value", "p"))
        for c in below[v]:
            parts = own[v] + [up[x] for x in below[v] if x != c] + ([down[v]] if v in down else [])
            if not parts:  # nothing else is known of what they share
                continue
            message = reduce(factor_product, parts)
            for x in variables(message):
                message = message if x in variables(up[c]) else marginalize(message, x)
            down[c] = materialize(message, "message")
    rows = materialize(reduce(DataFrame.unionByName, out), "marginals")
    total = rows.groupBy("network_id", "variable").agg(F.sum("p").alias("_t"))
    possible = reduce(factor_product, loose).select("network_id", (F.col("p") > 0).alias("_ok"))
    rows = rows.join(total, ["network_id", "variable"]).join(possible, "network_id")
    return rows.select("network_id", "variable", "value", F.when(F.col("_ok") & (F.col("_t") > 0), F.col("p") / F.col("_t")).otherwise(0.0).alias("p"))
