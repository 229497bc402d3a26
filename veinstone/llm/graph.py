"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

#: Nodes that may count as heavy in one round.
HEAVY = 512


def _with_facts(rows: DataFrame, facts: DataFrame, least_degree: int) -> DataFrame:
    """rows (u, v) with m from facts (u, m, d), which has one row for each u; d is how many rows u has.

    Nodes with more than least_degree rows come by broadcast, and their rows are dealt by v afterwards, so that no node's
    rows gather in one task. The caller's least_degree bounds their number by HEAVY.
    """
    heavy = facts.where(F.col("d") > least_degree).select("u", F.col("m").alias("known"))
    dealt = rows.join(F.broadcast(heavy), "u", "left").withColumn("at", F.when(F.col("known").isNull(), F.col("u")).otherwise(F.col("v")))
    found = dealt.join(facts.select(F.col("u").alias("at"), "m"), "at", "left")
    return found.select("u", "v", F.coalesce("known", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node that is not its component's smallest; edges: two long columns.

    Large-star and small-star rounds alternate until the table no longer changes; the rounds grow with the logarithm
    of a component's diameter. Each round is aggregations and joins by node and one write to the shared folder, which
    also measures the table, so that no job is needed to see the end. A node's minimum is a partial aggregation; nodes
    of more than 1 / HEAVY of all ends, of which there are at most HEAVY, are joined by broadcast.
    Null ends and loops are ignored; equal edges count once; an empty table has no components.
    """
    state = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u != v")
    now, found = scratch.save_measured(first, f"{name}0", *state)
    scratch.sweep()  # what made the edges is much larger than they are
    k, seen = 0, None
    while found != seen and found["n"]:
        k, seen = k + 1, found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least_degree = 2 * found["n"] // HEAVY
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = _with_facts(both.where("v > u"), least, least_degree).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _with_facts(large, low, least_degree).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, found = scratch.save_measured(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{k}", *state)
        scratch.drop(f"{name}{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
