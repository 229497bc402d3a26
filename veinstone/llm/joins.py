"""Joins in which a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that may count as heavy.
HEAVY = 512


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], total: int | None, most: int | None, count: str = "n_rows") -> DataFrame:
    """rows with the facts of their key. facts has one row for each key and in `count` how many rows bear it; keys that bear
    more than 1 / HEAVY of all rows, of which there are fewer than HEAVY, come by broadcast. total, most: the sum and the
    greatest of these counts, as measured; where no key is heavy, one join does."""
    bound = (total or 0) // HEAVY
    if (most or 0) <= bound:
        return rows.join(facts, keys)
    heavy, light = facts.where(F.col(count) > bound), facts.where(F.col(count) <= bound)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(light, keys))
