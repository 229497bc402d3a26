"""Hierarchies as nested intervals: a row of a block stands at its place in pre-order, and its subtree ends at another place.

Both numbers are made once, when a block is written; ancestors, children, descendants and contents are then ranges of
places, without a round for each level. A block is one finding aid, which one task has parsed; its rows stream through a
stack as high as the block is deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

LAST = "_last_"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come from each block's end: the next row that is not deeper ends a subtree, the block's last place all that is open."""
    block, stack, end = None, [], 0
    for batch in batches:
        out = []
        for root, at, level in zip(*(batch[c].to_pylist() for c in ("_root", "_at", "_level"))):
            if root != block:
                block, stack, end = root, [], at
            while stack and stack[-1][0] > level:
                stack.pop()
            out.append(stack[-1][1] - 1 if stack else end)
            stack.append((level, at))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, LAST])


def with_intervals(docs: DataFrame, root: str = "_root_", place: str = "sort_isi", level: str = "component_level_isim") -> DataFrame:
    """The rows with the place of their last descendant, their own place where they have none. Rows of one place in a
    block count as one, of the higher level; rows without a block, a place or a level have none. One shuffle by block."""
    first = lambda c: F.get(F.col(c), 0) if isinstance(docs.schema[c].dataType, T.ArrayType) else F.col(c)
    keyed = docs.withColumns({"_root": F.col(root).cast("string"), "_at": first(place).cast("long"), "_level": first(level).cast("long")})
    known = F.col("_root").isNotNull() & F.col("_at").isNotNull() & F.col("_level").isNotNull()
    numbers = keyed.where(known).groupBy("_root", "_at").agg(F.min("_level").alias("_level")).repartition("_root").sortWithinPartitions("_root", F.desc("_at")).mapInArrow(_ends, f"_root string, _at long, _level long, {LAST} long")
    return keyed.join(numbers.select("_root", "_at", LAST), ["_root", "_at"], "left").select(*docs.columns, LAST)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, stack = None, []
    for batch in batches:
        out = []
        for root, key, level in zip(*(batch[c].to_pylist() for c in ("_root", "_key", "_level"))):
            if root != block:
                block, stack = root, []
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, key))
            out.append([k for _, k in stack])
        yield pa.RecordBatch.from_arrays([batch["_key"], pa.array(out, pa.list_(pa.string()))], names=["id", "path"])


def paths(docs: DataFrame, root: str = "_root_", place: str = "sort_isi", level: str = "component_level_isim", key: str = "id") -> DataFrame:
    """(id, path) of all rows: the keys from the block's top down to the row, from one pass in pre-order."""
    rows = docs.select(F.col(root).cast("string").alias("_root"), F.col(place).cast("long").alias("_at"), F.col(level).cast("long").alias("_level"), F.col(key).cast("string").alias("_key"))
    return rows.repartition("_root").sortWithinPartitions("_root", "_at").select("_root", "_key", "_level").mapInArrow(_paths, "id string, path array<string>")


def ancestors_at(root, at, docs: DataFrame, block: str = "_root_", place: str = "sort_isi") -> DataFrame:
    """The rows whose intervals hold a place, from the top down: a filter on one block."""
    return docs.where((F.col(block) == root) & (F.col(place) < at) & (F.col(LAST) >= at)).orderBy(place)


def descendants(docs: DataFrame, root, at, last, block: str = "_root_", place: str = "sort_isi") -> DataFrame:
    """All rows of an interval but its top, in order."""
    return docs.where((F.col(block) == root) & (F.col(place) > at) & (F.col(place) <= last)).orderBy(place)


def contents(docs: DataFrame, tops: DataFrame, deep: int, block: str = "_root_", place: str = "sort_isi", level: str = "component_level_isim") -> DataFrame:
    """Rows down to so many levels below each top (block, at, last, top_level), with the top's place as `top` and the depth below it.

    tops: a few rows of each block, such as its series; a block is read once for each."""
    t = tops.select(F.col("block").alias("_b"), F.col("at").alias("top"), F.col("last").alias("_end"), F.col("top_level").alias("_lv"))
    inside = (docs[block] == F.col("_b")) & (docs[place] > F.col("top")) & (docs[place] <= F.col("_end")) & (docs[level] - F.col("_lv") <= deep)
    return docs.join(t, inside).withColumn("below", F.col(level) - F.col("_lv")).drop("_b", "_end", "_lv")


def is_below(at: Column, last: Column, place: Column) -> Column:
    return (place > at) & (place <= last)
