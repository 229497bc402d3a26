"""Joins, facets, groups, orders and set operations over documents.

Everything is declarative, so Catalyst prunes columns, pushes filters into the scan and picks the joins; dimension
sides are broadcast by Spark only below its size threshold.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Suffix order of the collection-last sort: 1, 2, 3, ..., then 0 and missing.
FACET_LIMIT, GROUP_TOP = 10, 3


# --- filters


def has(field: str, value) -> Column:
    """A multi-valued field holds the value."""
    return F.array_contains(field, value)


def lacks(field: str, value) -> Column:
    """The negated filter keeps rows without the field."""
    return ~F.coalesce(F.array_contains(field, value), F.lit(False))


def in_range(field: str, low, high) -> Column:
    """Some value of a multi-valued field lies in the closed range."""
    return F.exists(field, lambda y: (y >= low) & (y <= high))


def all_of(*clauses: Column | None) -> Column:
    """AND of the clauses that are there."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def is_collection(level: Column, depth: Column) -> Column:
    return F.coalesce((F.lower(level) == "collection") & (depth == 0), F.lit(False))


# --- joins


def with_root(docs: DataFrame, root: str = "_root_", key: str = "id") -> DataFrame:
    """Each row with an array of at most one root row, found by a left self-join on the block's key."""
    roots = docs.where(F.col(key) == F.col(root)).dropDuplicates([key])
    roots = roots.select(F.col(key).alias("_key"), F.array(F.struct(*docs.columns)).alias("collection"))
    return docs.join(roots, docs[root] == roots["_key"], "left").drop("_key")


def children_of(docs: DataFrame, parent: str, offset: int = 0, rows: int = 50) -> DataFrame:
    return docs.where(F.col("_nest_parent_") == parent).orderBy("sort_isi", "id").offset(offset).limit(rows)


def ancestors(docs: DataFrame) -> DataFrame:
    """(id, path): ancestors from the root down to the row, at any depth.

    Each round joins every path to its topmost row's path, so rounds grow with the logarithm of the depth; a table is
    written between them. A parent that is missing ends the path, and so does one that stands in the path already.
    """
    step = docs.select("id", F.array("id").alias("path"), F.col("_nest_parent_").alias("up"))
    while True:
        tops = step.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        more = step.join(tops, step.up == tops["_id"], "left")
        path = F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat(F.array_except("_path", "path"), "path"))
        up = F.when(~F.array_contains("path", F.col("_up")) & ~F.array_contains("_path", F.col("_up")), F.col("_up"))
        step = cut_lineage(more.select("id", path.alias("path"), up.alias("up")))
        if step.where("up is not null").isEmpty():
            return step.select("id", "path")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder that the session names; a local session without one uses its own."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veinstone-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def breadcrumbs(path: Column, grouped: Column, compact: Column) -> Column:
    """Two levels are skipped under a group header; two are shown in the compact view."""
    start = F.when(grouped, 3).otherwise(1)
    return F.when(compact, F.slice(path, start, F.lit(2))).otherwise(F.slice(path, start, F.greatest(F.size(path), F.lit(1))))


def stale(indexed: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Indexed rows whose key is not published: one row for each key, the last id. A null key is no candidate."""
    last = indexed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("id").alias("id"))
    return last.join(published.select(key), key, "left_anti")


# --- facets and groups


def facet_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, count) of all fields in one pass; each document counts once for each value."""
    def pairs_of(field: str) -> Column:
        values = F.array_distinct(F.coalesce(F.col(field).cast("array<string>"), F.array().cast("array<string>")))
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    pairs = F.flatten(F.array(*map(pairs_of, fields)))
    return docs.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def top_facets(counts: DataFrame, limit: int = FACET_LIMIT) -> DataFrame:
    """The most frequent values of each field, and one more to tell that there are others."""
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= limit + 1)


def histogram(docs: DataFrame, field: str, width: int) -> DataFrame:
    """(bucket, count) of a number, bucketed by width."""
    return docs.groupBy((F.floor(F.col(field) / width) * width).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def group_top(docs: DataFrame, key: str, *order: Column, top: int = GROUP_TOP) -> DataFrame:
    """The first rows of each group and the group's total.

    The ranking keeps `top` rows of a group in each task before any shuffle; totals are partial sums. No task gets
    more of a group than that.
    """
    best = docs.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= top)
    totals = docs.groupBy(key).agg(F.count(F.lit(1)).alias("group_total"))
    return best.join(totals, key)


def facet_page(docs: DataFrame, fields: list[str], limit: int = FACET_LIMIT) -> DataFrame:
    return top_facets(facet_counts(docs, fields), limit)


# --- orders, pages, sets


def collection_last(position: str = "sort_isi") -> Column:
    """Sort expression, descending: components by position, the collection (0 or missing) last."""
    return F.when(F.coalesce(F.col(position), F.lit(0)) == 0, 0.0).otherwise(1.0 / F.col(position)).desc()


def relevance() -> list[Column]:
    return [F.desc("score"), F.asc("sort_isi"), F.asc_nulls_last("title_sort")]


def text_order(field: str, descending: bool = False) -> Column:
    """Missing texts come last in both directions."""
    return F.desc_nulls_last(field) if descending else F.asc_nulls_last(field)


def page(docs: DataFrame, *order: Column, start: int = 0, rows: int = 10) -> DataFrame:
    """A page of a total order."""
    return docs.orderBy(*order).offset(start).limit(rows)


def custom_order(docs: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Rows whose value is listed, in the list's order."""
    return docs.where(F.col(field).isin(*values)).orderBy(F.array_position(F.array(*map(F.lit, values)), F.col(field)))


def chunks(docs: DataFrame, order: Column, size: int, value: str) -> DataFrame:
    """Rows of a short listing dealt into chunks of `size`; for listings such as repositories, not for documents."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    return docs.withColumn("_place", place).groupBy(F.floor(F.col("_place") / size).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_place", value))).alias("_v")).select("chunk", F.transform("_v", lambda v: v[value]).alias("values"))


def pick_one(docs: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """One row, pseudo-random by the seed."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(1)


def union_keys(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def upsert(old: DataFrame, new: DataFrame, root: str = "_root_") -> DataFrame:
    """Whole blocks are replaced: the old rows of each block in `new` go. Of new rows with one id, the last stays."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), F.coalesce("_version_", F.lit(0))).alias("d")).select("d.*")
    return old.join(new.select(root).distinct(), root, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def delete_blocks(docs: DataFrame, ids: DataFrame, root: str = "_root_") -> DataFrame:
    """Rows whose block is not deleted; a collection takes its components with it."""
    return docs.join(ids.select(F.col("id").alias(root)).distinct(), root, "left_anti")
