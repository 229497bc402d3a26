"""Incremental harvests as streams: new files become documents and replace their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.schema import derive
from ..sources.ead import to_documents

#: Folders of a harvest's table.
BUCKETS = 256
#: Files of one folder, at most.
PARTS = 8


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New XML files below a folder, as (path, content, repository)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("repository"))


def replace_blocks(docs: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """Replaces whole blocks in a table of `buckets` folders; running a batch again gives the same rows.

    A block's folder comes from its root's hash, so folders do not grow with the collections, and only the folders that
    the batch touches are read and written. Merged folders are stored beside the target before the old ones go: where a
    run ended in between, the next call first finishes it. `buckets` must stay the same for a target. Rows with a null
    root count as one block; of equal rows in one batch all stay; an empty batch changes nothing.
    """
    spark = docs.sparkSession
    new, merged = (f"{target.rstrip('/')}.{name}" for name in ("new", "merged"))
    if _exists(spark, f"{merged}/_SUCCESS"):
        _put(spark, merged, target)
    docs.withColumn("bucket", F.pmod(F.xxhash64("_root_"), F.lit(buckets)).cast("int")).write.mode("overwrite").parquet(new)
    fresh = spark.read.parquet(new)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if touched:
        out = fresh
        if _exists(spark, target):
            held = spark.read.parquet(target).where(F.col("bucket").isin(*touched))
            roots = fresh.select(F.col("_root_").alias("_new")).distinct()
            kept = held.join(roots, held["_root_"].eqNullSafe(roots["_new"]), "left_anti")
            out = kept.unionByName(fresh, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(merged)
        _put(spark, merged, target)
    _delete(spark, new)


def _put(spark: SparkSession, merged: str, target: str) -> None:
    rows = spark.read.parquet(merged)
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))  # one large block is not one task's
    rows.repartition("bucket", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
    spark.catalog.refreshByPath(target)
    _delete(spark, merged)


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _path(spark, at)
    return fs.exists(path)


def _delete(spark: SparkSession, at: str) -> None:
    fs, path = _path(spark, at)
    fs.delete(path, True)


def harvest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes what is new since the last run, then stops; a scheduler starts the next run. Bad files hold up no others."""

    def batch(files: DataFrame, _: int) -> None:
        replace_blocks(derive(to_documents(files, skip_bad=True)), target)

    return stream_files(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, key: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by key and tumbling window with a watermark, for monitoring a harvest."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))
