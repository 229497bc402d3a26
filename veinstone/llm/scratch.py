"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is named, a temporary folder serves a single local
    machine, as in tests; on a cluster its executors would not see each other's files, so there it is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="veinstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables that cut lineage. Each is rebuilt from files, so a lost executor costs only its tasks."""

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        """tidy: the shuffle files of a table are deleted as soon as it is written; its plan is not run again."""
        self.spark, self.tidy, self.root = spark, tidy, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _made.append(self.root)

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            if self.tidy and before is None:
                self.spark.conf.unset(_CLEANUP)
            elif self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_measured(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
        """save() with named aggregates of the rows, taken while they are written instead of by a job of their own."""
        seen = Observation()
        out = self.save(df.observe(seen, *measures), name)
        return out, seen.get

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that no live result reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def made() -> int:
    """A mark for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the tables of all scratches made after a mark, but for one: for callers that have stored their result."""
    for at in _made[since:]:
        if at != keep:
            _delete(spark, at)
    _made[since:] = [at for at in _made[since:] if at == keep]
