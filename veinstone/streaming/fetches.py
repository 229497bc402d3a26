"""Fetches with memory: each record's last version, tries and next try are the stream's state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.schema import derive
from ..plans.index import TermIndex
from ..sources.ead import to_documents
from ..sources.paged import Session, description_path
from .harvest import replace_blocks

#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FETCHED = "uri string, version string, content binary, error string, tries int"


class Fetcher(StatefulProcessor):
    """By uri: a version that was not fetched yet is fetched once. A failed fetch is tried again after `pause_ms`, doubled
    with each try, up to `retries` times; then its error comes out, and only a newer version starts again. While a try is
    due, a newer version takes the older one's place."""

    def __init__(self, options: dict, retries: int = 3, pause_ms: int = 60_000):
        self.options, self.retries, self.pause = options, retries, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fetch", "done string, wanted string, tries int")
        self.session = None

    def _fetch(self, uri: str) -> bytes:
        self.session = self.session or Session(self.options).login()
        return self.session.fetch("GET", description_path(uri))

    def _try(self, uri: str, done: str, wanted: str, tries: int, now: int) -> Iterator[Row]:
        try:
            content = self._fetch(uri)
        except (OSError, ValueError) as e:
            self.session = None
            if tries < self.retries:
                self.state.update((done, wanted, tries + 1))
                self.handle.registerTimer(now + self.pause * 2**tries)
            else:
                self.state.update((wanted, "", 0))
                yield Row(uri=uri, version=wanted, content=None, error=str(e), tries=tries + 1)
        else:
            self.state.update((wanted, "", 0))
            yield Row(uri=uri, version=wanted, content=content, error=None, tries=tries + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((r.version or "" for r in rows), default="")
        done, wanted, tries = self.state.get() if self.state.exists() else ("", "", 0)
        if newest <= max(done, wanted):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield from self._try(key[0], done, newest, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, wanted, tries = self.state.get() if self.state.exists() else ("", "", 0)
        if wanted:
            yield from self._try(key[0], done, wanted, tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def fetched(changes: DataFrame, options: dict, retries: int = 3, pause_ms: int = 60_000) -> DataFrame:
    """(uri, version, content, error, tries) of a stream of (uri, version). The session needs the settings of STORE."""
    rows = changes.select("uri", F.col("version").cast("string").alias("version")).where("uri is not null")
    return rows.groupBy("uri").transformWithState(statefulProcessor=Fetcher(options, retries, pause_ms), outputStructType=FETCHED, outputMode="Update", timeMode="ProcessingTime")


def follow(spark: SparkSession, changes: DataFrame, options: dict, target: str, index_root: str, fields: list[str], checkpoint: str, errors: str | None = None, **trying) -> StreamingQuery:
    """From changes to the index: what was fetched replaces its blocks in the table and in the index; errors are appended as a table.

    A batch that is run again replaces the same blocks, so a restart repeats nothing. The query goes on until it is stopped."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        good = rows.where("content is not null").select(F.col("uri").alias("path"), "content", F.element_at(F.split("uri", "/"), 3).alias("repository"))
        docs = derive(to_documents(good, skip_bad=True))
        if not good.isEmpty():
            replace_blocks(docs, target)
            roots = docs.select("_root_").distinct()
            now = spark.read.parquet(target).join(roots, "_root_", "left_semi")
            TermIndex(spark, index_root).update(now, [f for f in fields if f in now.columns])
        if errors:
            rows.where("content is null").select("uri", "version", "error", "tries").write.mode("append").parquet(errors)
        rows.unpersist()

    return fetched(changes, options, **trying).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).start()
