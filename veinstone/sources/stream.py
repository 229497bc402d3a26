"""The paged search service as a stream: each batch is a window of modification times, and a window can be read again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.harvest import source_plan
from .paged import PAGE_SIZE, Session

#: The service compares days, so a window is asked for from one day earlier and cut to its times afterwards.
SLACK = timedelta(days=1)


class Window(InputPartition):
    def __init__(self, since: str, until: str, first: int, last: int, open_end: bool):
        self.since, self.until, self.first, self.last, self.open_end = since, until, first, last, open_end


class ModifiedSource(DataSource):
    """Options: those of paged_search, and start, the time from which on records count (ISO, default: all). Records carry
    their uri and system_mtime (ISO, as text, which orders like the times)."""

    @classmethod
    def name(cls) -> str:
        return "modified_records"

    def schema(self) -> str:
        return "uri string, ead_id string, system_mtime string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ModifiedReader(schema, dict(self.options))


class ModifiedReader(DataSourceStreamReader):
    """An offset is a modification time. The records of (start, end] are the same at each reading, but for those that were
    modified again since: they left the window for a later one."""

    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = schema.fieldNames(), options

    def _ask(self, session: Session, since: str, page: int, size: int = PAGE_SIZE, newest: bool = False) -> dict:
        day = (date.fromisoformat(since[:10]) - SLACK).isoformat() if since else None
        form = {"aq": source_plan(updated_after=day), "page": page, "page_size": size} | ({"sort": "system_mtime desc"} if newest else {})
        return session.send("POST", self.options["path"], form)

    def initialOffset(self) -> dict:
        return {"until": self.options.get("start", "")}

    def latestOffset(self) -> dict:
        newest = self._ask(Session(self.options).login(), "", 1, 1, newest=True).get("results") or [{}]
        return {"until": max(newest[0].get("system_mtime") or "", self.options.get("start", ""))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["until"] <= start["until"]:
            return []
        last, step = max(1, self._ask(Session(self.options).login(), start["until"], 1)["last_page"]), int(self.options.get("pagespertask", 4))
        return [Window(start["until"], end["until"], k, min(last, k + step - 1), k + step > last) for k in range(1, last + 1, step)]

    def read(self, partition: Window) -> Iterator[tuple]:
        session = Session(self.options).login()
        page, last = partition.first, partition.last
        while page <= last:
            answer = self._ask(session, partition.since, page)
            for row in answer.get("results", []):
                if partition.since < (row.get("system_mtime") or "") <= partition.until:
                    yield tuple(row.get(f) for f in self.fields)
            if partition.open_end:
                last = max(last, answer.get("last_page", last))
            page += 1

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass
