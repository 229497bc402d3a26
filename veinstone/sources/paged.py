"""A paged JSON search service as a Spark data source, one partition for each run of pages."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE_SIZE = 250


def settings(options: dict) -> dict:
    """Base url, user and password, taken from the options or from the url itself; all are needed."""
    parts = urllib.parse.urlsplit(options.get("url", ""))
    user, password = options.get("user") or parts.username, options.get("password") or parts.password
    if not (parts.scheme and parts.hostname and user and password):
        raise ValueError("url, user and password are needed")
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    return {"base": urllib.parse.urlunsplit((parts.scheme, host, parts.path.rstrip("/"), "", "")), "user": urllib.parse.unquote(user), "password": urllib.parse.unquote(password)}


class Session:
    """A token for one partition; any answer but 200 is an error."""

    def __init__(self, options: dict):
        self.at, self.token = settings(options), ""
        self.header, self.retries = options.get("sessionheader", "X-Session"), int(options.get("retries", 1))

    def send(self, method: str, path: str, form: dict | None = None) -> dict | list:
        """The answer's JSON."""
        return json.loads(self.fetch(method, path, form) or b"null")

    def fetch(self, method: str, path: str, form: dict | None = None) -> bytes:
        """The answer's body as it is, such as an XML file; a failed request is sent again `retries` times."""
        for left in reversed(range(self.retries + 1)):
            try:
                return self._once(method, path, form)
            except OSError:
                if not left:
                    raise
        raise AssertionError

    def _once(self, method: str, path: str, form: dict | None) -> bytes:
        if method not in ("GET", "POST"):
            raise ValueError(f"method {method} is not supported")
        body = urllib.parse.urlencode(form or {}, doseq=True).encode() if method == "POST" else None
        request = urllib.request.Request(self.at["base"] + path, body, {self.header: self.token} if self.token else {}, method=method)
        with urllib.request.urlopen(request, timeout=120) as answer:
            if answer.status != 200:
                raise OSError(f"{method} {path}: {answer.status}")
            return answer.read()

    def login(self) -> "Session":
        self.token = self.send("POST", f"/users/{urllib.parse.quote(self.at['user'])}/login", {"password": self.at["password"]})["session"]
        return self

    def ping(self) -> bool:
        try:
            return bool(self.send("GET", "/"))
        except OSError:
            return False


def description_path(uri: str | None) -> str:
    """Where a resource's EAD file is."""
    if not uri:
        raise ValueError("no uri")
    return uri.replace("/resources/", "/resource_descriptions/") + ".xml?include_daos=true&numbered_cs=true"


class Pages(InputPartition):
    def __init__(self, first: int, last: int, open_end: bool):
        self.first, self.last, self.open_end = first, last, open_end


class PagedSource(DataSource):
    """Options: url, user, password, path, query, pagesPerTask, sessionHeader, retries. Fields that a record lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "uri string, ead_id string, identifier string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = schema.fieldNames(), options

    def _page(self, session: Session, page: int) -> dict:
        return session.send("POST", self.options["path"], {"aq": self.options.get("query", ""), "page": page, "page_size": PAGE_SIZE})

    def partitions(self) -> list[InputPartition]:
        last, step = max(1, self._page(Session(self.options).login(), 1)["last_page"]), int(self.options.get("pagespertask", 4))
        return [Pages(k, min(last, k + step - 1), k + step > last) for k in range(1, last + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        session = Session(self.options).login()
        page, last = partition.first, partition.last
        while page <= last:
            answer = self._page(session, page)
            for row in answer.get("results", []):
                yield tuple(row.get(f) for f in self.fields)
            if partition.open_end:  # pages that came up since the listing was planned
                last = max(last, answer.get("last_page", last))
            page += 1


def repositories(options: dict) -> list[dict]:
    """The service's repositories as records of code, uri and the ARK shoulder; codes are in small letters."""
    rows = Session(options).login().send("GET", "/repositories")
    return [{"code": (r.get("repo_code") or "").lower(), "uri": r.get("uri"), "ark_shoulder": r.get("ark_shoulder"), "key": r.get("key")} for r in rows]


def fetch_descriptions(resources: DataFrame, options: dict) -> DataFrame:
    """(uri, content, error) of resources by uri: one session for each task; a failed file does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                try:
                    session = session or Session(options).login()
                    rows.append((uri, session.fetch("GET", description_path(uri)), None))
                except (OSError, ValueError) as e:
                    rows.append((uri, None, str(e)))
            kinds = (pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uri", "content", "error"])

    return resources.select("uri").mapInArrow(run, "uri string, content binary, error string")


def opening_hours(url: str, library: str, location: str, first: str, last: str) -> str:
    """The hours feed's body for a span of days; an empty object where the service does not answer or answers no JSON."""
    try:
        query = urllib.parse.urlencode({"from": first, "to": last})
        with urllib.request.urlopen(f"{url.rstrip('/')}/{library}/{location}?{query}", timeout=30) as answer:
            body = answer.read().decode()
        json.loads(body)
        return body
    except (OSError, ValueError):
        return "{}"
