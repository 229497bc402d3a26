"""The streaming source and fetches with retries, against a local server."""

import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from veinstone.plans.index import TermIndex
from veinstone.sources import stream
from veinstone.streaming import fetches


class Service(http.server.BaseHTTPRequestHandler):
    records: dict = {}
    failing: dict = {}
    asked: list = []

    def answer(self, body, status=200):
        body = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        form = {k: v[0] for k, v in urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
        if "login" in self.path:
            return self.answer({"session": "t"})
        clauses = json.loads(form["aq"])["query"]["subqueries"]
        since = next((c["value"] for c in clauses if c.get("comparator") == "greater_than"), "")
        rows = sorted(({"uri": u, "ead_id": u, "system_mtime": t} for u, t in self.records.items() if t[:10] > since), key=lambda r: r["uri"])
        if form.get("sort"):
            rows.sort(key=lambda r: r["system_mtime"], reverse=True)
        size, page = int(form["page_size"]), int(form["page"])
        size = size if size == 1 else 2
        self.answer({"last_page": max(1, -(-len(rows) // size)), "results": rows[(page - 1) * size : page * size]})

    def do_GET(self):
        uri = self.path.split(".xml")[0].replace("resource_descriptions", "resources")
        self.asked.append(uri)
        if self.failing.get(uri, 0) > 0:
            self.failing[uri] -= 1
            return self.answer(b"", 500)
        n = uri.rsplit("/")[-1]
        self.answer(f"<ead><eadheader><eadid>e{n}</eadid></eadheader><archdesc level='collection'><did><unittitle>Box {self.records[uri][:10].replace('-', 'd')} number{n}</unittitle><unitid>U{n}</unitid></did></archdesc></ead>".encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def service():
    Service.records, Service.failing, Service.asked = {}, {}, []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"url": f"http://u:p@127.0.0.1:{server.server_port}/", "path": "/search", "pagesPerTask": "2", "retries": "0"}
    server.shutdown()


def uri(k):
    return f"/repositories/1/resources/{k}"


def test_stream_stops_and_resumes(spark, service, tmp_path):
    spark.dataSource.register(stream.ModifiedSource)

    def run():
        rows = spark.readStream.format("modified_records").options(**service).load()
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r.uri, r.system_mtime) for r in spark.read.schema("uri string, ead_id string, system_mtime string").parquet(f"{tmp_path}/out").collect())

    Service.records |= {uri(k): f"2024-01-0{k}T10:00:00Z" for k in range(1, 8)}
    first = [(u, t) for u, t in sorted(Service.records.items())]
    assert run() == first and run() == first
    Service.records |= {uri(3): "2024-01-07T11:00:00Z", uri(9): "2024-01-07T12:00:00Z"}
    assert run() == sorted([*first, (uri(3), "2024-01-07T11:00:00Z"), (uri(9), "2024-01-07T12:00:00Z")])
    reader = stream.ModifiedReader(stream.ModifiedSource({}).schema() and __import__("pyspark").sql.types.StructType().add("uri", "string"), {k.lower(): v for k, v in service.items()})
    window = reader.partitions({"until": "2024-01-02T10:00:00Z"}, {"until": "2024-01-06T10:00:00Z"})
    for _ in range(2):
        assert sorted(r[0] for p in window for r in reader.read(p)) == [uri(k) for k in (4, 5, 6)]
    assert reader.partitions({"until": "b"}, {"until": "a"}) == []


def test_fetches_are_tried_again_and_blocks_replaced_once(spark, service, tmp_path):
    for k, v in fetches.STORE.items():
        spark.conf.set(k, v)
    changes = tmp_path / "changes"
    changes.mkdir()

    def change(name, rows):
        (tmp_path / name).write_text("".join(json.dumps({"uri": u, "version": v}) + "\n" for u, v in rows))
        (tmp_path / name).rename(changes / name)

    Service.records |= {uri(k): "2024-01-01T00:00:00Z" for k in (1, 2, 3)}
    Service.failing |= {uri(2): 2, uri(3): 99}
    change("a.json", [(uri(1), "1"), (uri(2), "1"), (uri(3), "1"), (uri(1), "1")])
    rows = spark.readStream.schema("uri string, version string").json(str(changes))
    query = fetches.follow(spark, rows, service, f"{tmp_path}/docs", f"{tmp_path}/index", ["normalized_title_ssm"], f"{tmp_path}/cp", f"{tmp_path}/errors", retries=2, pause_ms=200)

    def until(done, limit=90):
        end = time.time() + limit
        while time.time() < end and query.isActive:
            try:
                if done():
                    return True
            except Exception:  # the table is not there yet
                pass
            time.sleep(0.5)
        raise AssertionError(query.exception() or "not in time")

    titles = lambda: {r.ead_ssi: r.normalized_title_ssm[0] for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
    until(lambda: set(titles()) == {"e1", "e2"} and spark.read.parquet(f"{tmp_path}/errors").count() == 1)
    assert Service.asked.count(uri(1)) == 1 and Service.asked.count(uri(2)) == 3 and Service.asked.count(uri(3)) == 3
    Service.records[uri(1)] = "2025-06-06T00:00:00Z"
    change("b.json", [(uri(1), "2"), (uri(2), "1")])
    found = lambda word: sorted(r.id for r in TermIndex(spark, f"{tmp_path}/index").hits([word], [], ["normalized_title_ssm"]).collect())
    until(lambda: "2025d06d06" in titles()["e1"] and found("2025d06d06"))
    query.stop()
    assert Service.asked.count(uri(1)) == 2 and Service.asked.count(uri(2)) == 3
    error = spark.read.parquet(f"{tmp_path}/errors").first()
    assert (error.uri, error.version, error.tries) == (uri(3), "1", 3) and "500" in error.error
    assert len(found("box")) == 2 and len(found("2025d06d06")) == 1 and len(found("2024d01d01")) == 1
