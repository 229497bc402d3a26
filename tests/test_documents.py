"""Finding aids, requests, ranked search, paged sources and streams."""

import http.server
import json
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from veinstone.functions import analyzers as A
from veinstone.operators import export as E, harvest as H, records as V, relational as R
from veinstone.operators.schema import derive
from veinstone.plans import execute as X2, request as Q, search as X
from veinstone.sources import ead, paged
from veinstone.streaming.harvest import harvest, replace_blocks


def deep(n):
    return f'<c{n:02d} id="d{n}" level="file"><did><unittitle>Level {n}</unittitle></did>{deep(n + 1) if n < 12 else ""}</c{n:02d}>'


AID = f"""<?xml version="1.0" encoding="utf-8"?><ead xmlns="urn:isbn:1-931666-22-9" xmlns:xlink="http://www.w3.org/1999/xlink"><!-- kept -->
<eadheader><eadid>Société 1.xml</eadid></eadheader><archdesc level="collection"><did><repository><corpname>Hill Library</corpname></repository>
<unittitle>Letters <emph>of</emph> Tom,</unittitle><unitid>M.12</unitid><unitid type="ark"><extref xlink:actuate="onLoad" xlink:href="https://x.org/ark:/12345/c84ed37b99">Archival Resource Key</extref></unitid>
<unitid type="uri">/repositories/1/resources/2</unitid><unitdate normal="1963/1965">1963-1965</unitdate><unitdate type="bulk">1964</unitdate><langmaterial><language>English</language> .</langmaterial>
<container type="Box">7</container></did><scopecontent><p>Many letters.</p></scopecontent><controlaccess><geogname>France</geogname></controlaccess>
<dsc>{deep(1)}<c01 level="item"><did><unitdate>1963</unitdate><dao xlink:href="ab123cd4567"/></did></c01><c01/></dsc></archdesc></ead>""".encode()


def test_documents_of_a_finding_aid():
    docs = ead.documents_of(AID, "ars")
    top = docs[0]
    assert top["id"] == "societe-1" and top["normalized_title_ssm"] == ["Letters of Tom, 1963-1965, 1964"] and top["unitid_ssm"] == ["M.12"] and top["language_ssim"] == ["English."]
    assert (top["ark_id_ssi"], top["ark_shoulder_ssi"], top["date_range_isim"]) == ("ark:/12345/c84ed37b99", "c8", [1963, 1964, 1965])
    assert len(docs) == 15 and [d["component_level_isim"][0] for d in docs] == [0, *range(1, 13), 1, 1] and [d["sort_isi"] for d in docs] == list(range(15))
    assert docs[3]["_nest_parent_"] == docs[2]["id"] == "societe-1_d2" and docs[12]["parent_unittitles_tesim"][0] == top["normalized_title_ssm"][0]
    assert docs[13]["normalized_title_ssm"] == ["1963"] and docs[13]["has_online_content_ssim"] == ["true"] and docs[14]["normalized_title_ssm"] == ["[NO TITLE PROVIDED]"]
    with pytest.raises(ValueError):
        ead.documents_of(b'<!DOCTYPE a [<!ENTITY x "y">]><ead/>', None)


def test_namespaces_and_indentation():
    plain = ead.without_namespace(AID).decode()
    assert "xmlns" not in plain and 'actuate="onload"' in plain and "<!-- kept -->" in plain and 'href="https://x.org' in plain
    assert ead.with_namespaces(b"<ead><a/></ead>", "urn:x") == b'<ead xmlns="urn:x"><a/></ead>' and ead.with_namespaces(AID, "urn:x") == AID
    assert b"\n  <" in ead.pretty(b"<ead><a/></ead>")


def test_harvest_stream(spark, tmp_path):
    at = tmp_path / "in" / "ars"
    at.mkdir(parents=True)
    (at / "a.xml").write_bytes(AID)
    for run in range(2):
        harvest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        docs = spark.read.parquet(str(tmp_path / "out"))
        assert docs.count() == 15 - 12 * run
        (at / "b.xml").write_bytes(AID.replace(deep(1).encode(), b""))
    got = derive(ead.to_documents(ead.read_files(spark, str(tmp_path / "in")).where(F.col("path").endswith("a.xml"))))
    assert got.where("sort_isi = 0").first().title_sort == "lettersoftom196319651964"


def test_replaced_blocks_survive_an_interruption(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "_root_ string, v long")
    held = lambda: sorted(map(tuple, spark.read.parquet(target).select("_root_", "v").collect()), key=repr)
    replace_blocks(rows(*[(f"r{k}", k) for k in range(50)], (None, -1), (None, -1)), target, buckets=4)
    assert sorted(p.name for p in (tmp_path / "t").glob("bucket=*")) == [f"bucket={k}" for k in range(4)]
    replace_blocks(rows(("r7", 70), ("r7", 71), (None, -2)), target, buckets=4)
    want = sorted([*((f"r{k}", k) for k in range(50) if k != 7), ("r7", 70), ("r7", 71), (None, -2)], key=repr)
    assert held() == want
    replace_blocks(rows().limit(0), target, buckets=4)
    assert held() == want
    # A run that ended after its merged folders were stored, when the old ones were gone already.
    held_rows = spark.read.parquet(target).where("bucket = 1").select("_root_", "v", "bucket")
    held_rows.write.parquet(f"{target}.merged")
    shutil.rmtree(f"{target}/bucket=1")
    replace_blocks(rows(("r3", 33)), target, buckets=4)
    assert held() == sorted([x if x != ("r3", 3) else ("r3", 33) for x in want], key=repr)
    assert not (tmp_path / "t.merged").exists() and not (tmp_path / "t.new").exists()


@pytest.mark.parametrize("n, least", [(1, 1), (4, 4), (5, 4), (10, 9), (11, 9), (20, 18), (21, 18)])
def test_least_terms(n, least):
    assert Q.least_terms(n, "4<90%") == least


def test_rewrites():
    of = lambda **p: Q.rewrite(Q.from_params(p))
    assert of(group="true").group_order == "collection_last" and of(group="true", q="x").group_order == "" and of(group=True).group_order == ""
    assert of(q="a OR b").mm == "1" and of(q="NOT b").mm == "4<90%" and of(q="a or b").mm == "4<90%"
    assert of(f={"access": ["digital_content"], "collection": ["c"]}).order == "collection_last" and of(f={"access": ["digital_content"]}).order == ""
    assert of(search_field="title").qf == {"title_tesim": 1, "normalized_title_teim": 1}
    assert Q.default_grouping(Q.from_params({})).group == "true" and Q.default_grouping(Q.from_params({"group": "true", "f": {"collection": ["c"]}})).group == ""


@pytest.mark.parametrize(
    "query, found",
    [("box", [1, 2]), ("boxes", [2]), ("box AND lid", [1]), ("lid OR red", [1, 2]), ("box -lid", [2]), ("NOT box", [3]), ('"red box"', [2]), ("(lid OR red) box", [1, 2]), ("b?x", [1, 2]), ("l*d - box", [1]), ("+red", [2])],
)
def test_boolean_queries(spark, query, found):
    df = spark.createDataFrame([(1, ["box", "lid"]), (2, ["red", "box", "boxes"]), (3, ["none"])], "id int, words array<string>")
    assert sorted(r.id for r in df.where(Q.matches(Q.parse(query), F.col("words"))).collect()) == found


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "red box", "old letters"), (2, "letters", "a red and very very old box"), (3, "box", "nothing"), (4, "zzz", "zzz")], "id long, title string, body string")
    index = X.postings(docs, {"title_tesim": "title", "text": "body"})
    got = {r.id: r.score for r in X.rank(index, ["red", "box"], Q.SearchRequest()).collect()}
    assert got.keys() == {1, 2} and got[1] > got[2]
    near = {r.id: r.boost for r in X.phrase_matches(index.where("term in ('red', 'box')"), ["red", "box"], Q.SearchRequest()).collect()}
    assert near == {1: 200.0}
    assert docs.select(X.highlight(F.col("body"), ["old"]).alias("h")).first().h == "<em>old</em> letters"


class Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        page = int(dict(x.split("=") for x in body.split("&")).get("page", 0))
        answer = {"session": "t"} if "login" in self.path else {"last_page": 3, "results": [{"uri": f"/r/{page}", "ead_id": None}] if self.headers.get("X-Session") else []}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_paged_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged_search").options(url=f"http://u:p@127.0.0.1:{server.server_port}/", path="/repositories/1/search", pagesPerTask=2).load()
    assert sorted(map(tuple, df.collect())) == [("/r/1", None, None), ("/r/2", None, None), ("/r/3", None, None)]
    server.shutdown()
    with pytest.raises(ValueError):
        paged.settings({"url": "http://x.org"})
    assert paged.settings({"url": "https://u:p%40@x.org:8/a/"}) == {"base": "https://x.org:8/a", "user": "u", "password": "p@"}
    assert paged.description_path("/repositories/1/resources/2").startswith("/repositories/1/resource_descriptions/2.xml?")


def test_search_path(spark):
    docs = spark.createDataFrame(
        [("c1", "c1", 0, "Collection", ["Café letters"], ["Le café noir"], ["c1"]), ("c1_1", "c1", 1, "File", ["One story"], ["many stories about boxes"], ["c1"]), ("c2", "c2", 0, "Collection", ["Boxes"], ["x", "red", "box"], ["c2"])],
        "id string, _root_ string, sort_isi int, level_ssm string, title_tesim array<string>, text array<string>, collection_ssim array<string>",
    )
    ask = lambda **k: X2.search(docs, Q.SearchRequest(**k), marked="text")
    ids = lambda found: [r.id for r in found.hits.collect()]
    assert ids(ask(q="café")) == ["c1"] and ids(ask(q="cafe")) == ["c1"] and ids(ask(q="stories")) == ["c1_1"] == ids(ask(q="story"))
    assert ids(ask(q='"one stories"')) == ["c1_1"] and ids(ask(q='"red box"')) == [] and ask(q="").total.first().hits == 3
    assert ids(ask(q="boxes", group="false", per_page=1, page=2)) != ids(ask(q="boxes", group="false", per_page=1))
    assert ids(X2.search(docs, X2.within(Q.SearchRequest(q="box"), "c2"))) == ["c2"] and X2.within(X2.within(Q.SearchRequest(), "c"), None).filters == {}
    assert ask(q="story").hits.first().highlight == "many stories about boxes" or "<em>" in ask(q="stories").hits.first().highlight
    assert [r.id for r in X2.resolve(docs.withColumn("ark_id_ssi", F.lit("ark:/1/c8aaaa")), F.lit("ark:/1/c8aaaa")).collect()] == ["c1"]


def test_ancestors_at_any_depth(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(40)] + [("x", "lost"), ("p", "q"), ("q", "p")]
    got = {r.id: r.path for r in R.ancestors(spark.createDataFrame(rows, "id string, _nest_parent_ string")).collect()}
    assert got["n39"] == [f"n{k}" for k in range(40)] and got["n0"] == ["n0"] and got["x"] == ["x"] and set(got["p"]) <= {"p", "q"}


def test_bad_files_hold_up_no_others(spark):
    files = spark.createDataFrame([("a.xml", bytearray(AID), "ars"), ("b.xml", bytearray(b"<ead>"), "ars"), ("c.xml", None, "ars")], "path string, content binary, repository string")
    assert sorted(r.path for r in ead.bad_files(files).collect()) == ["b.xml", "c.xml"]
    assert ead.to_documents(files.where("content is not null"), skip_bad=True).count() == 15


def test_convert_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r.path: r for r in V.convert_files(files, lambda data: data.upper(), lambda data: data != b"BAD").collect()}
    assert bytes(got["a"].content) == b"X" and got["b"].error == "not valid"


def test_analysis_columns_as_python(spark):
    words = ["stories", "Box", "boxes", "gas", "bus", "glass", "ties", "aies", "is", "as", "Café", "naïve", "Über", "shoes", "trees", "dontstems", "ies", "es", "s"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.fold_column(F.col("w")).alias("f"), A.stem_column(F.lower("w")).alias("s")).collect()
    assert all(r.f == A.fold(r.w) and r.s == A.stem(r.w.lower()) for r in got)


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.xml", bytearray(b"<x/>")), ("a/y.xml", bytearray()), ("z.xml", bytearray(b"zz"))], "file_name string, content binary")
    for _ in range(2):  # a second attempt writes the same files
        got = sorted(tuple(r) for r in E.write_files(rows, f"file://{tmp_path}/out").collect())
        assert got == [("a/x.xml", 4), ("a/y.xml", 0), ("z.xml", 2)]
    assert (tmp_path / "out/a/x.xml").read_bytes() == b"<x/>" and (tmp_path / "out/z.xml").read_bytes() == b"zz"


def test_checked_deletes(spark):
    rows = spark.range(10)
    assert H.checked_deletes(rows.limit(3), rows, most=3).count() == 3
    assert H.checked_deletes(rows.limit(0), rows.limit(0)).count() == 0
    for stale, most in ((rows.limit(4), 3), (rows, 100)):
        with pytest.raises(ValueError):
            H.checked_deletes(stale, rows, most)
