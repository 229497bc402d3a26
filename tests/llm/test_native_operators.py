"""URL filter, mixing and tool calls: contracts, SQL and edge cases."""

import json

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from veinstone.llm import mixing, queries, toolcalls, urls


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert columns == sorted(want.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[k] for k in order]) for r in want.fetchall())


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://net/", "http://net", "http://sub.example.com/de/a", "ftp://x.org/fr/", "http://x.org/frx", "http://é.com/" + "p" * 5000, "http://a.net/b://c", "http://?q"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "clash")], "page_id long, url string, verdict string")
    rows = urls.judge_urls(df).collect()
    got = {r.page_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(URLS) + 1
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("net", "/", "net/", "block") and got[5][:3] == ("net", "", None)
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow") and got[8][2] is None
    assert got[9][1] == "/" + "p" * 5000 and got[10] == ("a.net", "/b://c", "net/", "block") and got[11][:2] == ("", "")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_urls_of_one_class_are_allowed(spark):
    rows = [(1, "https://a.example.net/en/x"), (2, "http://foo.io/q"), (3, None)]
    for df in (spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rows[1:], "page_id long, url string")):
        assert {r.verdict for r in urls.judge_urls(df).collect()} == {"allow"}


def test_url_models_tell_classes_apart(spark):
    rows = [(k, f"http://good{k}.org/fr/article/{k}") for k in range(40)] + [(100 + k, f"http://win{k}.net/casino/{k}") for k in range(40)] + [(200, "http://good.info/article/1"), (201, "http://win.info/casino/1")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block" and got[5] == "allow" and got[105] == "block"


def test_mixture_fits_targets(spark):
    rows = [(k, "w " * (5 + k % 7), ("big", "a", "b")[min(2, k % 10)], ("en", "de")[k % 3 == 0]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shares = {"source": {"big": 0.2, "a": 0.3, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    targets = {m: spark.createDataFrame(list(v.items()), f"{m} string, target double") for m, v in shares.items()}
    got = mixing.mix(docs, targets, budget=0.05, rounds=30)
    total = got.agg(F.sum(F.col("_tokens") * F.col("_rate"))).first()[0]
    for margin, want in shares.items():
        for r in got.groupBy(f"_{margin}").agg((F.sum(F.col("_tokens") * F.col("_rate")) / total).alias("share")).collect():
            assert r.share == pytest.approx(want[r[0]], abs=1e-6)
    kept = mixing.sample_mixture(docs, budget=0.5)
    assert kept.columns == docs.columns and 0.4 < kept.count() / 600 < 0.65 and kept.subtract(docs).count() == 0


def test_mixture_drops_values_without_a_target(spark):
    docs = spark.createDataFrame([(k, "a b c", ("x", "y", "z")[k % 3], "en") for k in range(30)] + [(99, None, "y", "en")], "doc_id long, text string, source string, lang string")
    shares = {"source": {"x": 1.0, "y": 0.0}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}
    targets = {m: spark.createDataFrame(list(v.items()), f"{m} string, target double") for m, v in shares.items()}
    got = {r._source: r._rate for r in mixing.mix(docs, targets, budget=0.2).where("_tokens > 0").collect()}
    assert got["y"] == got["z"] == 0.0 and got["x"] == pytest.approx(0.6)
    assert [r.doc_id for r in mixing.mix(docs, targets, budget=0.2).where("_keep and source != 'x'").collect()] == [99]


def test_mixture_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "", "s", "en", 1), (3, "a b\u00a0c", "s", None, 1), (3, "a b\u00a0c", "s", None, 1), (4, "x " * 40_000, "s", "en", 1)], "doc_id long, text string, source string, lang string, topic int")
    got = mixing.mix(docs)
    assert got.count() == 5 and got.where("_rate is null or _keep is null").count() == 0
    assert sorted(r._tokens for r in got.collect()) == [0, 0, 2, 2, 40_000]
    assert mixing.sample_mixture(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_sample_meets_targets_with_the_set_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).where("_tokens > 0").cache()
    cells = got.groupBy(*(F.col(f"_{m}").alias(m) for m in mixing.MARGINS)).agg(F.sum("_tokens").alias("tokens")).cache()
    assert got.where("_expected > 1").count() and got.where("_keep != (_copies > 0)").count() == 0
    tokens, expected = got.agg(F.sum("_tokens"), F.sum(F.col("_tokens") * F.col("_expected"))).first()
    assert expected / tokens == pytest.approx(mixing.BUDGET, abs=1e-6)
    sample = mixing.sample_mixture(docs).withColumns({"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "topic": mixing.topic_of(F.col("text")), "tokens": mixing.tokens_of(F.col("text"))}).select(*mixing.MARGINS, "tokens").cache()
    all_kept = sample.agg(F.sum("tokens")).first()[0]
    assert all_kept / tokens == pytest.approx(mixing.BUDGET, abs=0.03)
    for m in mixing.MARGINS:
        want = {r[0]: r.target for r in mixing.targets_of(cells, m).collect()}
        mean = {r[0]: r[1] / expected for r in got.groupBy(f"_{m}").agg(F.sum(F.col("_tokens") * F.col("_expected"))).collect()}
        real = {r[0]: r[1] / all_kept for r in sample.where("tokens > 0").groupBy(m).agg(F.sum("tokens")).collect()}
        assert mean == pytest.approx(want, abs=1e-4) and real == pytest.approx(want, abs=0.03)


def call(i, name, arguments, after=()):
    return {"id": i, "name": name, "arguments": arguments, "depends_on": list(after)}


def test_tool_calls(spark):
    calls = json.dumps({"tool_calls": [call("c", "search", {"limit": 3, "query": "x", "from": {"$ref": "b"}}), call("b", "fetch", {"url": 5}, ["a"]), call("a", "calculate", {"expression": "1+1"}), call("p", "fetch", {"url": "u"}, ["q"]), call("q", "nope", {}, ["p"])]})
    tool = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    turns = [(1, 0, "user", "hello é\n"), (1, 1, "assistant", calls), (1, 2, "tool", tool("a", "2")), (1, 3, "tool", tool("b", "two")), (1, 4, "tool", tool("zz", "lost")), (1, 2, "tool", tool("a", "2")), (1, 5, "tool", tool("b", "three")), (2, 0, "user", None), (2, 1, "assistant", "ok"), (None, 0, "user", "x"), (3, None, "user", "x"), (2, 7, "assistant", "late"), (4, 0, "user", "y " * 50_000), (1, 9, "assistant", "{broken")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, status string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_conversations(df).collect()}
    level = {k[1]: r.level for k, r in got.items() if k[0] == 1}
    assert (level["a"], level["b"], level["c"], level["p"], level["q"]) == (0, 1, 2, -1, -1)
    status = {k: r.status for k, r in got.items()}
    assert status[1, "a"] == "linked" and status[1, "b"] == "duplicate" and status[1, "c"] == "unanswered" and status[1, "p"] == "cycle" and status[1, "zz"] == "orphan result"
    assert status[2, "turn:0"] == "linked" and got[2, "turn:0"].errors == "prompt empty" and status[2, "turn:6"] == "orphan result" and status[4, "turn:0"] == "unanswered"
    assert got[1, "a"].errors == "" and got[1, "b"].errors == "url not string" and got[1, "c"].errors == "unknown from" and got[1, "q"].errors == "unknown tool"
    record = got[1, "a"].record
    assert record == '{"arguments":{"expression":"1+1"},"id":"a","name":"calculate","result":"2","status":"linked"}' and json.loads(got[1, "turn:0"].record)["arguments"] == {"prompt": "hello é\n"}
    assert json.loads(got[1, "c"].record)["arguments"] == {"from": {"$ref": "b"}, "limit": 3, "query": "x"} and '"from":{"$ref":"b"},"limit":3' in got[1, "c"].record
    assert toolcalls.link_conversations(df.limit(0)).count() == 0
