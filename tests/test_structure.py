"""Intervals, ranges and cursors against plain Python."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from veinstone.operators import harvest
from veinstone.operators import cursors, intervals, networks, ranges


def test_intervals_of_random_blocks(spark):
    rng, rows = random.Random(4), []
    for b in range(12):
        level = 0
        for p in range(rng.randint(1, 40)):
            rows.append((f"b{b}", p * 2, [level], f"{b}_{p}"))
            level = rng.randint(1, level + 1)
    docs = spark.createDataFrame([*rows, (None, 1, [0], "x"), ("b1", None, None, "y")], "_root_ string, sort_isi int, component_level_isim array<int>, id string").repartition(5)
    got = {r.id: r[intervals.LAST] for r in intervals.with_intervals(docs).collect()}
    want = {}
    for b, p, (level,), i in rows:
        later = [(q, k[0]) for c, q, k, _ in rows if c == b and q > p]
        end = next((q for q, k in later if k <= level), None)
        want[i] = max([p, *(q for q, _ in later)]) if end is None else end - 1
    assert got == want | {"x": None, "y": None}
    flat = docs.where("id not in ('x', 'y')").withColumn("component_level_isim", F.col("component_level_isim")[0])
    parents = {}
    for b, p, (level,), i in rows:
        stack = parents.setdefault(b, [])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, i))
        want[i] = [k for _, k in stack]
    assert {r.id: r.path for r in intervals.paths(flat).collect()} == want


def test_ranges_count_without_expanding(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-9000, 9000), rng.randint(0, 4000)) for _ in range(200)]
    docs = spark.createDataFrame([(a, a + n) for a, n in rows] + [(None, 3), (3, None), (9, 2)], "a int, z int")
    found = ranges.range_facet(docs, "a", "z", -500, 3000, 7)
    got = [(r.begin, r.end, r["count"]) for r in found.orderBy("begin").collect()]
    assert got == [(b, min(b + 6, 3000), sum(a <= min(b + 6, 3000) and a + n >= b for a, n in rows)) for b in range(-500, 3001, 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Explode" not in plan
    lists = [[rng.randint(0, 60) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    years = spark.createDataFrame([(v,) for v in [*lists, None, [None, 5]]], "y array<int>")
    got = [(r.begin, r["count"]) for r in ranges.years_facet(years, "y", 3, 50, 5).orderBy("begin").collect()]
    assert got == [(b, sum(any(b <= y <= min(b + 4, 50) for y in v) for v in [*lists, [5]])) for b in range(3, 51, 5)]


def test_cursors_walk_all_rows(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, "a", "b", "c"]), rng.choice([None, date(2020, 1, 1), date(2021, 5, 6)]), rng.choice([1.5, 2.5, None])) for k in range(83)]
    docs = spark.createDataFrame(rows, "id int, s string, d date, x double").repartition(3)
    for keys in ([("s", "asc"), ("d", "desc"), ("id", "desc")], [("x", "desc"), ("s", "desc"), ("id", "asc")], [("id", "asc")]):
        seen = [r.id for page in cursors.walk(docs, keys, 10) for r in page]
        assert seen == [r.id for r in docs.orderBy(*cursors.order(keys)).collect()] and len(seen) == 83
    first = cursors.page_after(docs, [("id", "asc")], None, 2).collect()
    with pytest.raises(ValueError):
        cursors.after(cursors.encode(first[-1], [("id", "asc")]), [("id", "desc")], docs)


def test_cursor_reaches_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    docs = spark.read.schema("id long").parquet(f"{tmp_path}/t")
    keys = [("id", "asc")]
    cursor = cursors.encode(docs.where("id = 700").first(), keys)
    page = cursors.page_after(docs, keys, cursor, 5)
    assert [r.id for r in page.collect()] == [701, 702, 703, 704, 705]
    plan = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,700)" in plan and "Offset" not in plan


def test_networks_of_both_kinds(spark):
    import ipaddress

    rng = random.Random(3)
    v4 = [".".join(str(rng.choice([0, 1, 10, 255])) for _ in range(4)) for _ in range(60)]
    v6 = [str(ipaddress.ip_address(rng.choice([0xFD << 120, 0x2001 << 112]) | rng.getrandbits(rng.choice([3, 40, 112])))) for _ in range(60)]
    odd = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "FD00::A", "1:2:3::4:5:6:7:8", ":1::", "1::2::3", "256.1.1.1", "1.2.3", "", None, "x", "12345::", "1:2", "10.0.0.1 "]
    df = spark.createDataFrame([(a,) for a in v4 + v6 + odd], "a string")

    def number(a):
        try:
            ip = ipaddress.ip_address((a or "").strip())
        except ValueError:
            return None
        return f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}"

    assert {r.a: r.h for r in df.select("a", networks.address_hex(F.col("a")).alias("h")).collect()} == {a: number(a) for a in v4 + v6 + odd}
    nets = [f"{a}/{rng.choice([0, 4, 8, 12, 16, 24, 31, 32])}" for a in v4[:15]] + [f"{a}/{rng.choice([0, 8, 20, 64, 100, 128])}" for a in v6[:15]] + [v4[20], v6[20], "1.1.1.1/33", "::/x", None]
    parsed = []
    for n in nets:
        try:
            parsed.append((n, ipaddress.ip_network(n, strict=False)))
        except (ValueError, AttributeError):
            pass

    def best(a):
        if number(a) is None:
            return None
        ip = ipaddress.ip_address(a.strip())
        ip = ip.ipv4_mapped if ip.version == 6 and ip.ipv4_mapped else ip
        bits = lambda n: n.prefixlen + (96 if n.version == 4 else 0)
        fits = [(-bits(n), t) for t, n in parsed if ip.version == n.version and ip in n or ip.version == 4 and n.version == 6 and ipaddress.ip_address(int(ip) + (0xFFFF << 32)) in ipaddress.ip_network(n) if n.version == 6 or ip.version == 4]
        return min(fits)[1] if fits else None

    found = networks.longest_prefix(df, "a", spark.createDataFrame([(n,) for n in nets], "n string"), "n")
    assert {r.a: r.network for r in found.collect()} == {a: best(a) for a in v4 + v6 + odd}
    assert found.count() == len(v4 + v6 + odd) and networks.longest_prefix(df, "a", spark.createDataFrame([("x",)], "n string"), "n").where("network is not null").count() == 0


def test_linked_resources_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(harvest, "TASK_ROWS", 10)
    links = spark.range(100).selectExpr("id % 7 agent", "id record").unionByName(spark.createDataFrame([(3, 500), (4, 501)], "agent long, record long"))
    parents = spark.range(100).selectExpr("id record", "id div 4 resource")
    found = harvest.linked_resources(spark.createDataFrame([(3,), (3,)], "agent long"), links, parents)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(r.uri for r in found.collect()) == [*sorted({k // 4 for k in range(3, 100, 7)}), 500]
