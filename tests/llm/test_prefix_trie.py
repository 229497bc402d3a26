"""The prefix trie against a plain trie in Python and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import types as T

from veinstone.llm import prefix_trie

SCHEMA = T.StructType().add("conv_id", T.LongType()).add("turn", T.LongType()).add("role", T.StringType()).add("text", T.StringType()).add("name", T.StringType()).add("d", T.IntegerType())


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)
        ends = sorted(c for c in who if len(made[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), sum(len(n) == len(node) + 1 for n in under), sum(map(leaf, under)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_against_a_plain_trie(spark):
    rng = random.Random(2)
    rows = []
    for c in [-7, -5, -3, -1, *range(0, 24), 2**63 - 1, 2**63 - 3, -(2**63)]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 40])))
    rows += rows[:9] + [(None, 1, "user", "lost")] + [(10, k, "user", "same") for k in range(300)]
    assert result(prefix_trie.prefix_trie(frame(spark, rows).repartition(3))) == brute(rows)


def test_small_tables(spark):
    assert result(prefix_trie.prefix_trie(frame(spark, []))) == []
    # crc32("4") % 9 is 6: conversation 4 has one turn, which its head takes away, and conversation 0 does not exist.
    rows = [(4, 0, "user", "hi")]
    assert result(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows) and len(brute(rows)) == 1
    rows = [(0, 0, "user", "hi"), (5, 0, "user", "hi")]
    assert result(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_digest_of_many_chunks(spark, monkeypatch):
    ends = spark.range(0, 20000).selectExpr("2L as d", "7L as rep", "id - 50 as conv").repartition(4)
    assert prefix_trie.end_digests(ends).first().ends_sha256 == hashlib.sha256(",".join(map(str, range(-50, 19950))).encode()).hexdigest()


def test_sql_on_the_whole_table(spark):
    at = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{at}'")
    rows = con.sql(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({prefix_trie.ORACLE_SQL})").fetchall()
    assert result(prefix_trie.prefix_trie(spark.read.parquet(at))) == sorted(rows, key=str)
