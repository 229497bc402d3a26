"""Joins, searches and the classifier against brute force."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veinstone.llm import jaccard, leaks, quality
from veinstone.llm.graph import components
from veinstone.llm.scratch import Scratch

SF1 = "/root/testdata/sf0.01"


def brute_sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_components(rows):
    """rows: (id, text) -> sorted (id, set size, component) from all pairs."""
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= 75 * (len(a) + len(b) - same):
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.integers(10**6)}" for w in words)


@pytest.mark.parametrize("limits", [(4096, 1 << 22), (4, 700)])
def test_components_against_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(["", "   ", "one two", "ONE two", "one two three", "a b c d e", "a b c d E", "\x0ba\x0cb c d e\n"])]
    common = " ".join(f"c{k}" for k in range(60))
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(int(rng.integers(30, 200)))]
        rows += [(100 * group + 10 + k, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])) + (f" {common}" if group % 2 else "")) for k in range(25)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(*rows[k], "clash") for k in order], "doc_id long, text string, component_id string").repartition(7)
    got = jaccard.jaccard_components(df, cluster_limit=limits[0], token_limit=limits[1])
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_components_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(spark.read.parquet(f"{SF1}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_component_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, "x " * 50_000), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 2), (3, 2, 2), (3, 2, 2), (4, 0, 4), (5, 1, 5), (2, 2, 2)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, 5, None]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = b" ".join(b"w%d" % (k * k) for k in range(3000))
    whole = jaccard.shingle_sets([text, b"a b", text], 7)
    monkeypatch.setattr(jaccard, "CHUNK", 100)
    cut = jaccard.shingle_sets([text, b"a b", text], 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and len(whole[0]) == 2996 and np.array_equal(whole[0], whole[2])


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.uniform(0, 0.3)], rng.integers(0, 2**63, int(rng.integers(0, 40)), dtype=np.uint64)])) for _ in range(80)]
        sets.sort(key=len)
        tree = jaccard.CountTree(sets)
        for q in range(79):
            found = set(tree.search(q, np.arange(q + 1, 80)).tolist())
            assert found >= {r for r in range(q + 1, 80) if jaccard.linked(sets[q], sets[r])}


def test_graph_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test"), "g")
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(1, 61)] + [(101, 100), (103, 100)]
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "g").count() == 0


def brute_leaks(docs, items):
    """Every unit of every item against every passage with full scores, then the whole item's parts against the whole text."""
    df, units = {}, []
    for item, text in items:
        words, cut = leaks.split_item(text or "")
        n = max(1, round(len(words) / leaks.UNIT))
        if len(words) >= 5:
            units += [(words[k * len(words) // n : (k + 1) * len(words) // n], item, words, cut) for k in range(n)]
    for u, *_ in units:
        for w in set(u):
            df[w] = df.get(w, 0) + 1
    mean, span = sum(len(u[0]) for u in units) / max(1, len(units)), max((len(u[0]) for u in units), default=1)
    grams = lambda words, n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    out = set()
    short = {(tuple(leaks.words_of((t or "").encode())), i) for i, t in items}
    for doc, body in docs:
        found = leaks.words_of((body or "").encode())
        out |= {(doc, i) for w, i in short if 0 < len(w) < 5 and w == tuple(found)}
        whole = {}
        passages = [set(found[p : p + 2 * span]) for p in range(0, len(found), span)]
        for u, item, words, cut in units:
            parts = [(p, min(5, len(p))) for p in (words[:cut], words[cut:]) if p]
            for _, n in parts:
                whole.setdefault(n, grams(found, n))
            if not all(len(grams(p, n) & whole[n]) >= 0.5 * len(grams(p, n)) for p, n in parts):
                continue
            norm = 1.2 * (0.25 + 0.75 * len(u) / mean)
            gain = {w: np.log(1 + (len(units) - df[w] + 0.5) / (df[w] + 0.5)) * u.count(w) * 2.2 / (u.count(w) + norm) for w in set(u)}
            if any(sum(g for w, g in gain.items() if w in p) >= 0.6 * sum(gain.values()) - 1e-9 for p in passages):
                out.add((doc, item))
    return out


def test_long_and_short_items(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    question, answer = word(150) + "?", word(150)
    items = [(1, f"{question} {answer}"), (2, "the"), (3, "what is dna"), (4, word(64)), (5, f"{word(100)}? {word(6)}")]
    docs = [(1, f"{word(300)} {question} {word(50)}"), (2, f"{word(99)} {answer}"), (3, f"{question} {word(400)} {answer}"), (4, "the end of the story"), (5, "What is DNA?"), (6, "so what is dna then"), (7, word(3000) + " " + items[4][1]), (8, items[4][1][:300]), (9, "The")]
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items) == {(3, 1), (5, 3), (7, 5), (9, 2)}


def test_words_that_collide_in_polynomial_hashes(spark):
    first = "a"
    while len(first) < 2048:
        first += first.translate(str.maketrans("ab", "ba"))
    other = first.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, first), (2, other), (3, first), (4, "x\x00"), (5, "x"), (6, "abcdefghi"), (7, "abcdefghj")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_links_by_words():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = [f"w{x}" for x in rng.integers(0, 30, int(rng.integers(3, 60)))]
        a, b = edited(rng, base, 0.02), edited(rng, base, 0.05)
        x, y = brute_sets(a), brute_sets(b)
        assert jaccard.same_words_link(a.encode(), b.encode()) == (100 * len(x & y) >= 75 * len(x | y))


def test_hot_tokens_and_wrong_hashes(spark, monkeypatch):
    """Ties through hot tokens lose no link, and words decide where hashes say that all is equal."""
    rng = np.random.default_rng(11)
    base = [f"h{k}" for k in range(40)]
    rows = [(k, edited(rng, base[: int(rng.integers(25, 41))], rng.choice([0, 0.03]))) for k in range(150)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=2, cluster_limit=40)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)
    same = np.arange(3, dtype=np.uint64)
    assert jaccard.cluster_links([same, same], verify=lambda q, r: False) == [] and jaccard.cluster_links([same, same]) == [(0, 1)]


def test_tree_is_packed_by_coordinates():
    sets = [np.unique(np.concatenate([np.arange(200, dtype=np.uint64) * np.uint64(2**40) + np.uint64(k % 2) * np.uint64(2**63)])) for k in range(64)]
    leaves = jaccard.CountTree(sets).leaf
    assert len(set(leaves)) == 2 and all(len({k % 2 for k in np.flatnonzero(leaves == x)}) == 1 for x in set(leaves))


def test_leaks_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()}
    assert got == brute_leaks(docs.select("doc_id", "text").collect(), items.collect()) and got


def test_leak_edge_cases(spark, monkeypatch):
    item = "What is the tallest hill of the old shire and who first climbed it? It is the long barrow hill climbed by old Tom in the year nine"
    docs = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "pad " * 30_000 + item.upper()), (None, item), (1, item), (5, item[:60])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (7, item, "x")], "item_id long, text string, score string")
    want = [(1, 7), (1, 7), (4, 7), (None, 7)]
    assert sorted(((r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id for r in leaks.drop_leaks(docs, items).collect()), key=str) == [2, 3, 5]
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0 and leaks.drop_leaks(docs, items.limit(0)).count() == 7
    monkeypatch.setattr(leaks, "SHARD_BYTES", 60)
    assert leaks.find_leaks(docs, items).count() == 4
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.drop_leaks(docs, items).columns == docs.columns


def test_wand_against_full_scores():
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"t{x}" for x in rng.zipf(1.4, 30) % 90)) for k in range(300)]
    units = leaks.units_of(items)
    df = {}
    for u in units:
        for w in u.terms:
            df[w] = df.get(w, 0) + 1
    index = leaks.Index(items, df, len(units), np.mean([len(u.words) for u in units]), 0.7)
    for _ in range(60):
        passage = {f"t{x}".encode() for x in rng.zipf(1.3, 60) % 90}
        full = {}
        for w in passage & index.postings.keys():
            for u, g in zip(*index.postings[w][:2]):
                full[u] = full.get(u, 0.0) + g
        assert {u for u, _ in index.search(passage)} == {u for u, s in full.items() if s >= 0.7 - 1e-9}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(hash(doc_id), 4) = 0")
    model = quality.train(docs, labels.where("pmod(hash(doc_id), 4) != 0"))
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.score(docs, model).join(held, "doc_id").toPandas()
    good, poor = got[(got.quality == 1) & (got.toxic == 0)], got[got.quality == 0]
    assert good.keep.mean() > 0.98 and poor.keep.mean() < 0.1
    assert good.expected_grade.mean() > got[(got.quality == 1) & (got.toxic == 1)].expected_grade.mean() > poor.expected_grade.mean()


def test_quality_rejects_held_out_toxic_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(hash(doc_id), 4) = 0")
    model = quality.train(docs, labels.where("pmod(hash(doc_id), 4) != 0"))
    got = quality.score(docs, model).join(held, "doc_id").toPandas()
    kept = {g: got[(got.quality == q) & (got.toxic == t)].keep.mean() for g, q, t in ((1, 1, 1), (2, 1, 0))} | {0: got[got.quality == 0].keep.mean()}
    print("kept", kept, "cut", model.cut, "rejected in calibration", model.rejected)
    assert kept[1] < 0.65 and kept[0] < 0.05 and kept[2] > 0.98
    assert model.rejected[1] > 0.35 and model.rejected[0] > 0.95 and model.rejected[2] <= 0.01


def test_calibration_uses_all_grades():
    tails = np.array([0.1, 0.6, 0.99, 0.9, 0.95, 0.97])  # of grades 0, 1, 1, 2, 2, 2
    got = quality.calibrate(quality.OrdinalModel(np.zeros(1), np.zeros(2)), tails, np.array([0, 1, 1, 2, 2, 2]))
    assert 0.6 < got.cut < 0.9 and got.rejected == {0: 1.0, 1: 0.5, 2: 0.0}


def test_quality_objective_against_brute_force():
    """The gradient against finite differences, and the fit against plain gradient descent on a dense table."""
    rng = np.random.default_rng(6)
    dense = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.6)
    grades = np.clip(np.digitize(dense @ rng.normal(size=5) + rng.normal(size=60), [-0.5, 0.7]), 0, 2)
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)].astype(np.float64)) for x in dense]
    f = quality.Objective(rows, grades, 5, 3, 1e-2)

    def dense_loss(x):
        theta = np.array([x[5], x[5] + np.exp(x[6])])
        cum = np.c_[np.zeros(60), 1 / (1 + np.exp(dense @ x[:5][:, None] - theta)), np.ones(60)]
        p = np.diff(cum, axis=1)[np.arange(60), grades]
        w = np.array([1 / np.sum(grades == g) ** 0.5 for g in range(3)])[grades]
        return -np.sum(w * np.log(p)) / w.sum() + 1e-2 * x[:5] @ x[:5] / 2

    x = rng.normal(size=7) * 0.3
    slope = np.array([(dense_loss(x + d) - dense_loss(x - d)) / 2e-6 for d in np.eye(7) * 1e-6])
    assert f(x)[0] == pytest.approx(dense_loss(x)) and np.allclose(f(x)[1], slope, atol=1e-6)
    plain = np.zeros(7)
    for _ in range(3000):
        plain -= 1.0 * np.array([(dense_loss(plain + d) - dense_loss(plain - d)) / 2e-6 for d in np.eye(7) * 1e-6])
    assert np.allclose(quality.minimise(f, np.zeros(7), 200), plain, atol=1e-3)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "w " * 60_000, "x"), (None, "a b", "x"), (3, "w", "x")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = quality.train(docs, some)
        assert quality.score(docs, model).count() == 5 and quality.select_quality(docs, model).columns == docs.columns
    assert quality.select_quality(docs, quality.train(docs, labels.limit(0))).count() == 5
    assert quality.score(docs.limit(0), model).count() == 0


def test_components_of_stars_and_chains(spark):
    """A node with a third of all edges, chains, a clique, equal edges, loops and null ends."""
    from random import Random

    from veinstone.llm.scratch import Scratch

    rng = Random(3)
    edges = [(7, 1000 + k) for k in range(700)] + [(5000 + k, 5001 + k) for k in range(300)] + [(9000 + i, 9000 + j) for i in range(12) for j in range(i)]
    edges += [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(600)] + [(-3, 1000), (7, 1000), (4, 4), (None, 4), (4, None)]
    rng.shuffle(edges)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in root if top(x) != x)


def test_a_token_of_some_large_classes_alone_ties_nothing():
    """20 classes of 640 shingles that meet on one token: it is one vote of the 11 that a linked pair has at least."""
    n, key = 640, np.arange(1, 21, dtype=np.int64)
    rows = [np.full(20, 7, np.int64), key, np.full(20, 2 * n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(20, pa.int64())], ["token", "key", "size", "hot"])
    made = pa.Table.from_batches(jaccard._meet(iter([batch]))).to_pydict()
    assert len(made["a"]) == 190 and set(made["votes"]) == {1} and set(made["need"]) == {11}


def text_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "raw"])


def test_a_batch_is_hashed_by_pieces(monkeypatch):
    """Pieces of any size give the same rows: the survey's names and counts, and routing rows, copies in other pieces included."""
    rng = np.random.default_rng(12)
    texts = [None, "", *(" ".join(f"w{x}" for x in rng.integers(0, 30, int(rng.integers(1, 90)))) for _ in range(60)), "one long text " * 300]
    batch = text_batch([*texts, *texts[:20]])
    sets = jaccard.shingle_sets([t and t.encode() for t in texts], 5)
    seen = Counter(x for s in {jaccard.set_key(s): s for s in sets}.values() for x in s.tolist())
    common = np.array(sorted(seen)[::7], np.uint64)
    route = jaccard._router(5, common, rng.permutation(len(common)), np.ones(len(common), np.int64))
    made = []
    for size in (1 << 20, 500, 1):
        monkeypatch.setattr(jaccard, "CHUNK", size)
        survey = pa.Table.from_batches(jaccard._survey(5)(iter([batch, batch.slice(0, 0)]))).to_pylist()
        assert {r["token"] % 2**64: r["times"] for r in survey if r["token"] is not None} == {x: n for x, n in seen.items() if n > 1}
        assert [(r["doc_id"], r["n"], r["key"], r["key2"]) for r in survey if r["token"] is None] == [(k, len(s), *jaccard.set_key(s)) for k, s in enumerate([*sets, *sets[:20]])]
        made.append(pa.Table.from_batches(route(iter([batch]))).to_pylist())
    assert made[0] == made[1] == made[2] and made[0]


def test_memory_of_a_python_worker():
    """A batch takes a few times its text, and what a worker keeps for later tasks is bounded: both count in an executor's memory."""
    texts = [" ".join(f"word{k * 7919 + j}" for j in range(900)) for k in range(600)]
    batch, rare = text_batch(texts), np.arange(1, dtype=np.uint64)
    for run in (jaccard._survey(3), jaccard._router(3, rare, np.zeros(1, np.int64), np.ones(1, np.int64))):
        tracemalloc.start()
        n = sum(out.num_rows for out in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print("peak as a multiple of the text", most / batch.nbytes)
        assert n and most < 3.3 * batch.nbytes
    for text in texts:
        quality.text_features(text)
    assert len(quality._cache) < 100_000
