"""The stored index, spelling, suggestions and fragments against plain Python and in their plans."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veinstone.functions.analyzers import fold, stem, stem_forms
from veinstone.plans import execute as X, fragments, suggestions
from veinstone.plans.index import TermIndex, gram_list, pattern_grams
from veinstone.plans.request import SearchRequest, has_syntax


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, 1, ["small rings here"], None), (2, 2, ["large bolts there", "the small"], "rings end"), (3, 3, ["small bolt and ring"], "many stories"), (4, 3, ["café noir"], "many stores"), (5, 4, [], "")]
    return spark.createDataFrame(rows, "id long, _root_ long, title array<string>, text string").cache()


QF = {"title": 2, "text": 1}
FORMS = [
    ("bolt*", [2, 3]), ("(bolt* OR ring*)", [1, 2, 3]), ("NOT bolts", [1, 4, 5]), ("+ring bolt", [2, 3]), ("small OR caf?", [1, 2, 3, 4]), ("many AND stor?es", [3]), ('"small rings"', [1]), ('"there the"', []),
    ("-small", [4, 5]), ("ring -bolt", [1]), ("NOT (small OR many)", [5]), ("many NOT stories", [4]), ("*olt?", [2]), ("CAFE", [4]), ("ring bolt", [2, 3]), ('-"small bolt" ring', [1, 2]), ("zzz*", []), ("s*l stores", [4]),
]


@pytest.mark.parametrize("q, found", FORMS)
def test_forms_over_scan_and_index(spark, docs, tmp_path_factory, q, found):
    index = test_forms_over_scan_and_index.__dict__.setdefault("index", None) or TermIndex(spark, str(tmp_path_factory.mktemp("index"))).update(docs, ["title", "text"])
    test_forms_over_scan_and_index.index = index
    request = SearchRequest(q=q, qf=QF, pf={"title": 4}, group="false", mm="1" if q == "s*l stores" else "4<90%")
    want = [] if q == "s*l stores" else found
    scores = []
    for source in (None, index):
        ranked = X.search(docs, request, index=source).ranked.collect()
        assert sorted(r.id for r in ranked) == want, source
        scores.append({r.id: round(r.score, 9) for r in ranked})
    assert scores[0] == scores[1]


def test_filters_do_not_change_scores(docs):
    scored = lambda **more: {r.id: r.score for r in X.search(docs.withColumn("collection_ssim", F.array(F.col("_root_").cast("string"))), SearchRequest(q="ring", qf=QF, pf={}, group="false", **more)).ranked.collect()}
    assert scored(filters={"collection": ["3"]}) == {3: scored()[3]}


def test_search_reads_its_buckets_only(spark, docs, tmp_path):
    index = TermIndex(spark, str(tmp_path)).update(docs, ["title", "text"])
    plan = index.hits(["ring"], [], ["title"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(field), IsNotNull(term), EqualTo(field,title), EqualTo(term,ring)]" in plan.replace("[IsNotNull(term), IsNotNull(field), EqualTo(term,ring), EqualTo(field,title)]", "[IsNotNull(field), IsNotNull(term), EqualTo(field,title), EqualTo(term,ring)]")
    ranked = X.dismax(docs, SearchRequest(q="ring bolt", qf=QF, pf={}), index=index)
    text = ranked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    places = [line.split("[")[1] for line in text.splitlines() if line.startswith("Location")]
    assert places and all(str(tmp_path) in p for p in places) and "regexp" not in text.lower() and "InMemoryTableScan" not in text


def test_updates_replace_blocks(spark, tmp_path):
    rng, words = random.Random(1), ["red", "box", "boxes", "lid", "old", "letter"]
    live = {}
    index = TermIndex(spark, str(tmp_path))
    for step in range(4):
        changed = {(b, k): [" ".join(rng.choices(words, k=rng.randint(0, 4)))] for b in rng.sample(range(6), 3) for k in range(rng.randint(1, 3))}
        blocks = {b for b, _ in changed}
        removed = {rng.randint(0, 5)} - blocks
        live = {k: v for k, v in live.items() if k[0] not in blocks | removed} | changed
        rows = spark.createDataFrame([(f"{b}_{k}", b, t) for (b, k), t in changed.items()], "id string, _root_ long, title array<string>")
        index.update(rows, ["title"], removed=spark.createDataFrame([(b,) for b in removed], "b long"))
        if step == 2:
            index.compact().clean()
        now = TermIndex(spark, str(tmp_path))
        got = {(r.id, r.term): r["at"] for r in now.hits(["red", "box", "letter"], [], ["title"]).collect()}
        want = {}
        for (b, k), (t,) in live.items():
            for place, w in enumerate(t.split()):
                if stem(w) in ("red", "box", "letter"):
                    want.setdefault((f"{b}_{k}", stem(w)), []).append(place)
        assert got == want
        n = [len(t.split()) for (t,) in live.values() if t.split()]
        assert {r.field: (r.n, r.mean) for r in now.sizes(["title"]).collect()} == {"title": (len(n), sum(n) / len(n))}
        freq = {}
        for (t,) in live.values():
            for w in set(t.split()):
                freq[w] = freq.get(w, 0) + 1
        assert {r.term: r.freq for r in now.dictionary().collect()} == freq


def test_only_one_writer_commits(spark, docs, tmp_path):
    a, b = TermIndex(spark, str(tmp_path)), TermIndex(spark, str(tmp_path))
    a.update(docs, ["title"])
    with pytest.raises(RuntimeError):
        b.update(docs, ["title"])
    assert TermIndex(spark, str(tmp_path)).state["number"] == 1


def test_syntax_and_stems():
    assert all(map(has_syntax, ["a OR b", "NOT a", '"a b"', "(a", "a*", "?", "+a", "a -b", "a (-b)"])) and not any(map(has_syntax, ["a b", "a-b", "a - b", "or not", "AND-gate", ""]))
    words = ["stories", "story", "boxes", "glass", "gas", "bus", "toes", "shoes", "days", "ties", "movies", "is", "as"]
    assert all(w in stem_forms(stem(w)) for w in words)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_shortened_forms_meet_for_near_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 11))) for _ in range(250)]
    for a, b in itertools.combinations(words, 2):
        assert edits(a, b) > 2 or set(suggestions.shortened(a)) & set(suggestions.shortened(b)), (a, b)
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", suggestions.shortened_column(F.col("w")).alias("f"), gram_list(F.col("w")).alias("g"))
    for r in df.collect():
        assert sorted(r.f) == suggestions.shortened(r.w) and len(r.f) == len(set(r.f))
        assert set(pattern_grams(r.w[:4] + "*")) <= set(r.g)


def test_near_words_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(300)})
    texts = [(k, k, [" ".join(rng.choices(vocabulary, k=30))]) for k in range(40)]
    docs = spark.createDataFrame(texts, "id long, _root_ long, title_tesim array<string>")
    index = TermIndex(spark, f"{tmp_path}/i").update(docs, ["title_tesim"])
    spelling = suggestions.Spelling(index, f"{tmp_path}/s").build()
    freq = {}
    for _, _, (t,) in texts:
        for w in set(t.split()):
            freq[w] = freq.get(w, 0) + 1
    for asked in [*rng.sample(sorted(freq), 3), "abcabcabca", "zz"]:
        for popular in (True, False):
            want = sorted((-round(1 - edits(asked, w) / max(len(w), len(asked)), 6), -n, w) for w, n in freq.items() if w != asked and edits(asked, w) <= 2 and 1 - edits(asked, w) / max(len(w), len(asked)) >= 0.6 and (not popular or n > freq.get(asked, 0)))
            got = spelling.near(asked, "title", 1000, 0.6, popular).collect()
            assert [(-r.accuracy, -r.freq, r.term) for r in got] == want
    assert spelling.near("abcabcabca", "author").count() == 0


def test_suggestions_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(12)] + ["a" * 30, "a" * 30 + "b"]
    values = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(200)] + [None, ""]
    made = suggestions.Suggestions(spark, str(tmp_path)).build(spark.createDataFrame([(v,) for v in values], "v string").repartition(3), "v")
    for typed in ("a", "A b", "é", "ab a", "a" * 25, "a" * 31, "zz", f"{words[0]} {words[1]}"):
        *whole, last = fold(typed).split()
        fits = [v for v in values if v and set(whole) <= set(fold(v).split()) and any(w.startswith(last) for w in fold(v).split())]
        want = sorted({(-values.count(v), len(v), v) for v in fits})[:5]
        assert [(-r.weight, len(r.value), r.value) for r in made.suggest(typed).collect()] == want


def test_fragments_against_brute_force(spark):
    rng = random.Random(8)
    words = ["box", "Boxe", "Stories", "story", "lid", "Café", "x"]
    rows = [(k, ["".join(w + rng.choice([" ", ", ", " - "]) for w in rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 3))]) for k in range(60)]
    terms = ["stories", "cafe"]
    import re

    def brute(values):
        out = []
        for v in values:
            spans = [m.span() for m in re.finditer(r"\w+", v)]
            for k in range(0, len(spans), 6):
                own = spans[k : k + 6]
                begin, end = (0 if k == 0 else own[0][0]), (spans[k + 6][0] if k + 6 < len(spans) else len(v))
                text, found, at = "", [], begin
                for a, b in own:
                    hit = stem(fold(v[a:b])) in ("story", "cafe")
                    found += [stem(fold(v[a:b]))] * hit
                    text, at = text + v[at:a] + (f"<em>{v[a:b]}</em>" if hit else v[a:b]), b
                if found:
                    out.append((-len(set(found)), -len(found), len(out), (text + v[at:end]).strip(" ")))
        return [t for *_, t in sorted(out, key=lambda x: x[:3])[:2]]

    got = {r.id: r.f for r in spark.createDataFrame(rows, "id int, v array<string>").select("id", fragments.fragments(F.col("v"), terms, 6, 2).alias("f")).collect()}
    assert got == {k: brute(v) for k, v in rows}


def test_postings_are_packed_and_a_long_text_takes_linear_time(spark, tmp_path):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, k, " ".join(words)) for k in range(50)], "id long, _root_ long, text string").coalesce(1)
    index = TermIndex(spark, str(tmp_path)).update(docs, ["text"], grams=False)
    assert index._rows("postings").count() <= 300 * 4  # 15000 postings, in packs of a task
    assert sorted((int(r.id), r["at"]) for r in index.hits(["w7"], [], ["text"]).collect()) == [(k, [7]) for k in range(50)]
    assert sorted(r.word for r in index.words_like("w29?").collect()) == [f"w29{k}" for k in range(10)]


def test_a_scan_reads_the_texts_once(spark, docs):
    source = X.Scan(docs)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (source.hits(["ring"], [], ["title", "text"]), source.sizes(["title", "text"]))]
    assert all("translate" not in p and "split" not in p for p in plans)


def test_long_words_are_kept_under_few_forms(spark):
    made = spark.createDataFrame([("thingerbly",), ("short",)], "w string").select("w", F.size(suggestions.kept_forms(F.col("w"))).alias("n")).collect()
    assert {r.w: r.n for r in made} == {"thingerbly": 10, "short": 16}
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=rng.randint(4, 11))) for _ in range(250)]
    kept = {r.w: set(r.f) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", suggestions.kept_forms(F.col("w")).alias("f")).collect()}
    assert all(kept[b] & set(suggestions.asked_forms(a)) for a in words for b in words if edits(a, b) <= 2)
