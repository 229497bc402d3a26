"""Induced sorting and repeated passages against brute force."""

import glob
import hashlib
import random
import time

import numpy as np
from pyspark.sql import types as T

from veinstone.llm import repeats
from veinstone.llm.suffixes import CAP, Induced


def joined(strings):
    return np.concatenate([np.r_[np.frombuffer(s, np.uint8).astype(np.uint16) + 1, np.uint16(0)] for s in strings])


def brute_order(text):
    def key(i):
        end = i + int(np.argmax(text[i:] == 0))
        return [(int(x), 0) for x in text[i:end]] + [(0, end)]

    def common(a, b):
        k = 0
        while k < CAP and text[a + k] and text[a + k] == text[b + k]:
            k += 1
        return k

    order = sorted((i for i in range(len(text)) if text[i]), key=key)
    return order, [0] + [common(a, b) for a, b in zip(order, order[1:])]


def test_order_and_prefixes_at_any_memory():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choices(letters, k=80))
        strings = [bytes(rng.choices(letters, k=rng.randint(1, 90))) if rng.random() < 0.5 else base[rng.randint(0, 20) : rng.randint(30, 80)] for _ in range(rng.randint(1, 10))]
        text, memory = joined(strings), rng.choice([1, 3, 10, 1 << 20])
        blocks = list(Induced(text, memory, memory).scan())
        order, common = brute_order(text)
        assert np.concatenate([b["at"] for b in blocks])[::-1].tolist() == order
        assert np.concatenate([b["lcp"] for b in blocks])[1:][::-1].tolist() == common[1:]


def test_anchors_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(7)
    data = bytes(rng.choices(b"abcd ", k=700)) + b"x" * 900 + bytes(rng.choices(b"abcd ", k=300)) * 2
    whole = {}
    one = np.array([0, len(data)])
    text, h, first, end = repeats.anchors(np.frombuffer(data, np.uint8), one)
    assert not text.any() and first.tolist() == [0, *end[:-1].tolist()] and end[-1] == len(data) - repeats.WINDOW + 1 and (end - first).max() <= repeats.PIECE
    for a, lo, hi in zip(h.tolist(), first.tolist(), end.tolist()):
        for k in range(lo, hi):
            assert whole.setdefault(data[k : k + repeats.WINDOW], a) == a
    monkeypatch.setattr(repeats, "SLAB", 64)
    _, h, first, end = repeats.anchors(np.frombuffer(data, np.uint8), one)
    assert all(whole[data[k : k + repeats.WINDOW]] == a for a, lo, hi in zip(h.tolist(), first.tolist(), end.tolist()) for k in range(lo, hi))


    bounds = np.array([0, 3, 60, 60, 110, 159, len(data)])
    text, h, first, end = repeats.anchors(np.frombuffer(data, np.uint8), bounds)
    for k in range(6):
        own = text == k
        assert (end - first)[own].sum() == max(0, bounds[k + 1] - bounds[k] - repeats.WINDOW + 1)
        assert all(whole[data[bounds[k] + j : bounds[k] + j + repeats.WINDOW]] == a for a, lo, hi in zip(h[own].tolist(), first[own].tolist(), end[own].tolist()) for j in range(lo, hi))


def brute_repeats(rows, width=50):
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - width + 1) if i is not None else ():
            w = data[k : k + width]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - width + 1) if i is not None else ():
            if least[data[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_repeats_small(spark):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choices("abcdefg éß\n", k=n))
    passage, long = part(60), part(300)
    rows = [(9, None), (8, ""), (7, "x" * 49), (6, "x" * 50), (5, "x" * 700), (4, "x" * 2000), (None, long), (3, long), (2, part(30) + passage + part(40)), (1, passage[1:] + part(80) + passage)]
    rows += [(20 + k, part(rng.randint(0, 60)) + passage[rng.randint(0, 8) :] + long[rng.randint(0, 200) :]) for k in range(12)] + [(3, long + passage), (3, long), (40, long), (41, long), (42, passage + passage)]
    schema = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("h", T.StringType()).add("key", T.StringType())
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], schema).repartition(3)
    made = repeats.remove_repeats(docs, with_text=True)
    assert result(made) == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_removed == sum(s.end - s.start for s in r.spans) for r in made.collect())
    assert result(repeats.remove_repeats(docs.limit(0))) == []


def test_repeats_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(repeats.remove_repeats(docs)) == brute_repeats(rows)


def test_repeats_with_disk_and_recursion(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abc", k=4)) for _ in range(6)]
    rows = [(k, " ".join(rng.choices(words, k=60))) for k in range(30)]
    monkeypatch.setattr(repeats, "Induced", lambda text: Induced(text, 16, 16))
    batch = repeats.pa.RecordBatch.from_pylist([{"context": t.encode(), "low": k, "high": k} for k, t in rows], repeats.pa.schema([("context", repeats.pa.binary()), ("low", repeats.pa.int64()), ("high", repeats.pa.int64())]))
    number = {repeats._key(t.encode()): k for k, t in rows}
    found = {(number[r["key"]], w): r["least"] for b in repeats._decide([batch]) for r in b.to_pylist() for w in range(r["a"], r["b"] + 1)}
    least = {}
    for k, t in rows:
        for w in range(len(t) - 49):
            least.setdefault(t[w : w + 50], k)
    assert found == {(k, w): least[t[w : w + 50]] for k, t in rows for w in range(len(t) - 49) if least[t[w : w + 50]] < k}


def test_order_with_all_bytes_and_long_common_prefixes():
    rng = random.Random(13)
    base = bytes(rng.choices(range(256), k=120))
    for letters in (bytes(range(256)), bytes(range(254)), b"\x00\xff"):
        strings = [letters, *(base[k:] for k in range(0, 24)), *(base[:k] for k in range(1, 70, 3)), bytes(rng.choices(letters, k=90))]
        text = joined(strings)
        blocks = list(Induced(text, 50, 50).scan())
        order, common = brute_order(text)
        assert np.concatenate([b["at"] for b in blocks])[::-1].tolist() == order
        assert np.concatenate([b["lcp"] for b in blocks])[1:][::-1].tolist() == common[1:]


def test_anchors_of_equal_texts_alone_do_not_go_on(spark, monkeypatch):
    """Before, every context of a text with copies was cut out, sent and sorted, though nothing else shares it."""
    rng = random.Random(17)
    part = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    copied, passage, seen, save = part(3000), part(200), {}, repeats.Scratch.save

    def counted(self, df, name, **options):
        out = save(self, df, name, **options)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(repeats.Scratch, "save", counted)
    schema = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType())
    rows = [(k, copied) for k in range(9)] + [(20 + k, part(400)) for k in range(4)]
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, schema).repartition(3))) == brute_repeats(rows)
    assert seen["contexts"] == 0
    rows += [(3, passage + part(90)), (30, part(80) + passage), (31, copied[1000:1300] + part(50)), (2, copied[:1200] + part(10))]
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, schema).repartition(3))) == brute_repeats(rows)
    assert seen["contexts"] > 0


def test_texts_that_share_a_name_get_others(spark, monkeypatch):
    tag, salts = repeats._tag, []

    def clashing(digest, salt):
        salts.append(salt)
        return repeats.F.lit(7).cast("long") if salt == 0 else tag(digest, salt)

    monkeypatch.setattr(repeats, "_tag", clashing)
    rows = [(1, "a passage that stands in two documents, whatever their names may be. " + "x" * 9), (2, "a passage that stands in two documents, whatever their names may be. " + "y" * 70), (3, "z" * 80)]
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)
    assert salts == [0, 1]


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark):
    """Before, they stayed until a later collection of the JVM's garbage found nothing that held them."""
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, passage = files(), "one passage that stands in every one of these few documents, " * 2
    rows = [(k, f"{k} {passage} {k * k}") for k in range(9)]
    made = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    end = time.time() + 5
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert result(made) == brute_repeats(rows) == result(made)
