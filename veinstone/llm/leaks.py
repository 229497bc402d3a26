"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every passage.

Items are cut into units of at most UNIT words. Impacts are BM25 contributions divided by the unit's own full score,
so a score is the share of a unit's weight that a passage holds, and one threshold serves all units. Every text is
cut into overlapping passages that are twice as long as the longest unit, so each unit-long stretch lies whole
inside one of them. A passage is searched only if its essential terms (those without which no unit can reach the
threshold) weigh enough; the rest is skipped by an upper bound, as in WAND itself. An item is reported when one of its
units is retrieved and the text holds OVERLAP of the word shingles of the whole item's question and of its answer.

The index holds one shard of the items at a time (SHARD_BYTES of item text at most), so what is sent to executors
is bounded; document frequencies cover all items and are added up on the cluster, and a shard brings only its own
terms' to the driver. Each shard reads the texts once more.

Defined cases: null and empty texts and items match nothing; an item of fewer than SHINGLE words says too little to be
found inside a text and matches texts that have just its words; equal items each match; texts and passages are never
cut short, and of a very long text only the shingles that candidates ask for are kept; a score on a threshold counts as
reached; repeated rows each get their own rows; several copies of an item in one text, or several units of it, give one
row with the best score; an empty table of texts or items has no leaks; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .licenses import words_of
from .scratch import Scratch

K1, B = 1.2, 0.75
UNIT, POSTINGS_BLOCK = 64, 32
#: Least share of a unit's BM25 weight in a passage, and least shares of its question's and answer's shingles.
RETRIEVE, OVERLAP, SHINGLE = 0.6, 0.5, 5
SHARD_BYTES = 16 << 20


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def split_item(text: str) -> tuple[list[bytes], int]:
    """The item's words and where its answer begins: after the last question mark, else in the middle."""
    words = words_of(text.encode())
    if "?" in text:
        cut = len(words_of(text[: text.rindex("?") + 1].encode()))
        if 0 < cut < len(words):
            return words, cut
    return words, len(words) // 2


class Item:
    """An item with the shingles of its question and of its answer."""

    def __init__(self, item_id: int, words: list[bytes], cut: int):
        self.item_id = item_id
        self.parts = [p for p in (shingles(words[:cut]), shingles(words[cut:])) if p]
        self.has_question = cut > 0

    def overlap(self, found: set[tuple[bytes, ...]]) -> tuple[float, float]:
        """Shares of the question and of the answer; a part without words is held by any text."""
        shares = [len(part & found) / len(part) for part in self.parts]
        return (shares[0] if self.has_question else 1.0), shares[-1]


class Unit:
    """A piece of an item, by the item's place in its list."""

    def __init__(self, item: int, words: list[bytes]):
        self.item, self.words, self.terms = item, words, set(words)


def cut_items(items: list[tuple[int, str]]) -> tuple[list[Item], list[Unit], dict[tuple[bytes, ...], list[int]]]:
    """Items and their units, and the items that are too short for the index by their words."""
    made, units, short = [], [], defaultdict(list)
    for item_id, text in items:
        words, cut = split_item(text or "")
        if len(words) < SHINGLE:
            if words:
                short[tuple(words)].append(item_id)
            continue
        pieces = max(1, round(len(words) / UNIT))
        units += [Unit(len(made), words[k * len(words) // pieces : (k + 1) * len(words) // pieces]) for k in range(pieces)]
        made.append(Item(item_id, words, cut))
    return made, units, dict(short)


def units_of(items: list[tuple[int, str]]) -> list[Unit]:
    return cut_items(items)[1]


class Index:
    """Postings sorted by unit, in blocks with their greatest impacts."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_units: int, mean_len: float, threshold: float = RETRIEVE):
        self.threshold = threshold
        self.items, self.units, self.short = cut_items(items)
        rows: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        essential: list[dict[bytes, float]] = []
        self.need: list[float] = []
        for u, unit in enumerate(self.units):
            norm = K1 * (1 - B + B * len(unit.words) / mean_len)
            gain = {w: math.log(1 + (n_units - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(unit.words).items()}
            total = sum(gain.values())
            gain = {w: g / total for w, g in gain.items()}
            for w, g in gain.items():
                rows[w].append((u, g))
            # The lightest terms together stay below half the threshold: a match must hold the other half in the rest.
            rest, light = dict(gain), 0.0
            for w, g in sorted(gain.items(), key=lambda x: (x[1], x[0])):
                if light + g >= threshold / 2 or len(rest) == 1:
                    break
                light += g
                del rest[w]
            essential.append(rest)
            self.need.append(threshold - light - 1e-9)
        self.postings = {w: ([u for u, _ in p], [g for _, g in p], [max(g for _, g in p[k : k + POSTINGS_BLOCK]) for k in range(0, len(p), POSTINGS_BLOCK)]) for w, p in rows.items()}
        self.most = {w: max(p[2]) for w, p in self.postings.items()}
        self.span = max((len(u.words) for u in self.units), default=1)
        # Essential postings as flat arrays, for the screen.
        self.code = {w: k for k, w in enumerate(sorted({w for e in essential for w in e}))}
        flat: list[list[tuple[int, float]]] = [[] for _ in self.code]
        for u, e in enumerate(essential):
            for w, g in e.items():
                flat[self.code[w]].append((u, g))
        self.first = np.cumsum([0] + [len(f) for f in flat])
        self.flat_unit = np.array([u for f in flat for u, _ in f], np.int64)
        self.flat_gain = np.array([g for f in flat for _, g in f], np.float64)
        self.need_array = np.array(self.need)

    def search(self, passage: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: every unit that scores the threshold or more."""
        lists = [[0, *self.postings[w], self.most[w]] for w in passage if w in self.postings]
        out, threshold = [], self.threshold - 1e-9
        while True:
            lists = [x for x in lists if x[0] < len(x[1])]
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[4]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == unit:
                pivot += 1
            block, ends = 0.0, []
            for x in lists[: pivot + 1]:
                at = bisect.bisect_left(x[1], unit, x[0])
                if at < len(x[1]):
                    block += x[3][at // POSTINGS_BLOCK]
                    ends.append(x[1][min(len(x[1]), (at // POSTINGS_BLOCK + 1) * POSTINGS_BLOCK) - 1])
            if block >= threshold:
                score = 0.0
                for x in lists[: pivot + 1]:
                    x[0] = bisect.bisect_left(x[1], unit, x[0])
                    if x[0] < len(x[1]) and x[1][x[0]] == unit:
                        score += x[2][x[0]]
                        x[0] += 1
                if score >= threshold:
                    out.append((unit, score))
            else:  # no unit up to the nearest block end can reach the threshold
                after = min([*ends, *(x[1][x[0]] - 1 for x in lists[pivot + 1 : pivot + 2])]) + 1
                for x in lists[: pivot + 1]:
                    x[0] = bisect.bisect_left(x[1], max(after, unit + 1), x[0])

    def screen(self, texts: list[list[bytes]]) -> dict[int, set[int]]:
        """text -> numbers of its passages in which some unit's essential terms weigh enough."""
        sizes = [len(words) for words in texts]
        at = np.fromiter(map(self.code.get, chain.from_iterable(texts), repeat(-1)), np.int64, sum(sizes))
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return {}
        starts = np.cumsum([0] + sizes)
        texts_at = np.searchsorted(starts, hit, side="right") - 1
        places, c = hit - starts[texts_at], at[hit]
        n = self.first[c + 1] - self.first[c]
        src = np.repeat(np.arange(len(c)), n)
        post = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + self.first[c][src]
        unit, gain = self.flat_unit[post], self.flat_gain[post]
        t, i = texts_at[src], places[src] // self.span
        out: dict[int, set[int]] = defaultdict(set)
        # Passage p covers the spans p and p + 1, so a term counts in passages i and i - 1.
        key_t, key_p, key_u = np.concatenate([t, t]), np.concatenate([i, np.maximum(i - 1, 0)]), np.concatenate([unit, unit])
        order = np.lexsort((key_u, key_p, key_t))
        key_t, key_p, key_u, gain = key_t[order], key_p[order], key_u[order], np.concatenate([gain, gain])[order]
        start = np.flatnonzero(np.r_[True, (np.diff(key_t) != 0) | (np.diff(key_p) != 0) | (np.diff(key_u) != 0)])
        total = np.add.reduceat(gain, start)
        for s in start[total >= self.need_array[key_u[start]]]:
            out[int(key_t[s])].add(int(key_p[s]))
        return out

    def match(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of each verified item, best values first."""
        for k, words in enumerate(texts if self.short else ()):
            if len(words) < SHINGLE:
                yield from ((k, item, 1.0, 1.0, 1.0) for item in sorted(set(self.short.get(tuple(words), ()))))
        for k, passages in self.screen(texts).items():
            words, scores = texts[k], {}
            for p in passages:
                for u, score in self.search(set(words[p * self.span : (p + 2) * self.span])):
                    at = self.units[u].item
                    scores[at] = max(scores.get(at, 0.0), score)
            asked: dict[int, set] = defaultdict(set)
            for part in (part for at in scores for part in self.items[at].parts):
                asked[len(next(iter(part)))] |= part
            found = set().union(*(some.intersection(zip(*(words[j:] for j in range(n)))) for n, some in asked.items()))
            best: dict[int, tuple] = {}
            for at, score in scores.items():
                q, a = self.items[at].overlap(found)
                if min(q, a) >= OVERLAP:
                    item = self.items[at].item_id
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
            for item, values in sorted(best.items()):
                yield (k, item, *values)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, units that hold it, 0) of each batch, and (null, units, their words)."""
    for batch in batches:
        units = units_of(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        df = Counter(w for unit in units for w in unit.terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *df], pa.binary()), pa.array([len(units), *df.values()], pa.int64()), pa.array([sum(len(u.words) for u in units)] + [0] * len(df), pa.int64())],
            ["term", "n", "words"],
        )


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """One index for each shard of the items. Statistics cover all items; a shard's text is bounded by SHARD_BYTES."""
    scratch = Scratch(items.sparkSession, "leaks")
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")
    rows, found = scratch.save_measured(rows, "items", size)
    shards = max(1, -(-(found["bytes"] or 0) // SHARD_BYTES))
    shape = "term binary, n long, words long"
    terms = scratch.save(rows.mapInArrow(_count_terms, shape).groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
    total = terms.where("term is null").first()
    for k in range(shards if total else 0):
        shard = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        own = shard.mapInArrow(_count_terms, shape).where("term is not null").select("term").distinct()
        df = {bytes(r.term): r.n for r in terms.join(own, "term", "left_semi").collect()}
        yield Index(sorted((r.item_id, r.text) for r in shard.collect()), df, total.n, total.words / max(1, total.n))


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text and test item that it contains."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    out = None
    for index in build_indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # at most SHARD_BYTES of item text

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    ids = part.column(0).to_pylist()
                    rows = list(sent.value.match([words_of(x.as_py()) for x in part.column(1)]))
                    cols = [[ids[r[0]] for r in rows], [r[1] for r in rows], *([round(r[c], 6) for r in rows] for c in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)], [x.split()[0] for x in SCHEMA.split(", ")])

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.select(F.col("doc_id"), F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap"))).where("false")


def _clean(sent):
    """Whether each text holds no item of the index that was sent."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for k in range(0, len(texts), 512):
            out[[k + r[0] for r in sent.value.match([words_of(x.as_py()) for x in texts.slice(k, 512)])]] = False
        return pa.array(out)

    return clean


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without any test item, with all their columns. Each row is judged on its own text, with no join."""
    out = docs
    for index in build_indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # at most SHARD_BYTES of item text
        out = out.where(_clean(sent)(F.col(text_col).cast("string").cast("binary")))
    return out
