"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one vector of hashed-text weights is shared by all grades, and ordered
thresholds cut its score. The expected grade and the tail probability P(grade >= top) come from the same model.

Training reads at most SAMPLE labelled rows, those with the smallest hash of their id; scoring reads every row.

Defined cases: a null text counts as empty; an empty text has no features and gets the thresholds' prior; without
labelled rows every row is kept; different labels of one id each count, equal ones once, and of several texts of one
labelled id the least is used; repeated rows each get their own row; null grades are not used; a tail probability on
the cut is kept; a very long text is read whole; an empty table has no rows; other columns are ignored by score() and
kept by select_quality().
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BITS, SAMPLE, GRADES, FOLDS = 17, 8000, 3, 5
#: Steps of the optimiser and weight of the penalty.
STEPS, DECAY = 80, 3e-4
#: Share of good held-out rows that the decision keeps at least.
KEEP_GOOD = 0.995
_SIZE = 1 << BITS
_SHAPES, _OTHER = 1 << 12, 64  # the last slots hold word shapes and text measures


def _shape(word: str) -> int:
    """A slot for the word's pattern of letter cases, digits and punctuation, runs collapsed."""
    out = []
    for c in word[:2] + word[-6:]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return _SIZE + zlib.crc32("".join(out).encode()) % _SHAPES


#: Words whose slots are kept. A worker process lives on after its task, so what it keeps adds to all later stages' memory.
CACHED = 1 << 16
_cache: dict[str, tuple[int, int]] = {}


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: word presence, shares of word shapes, and measures of repetition and length."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts, values = Counter(words), {}
    for w, n in counts.items():
        if (slots := _cache.get(w)) is None:
            if len(_cache) >= CACHED:
                _cache.clear()
            slots = _cache[w] = (zlib.crc32(w.lower().strip(".,;:!?").encode()) & (_SIZE - 1), _shape(w))
        values[slots[0]] = 0.2
        values[slots[1]] = values.get(slots[1], 0.0) + 4.0 * n / len(words)
    base = _SIZE + _SHAPES
    values[base + min(9, int(10 * (1 - len(counts) / len(words))))] = 1.0
    values[base + 10 + min(20, len(words).bit_length())] = 0.3
    values[base + 40] = 2.0 * max(counts.values()) / len(words)
    return np.fromiter(values.keys(), np.int32, len(values)), np.fromiter(values.values(), np.float32, len(values))


@dataclass
class OrdinalModel:
    """weights over the slots, ordered thresholds, the least tail probability that is kept, and the share of held-out rows of each grade that it rejects."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0
    rejected: dict[int, float] = field(default_factory=dict)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))

    def score_rows(self, rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([float(self.weights[i] @ v) if len(i) else 0.0 for i, v in rows], np.float64)


class Objective:
    """The weighted ordinal negative log-likelihood with a quadratic penalty, over a sparse table of features.

    Parameters: the weights, the first threshold, and the logarithms of the gaps to the next ones, which keep them ordered.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, dim: int, n_grades: int, decay: float):
        self.n, self.dim, self.decay, self.m, self.grades = len(rows), dim, decay, n_grades - 1, grades
        self.own = np.repeat(np.arange(self.n), [len(i) for i, _ in rows])
        self.idx, self.val = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        by_slot = np.argsort(self.idx, kind="stable")
        self.back_own, self.back_val = self.own[by_slot], self.val[by_slot]
        self.slots, self.starts = np.unique(self.idx[by_slot], return_index=True)
        rare = np.array([1 / max(1, np.sum(grades == k)) ** 0.5 for k in range(n_grades)])[grades]
        self.weight = rare / rare.sum()

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = x[: self.dim], x[self.dim :]
        s = np.bincount(self.own, w[self.idx] * self.val, self.n)
        theta = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        below = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None], -30, 30)))  # P(grade <= k)
        low, high = np.c_[np.zeros(self.n), below], np.c_[below, np.ones(self.n)]
        y, at = self.grades, np.arange(self.n)
        p = np.maximum(high[at, y] - low[at, y], 1e-9)
        dh, dl = high[at, y] * (1 - high[at, y]), low[at, y] * (1 - low[at, y])
        g = self.weight / p
        dtheta = np.array([-np.sum(g * (dh * (y == j) - dl * (y == j + 1))) for j in range(self.m)])
        graw = np.r_[dtheta.sum(), [dtheta[j + 1 :].sum() * np.exp(raw[j + 1]) for j in range(self.m - 1)]]
        gw = self.decay * w
        if len(self.slots):
            gw[self.slots] += np.add.reduceat((g * (dh - dl))[self.back_own] * self.back_val, self.starts)
        return float(-np.sum(self.weight * np.log(p)) + self.decay * (w @ w) / 2), np.concatenate([gw, graw])


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -grad, []
        for s, y in reversed(past):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, y), a in zip(past, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = grad @ d, 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
        if slope > -1e-12:
            break
        for _ in range(30):
            new_value, new_grad = f(x + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_grad - grad
        if s @ y > 1e-14:
            past = [*past, (s, y)][-memory:]
        x, value, grad = x + s, new_value, new_grad
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, steps: int = STEPS, decay: float = DECAY) -> OrdinalModel:
    """Minimises the objective over the rows. Slots of few rows keep weight 0: they would learn single documents by heart."""
    full, m = _SIZE + _SHAPES + _OTHER, n_grades - 1
    used = np.flatnonzero(np.bincount(np.concatenate([i for i, _ in rows]), minlength=full) >= max(2, min(10, len(rows) // 300))) if len(rows) else np.empty(0, int)
    place, dim = np.full(full, -1), len(used)
    place[used] = np.arange(dim)
    share = np.clip([np.mean(grades <= k) if len(grades) else 0.5 for k in range(m)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(dim), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    if len(rows):
        rows = [(place[i][on], v[on]) for i, v in rows for on in [place[i] >= 0]]
        x = minimise(Objective(rows, grades, dim, n_grades, decay), x, steps)
    weights, raw = np.zeros(full, np.float32), x[dim:]
    weights[used] = x[:dim]
    return OrdinalModel(weights, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def calibrate(model: OrdinalModel, tail: np.ndarray, grades: np.ndarray, top: int = GRADES - 1) -> OrdinalModel:
    """Sets the cut from held-out rows' tail probabilities and notes the share of each grade that it rejects.

    KEEP_GOOD of the top grade bounds the cut from above. Below that bound it lies halfway down to the highest row of a
    lower grade, so that it rejects as many of those as the bound does. Without such a row it is one half at most."""
    if np.any(grades == top):
        bound = np.quantile(tail[grades == top], 1 - KEEP_GOOD)
        below = tail[(grades < top) & (tail < bound)]
        model.cut = float((below.max() + bound) / 2 if len(below) else min(0.5, bound))
        model.rejected = {int(k): float(np.mean(tail[grades == k] < model.cut)) for k in np.unique(grades)}
    return model


def fit_folds(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> tuple[OrdinalModel, np.ndarray]:
    """The model of all rows, and each row's tail probability by a model that was fitted on the other folds.

    Every model is a task of its own; the rows that are sent are bounded by the sample.
    """
    sent = spark.sparkContext.broadcast((rows, grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, known = sent.value
        fold = np.arange(len(some)) % FOLDS
        for batch in batches:
            for k in batch.column(0).to_pylist():
                model = fit([r for r, f in zip(some, fold) if f != k], known[fold != k])
                held = [r for r, f in zip(some, fold) if f == k]
                tail = model.tails(model.score_rows(held))[:, -1] if held else np.empty(0)
                cols = [[k], [model.weights.tobytes() if k == FOLDS else None], [model.thresholds.tobytes()], [tail.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["k", "weights", "thresholds", "tail"])

    got = {r.k: r for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).toDF("k").mapInArrow(run, "k long, weights binary, thresholds binary, tail binary").collect()}
    sent.destroy()
    tail = np.zeros(len(rows))
    for k in range(FOLDS):
        tail[np.arange(len(rows)) % FOLDS == k] = np.frombuffer(got[k].tail)
    return OrdinalModel(np.frombuffer(got[FOLDS].weights, np.float32), np.frombuffer(got[FOLDS].thresholds)), tail


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: good but toxic; 2: good. Null where the quality is null."""
    return F.when(quality == 0, 0).when(quality.isNotNull() & (F.coalesce(toxic, F.lit(0)) == 1), 1).when(quality.isNotNull(), 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most `sample` labelled rows; models of all folds but one give the tails that calibrate the cut."""
    chosen = labels.select(F.col("doc_id").alias("_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("_id is not null and grade is not null")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["_id", "grade", "slots", "vals"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # One row for each labelled id and grade, so at most `sample` rows are trained on and collected.
    rated = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "grade").agg(F.min("text").alias("text")).select("_id", "text", "grade")
    got = sorted(rated.mapInArrow(run, "_id long, grade int, slots binary, vals binary").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    rows = [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32)) for r in got]
    grades = np.array([r.grade for r in got], int)
    model, tail = fit_folds(docs.sparkSession, rows, grades)
    return calibrate(model, tail, grades)


SCHEMA = "doc_id long, expected_grade double, tail_probability double, keep boolean"


def _judge(model: OrdinalModel, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tails = model.tails(model.score_rows(text_features(x.as_py()) for x in texts))
    return tails.sum(axis=1), tails[:, -1], tails[:, -1] >= model.cut


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: expected grade, probability of the top grade, and whether it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade, tail, keep = _judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(tail), pa.array(keep)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def select_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows that the model keeps, with all their columns."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array(_judge(model, texts)[2], pa.bool_())

    return docs.where(kept(F.col(text_col).cast("string")))
