"""Repeated passages: every byte that a string of WINDOW bytes covers which also starts in a document of a smaller id.

1. Anchors. A window's anchor is the least hash of its GRAM-byte parts, so equal windows have equal anchors wherever they
   stand, and one anchor serves a run of windows. Only anchors that occur in two different texts or more go on.
   Texts that another document has as a whole are out before: one text stands for all equal ones.
2. Contexts. Around each such anchor the bytes of its run of windows are cut out; equal contexts become one, with the
   smallest and largest id of their documents. All contexts of an anchor come to one shard.
3. Suffix order. Each shard sorts the suffixes of its contexts by external induced sorting (suffixes.Induced). Suffixes
   with WINDOW bytes in common with their neighbour are one class, and the class's smallest id decides its windows.
4. The decided windows of each context go back to all places of the context, and each document loses what they cover.

Null and empty texts lose nothing, nor do documents whose id is null, and they take nothing from others. Rows of one id are
one document as far as "smaller" goes; each is cut by its own text. Texts of any length are hashed in slabs. Repeated rows
give repeated results; an empty table gives no rows. Only the id and the text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .joins import join_counted
from .scratch import Scratch
from .suffixes import Induced, Spill

WINDOW, GRAM = 50, 19
#: Windows of one context at most, and bytes that are hashed at once; longer runs and texts come in several pieces.
PIECE, SLAB = 512, 1 << 22
#: Bytes of text that a task handles at once.
PIECE_BYTES = 1 << 22
#: Keys that are tried until no two texts share a name.
SALTS = 4
#: Bytes of text for each shard and each bucket of anchors.
SHARD, BUCKET = 1 << 23, 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray, size: int, at: int, n: int) -> np.ndarray:
    """Hashes of n strings from those of their first `at` bytes and of the `size` bytes behind."""
    power = np.uint64(pow(int(_ODD), size, 1 << 64))
    return left[:n] * power + right[at : at + n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    part, size, done, length, n = _TABLE[data], 1, None, 0, len(data) - GRAM + 1
    while size <= GRAM:
        if GRAM & size:
            done, length = (part, size) if done is None else (_joined(part, done, length, size, len(done) - size), length + size)
        if size * 2 <= GRAM:
            part = _joined(part, part, size, size, len(part) - size)
        size *= 2
    h = done[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size, out = 1, h
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, end of windows) of each run of windows, at most PIECE windows long; data holds all texts,
    text k from bounds[k] to bounds[k + 1], and windows are counted from the text's start."""
    found = [[np.empty(0, np.int64)] * 4]
    breaks = np.unique(np.concatenate([bounds, np.maximum(bounds[1:] - WINDOW + 1, bounds[:-1])]))
    for start in range(0, len(data) - WINDOW + 1, SLAB):
        least = _least(_gram_hashes(data[start : start + SLAB + WINDOW - 1]), WINDOW - GRAM + 1)
        change = np.r_[True, least[1:] != least[:-1]]
        change[breaks[np.searchsorted(breaks, start) : np.searchsorted(breaks, start + len(least))] - start] = True
        cut = np.flatnonzero(change)
        size = np.diff(np.r_[cut, len(least)])
        text = np.searchsorted(bounds, cut + start, side="right") - 1
        whole = cut + start + WINDOW <= bounds[text + 1]
        cut, size, text = cut[whole], size[whole], text[whole]
        pieces = -(-size // PIECE)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(cut, pieces) + within * PIECE
        end, text = np.minimum(first + PIECE, np.repeat(cut + size, pieces)), np.repeat(text, pieces)
        found.append([text, least[first].view(np.int64), first + start - bounds[text], end + start - bounds[text]])
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's texts in one array, and where each begins."""
    column = batch["text"]
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.empty(0, np.uint8) for x in column)


def _split(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of the values' bytes, cut at the given places."""
    size, values = values.dtype.itemsize, np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int64)), pa.py_buffer(values)])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PIECE_BYTES of text, at least one row each; the texts are not null."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    cut = [0, *(np.flatnonzero(np.diff(size // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cut, cut[1:]))


def _one_of_each(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of equal texts of a batch the one with the smallest id, in the order of the batch."""
    tag, doc = batch["tag"].to_numpy(), batch["doc"].to_numpy()
    o = np.lexsort((doc, tag))
    first = np.r_[True, tag[o][1:] != tag[o][:-1]]
    return batch if first.all() else batch.take(pa.array(np.sort(o[first])))


def _spread(n_buckets: int):
    """Anchors of a batch. One that several texts of the batch share is known, so its texts need no comparison with others."""

    def run(batches):
        for batch in (_one_of_each(piece) for whole in batches for piece in _pieces(whole)):
            row, h, _, _ = anchors(*_joined_texts(batch))
            if not len(h):
                continue
            o = np.argsort(h, kind="stable")
            sh, sr = h[o], row[o]
            change = np.r_[True, sh[1:] != sh[:-1]]
            new = change.copy()
            new[1:] |= sr[1:] != sr[:-1]
            cut = np.flatnonzero(change)
            # Rows ascend within an anchor, and each has a text of its own.
            several = np.repeat(np.minimum.reduceat(sr, cut) != np.maximum.reduceat(sr, cut), np.diff(np.r_[cut, len(h)]))
            known, first = np.flatnonzero(new & several), np.flatnonzero(np.where(several, change, new))
            tags, docs = batch["tag"].to_numpy(), batch["doc"].to_numpy()
            yield from _direct(sh[known], tags[sr[known]], docs[sr[known]])
            h, tag, known = sh[first], tags[sr[first]], several[first]
            bucket = (h.view(np.uint64) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
            o = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.r_[True, bucket[o][1:] != bucket[o][:-1], True])
            columns = [pa.array(bucket[o][at[:-1]].astype(np.int64)), pa.nulls(len(at) - 1, pa.int64()), pa.nulls(len(at) - 1, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [_split(x[o], at).cast(pa.binary()) for x in (h, tag, known.astype(np.uint8))], names=_SPREAD_NAMES)

    return run


_SPREAD_NAMES = ["bucket", "doc", "tag", "h", "tags", "known"]
_SPREAD = "bucket long, doc long, tag long, h binary, tags binary, known binary"


def _direct(h: np.ndarray, tag: np.ndarray, doc: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each text with its shared anchors, once each; h ascends. doc: where they were found, if in one document each."""
    if len(h):
        o = np.argsort(tag, kind="stable")
        h, tag = h[o], tag[o]
        once = np.r_[True, (tag[1:] != tag[:-1]) | (h[1:] != h[:-1])]
        h, tag = h[once], tag[once]
        at = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1], True])
        n = len(at) - 1
        docs = pa.nulls(n, pa.int64()) if doc is None else pa.array(doc[o][once][at[:-1]])
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), docs, pa.array(tag[at[:-1]]), _split(h, at).cast(pa.binary()), *[pa.nulls(n, pa.binary())] * 2], names=_SPREAD_NAMES)


def _shared(batches):
    """Of a partition's anchors those of two texts or more, as one row for each text."""
    held: dict[str, list] = {k: [] for k in ("h", "tags", "known")}
    for batch in batches:
        direct = batch.filter(pc.is_null(batch["bucket"]))
        if direct.num_rows:
            yield direct
        for row in batch.filter(pc.is_valid(batch["bucket"])).select(list(held)).to_pylist():
            for k, kind in (("h", np.int64), ("tags", np.int64), ("known", np.uint8)):
                held[k].append(np.frombuffer(row[k], kind))
    if not held["h"]:
        return
    h, tag, known = (np.concatenate(held.pop(k)) for k in ("h", "tags", "known"))
    o = np.argsort(h, kind="stable")
    h, tag, known = h[o], tag[o], known[o]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    some = (np.minimum.reduceat(tag, cut) != np.maximum.reduceat(tag, cut)) | (np.maximum.reduceat(known, cut) > 0)
    keep = np.repeat(some, np.diff(np.r_[cut, len(h)]))
    yield from _direct(h[keep], tag[keep])


_CONTEXTS = "h long, key binary, context binary, docs array<long>, tags array<long>, starts array<int>"


def _key(context: bytes) -> bytes:
    """A context's name; two different ones share it with a chance of 2^-128."""
    return hashlib.blake2b(context, digest_size=16).digest()


def _contexts(batches):
    """Different contexts of a batch with their places."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        found: dict[bytes, int] = {}
        owner, starts, rows, ids = [], [], [], []
        data, bounds = _joined_texts(batch)
        text, h, first, end = anchors(data, bounds)
        runs = np.searchsorted(text, np.arange(batch.num_rows + 1))
        raw = data.tobytes()
        for row, shared in enumerate(batch["shared"]):
            wanted = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in shared.values]))
            own = slice(runs[row], runs[row + 1])
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h[own]), len(wanted) - 1)] == h[own]) + runs[row]
            lo = first[hit]
            before = len(found)
            made = np.array([found.setdefault(raw[a:b], len(found)) for a, b in zip((lo + bounds[row]).tolist(), (end[hit] + bounds[row] + WINDOW - 1).tolist())], np.int64)
            fresh = np.flatnonzero(made >= before)
            ids.append(h[hit][fresh[np.unique(made[fresh], return_index=True)[1]]])
            owner.append(made)
            starts.append(lo)
            rows.append(np.full(len(lo), row))
        if found:
            owner, starts, rows = np.concatenate(owner), np.concatenate(starts).astype(np.int32), np.concatenate(rows)
            o = np.argsort(owner, kind="stable")
            at = pa.array(np.searchsorted(owner[o], np.arange(len(found) + 1)).astype(np.int32))
            nested = [pa.ListArray.from_arrays(at, pa.array(x[o])) for x in (batch["doc"].to_numpy()[rows], batch["tag"].to_numpy()[rows], starts)]
            keys = [_key(c) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(keys, pa.binary()), pa.array(list(found), pa.binary()), *nested], names=["h", "key", "context", "docs", "tags", "starts"])


def _decide(batches):
    """(context, windows from a to b, smallest id of a document that holds them), where it is below the context's largest id."""
    text, keys, low, high, sizes = Spill(), [], [], [], []
    for batch in batches:
        contexts = batch["context"]
        length = pc.binary_length(contexts).to_numpy().astype(np.int64)
        raw = np.frombuffer(contexts.buffers()[2], np.uint8)
        first = int(np.frombuffer(contexts.buffers()[1], np.int32)[contexts.offset])
        symbols = np.zeros(length.sum() + len(length), np.uint16)
        symbols[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = raw[first : first + length.sum()].astype(np.uint16) + 1
        text.append(symbols)
        keys += map(_key, contexts.to_pylist())
        low.append(batch["low"].to_numpy())
        high.append(batch["high"].to_numpy())
        sizes.append(length + 1)
    if not keys:
        return
    low, high, sizes = np.concatenate(low), np.concatenate(high), np.concatenate(sizes)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # The suffixes of less than WINDOW bytes are ordered, too, but are no windows; each has a smaller prefix in common with both neighbours.
    window = np.arange(n, dtype=np.int32) < (ends - WINDOW).astype(np.int32)[owner]
    cls, least, n_classes = np.zeros(n, np.int32), [], 0
    for block in Induced(text.mapped(np.uint16, n)).scan():
        block = block[window.take(block["at"])]
        if not len(block):
            continue
        at, ids, new = block["at"], low[owner[block["at"]]], block["lcp"] < WINDOW
        new[0] |= not least
        cls[at] = n_classes - 1 + np.cumsum(new)
        cut = np.flatnonzero(np.r_[True, new[1:]])
        mins = np.minimum.reduceat(ids, cut)
        if not new[0]:
            least[-1][-1] = min(least[-1][-1], mins[0])
            mins = mins[1:]
        if len(mins):
            least.append(mins)
            n_classes += len(mins)
    least = np.concatenate(least)
    for k in range(0, len(sizes), 8192):  # contexts at a time
        begin, stop = int(ends[k] - sizes[k]), int(ends[min(k + 8192, len(sizes)) - 1])
        at = begin + np.flatnonzero(window[begin:stop])
        own = owner[at]
        m = least[cls[at]]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (m[1:] != m[:-1])])
        last = np.r_[cut[1:], len(at)] - 1
        m, own, a, b = m[cut], own[cut], at[cut], at[last]
        hit = m < high[own]
        m, own, first = m[hit], own[hit], (ends - sizes)[own[hit]]
        yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in own.tolist()], pa.binary()), pa.array((a[hit] - first).astype(np.int32)), pa.array((b[hit] - first).astype(np.int32)), pa.array(m)], names=["key", "a", "b", "least"])


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for data, spans in zip(_bytes_of(batch["text"]), batch["spans"]):
                merged: list[list[int]] = []
                for s in sorted((x["s"], x["e"]) for x in (spans.as_py() or [])):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                keep = np.ones(len(data), bool)
                for s, e in merged:
                    keep[s:e] = False
                rows.append((len(data), merged, data[keep].tobytes() if merged else data.tobytes()))
            spans = pa.array([[{"start": s, "end": e} for s, e in m] for _, m, _ in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [batch["doc"], pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sum(e - s for s, e in m) for _, m, _ in rows], pa.int64()), pa.array([len(m) for _, m, _ in rows], pa.int64())]
            columns += [pa.array([hashlib.sha256(k).hexdigest() for _, _, k in rows], pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([k for _, _, k in rows], pa.binary())] * with_text, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text)

    return run


def _tag(digest: Column, salt: int) -> Column:
    """A text's name in 64 bits, from its SHA-256. _texts() sees to it that no two texts of a call share one."""
    return F.xxhash64(F.lit(salt), digest)


def _texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows (doc, tag, text); (tag, doc) of each text with the smallest id that has it; (doc, tag, n) of texts that a
    document of a smaller id has as a whole; the bytes of all texts."""
    for salt in range(SALTS):
        digest = F.sha2("text", 256)
        rows = docs.select("doc", _tag(digest, salt).alias("tag"), "text")
        measured = rows.select("doc", "tag", F.xxhash64(digest).alias("check"), F.octet_length("text").alias("n"))
        narrow, seen = scratch.save_measured(measured, f"digests{salt}", F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        narrow = narrow.where("doc is not null")
        groups = narrow.groupBy("tag").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n_rows"), (F.min("check") < F.max("check")).alias("clash"))
        texts, facts = scratch.save_measured(groups, f"texts{salt}", F.max("clash").alias("clash"), F.max(F.when(F.col("low") < F.col("high"), F.col("n_rows"))).alias("most"))
        if not facts["clash"]:
            break
    else:
        raise ValueError(f"different texts share a name under each of {SALTS} keys")
    equal = join_counted(narrow, texts.where("low < high"), ["tag"], seen["rows"], facts["most"]).where("doc > low").select("doc", "tag", "n").distinct()
    return rows, texts.select("tag", F.col("low").alias("holder")), scratch.save(equal, "equal"), seen["bytes"] or 0


def _shared_anchors(rows: DataFrame, holders: DataFrame, total: int) -> DataFrame:
    """(doc, tag, shared): the anchors that a text shares with other texts, where doc has the smallest id of those with the text."""
    spread = rows.mapInArrow(_spread(total // BUCKET + 64), _SPREAD).repartition(total // SHARD + 3, F.coalesce("bucket", "tag"))
    found = spread.mapInArrow(_shared, _SPREAD).select("doc", "tag", "h").join(holders, "tag").where("doc is null or doc = holder")
    return found.groupBy("tag", "holder").agg(F.collect_list("h").alias("shared")).select(F.col("holder").alias("doc"), "tag", "shared")


def _repeated_windows(contexts: DataFrame, total: int) -> DataFrame:
    """(key, a, b, least) of contexts: windows a to b also start in the document `least`."""
    n, low = total // SHARD + 3, F.array_min("docs")
    # What is sent is small: a shard's number instead of the anchor, many to a partition, and both ids' difference, mostly 0.
    sent = contexts.select(F.pmod("h", F.lit(32 * n)).cast("int").alias("shard"), "context", low.alias("low"), low.bitwiseXOR(F.array_max("docs")).alias("more")).repartition(n, "shard")
    same = sent.groupBy("shard", "context").agg(F.min("low").alias("low"), F.max(F.col("low").bitwiseXOR(F.col("more"))).alias("high"))
    return same.mapInArrow(_decide, "key binary, a int, b int, least long")


def _spans(contexts: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, tag, spans) of the places of the decided windows."""
    places = contexts.select("key", F.arrays_zip("docs", "tags", "starts").alias("places")).join(runs, "key").select(F.explode(F.filter("places", lambda p: p["docs"] > F.col("least"))).alias("p"), "a", "b")
    spans = places.select(F.col("p.docs").alias("doc"), F.col("p.tags").alias("tag"), F.struct((F.col("p.starts") + F.col("a")).alias("s"), (F.col("p.starts") + F.col("b") + WINDOW).alias("e")).alias("span"))
    return spans.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row, and the bytes that are left (kept) if asked for."""
    scratch = Scratch(docs.sparkSession, "repeats", tidy=True)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), text.cast("binary").alias("text"))
    rows, holders, equal, total = _texts(docs, scratch)
    long_enough = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= WINDOW))
    shared = scratch.save(_shared_anchors(long_enough, holders, total), "shared")
    contexts = scratch.save(long_enough.join(shared, ["doc", "tag"]).mapInArrow(_contexts, _CONTEXTS), "contexts", codec="zstd")
    scratch.drop("shared")
    runs = scratch.save(_repeated_windows(contexts, total), "runs")
    found = scratch.save(_spans(contexts, runs), "spans")
    scratch.drop("contexts", "runs")
    whole = equal.where(F.col("n") >= WINDOW).select("doc", "tag", F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e"))).alias("spans"))
    result = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * with_text
    return rows.join(found.unionByName(whole), ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(_cut(with_text), result).withColumnRenamed("doc", id_col)
