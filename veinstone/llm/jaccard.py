"""N-gram Jaccard join with a count-vector R-tree.

Two texts link when their sets of word shingles overlap by JACCARD or more (exact integer arithmetic).

1.  Every text's shingles are hashed to 64 bits under a key that is drawn anew for each call. Texts whose sets have the
    same 128-bit name are one class, which goes by its smallest doc_id.
2.  Each class gives its rarest tokens (so many that linked partners must share a few of them, the more the larger
    they are) as routing rows; tokens that are common in some batch come last in the order. Classes that meet on enough
    tokens, or on one token that many have, and are near enough in size, are tied by an edge, and the components of
    these edges are the clusters: no link leaves a cluster. The classes of a hot token (HOT times or more) are dealt to
    parts of some HOT classes, and nodes that stand for the token and a band of sizes tie the parts, so that no task
    gathers all rows of such a token.
3.  In each cluster, tokens are hashed into groups and the group counts are points of an R-tree, which is packed by the
    coordinates that spread most and whose nodes hold the greatest counts below them. The sum of coordinate minima
    bounds the overlap with a node or point; what passes is verified on the hashed sets, and a link then on the words
    themselves. Pairs that are already connected are skipped, so a large group of copies does not cost all its pairs. A
    cluster beyond CLUSTER classes or TOKENS tokens is dealt by size and hash, see deal().
4.  The links' components are the result.

Defined cases: null and empty texts, and texts of white space, have n_shingles 0 and stand alone; a text of fewer words
than a shingle has one, the whole sequence; very long texts are hashed in pieces; repeated rows each get a row with the
same component; different texts under one id are told apart unless that id is the smallest of both classes; rows with a
null id take the component of equal texts, or null, and link nothing else; an empty table has no rows; other columns
are ignored by the join and kept by keep_one().
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import components
from .scratch import Scratch

WORDS = 5
#: The threshold as a fraction: 75 / 100.
NUM, DEN = 75, 100
#: Bytes of text hashed at once; common tokens kept as a fixed-size list; least count in one batch to be common.
CHUNK, COMMON, REPEATED = 1 << 20, 1 << 18, 2
#: Ranges of tokens, by their highest bits, that are counted one after the other.
RANGES = 16
#: Times that a token was seen among others of its batch from which on its classes are dealt to parts of that size.
HOT = 2048
#: Runs of a routing token up to this length give all pairs, which count their votes; longer ones give stars, whose edges always hold.
#: A token that chance brings into some classes grows with the corpus: where its run makes a star, unrelated classes come
#: into one cluster, so only runs far beyond what chance brings may do so.
RUN, ENOUGH = 64, 1 << 40
#: Size limits of one group in one task, and rows in an R-tree leaf.
CLUSTER, TOKENS, LEAF = 512, 1 << 22, 32
#: 64-bit words of the fixed-size filter in front of the join that fetches sets.
FILTER_WORDS = 1 << 17

_STEP, _LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: The lowest 0 to 7 bytes of a lane; words beyond LONG_WORD bytes are hashed one by one.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
LONG_WORD = 256
#: Sizes that can link differ by a factor of DEN / NUM, so by one band at most; a little more guards the rounding.
_BAND = float(np.log(DEN / NUM + 0.01))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(line: bytes, key: int) -> np.ndarray:
    """One keyed hash for each word of a line whose words stand one space apart.

    Words of up to eight bytes and one length never collide; longer ones are chained eight bytes at a time.
    """
    out, at = [], 0
    while at < len(line):
        end = len(line)
        if end - at > CHUNK:  # cut at a space; only a word that is longer makes a longer piece
            end = line.rfind(b" ", at, at + CHUNK)
            end = line.find(b" ", at + CHUNK) if end < 0 else end
            end = len(line) if end < 0 else end
        piece = line[at:end] + bytes(8)
        gaps = np.flatnonzero(np.frombuffer(piece, np.uint8, end - at) == 32)
        first, stop = np.r_[0, gaps + 1], np.r_[gaps, end - at]
        size = stop - first
        lanes = np.ndarray((end - at + 1,), "<u8", piece, strides=(1,))
        h = _mix(size.astype(np.uint64) * _LENGTH + np.uint64(key))
        rows, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(rows):
            lane, left = lanes[first[rows] + 8 * k], size[rows] - 8 * k
            cut = left < 8
            lane[cut] &= _MASKS[left[cut]]
            h[rows] = _mix(h[rows] ^ lane)
            rows, k = rows[left > 8], k + 1
        for w in np.flatnonzero(size > LONG_WORD):
            h[w] = int.from_bytes(hashlib.blake2b(piece[first[w] : stop[w]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
        out.append(h)
        at = end + 1
    return np.concatenate(out)


def shingle_sets(texts: list[bytes | None], key: int = 0) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    lines = [b" ".join(t.lower().split()) if t else b"" for t in texts]
    k = 0
    while k < len(lines):
        some, size = [], 0
        while k < len(lines) and (not some or size + len(lines[k]) <= CHUNK):
            some.append(lines[k])
            size += len(lines[k]) + 1
            k += 1
        full = [x for x in some if x]
        if full:
            words = _word_hashes(b" ".join(full), key)
            ends = np.cumsum([x.count(b" ") + 1 for x in full])
            rolled = words[: max(0, len(words) - WORDS + 1)].copy()
            for j in range(1, WORDS):
                rolled = rolled * _STEP + words[j : j + len(rolled)]
            rolled = _mix(rolled)
        at = 0
        for line in some:
            if not line:
                out.append(np.empty(0, np.uint64))
                continue
            a, b = (int(ends[at - 1]) if at else 0), int(ends[at])
            at += 1
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            else:
                with np.errstate(over="ignore"):
                    h = np.uint64(b - a)
                    for w in words[a:b]:
                        h = h * _STEP + w
                out.append(_mix(np.array([h], np.uint64)))
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """A 128-bit name of the set as two numbers; nulls for the empty set."""
    if not len(tokens):
        return None, None
    with np.errstate(over="ignore"):
        n = np.uint64(len(tokens))
        sums = [_mix(_mix(tokens + np.uint64(c)) + n).sum(dtype=np.uint64) ^ n for c in (0x5851F42D4C957F2D, 0xA0761D6478BD642F)]
        return tuple(_mix(np.array(sums, np.uint64)).view(np.int64).tolist())


def same_words_link(a: bytes, b: bytes) -> bool:
    """Whether two texts link by the words of their shingles, without any hash."""
    both, number = [t.lower().split() for t in (a, b)], {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in both]
    if min(map(len, ids)) < WORDS:
        return both[0] == both[1] and len(both[0]) > 0
    # Runs of 1, 2, ... words are numbered one after the other, so that equal numbers are equal runs.
    code = np.concatenate(ids)
    for j in range(1, WORDS):
        parts = np.split(code, [len(ids[0]) - j + 1])
        pair = [p[:-1] * len(number) + own[j:] for p, own in zip(parts, ids)]
        code = np.unique(np.concatenate(pair), return_inverse=True)[1]
    left, right = (np.unique(p) for p in np.split(code, [len(ids[0]) - WORDS + 1]))
    return linked(left, right)


def need_of(n: int) -> int:
    """Tokens that a set of n must share with any partner: ceil(n * NUM / DEN)."""
    return -(-n * NUM // DEN)


def need_of_smaller(n: int) -> int:
    """Tokens that a set of n must share with any partner that is not smaller: ceil(2 n NUM / (NUM + DEN))."""
    return -(-2 * n * NUM // (NUM + DEN))


def shared_at_least(n):
    """Routing tokens that two linked classes share at least, by the smaller one's size: a longer prefix, more in common."""
    return 1 + n // 64


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether DEN * intersection >= NUM * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return DEN * same >= NUM * (len(a) + len(b) - same)


def _packed(points: np.ndarray) -> np.ndarray:
    """Each point's leaf: halves are cut at the median of the coordinate that spreads most, until LEAF points are left."""
    leaf, done, todo = np.zeros(len(points), np.int64), 0, [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaf[rows], done = done, done + 1
            continue
        widest = int(np.argmax(np.ptp(points[rows], axis=0)))
        rows = rows[np.argsort(points[rows, widest], kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        todo += [rows[half:], rows[:half]]
    return leaf


class CountTree:
    """An R-tree of group-count vectors: leaves of LEAF points at most, nodes of LEAF leaves, each with its greatest counts."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        groups = 1 << max(6, min(12, int(np.median(self.n)).bit_length()))
        shift = np.uint64(64 - groups.bit_length() + 1)
        points = np.zeros((len(sets), groups), np.uint16 if self.n.max(initial=0) < 65536 else np.uint32)
        for k, s in enumerate(sets):
            points[k] = np.bincount((s >> shift).astype(np.int64), minlength=groups)
        self.points = points if points.max(initial=0) > 255 else points.astype(np.uint8)
        self.leaf = _packed(self.points)
        order = np.argsort(self.leaf, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(self.leaf[order]) > 0])
        self.leaf_max = np.maximum.reduceat(self.points[order], starts, axis=0)
        self.node_max = np.maximum.reduceat(self.leaf_max, np.arange(0, len(starts), LEAF), axis=0)

    @staticmethod
    def bound(point: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.minimum(point, others).sum(axis=1, dtype=np.int64)

    def search(self, q: int, wanted: np.ndarray) -> np.ndarray:
        """The wanted points, none smaller than q, whose bound allows a link with point q, the most promising first."""
        least = need_of_smaller(int(self.n[q]))
        leaves = np.unique(self.leaf[wanted])
        nodes = np.unique(leaves // LEAF)
        nodes = nodes[self.bound(self.points[q], self.node_max[nodes]) >= least]
        leaves = leaves[np.isin(leaves // LEAF, nodes)]
        leaves = leaves[self.bound(self.points[q], self.leaf_max[leaves]) >= least]
        wanted = wanted[np.isin(self.leaf[wanted], leaves)]
        got = self.bound(self.points[q], self.points[wanted])
        ok = DEN * got >= NUM * (self.n[q] + self.n[wanted] - got)
        return wanted[ok][np.argsort(-got[ok], kind="stable")]


def cluster_links(sets: list[np.ndarray], side: np.ndarray | None = None, verify: Callable[[int, int], bool] = lambda q, r: True) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that are sorted by size; with sides, only of links between sides.

    Every pair that is not connected by the forest has been excluded by the tree's bound or by verification.
    """
    m, out, tree = len(sets), [], CountTree(sets)
    label = np.arange(m)
    for q in range(m - 1):
        # Partners that are not smaller and come later: sizes are sorted, so they are one stretch.
        stop = int(np.searchsorted(tree.n, tree.n[q] * DEN // NUM, side="right"))
        wanted = np.arange(q + 1, max(q + 1, stop))
        wanted = wanted[label[wanted] != label[q]]
        if side is not None:
            wanted = wanted[side[wanted] != side[q]]
        if not len(wanted):
            continue
        for r in tree.search(q, wanted):
            if label[r] != label[q] and linked(sets[q], sets[r]) and verify(q, r):
                out.append((q, int(r)))
                label[label == label[r]] = label[q]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))


def _pieces(batch: pa.RecordBatch, key: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of stretches of CHUNK bytes of text, or of one text that is longer: a batch's texts are not
    all copied at once."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        piece = batch.slice(at, stop - at)
        yield piece.column(0), shingle_sets(piece.column(1).to_pylist(), key)
        at = stop


def repeated_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that REPEATED or more of the sorted sets hold, ascending, and in how many; counted range by range, so that
    all the sets' tokens are not copied at once."""
    starts = np.arange(RANGES, dtype=np.uint64) * np.uint64(2**64 // RANGES)
    cuts = [np.r_[np.searchsorted(s, starts), len(s)] for s in sets]
    tokens, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k in range(RANGES if sets else 0):
        token, n = np.unique(np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]), return_counts=True)
        tokens.append(token[n >= REPEATED])
        times.append(n[n >= REPEATED].astype(np.int64))
    return np.concatenate(tokens), np.concatenate(times)


def _survey(secret: int) -> Callable:
    """Rows of (doc_id, n, key, key2), and rows of (token, times) for tokens that several texts of a batch share."""

    def rows(*cols: pa.Array) -> pa.RecordBatch:
        n = max(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else c for c in cols], ["doc_id", "n", "key", "key2", "token", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = {}  # copies do not make a token common
            for ids, sets in _pieces(batch, secret):
                keys = [set_key(s) for s in sets]
                once.update(zip(keys, sets))
                yield rows(ids, pa.array(map(len, sets), pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), None, None)
            token, times = repeated_tokens(list(once.values()))
            yield rows(None, None, None, None, pa.array(token.view(np.int64)), pa.array(times))

    return run


def _router(secret: int, common: np.ndarray, rank: np.ndarray, parts: np.ndarray) -> Callable:
    """common: sorted tokens; rank: their places among the common ones, rarest first; parts: into how many parts their
    classes are dealt, a power of two, so that parts of several tokens hold the same classes.

    Rows (token, key, size, hot): classes meet on a token, or on a part of a hot one, which hot names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, (_, sets) in ((seen, piece) for batch in batches for seen in [set()] for piece in _pieces(batch, secret)):
            rows = []
            for s in sets:
                n = len(s)
                if not n or (name := set_key(s)) in seen:
                    continue
                seen.add(name)
                key = name[0]
                more = shared_at_least(n)
                take, first = min(n, n - need_of(n) + more), n - need_of_smaller(n) + more
                part = None
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hit = common[at] == s
                    if hit.any():
                        order = np.argsort(rank[at[hit]], kind="stable")
                        s = np.concatenate([s[~hit], s[hit][order]])
                        part = np.concatenate([np.ones(n - len(order), np.int64), parts[at[hit]][order]])[:take]
                rows.append((s[:take], key, 2 * n, first, part))
            if not rows:
                continue
            sizes = [len(r[0]) for r in rows]
            token, key = np.concatenate([r[0] for r in rows]), np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
            # size: twice the set's size, plus 1 where no larger partner needs to meet it
            size = np.concatenate([r[2] + (np.arange(k) >= r[3]) for r, k in zip(rows, sizes)]).astype(np.int64)
            part = np.concatenate([np.ones(k, np.int64) if r[4] is None else r[4] for r, k in zip(rows, sizes)])
            hot, met = part > 1, token.copy()
            met[hot] = _mix(token[hot] + (key[hot] & (part[hot] - 1)).astype(np.uint64) * _LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(key), pa.array(size), pa.array(token.view(np.int64), mask=~hot)], ["token", "key", "size", "hot"])

    return run


def _pairs(token: np.ndarray, key: np.ndarray, size: np.ndarray, hot: np.ndarray, is_hot: np.ndarray, long_token: int | None) -> list[np.ndarray]:
    """Columns (a, b, votes, need) of complete runs of one token; size also says whether a row is indexed."""
    n, indexed = size // 2, (size & 1) == 0
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[start, len(token)])
    run, rows = np.repeat(np.arange(len(start)), length), np.arange(len(token))
    is_long = is_hot | (np.repeat(length, length) > RUN) | (token == long_token if long_token is not None else False)
    low, high, votes = [], [], []
    # Short runs: all pairs of an indexed row and a later one. Rows stand by size, so what is too large stays so.
    end, i = np.repeat(start + length, length), rows[~is_long & indexed]
    for d in range(1, RUN):
        i = i[i + d < end[i]]
        i = i[DEN * n[i] >= NUM * n[i + d]]
        if not len(i):
            break
        low, high, votes = [*low, i], [*high, i + d], [*votes, np.ones(len(i), np.int64)]
    # Long runs: a star around the first indexed row of each band of sizes, and an edge to the band before it. A row
    # before its band's star, if any, is tied to the last indexed row before it.
    centre = _centres(run, n, indexed)
    before = np.maximum.accumulate(np.where(indexed, rows, -1))
    prev = np.r_[-1, before[:-1]]
    p = np.maximum(prev, 0)
    own = is_long & (centre >= 0) & (centre < rows)
    j = rows[own | (is_long & (prev >= 0) & (run[p] == run) & (DEN * n[p] >= NUM * n))]
    i = np.where(own, centre, p)[j]
    low, high, votes = np.concatenate([*low, i]), np.concatenate([*high, j]), np.concatenate([*votes, np.full(len(j), ENOUGH)])
    a, b, need = key[low], key[high], shared_at_least(n[low])
    # Parts of a hot token: what has no star in its part, and each star's centre, is tied to the nodes of two bands of
    # sizes; a linked pair shares one, the larger one's.
    lone = rows[is_hot & ~own]
    for more in (0, 1):
        node = _mix(hot[lone].view(np.uint64) + (_bands(n[lone]) + more).astype(np.uint64) * _LENGTH).view(np.int64)
        a, b = np.r_[a, key[lone]], np.r_[b, node]
        votes, need = np.r_[votes, np.full(len(lone), ENOUGH)], np.r_[need, np.ones(len(lone), np.int64)]
    return [np.minimum(a, b), np.maximum(a, b), votes, need]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node of the component, node) of each other node of these edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[some]], nodes[some]


def _bands(n: np.ndarray) -> np.ndarray:
    return (np.log(n) / _BAND).astype(np.int64)


def _centres(run: np.ndarray, n: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    """The first indexed row of each row's run and band of sizes; -1 where there is none."""
    band = run * 4096 + _bands(n)
    at = np.flatnonzero(indexed)
    if not len(at):
        return np.full(len(run), -1)
    first = at[np.r_[True, np.diff(band[at]) != 0]]
    place = np.minimum(np.searchsorted(band[first], band), len(first) - 1)
    return np.where(band[first[place]] == band, first[place], -1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, votes, need) of classes that share a routing token, from rows sorted by (token, size, key)."""
    held, long_token = [*[np.empty(0, np.int64)] * 4, np.empty(0, bool)], None

    def made(cols: list[np.ndarray]) -> pa.RecordBatch:
        # Edges that always hold shrink to stars of the same components, so that a group's many tokens bring few edges.
        sure = cols[2] >= ENOUGH
        if sure.any():
            root, node = _stars(cols[0][sure], cols[1][sure])
            new = [root, node, np.full(len(root), ENOUGH), np.ones(len(root), np.int64)]
            cols = [np.r_[c[~sure], x] for c, x in zip(cols, new)]
        # Votes of one pair are added up here as far as they are in one batch.
        order = np.lexsort((cols[1], cols[0]))
        a, b, votes, need = (c[order] for c in cols)
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.add.reduceat(votes, first) if len(a) else votes), pa.array(need[first])], ["a", "b", "votes", "need"])

    for batch in batches:
        new = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), batch.column(3).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(3).is_valid())]
        cols = [np.concatenate([h, c]) for h, c in zip(held, new)]
        if not len(cols[0]):
            continue
        again = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        token, key, size, hot, is_hot = (c[np.r_[True, ~again]] for c in cols)
        # The last run may go on in the next batch: a short one waits; of a long one the last indexed row and the
        # centre of the last band do.
        last = int(np.searchsorted(token, token[-1]))
        if len(token) - last > RUN or token[-1] == long_token:
            yield made(_pairs(token, key, size, hot, is_hot, long_token))
            long_token = token[-1]
            indexed = (size[last:] & 1) == 0
            centre = _centres(np.zeros(len(indexed), np.int64), size[last:] // 2, indexed)[-1:]
            keep = last + np.unique(np.r_[centre[centre >= 0], np.flatnonzero(indexed)[-1:]])
        else:
            if last:
                yield made(_pairs(token[:last], key[:last], size[:last], hot[:last], is_hot[:last], long_token))
            keep = np.arange(last, len(token))
        held = [c[keep] for c in (token, key, size, hot, is_hot)]
    if len(held[0]):
        yield made(_pairs(*held, long_token))


def _join_groups(secret: int) -> Callable:
    """(a, b) for each member b of a group that links reach from its smallest member a, from rows (cluster, band, left,
    right, side, rep, key, key2, text) sorted by group, size and rep."""

    def close(group: list | None, rows: list[tuple]) -> list[tuple[int, int]]:
        # Texts travel, for they are smaller than their sets. A repeated id can bring a text of another set.
        sets = shingle_sets([r[3] for r in rows], secret)
        kept = [k for k in range(len(rows)) if set_key(sets[k]) == rows[k][2]]
        kept = [k for i, k in enumerate(kept) if not i or rows[k][1:3] != rows[kept[i - 1]][1:3]]
        if len(kept) < 2:
            return []
        side = None if group[2] == group[3] else np.array([rows[k][0] for k in kept])
        forest = cluster_links([sets[k] for k in kept], side, lambda q, r: same_words_link(rows[kept[q]][3], rows[kept[r]][3]))
        root = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for i, j in forest:
            a, b = sorted((top(rows[kept[i]][1]), top(rows[kept[j]][1])))
            root[b] = a
        return [(top(x), x) for x in root]

    def links_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            links, cols = [], [batch.column(i).to_pylist() for i in range(8)]
            for k, (*now, side, rep, key, key2) in enumerate(zip(*cols)):
                if now != group:
                    links += close(group, rows)
                    group, rows = now, []
                rows.append((side, rep, (key, key2), batch.column(8)[k].as_py()))
            yield links_of(links)
        yield links_of(close(group, rows))

    return run


def maybe_in(df: DataFrame, col: str, ids: DataFrame, id_col: str, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose value may be among ids: a filter of `words` 64-bit words, whatever the number of ids."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(words))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}, 1), 64) as int))")
    made = ids.where(F.col(id_col).isNotNull()).groupBy(slot(id_col).alias("_slot")).agg(F.bit_or(bit(id_col)).alias("_bits"))
    # At most `words` rows of 16 bytes are broadcast.
    return df.join(F.broadcast(made), slot(col) == F.col("_slot")).where(F.col("_bits").bitwiseAND(bit(col)) != 0).drop("_slot", "_bits")


def deal(members: DataFrame, cluster_limit: int, token_limit: int) -> DataFrame:
    """Members (rep, key, key2, n, cluster) with the groups (cluster, band, left, right) in which they meet their partners.

    A cluster within the limits is one group. A larger one is cut into bands of sizes, which only meet themselves and
    the next band, and a band that is still too large into blocks, dealt by hash. Groups with left = right compare all
    their members; others compare the two sides.
    """
    count = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")]
    blocks = F.ceil(F.greatest(F.col("m") / cluster_limit, F.col("t") / token_limit)).cast("int")
    kept = ["rep", "key", "key2", "n", "cluster"]
    over = members.groupBy("cluster").agg(*count).where(blocks > 1).select("cluster")
    zero = [F.lit(0).alias(c) for c in ("band", "left", "right", "side")]
    whole = members.join(over, "cluster", "left_anti").select(*kept, *zero)
    banded = members.join(over, "cluster", "left_semi").withColumn("band", F.floor(F.log("n") / F.lit(_BAND)).cast("int"))
    units = banded.groupBy("cluster", "band").agg(*count).select("cluster", "band", blocks.alias("blocks"))
    ahead = units.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next"))
    behind = units.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("prior"))
    units = units.join(ahead, ["cluster", "band"], "left").join(behind, ["cluster", "band"], "left")
    far = 1 << 20  # numbers of blocks of the next band start here
    own, block = F.col("blocks"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # A member meets every block of its own band, and every block of the bands on both sides. A whole band takes the
    # next band's members into its own group.
    at = lambda band, left, right, side: F.struct(band.cast("int").alias("band"), left.cast("int").alias("left"), right.cast("int").alias("right"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    none = F.array().cast("array<struct<band: int, left: int, right: int, side: int>>")
    here = F.col("band")
    homes = each(own, lambda o: at(here, F.least(F.col("block"), o), F.greatest(F.col("block"), o), F.col("block")))
    after = F.col("next")
    low = F.when((own > 1) | (after > 1), each(after, lambda o: at(here, F.col("block"), o + far, F.lit(0))))
    prior = F.col("prior")
    high = F.when((own > 1) | (prior > 1), each(prior, lambda o: at(here - 1, o, F.col("block") + far, F.lit(1)))).when(prior.isNotNull(), F.array(at(here - 1, F.lit(0), F.lit(0), F.lit(1))))
    places = F.concat(homes, F.coalesce(low, none), F.coalesce(high, none))
    dealt = banded.join(units, ["cluster", "band"]).withColumn("block", block).select(*kept, F.explode(places).alias("place")).select(*kept, "place.*")
    return whole.unionByName(dealt)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster_limit: int = CLUSTER, token_limit: int = TOKENS, hot: int = HOT) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id."""
    spark: SparkSession = docs.sparkSession
    scratch, secret = Scratch(spark, "jaccard"), secrets.randbits(63)
    texts = _texts(docs, id_col, text_col)
    survey = scratch.save(texts.mapInArrow(_survey(secret), "doc_id long, n long, key long, key2 long, token long, times long"), "survey")
    slim = survey.where("token is null").select("doc_id", "n", "key", "key2")

    # The commonest tokens, as a list of at most COMMON entries: the order need not be exact, only the same for all.
    parts = 64
    ranked = survey.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).selectExpr("token", "times", f"row_number() over (partition by pmod(token, {parts}) order by times desc, token) as place")
    common = ranked.where(F.col("place") <= COMMON // parts).select("token", "times").toArrow()
    tokens, times = (np.array(common.column(c).to_numpy(), np.int64) for c in ("token", "times"))
    by_count = np.lexsort((tokens, times))
    tokens, times = tokens[by_count].view(np.uint64), times[by_count]
    order = np.argsort(tokens)

    shares = 2 ** np.ceil(np.log2(np.maximum(1, times[order] / hot))).astype(np.int64)
    shares[times[order] >= hot] = np.maximum(2, shares[times[order] >= hot])
    routed = texts.mapInArrow(_router(secret, tokens[order], order, shares), "token long, key long, size long, hot long")
    edges = routed.repartition("token").sortWithinPartitions("token", "size", "key").mapInArrow(_meet, "a long, b long, votes long, need long")
    edges = edges.groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("need").alias("need")).where("votes >= need").select("a", "b")
    clusters = components(edges, scratch, "cluster")
    scratch.sweep()
    nodes = clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    nodes = nodes.unionByName(nodes.select(F.col("cluster").alias("key"), "cluster").distinct())
    reps = scratch.save(slim.where("key is not null and doc_id is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "reps")
    members = scratch.save(nodes.join(reps, "key"), "members")
    scratch.sweep()

    dealt = deal(members, cluster_limit, token_limit)
    fetched = maybe_in(texts, "doc_id", members, "rep").withColumnRenamed("doc_id", "rep").join(dealt, "rep")
    group = ["cluster", "band", "left", "right"]
    links = fetched.repartition(*group).sortWithinPartitions(*group, "n", "rep", "key", "key2").select(*group, "side", "rep", "key", "key2", "raw").mapInArrow(_join_groups(secret), "a long, b long")
    # A class goes by its smallest id, so the smallest class of a component names the component.
    roots = components(links, scratch, "link").withColumnsRenamed({"node": "rep", "root": "component_id"})
    scratch.sweep()
    names = reps.join(roots, "rep", "left").select("key", "key2", F.coalesce("component_id", "rep").alias("component_id"))
    out = slim.join(names, ["key", "key2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component, and rows with a null id, with all their columns."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
