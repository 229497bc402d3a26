"""Suffix order and common prefixes of many strings by external induced sorting.

The strings stand one after the other in one text of symbols, each ended by the symbol 0; two ends never compare as equal,
the one further left is the smaller. A suffix is "small" if it is smaller than the one that starts one symbol later,
else "large"; a star is a small suffix behind a large one. The substrings from star to star get names, the string of names
is sorted by recursion, and the order of the stars induces that of all large suffixes (symbols ascending) and then of all
small ones (symbols descending). What waits for its turn stands in queues that are kept on disk beyond a given size; a
tuple carries its position and the prefix that it has in common with the tuple before it, up to CAP symbols.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Common prefixes are followed up to so many symbols.
CAP = 50
#: Names that are sorted in memory, without another level of recursion (some 100 MB), and tuples of a queue in memory.
BASE, QUEUED = 1 << 22, 1 << 19
#: Symbols that are counted at once.
SLICE = 1 << 20
_TUPLE = np.dtype([("at", "<i4"), ("lcp", "u1")])


class Spill:
    """Arrays in an unnamed file of the task, which is gone when the task ends and which nothing else reads."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def append(self, part: np.ndarray) -> tuple[int, int]:
        start = self.file.seek(0, 2)
        part.tofile(self.file)
        return start, len(part)

    def read(self, start: int, n: int, dtype) -> np.ndarray:
        self.file.seek(start)
        return np.fromfile(self.file, dtype, n)

    def mapped(self, dtype, n: int) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, dtype, "r+", shape=(n,))) if n else np.empty(0, dtype)


class Queue:
    """A priority queue of suffixes by (first symbol, rank of the suffix behind it).

    Suffixes are pushed in the order of the rank behind them, so each symbol's tuples are kept in the order of their
    arrival. Beyond `memory` tuples all go to the file, in blocks of one symbol each.
    """

    def __init__(self, memory: int):
        self.memory, self.n, self.disk = memory, 0, None
        self.blocks: dict[int, list] = defaultdict(list)

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """symbols: ascending."""
        if not len(symbols):
            return
        cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            self.blocks[int(symbols[a])].append(tuples[a:b])
        self.n += len(symbols)
        if self.n > self.memory:
            self.disk = self.disk or Spill()
            for symbol, held in self.blocks.items():
                new = [x for x in held if isinstance(x, np.ndarray)]
                if new:
                    self.blocks[symbol] = [x for x in held if not isinstance(x, np.ndarray)]
                    joined = np.concatenate(new)
                    self.blocks[symbol] += [self.disk.append(joined[k : k + self.memory]) for k in range(0, len(joined), self.memory)]
            self.n = 0

    def _load(self, block) -> np.ndarray:
        return block if isinstance(block, np.ndarray) else self.disk.read(*block, _TUPLE)

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """What waits under a symbol, also what is pushed under it meanwhile."""
        while waiting := self.blocks.pop(symbol, None):
            held = [x for x in waiting if isinstance(x, np.ndarray)]
            self.n -= sum(map(len, held))
            yield from (self._load(x) for x in waiting if not isinstance(x, np.ndarray))
            if held:
                yield np.concatenate(held)

    def pop_backwards(self, symbol: int) -> Iterator[np.ndarray]:
        for block in reversed(self.blocks.pop(symbol, [])):
            yield self._load(block)


def refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits groups of equal rank (a rank is the number of smaller ones) by a key; what is still tied, and its ranks' starts."""
    now = rank[live]
    if now.max() == now.min():
        o = np.argsort(key)
    elif len(rank) < 1 << 31 and key.max() < 1 << 32:
        o = np.argsort((now.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64))
    else:
        o = np.lexsort((key, now))
    live, key = live[o], key[o]
    old, at = rank[live], np.arange(len(live))
    change = np.r_[True, old[1:] != old[:-1]]
    group = np.maximum.accumulate(np.where(change, at, 0))
    change[1:] |= key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(change, at, 0))
    rank[live] = old + (start - group)
    tied = ~change | ~np.r_[change[1:], True]
    return live[tied], change[tied]


def symbols_of(text: np.ndarray) -> np.ndarray:
    """A text's different symbols in their order."""
    if text.dtype.itemsize > 2:
        return np.unique(text)
    count = np.zeros(1 << 8 * text.dtype.itemsize, np.int64)
    for k in range(0, len(text), SLICE):
        count += np.bincount(text[k : k + SLICE], minlength=len(count))
    return np.flatnonzero(count).astype(text.dtype)


def dense(text: np.ndarray) -> np.ndarray:
    """The text with its symbols renumbered in their order, in one byte each, if they are few enough to leave 255 free."""
    if text.dtype.itemsize > 2:
        return text
    used = np.zeros(1 << 8 * text.dtype.itemsize, bool)
    used[symbols_of(text)] = used[0] = True
    return (np.cumsum(used) - 1).astype(np.uint8)[text] if used.sum() < 256 else text


class Words:
    """The symbols from any position on, as many as 64 bits hold, the first in the highest bits; zeros behind the text."""

    def __init__(self, text: np.ndarray):
        size = text.dtype.itemsize
        self.bits, self.each = size * 8, 8 // size
        padded = np.zeros((len(text) // self.each + 2) * self.each + (CAP // self.each + 1) * self.each, f">u{size}")
        padded[: len(text)] = text
        self.aligned = padded.view(">u8").astype(np.uint64)

    def at(self, position: np.ndarray) -> np.ndarray:
        power = self.each.bit_length() - 1
        shift = ((position & (self.each - 1)) * self.bits).astype(np.uint64)
        i = position >> power
        return (self.aligned.take(i) << shift) | (self.aligned.take(i + 1) >> np.uint64(1) >> (np.uint64(63) - shift))


def names(words: Words, stars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ranks of the substrings of these lengths, equal for equal ones; behind its end a substring counts as larger than any symbol."""
    full = np.uint64((1 << 64) - 1)
    rank, live, done = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    while len(live):
        inside = np.clip(length[live] - done, 0, words.each)
        # A substring that has ended needs no symbols, and some that have are far from the text's end.
        word = words.at(np.where(inside > 0, stars[live] + done, 0))
        short = np.flatnonzero(inside < words.each)
        word[short] |= full >> (inside[short] * words.bits).astype(np.uint64)
        done += words.each
        live, change = refine(rank, live, word)
        if len(live):
            more = np.logical_or.reduceat(length[live] > done, np.flatnonzero(change))
            live = live[more[np.cumsum(change) - 1]]
    return rank


def doubled(rank: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a string of ranks in which each suffix has a symbol of its own before it ends."""
    order = np.argsort(rank, kind="stable")
    tie = np.r_[False, rank[order][1:] == rank[order][:-1]]
    live, h = order[tie | np.r_[tie[1:], False]], 1
    while len(live):
        live, _ = refine(rank, live, rank[live + h])
        h *= 2
    return rank


class Induced:
    """One level of the recursion: scan() gives blocks (positions, common prefix with the one before) from the largest suffix down."""

    def __init__(self, text: np.ndarray, memory: int = QUEUED, base: int = BASE, prefixes: bool = True):
        self.text = text = dense(text)
        self.words, self.memory, self.base, self.prefixes = Words(text), memory, base, prefixes
        n, at = len(text), np.arange(len(text), dtype=np.int32)
        end = text == 0
        # An end counts as smaller than what follows it; a run of one symbol takes the type of its last one.
        rises, differs = np.r_[text[:-1] < text[1:], True] | end, np.r_[text[:-1] != text[1:], True] | end
        follow = np.minimum.accumulate(np.where(differs, at, np.int32(n - 1))[::-1])[::-1]
        self.small = rises[follow]
        is_star = self.small & ~np.r_[True, self.small[:-1]]
        self.stars = np.flatnonzero(is_star)
        self._sort_stars(end)

    def _sort_stars(self, end: np.ndarray) -> None:
        stars = self.stars
        ends = end[stars]
        n_ends = int(ends.sum())
        inner = np.flatnonzero(~ends)
        behind = np.r_[stars[1:], 0]
        rank = np.empty(len(stars), np.int64)
        rank[ends] = np.arange(n_ends)
        rank[inner] = n_ends + names(self.words, stars[inner], behind[inner] - stars[inner] + 1)
        if len(stars) > self.base and len(np.unique(rank)) < len(rank):
            upper = Induced(np.where(ends, 0, rank - n_ends + 1).astype(np.uint32), self.memory, self.base, prefixes=False)
            order = np.concatenate([np.flatnonzero(ends), np.concatenate([[], *(b["at"] for b in upper.scan())]).astype(np.int64)[::-1]])
        else:
            order = np.empty(len(stars), np.int64)
            order[doubled(rank)] = np.arange(len(stars))
        self.stars = stars[order]
        self.star_lcp = np.zeros(len(stars), np.uint8)
        if self.prefixes and len(stars) > n_ends:
            self.star_lcp[n_ends + 1 :] = self._common(self.stars[n_ends:-1], self.stars[n_ends + 1 :])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, each = self.words.bits, self.words.each
        ones = np.uint64(sum(1 << bits * j for j in range(each)))
        tops = ones << np.uint64(bits - 1)
        out, live = np.zeros(len(a), np.uint8), np.arange(len(a))
        for k in range(0, CAP, each):
            x = self.words.at(a[live] + k)
            differs = x ^ self.words.at(b[live] + k)
            ends = (differs != 0) | (((x - ones) & ~x & tops) != 0)  # a difference, or a symbol 0
            last = np.flatnonzero(ends)
            x, differs, same = x[last], differs[last], np.ones(len(last), bool)
            for j in range(1, each):
                shift = np.uint64(64 - bits * j)
                same &= ((differs >> shift) == 0) & ((x >> shift) << np.uint64(64 - bits) != 0)
                out[live[last]] += same
            live = live[~ends]
            out[live] += each
            if not len(live):
                break
        return np.minimum(out, CAP)

    def _seam(self, a: int | None, b: int) -> int:
        return 0 if a is None or not self.prefixes else int(self._common(np.array([a]), np.array([b]))[0])

    def _begin(self, small: bool) -> Queue:
        # The symbol to the left of each suffix where it is of the wanted type, else 0.
        self.left = np.zeros_like(self.text)
        np.multiply(self.text[:-1], self.small[:-1] == small, out=self.left[1:])
        self.seen, self.least = np.zeros(int(self.text.max(initial=0)) + 1, bool), np.full(int(self.text.max(initial=0)) + 1, 255, np.uint8)
        self.queue = Queue(self.memory)
        return self.queue

    def _induce(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Pushes the suffixes one symbol further left that are of the wanted type."""
        symbol = self.left.take(at)
        source = np.flatnonzero(symbol)
        symbol = symbol[source]
        order = np.argsort(symbol, kind="stable")
        source, symbol = source[order], symbol[order]
        new = np.empty(len(source), _TUPLE)
        new["at"], new["lcp"] = at[source] - 1, 0
        if self.prefixes:
            self._carry(lcp, source, symbol, new)
        self.queue.push(symbol, new)

    def _carry(self, lcp: np.ndarray, source: np.ndarray, symbol: np.ndarray, new: np.ndarray) -> None:
        """Two suffixes pushed one after the other under one symbol share that symbol and the least prefix between their sources."""
        so_far = np.minimum.accumulate(lcp)
        if len(source):
            first = np.r_[True, symbol[1:] != symbol[:-1]]
            last, rest = np.r_[first[1:], True], np.flatnonzero(~first)
            least = np.empty(len(source), np.uint8)
            least[first] = np.minimum(self.least[symbol[first]], so_far[source[first]])
            if len(rest):
                spans = np.empty(2 * len(rest), np.int64)
                spans[::2], spans[1::2] = source[rest - 1] + 1, source[rest] + 1
                least[rest] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), spans)[::2]
            known = ~first | self.seen[symbol]
            new["lcp"] = np.where(known, np.minimum(least, CAP - 1) + 1, 0)
        np.minimum(self.least, so_far[-1], out=self.least)
        if len(source):
            rest_of = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.least[symbol[last]] = rest_of[source[last] + 1]
            self.seen[symbol[last]] = True

    def scan(self) -> Iterator[np.ndarray]:
        symbols = symbols_of(self.text)
        bounds = np.searchsorted(self.text[self.stars], np.append(symbols, symbols[-1:] + 1)) if len(symbols) else []
        large, waiting = Queue(self.memory), self._begin(small=False)
        for k, symbol in enumerate(symbols.tolist()):
            last = None
            for block in waiting.pop(symbol):
                large.push(np.full(len(block), symbol), block)
                self._induce(block["at"].astype(np.int64), block["lcp"])
                last = int(block["at"][-1])
            a, b = int(bounds[k]), int(bounds[k + 1])
            if a < b:
                lcp = self.star_lcp[a:b].copy()
                lcp[0] = self._seam(last, int(self.stars[a])) if symbol else 0
                for i in range(a, b, self.memory):
                    self._induce(self.stars[i : min(b, i + self.memory)], lcp[i - a : i - a + self.memory])
        waiting = self._begin(small=True)
        for symbol in symbols[symbols > 0][::-1].tolist():
            last = None
            for block in waiting.pop(symbol):
                yield block
                self._induce(block["at"].astype(np.int64), block["lcp"])
                last = int(block["at"][-1])
            link = None
            for block in large.pop_backwards(symbol):
                down = block[::-1].copy()
                link = self._seam(last, int(down["at"][0])) if link is None else link
                down["lcp"][1:], down["lcp"][0], link = block["lcp"][:0:-1], link, int(block["lcp"][0])
                yield down
                self._induce(down["at"].astype(np.int64), down["lcp"])
