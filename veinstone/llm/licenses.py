"""License scans by an exact set-similarity join of text blocks with license templates.

A block is any run of BLOCK times a template's word count. Template tokens are ordered by their frequency over the
whole corpus, rarest first. A block that contains THRESHOLD of a template holds at least one token of the template's
prefix (prefix filter), so only the stretches around such tokens are looked at. A stretch must have as many words as are
needed (length filter). Then the template's tokens are looked up in their order: behind each of them, those found so far
and all that stand behind bound what the stretch can hold, and it is dropped where that is too little (positional
filter). What passes is counted exactly in one sweep over the places of the template's tokens. Matcher.dropped counts
what each filter drops. Blocks of
one template that overlap are reported as one, from the first to the last template token, with their best containment.

Defined cases: a null text counts as empty; an empty text has no words, null positions, empty labels and blocks and
score 0; a very long text is read whole; equal places of several phrases count each; templates that tie are all
reported; a template without words fits nothing; repeated rows each get their own row; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Base phrases and their labels: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening sentences of common licenses and notices.
TEMPLATES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "released under the mit license"],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "gpl-3": ["licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
THRESHOLD, BLOCK = 0.9, 1.5

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and any character from U+0080 on, of UTF-8 bytes."""
    return raw.translate(_TABLE).split() if raw else []


class Matcher:
    """Templates under one global token order."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[bytes, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items: list[tuple[str, dict[bytes, int], int, int]] = []  # label, tokens by place in the order, tokens needed, block length
        self.dropped: Counter[str] = Counter()
        self.prefix: dict[bytes, list[int]] = defaultdict(list)
        for label, texts in templates.items():
            for text in texts:
                words = words_of(text.encode())
                tokens = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
                need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
                for w in tokens[: len(tokens) - need + 1]:
                    self.prefix[w].append(len(self.items))
                self.items.append((label, {w: k for k, w in enumerate(tokens)}, need, math.ceil(BLOCK * len(words))))

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(start, end, label, containment) of all blocks that reach the threshold, in words, sorted."""
        out = []
        hits = defaultdict(set)
        for w in self.prefix.keys() & set(words):
            for t in self.prefix[w]:
                hits[t].add(w)
        for t, seeds in hits.items():
            label, tokens, need, size = self.items[t]
            places = [(i, w) for i, w in enumerate(words) if w in tokens]
            # Stretches of places that some block with a seed can reach.
            reach = [i for i, w in places if w in seeds]
            stretch: list[list[int]] = []
            for i in reach:
                if stretch and i - size < stretch[-1][1]:
                    stretch[-1][1] = i + size
                else:
                    stretch.append([i - size + 1, i + size])
            at = 0
            for a, b in stretch:
                while at < len(places) and places[at][0] < a:
                    at += 1
                some = []
                while at < len(places) and places[at][0] < b:
                    some.append(places[at])
                    at += 1
                if min(b, len(words)) - max(a, 0) < need:
                    self.dropped["length"] += 1
                elif not self._can_hold({w for _, w in some}, tokens, need):
                    self.dropped["position"] += 1
                else:
                    out += [(x, y, label, most / len(tokens)) for x, y, most in self._sweep(some, need, size)]
        return sorted(out)

    @staticmethod
    def _can_hold(held: set[bytes], tokens: dict[bytes, int], need: int) -> bool:
        """Whether what is found up to each place of the order, and everything behind it, is enough."""
        found = 0
        for w, place in tokens.items():
            found += w in held
            if found + len(tokens) - place - 1 < need:
                return False
        return True

    @staticmethod
    def _sweep(places: list[tuple[int, bytes]], need: int, size: int) -> list[tuple[int, int, int]]:
        """(start, end, most different tokens) of merged blocks; a block ends at each place."""
        inside: Counter[bytes] = Counter()
        left, out = 0, []
        for i, w in places:
            inside[w] += 1
            while places[left][0] <= i - size:
                gone = places[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if len(inside) >= need:
                if out and places[left][0] < out[-1][1]:
                    out[-1] = (out[-1][0], i + 1, max(out[-1][2], len(inside)))
                else:
                    out.append((places[left][0], i + 1, len(inside)))
        return out

    def match(self, words: list[bytes]) -> dict[str, float]:
        """The best containment of each label that some block reaches."""
        best: dict[str, float] = {}
        for _, _, label, share in self.blocks(words):
            best[label] = max(best.get(label, 0.0), share)
        return best


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of each place where a phrase's words stand consecutively."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, seen, n = line.find(sought), 0, 0
        while at >= 0:
            n += line.count(b" ", seen, at)  # words before this place
            out.append((n, label))
            seen, at = at, line.find(sought, at + 1)
    return sorted(out)


def token_counts(df: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each template token occurs in all texts; the result is as small as the templates' vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for raw in batch.column(0):
                total.update(w for w in words_of(raw.as_py()) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    rows = df.select(F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, "token binary, n long")
    return {bytes(r.token): r.n for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row with base phrase places, labels, the best containment and the blocks, each as
    label:start:end:containment in words, end exclusive."""
    vocabulary = {w for texts in templates.values() for t in texts for w in words_of(t.encode())}
    matcher = Matcher(templates, token_counts(df, vocabulary, text_col), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(raw.as_py())
                base, blocks = base_places(words), matcher.blocks(words)
                kinds, starts = {label for _, label in base}, [start for start, _ in base]
                labels = kinds | {label for _, _, label, _ in blocks}
                score = max([1.0 if base else 0.0, *(share for *_, share in blocks)])
                listed = ",".join(f"{label}:{a}:{b}:{share:.6g}" for a, b, label, share in blocks)
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(kinds)), ",".join(sorted(labels)), score, listed))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, SCHEMA)
