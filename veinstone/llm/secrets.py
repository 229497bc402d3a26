"""Secret scans by assignment-aware lexing.

Base patterns find assignments to well-known names, access keys and long hex runs. The lexer then cuts source and
configuration syntax into strings, names, operators and tags, reads ``target = value`` pairs from them (assignments,
keys of maps, subscripts, #define, XML elements with or without attributes), and follows constants through names, ``+``
and ``+=`` over any number of steps, whether a constant stands before or after its use. Each value is scored by how sensitive its target's name is and by how
random the literals are that reach it.

Defined cases: a null text counts as empty; an empty text has no spans; a very long text is read whole, in time that is
linear in its length; of several values of one name the last one before a use counts, else the first one after it;
words of prose are no literals; equal spans count once; repeated rows each get their own row; an empty table has no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Span kinds in listed order: the three base kinds, then the lexer's.
KINDS = ("assign", "access", "hex", "literal")
#: Words of a target name and what they add to a literal's score.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "private": 0.5, "access": 0.4, "signing": 0.5, "encryption": 0.5, "key": 0.5, "salt": 0.5, "bearer": 0.7,
}
THRESHOLD = 1.4
#: The rest of a name behind a sensitive word, what makes the name a target, and a closing tag with such a word.
_REST = re.compile(r"[a-z0-9_$.-]*+")
_AFTER = re.compile(r"""["'`]*+\]?[\x20\t]*+[:=>+]""")
_CLOSING = re.compile(rf"</[a-z0-9_.:-]*?(?:{'|'.join(SENSITIVE)})")

_TOKEN = re.compile(
    r'''(?P<s>(?:(?<![\w$.-])[bBfFrRuU]{1,2})?(?:"""[\s\S]*?"""|(?<!\\)"(?:[^"\\\n]|\\.)*+")|(?<![\w\\])(?:[bBfFrRuU]{1,2})?(?:\'\'\'[\s\S]*?\'\'\'|'(?:[^'\\\n]|\\.)*+')|`[^`\n]*+`)'''
    r"|(?P<d>\#[ \t]*define[ \t]+)|(?P<x><(?P<tag>[A-Za-z][\w.:-]*+)(?:[ \t][^<>\n]*+)?>[ \t]*(?P<body>[^<>\s]++)[ \t]*</(?P=tag)>)"
    r"|(?P<n>[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z0-9_$]++)*+)|(?P<o>:=|=>|\+=|[=!<>]=|[=:+,;()\[\]{}\n])"
)
#: A value without quotes: one run of such characters that ends its line or its entry.
_BARE = re.compile(r"[\x20\t]*([A-Za-z0-9+/_.@!$%^&*~-]++={0,2})[\x20\t]*(?=$|[\n,;}#]|//)")
_ASSIGNS = frozenset((":=", "=>", "=", ":", "+="))
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """Sum of the sensitive words in a target name, split at case changes and punctuation; at most 1.5."""
    words = [w.lower() for w in _NAME.findall(name)]
    both = words + [a + b for a, b in zip(words, words[1:])]
    return min(1.5, sum(SENSITIVE.get(w, 0.0) for w in both))


def literal_score(value: str) -> float:
    """0 to 1 from length and entropy; short or wordlike values stay low."""
    return _score(Counter(value), len(value.split()) > 2)


def _score(counts: Counter, prose: bool) -> float:
    n = sum(counts.values())
    if n < 6:
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    mixed = sum(any(a <= c <= b for c in counts) for a, b in ("09", "AZ", "az"))
    return min(0.3 if prose else 1.0, bits / 5 + 0.1 * mixed)


def _is_random(value: str) -> bool:
    """Whether a run without quotes is no word: it has a digit, or capitals after small letters."""
    return bool(re.search(r"[0-9]", value) or re.search(r"[a-z][A-Z]", value))


class Pair:
    """A target and what it is made of: parts are spans of literals and names of constants."""

    __slots__ = ("target", "parts", "bare", "adds", "links", "spans", "counts", "prose")

    def __init__(self, target: str, parts: list, bare: tuple[int, int] | None, adds: bool = False):
        self.target, self.parts, self.bare, self.adds = target, parts, bare, adds
        self.links: list[Pair] = []


def read_pairs(text: str) -> list[Pair]:
    """The target-value pairs in order."""
    tokens = [(m.lastgroup if m.lastgroup not in ("tag", "body") else "x", m) for m in _TOKEN.finditer(text)]
    out, k, n = [], 0, len(tokens)

    def inside(m: re.Match) -> tuple[int, int]:
        prefix = len(m[0]) - len(m[0].lstrip("bBfFrRuU"))
        q = 3 if m[0][prefix : prefix + 3] in ('"""', "'''") and len(m[0]) >= prefix + 6 else 1
        return m.start() + prefix + q, m.end() - q

    def value(at: int, k: int) -> tuple[list, tuple[int, int] | None, int]:
        """Parts of the expression whose first token is k, its text as one run, and the token after it."""
        bare = _BARE.match(text, at)
        parts, more = [], True
        while k < n:
            kind, m = tokens[k]
            if kind == "o" and m[0] == "(" and not parts:
                k += 1
            elif kind == "s" and (more or parts and parts[-1][0] is None):
                parts.append((None, *inside(m)))
                k, more = k + 1, False
            elif kind == "n" and more:
                parts.append((m[0], m.start(), m.end()))
                k, more = k + 1, False
            elif kind == "o" and m[0] == "+" and not more:
                k, more = k + 1, True
            else:
                break
        if k < n and parts and parts[-1][0] is not None and tokens[k][0] == "o" and tokens[k][1][0] in ("(", "[") and tokens[k][1].start() == parts[-1][2]:
            return [], None, k  # what a call or a subscript gives is unknown
        return parts, bare.span(1) if bare else None, k

    while k < n:
        kind, m = tokens[k]
        if kind == "x":
            out.append(Pair(m["tag"], [(None, *m.span("body"))], None))
            k += 1
        elif kind == "d" and k + 1 < n and tokens[k + 1][0] == "n":
            parts, bare, after = value(tokens[k + 1][1].end(), k + 2)
            out.append(Pair(tokens[k + 1][1][0], parts, bare))
            k = max(after, k + 2)
        elif kind in "sn":
            a, b = m.span() if kind == "n" else inside(m)
            j = k + 1
            if j + 1 < n and kind == "s" and tokens[j][1][0] == "]":
                j += 1
            # A type between the name and its value: name: type = value.
            if j + 2 < n and [tokens[j][1][0], tokens[j + 1][0], tokens[j + 2][1][0]] == [":", "n", "="]:
                j += 2
            if j < n and tokens[j][0] == "o" and tokens[j][1][0] in _ASSIGNS:
                op = tokens[j][1]
                parts, bare, after = value(op.end(), j + 1)
                out.append(Pair(text[a:b], parts, bare, op[0] == "+="))
                # A name inside the value can be the next pair's target: read on behind the operator.
                k = j + 1 if not parts or after < n and tokens[after][0] == "o" and tokens[after][1][0] in _ASSIGNS else after
            else:
                k += 1
        else:
            k += 1
    return out


def _gather(pairs: list[Pair]) -> None:
    """Adds to each pair's counts those of everything it is linked to, at any distance; inside a cycle each pair that is
    still open gives its own literals only."""
    own = {id(p): p.counts for p in pairs}
    state: dict[int, int] = {}
    for root in pairs:
        todo = [root]
        while todo:
            p = todo[-1]
            if state.get(id(p)) is None:
                state[id(p)] = 0
                todo += [q for q in p.links if id(q) not in state]
                continue
            todo.pop()
            if not state[id(p)]:
                counts = Counter(own[id(p)])
                for q in p.links:
                    counts.update(q.counts if state[id(q)] else own[id(q)])
                p.counts, state[id(p)] = counts, 1


def lex_literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through constants."""
    pairs = read_pairs(text)
    first: dict[str, Pair] = {}
    for p in pairs:
        first.setdefault(p.target, p)
    last: dict[str, Pair] = {}
    for p in pairs:
        names = [x[0] for x in p.parts if x[0] is not None]
        p.spans = [(a, b) for name, a, b in p.parts if name is None and b > a]
        if p.bare and not p.spans and not all(x in first for x in names or [None]):
            p.spans = [p.bare] if _is_random(text[slice(*p.bare)]) else []
        else:
            p.links = [q for x in names if (q := last.get(x) or first.get(x)) and q is not p]
            if p.adds and p.target in last:
                p.links.append(last[p.target])
        last[p.target] = p
    for p in pairs:
        p.counts, p.prose = Counter(), any(len(text[a:b].split()) > 2 for a, b in p.spans)
        for a, b in p.spans:
            p.counts.update(text[a:b])
    _gather(pairs)
    # From each pair that scores enough, everything that reaches it; what was reached once is not followed again.
    todo = [p for p in pairs if (score := name_score(p.target)) and score + _score(p.counts, p.prose) >= THRESHOLD]
    seen, found = {id(p) for p in todo}, set()
    while todo:
        p = todo.pop()
        found.update(p.spans)
        for q in p.links:
            if id(q) not in seen:
                seen.add(id(q))
                todo.append(q)
    return sorted(found)


def has_target(text: str) -> bool:
    """Whether some name with a sensitive word is a target, or there is a definition; other texts are not lexed."""
    low = text.lower()
    for word in SENSITIVE:
        at = low.find(word)
        while at >= 0:
            end = _REST.match(low, at + len(word)).end()
            if _AFTER.match(low, end):
                return True
            at = low.find(word, end)
    return "define" in low and "#" in low or "</" in low and bool(_CLOSING.search(low))


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's number, end) in code points, sorted."""
    text = text or ""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if has_target(text):
        out += [(a, 3, b) for a, b in lex_literals(text)]
    return sorted(out)


def spans_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row with span counts, the base spans' digest and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = scan_text(text.as_py())
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                base = spans_string([s for s in spans if s[1] < 3])
                for col, v in zip(cols, (doc, *n, hashlib.sha256(base.encode()).hexdigest(), spans_string(spans))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(cols)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def mask_text(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with each run of overlapping spans replaced by the mask; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in scan_text(text):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in the text column."""

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([mask_text(t.as_py()) for t in texts], pa.string())

    return df.withColumn(text_col, masked(F.col(text_col).cast("string")))


def mask_documents(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """mask_secrets() with the column of character counts, where there is one, brought up to date."""
    out = mask_secrets(df, text_col)
    return out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType)) if chars_col in df.columns else out
