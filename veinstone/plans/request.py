"""Search requests and the rewrites that turn a form's parameters into a plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.analyzers import fold, query_terms, stem, stem_forms

#: Fields and boosts of a query, and of its phrase: fixed values.
QF = {"collection_title_tesim": 150, "title_tesim": 100, "normalized_title_teim": 100, "unitid_identifier_match": 40, "ead_identifier_match": 40, "name_teim": 10, "place_teim": 10, "subject_teim": 2, "identifier_search": 1, "container_teim": 1, "parent_unittitles_tesim": 1, "text": 1}
PF = {"collection_title_tesim": 300, "title_tesim": 200, "normalized_title_teim": 200, "unitid_identifier_match": 80, "ead_identifier_match": 80, "name_teim": 20, "place_teim": 20, "subject_teim": 5, "identifier_search": 2, "container_teim": 2, "parent_unittitles_tesim": 2, "text": 2}
FIELDED = {"name": ["name_teim"], "place": ["place_teim"], "subject": ["subject_teim"], "title": ["title_tesim", "normalized_title_teim"], "container": ["container_teim"], "call_number": ["identifier_search", "ead_identifier_match", "unitid_identifier_match"]}
SLOP, TIE = 3, 0.01
PARAMETERS = frozenset("q f range search_field group sort page per_page view".split())


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    filters: dict[str, list[str]] = field(default_factory=dict)
    search_field: str = "keyword"
    sort: str = ""
    group: str = ""
    page: int = 1
    per_page: int = 10
    qf: dict[str, float] = field(default_factory=lambda: dict(QF))
    pf: dict[str, float] = field(default_factory=lambda: dict(PF))
    mm: str = "4<90%"
    order: str = ""
    group_order: str = ""
    range: dict = field(default_factory=dict)


def from_params(params: dict) -> SearchRequest:
    """Known parameters only."""
    p = {k: v for k, v in params.items() if k in PARAMETERS}
    return SearchRequest(q=p.get("q") or "", filters=p.get("f") or {}, range=p.get("range") or {}, search_field=p.get("search_field") or "keyword", sort=p.get("sort") or "", group=str(p.get("group") or ""), page=int(p.get("page") or 1), per_page=int(p.get("per_page") or 10))


def default_grouping(r: SearchRequest) -> SearchRequest:
    """Grouping is off inside one collection and for lists of collections."""
    scoped = r.filters.get("collection") or "Collection" in r.filters.get("level", [])
    return replace(r, group="" if scoped else r.group or "true")


def _by_relevance(r: SearchRequest) -> bool:
    return not r.q.strip() and r.sort in ("", "relevance")


def group_sort(r: SearchRequest) -> SearchRequest:
    """Browsed groups show components by position and the collection last."""
    return replace(r, group_order="collection_last") if r.group == "true" and _by_relevance(r) else r


def online_sort(r: SearchRequest) -> SearchRequest:
    """So does a browsed collection that is limited to online content."""
    inside = "digital_content" in r.filters.get("access", []) and r.filters.get("collection")
    return replace(r, order="collection_last") if inside and _by_relevance(r) else r


def boolean_match(r: SearchRequest) -> SearchRequest:
    """Operators in capitals between words: one term is enough."""
    return replace(r, mm="1") if re.search(r"\s(AND|OR|NOT)\s", r.q) else r


def fielded(r: SearchRequest) -> SearchRequest:
    some = FIELDED.get(r.search_field)
    return replace(r, qf={f: 1 for f in some}, pf={f: 2 for f in some}) if some else r


REWRITES = (default_grouping, fielded, group_sort, online_sort, boolean_match)


def rewrite(r: SearchRequest) -> SearchRequest:
    return reduce(lambda x, f: f(x), REWRITES, r)


def least_terms(n: int, mm: str) -> int:
    """Terms that must match: of "4<90%", all up to four and 90 percent, rounded down, beyond."""
    if m := re.fullmatch(r"(\d+)<(\d+)%", mm):
        return n if n <= int(m[1]) else n * int(m[2]) // 100
    return min(n, int(mm))


# --- boolean queries

_LEX = re.compile(r'\(|\)|[+-]?"[^"]*"|[^\s()]+')


def parse(query: str):
    """("and" | "or", parts), ("not", part), ("term", word) or ("phrase", words); null for a query without terms."""
    tokens = [t for t in _LEX.findall(query) if t in "()" or query_terms(t.strip('"+'))]
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else ("or", parts) if parts else None

    def both():
        nonlocal at
        parts = []
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                at += 1
                continue
            parts.append(one())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else ("and", parts) if parts else None

    def one():
        nonlocal at
        t = peek()
        if t is None:
            return None
        at += 1
        if t == "NOT" or t.startswith("-") and len(t) > 1:
            if t != "NOT":
                tokens.insert(at, t[1:])
            inner = one()
            return ("not", inner) if inner else None
        if t == "(":
            inner = either()
            at += peek() == ")"
            return inner
        t = t.lstrip("+")
        return ("phrase", [fold(w) for w in t.strip('"').split()]) if t.startswith('"') else ("term", fold(t))

    return either()


def has_syntax(query: str) -> bool:
    """Whether a query has operators, quotes, parentheses or wildcards."""
    return bool(re.search(r'(?:^|\s)(?:AND|OR|NOT)(?=\s|$)|["()*?]|(?:^|[\s(])[+-](?=[^\s-])', query))


def is_pattern(word: str) -> bool:
    return "*" in word or "?" in word


def leaves(tree, denied: bool = False) -> list[tuple]:
    """(kind, stem, list of stems or pattern, whether it is denied) of each leaf."""
    kind, body = tree
    if kind in ("and", "or"):
        return [x for part in body for x in leaves(part, denied)]
    if kind == "not":
        return leaves(body, not denied)
    if kind == "phrase":
        return [(kind, [stem(w) for w in body], denied)]
    return [("pattern", body, denied) if is_pattern(body) else ("term", stem(body), denied)]


def holds(tree, leaf, both, either, no):
    """A tree's value over labels: a stem, a pattern, or a phrase's stems behind a quote."""
    kind, body = tree
    if kind in ("and", "or"):
        return reduce(both if kind == "and" else either, [holds(p, leaf, both, either, no) for p in body])
    if kind == "not":
        return no(holds(body, leaf, both, either, no))
    if kind == "phrase":
        return leaf(" ".join(['"', *map(stem, body)]))
    return leaf(body if is_pattern(body) else stem(body))


def matches(tree, tokens: Column) -> Column:
    """A boolean query over an array of folded words in order; * and ? are wildcards, plural and singular meet."""
    kind, body = tree
    if kind == "and" or kind == "or":
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [matches(p, tokens) for p in body])
    if kind == "not":
        return ~matches(body, tokens)
    if kind == "phrase":
        some = [f"(?:{'|'.join(map(re.escape, stem_forms(stem(w))))})" for w in body]
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).rlike(f" {' '.join(some)} ")
    if is_pattern(body):
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in body) + "$"
        return F.exists(tokens, lambda w: w.rlike(pattern))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, dict.fromkeys([body, *stem_forms(stem(body))]))))
