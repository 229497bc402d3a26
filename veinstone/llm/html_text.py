"""Main text of web pages by two-pass block rules.

The markup is cut into blocks. The first pass decides a block by link density, stop-word density and length; the
second lets ambiguous blocks inherit the label of their nearest decided neighbours in the same container. The container
says what its ends count as: an article or main element's ends are good neighbours, all others bad ones. Elements that
are boilerplate by tag, role or an unmistakable name never give blocks, unless they hold most of the page's text or an
article; a name that only hints at boilerplate makes a block that needs the densities to stay. A heading shares the fate of
the block below it.

Defined cases: a null html counts as empty; a page without main text gives an empty string; an unclosed boilerplate
element ends before the next article or main element, other unclosed elements with the page; at equal distances the
neighbour before counts; a very long page is read whole, in linear time; text without blanks between words is judged by
its characters; repeated rows each get their own row; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Frequent words of four languages: fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "der die das den dem des ein eine einer und ist nicht von mit zu zur auf als auch an bei für im in sich sie es wird aus "
    "le la les un une des du de et est en que qui dans pour par sur au aux avec ne pas ce il elle se son sa "
    "el los las una del y es por con para se su al lo como no más o pero sus".split()
)
#: Characters that play that part where words stand without blanks: fixed values.
STOP_CHARACTERS = frozenset("的了是在不有和人这中大为上个我以要他时来用们の に は を た が で て と し れ さ も な".replace(" ", ""))
#: Lengths in characters, stop-word densities, and the greatest link density outside and inside of an article.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, ARTICLE_LINKS = 70, 200, 0.30, 0.32, 0.2, 0.5
#: Share of a page's text from which on an element is a wrapper, whatever its name is.
MOST = 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^<>]*+>|[^<]++|<""", re.S)
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SKIP = frozenset("aside button datalist dialog footer form header menu nav object audio video canvas map select label fieldset".split())
#: Words of class and id names: boilerplate, what may be boilerplate, content, and signs that something else is meant.
_NAMED = re.compile(
    r"ads?|ad(?:box|slot|unit|space|zone|block|banner|container|wrapper|sense)s?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|paywall|sidebar|menu|navigation|nav|navbar|breadcrumbs?|masthead|topbar|footer|comments?|commentlist|disqus|respond|replies|reply|discussion"
    r"|sharing|related|recommended|recommendations|login|signin|signup|pagination|pager|toolbar"
)
_HINTED = re.compile(r"rail|header|bottom|share|social|widget|register|search|form|copyright|legal|skip")
_PROPER = re.compile(r"article|body|content|entry|main|post|story|text|with|has|no")
_WITH, _SITE = frozenset("with has no without".split()), frozenset("site page global top".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_DENSE = re.compile("[\u3040-\u9fff\uac00-\ud7a3]")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _name_kind(name: str) -> str:
    """What one class or id says. The last word of a compound says what the thing is, so article-comments and cookieBanner
    are boilerplate; other words count unless some word names content, as in post-form-content or with-sidebar."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or not _WITH.isdisjoint(words):
        return ""
    if _NAMED.fullmatch(words[-1]) or words[-2:] == ["side", "bar"] or words[-1] == "header" and not _SITE.isdisjoint(words):
        return "bad"
    if any(map(_PROPER.fullmatch, words)):
        return "proper"
    return "bad" if any(map(_NAMED.fullmatch, words)) else "hint" if any(map(_HINTED.fullmatch, words)) else ""


def _kind(tag: str, attrs: str) -> str:
    """"gone" for elements that are never shown, "bad" for boilerplate, "hint" for what may be, else empty."""
    if tag in _SKIP:
        return "bad"
    if not attrs.strip():
        return ""
    out = ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "gone"
        if name == "role" and value.lower() in _ROLES:
            out = "bad"
        if name in ("class", "id"):
            kinds = set(map(_name_kind, value.split()))
            if "bad" in kinds and (tag not in ("html", "body", "article", "main") or re.search(r"comment|repl", value, re.I)):
                out = "bad"
            elif "hint" in kinds and "proper" not in kinds:
                out = out or "hint"
    return out


def _tokens(page: str) -> list[tuple[str, bool, str]]:
    """(tag or "", closing, attributes or text); comments, declarations and the content of raw elements are left out."""
    out, at, unclosed = [], 0, set()
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                out.append(("", False, m[0]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            # Only drawings and formulas can close themselves; an address that ends in a slash closes nothing.
            if not (tag in ("svg", "math") and m[3].endswith("/")) and tag not in unclosed:
                end = _CLOSERS[tag].search(page, at)
                if not end:
                    unclosed.add(tag)
                at = end.end() if end else len(page)
            continue
        out.append((tag, closing, m[3]))
    return out


def _ends(tokens: list[tuple[str, bool, str]]) -> tuple[list[int], list[int], list[int]]:
    """For each token: where its element ends, or where the page would stop an unclosed one; text before it; articles before it."""
    n = len(tokens)
    end, chars, mains, open_at = [-1] * n, [0] * (n + 1), [0] * (n + 1), {}
    for k, (tag, closing, rest) in enumerate(tokens):
        chars[k + 1] = chars[k] + (0 if tag else len(rest.strip()))
        mains[k + 1] = mains[k] + (tag in ("article", "main") and not closing)
        if tag and closing:
            if open_at.get(tag):
                end[open_at[tag].pop()] = k + 1
        elif tag and tag not in _VOID:
            open_at.setdefault(tag, []).append(k)
    after = n
    for k in reversed(range(n)):
        if end[k] < 0:
            end[k] = after
        if tokens[k][0] in ("article", "main") and not tokens[k][1]:
            after = k
    return end, chars, mains


def blocks_of(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters inside links, inside an article or main element, hinted, a heading) of each block outside boilerplate."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked = anchors = main = k = hinted = 0
    heading = False
    tokens = _tokens(page)
    end, chars, mains = _ends(tokens)

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
            out.append((text, min(linked, len(text)), main > 0, k <= hinted, heading))
        parts.clear()
        linked = 0

    while k < len(tokens):
        tag, closing, rest = tokens[k]
        if not tag:
            parts.append(rest)
            linked += anchors * len(rest.strip())
            k += 1
            continue
        if tag in _BLOCK or tag in _SKIP:
            flush()
            anchors, heading = 0, not closing and tag in _HEADINGS
        kind = "" if closing or tag in _VOID or not rest and tag not in _SKIP else _kind(tag, rest)
        if kind and kind != "gone":
            # A wrapper stays: around an article, or, on a page without one, around most of the text.
            most = not mains[-1] and (tag == "form" or tag not in _SKIP) and chars[end[k]] - chars[k] > MOST * chars[-1]
            if (mains[end[k]] > mains[k] + (tag in ("article", "main")) or most) and main == 0 and not re.search(r"comment|repl", rest, re.I):
                kind = ""
        if kind in ("gone", "bad"):
            k = k + 1 if rest.endswith("/") and tag not in _BLOCK | _SKIP else max(k + 1, end[k])
            continue
        if kind == "hint":
            hinted = max(hinted, end[k])
        if closing:
            anchors = 0 if tag == "a" else anchors
            main = max(0, main - (tag in ("article", "main")))
        elif tag == "a":
            anchors = 1
        elif tag in ("article", "main"):
            main += 1
        elif tag == "br":
            parts.append("\n")
        k += 1
    flush()
    return out


def _units(text: str) -> tuple[float, int]:
    """Share of stop words, and the length in characters of a text with blanks."""
    if not text.isascii() and 2 * len(_DENSE.findall(text)) > len(text):
        return min(1.0, 3 * sum(c in STOP_CHARACTERS for c in text) / len(text)), 3 * len(text)
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words), len(text)


def first_pass(text: str, linked: int, inside: bool = False, hinted: bool = False, heading: bool = False) -> str:
    """good, bad, near (to good), short, heading or teaser, which is a heading that is a link."""
    if heading and not hinted:
        return "teaser" if linked > ARTICLE_LINKS * len(text) else "heading"
    if linked > (ARTICLE_LINKS if inside else LINKS) * len(text):
        return "bad"
    stop, size = _units(text)
    if size < SHORT:
        return "bad" if linked and not inside or hinted else "short"
    if stop >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if (stop >= STOP_LOW or inside) and not hinted else "bad"


def second_pass(labels: list[str], inside: list[bool]) -> list[bool]:
    """Whether each block is main text: short and near ones inherit from the nearest decided neighbours on both sides,
    headings from what they stand above.

    Neighbours are looked for in the same container; its ends are good neighbours inside an article, else bad ones.
    """
    out: list[bool] = []
    k, n = 0, len(labels)
    while k < n:
        stop = k
        while stop < n and inside[stop] == inside[k]:
            stop += 1
        edge = "good" if inside[k] else "bad"
        before, seen = [], (k - 1, edge)
        for i in range(k, stop):
            before.append((i - seen[0], seen[1]))
            if labels[i] in ("good", "bad"):
                seen = (i, labels[i])
        after, seen = [], (stop, edge)
        for i in reversed(range(k, stop)):
            after.append((seen[0] - i, seen[1]))
            if labels[i] in ("good", "bad"):
                seen = (i, labels[i])
        lone = not any(x in ("good", "bad") for x in labels[k:stop])
        for i, (d1, a), (d2, b) in zip(range(k, stop), before, reversed(after)):
            if labels[i] in ("good", "bad"):
                out.append(labels[i] == "good")
            elif a == b:
                out.append(a == "good" or labels[i] == "near" and lone)
            else:
                out.append(labels[i] == "near" or (a if d1 <= d2 else b) == "good")
        for i in reversed(range(k, stop)):
            if labels[i] in ("heading", "teaser"):
                out[i] = out[i + 1] if i + 1 < stop else edge == "good" and labels[i] == "heading"
        k = stop
    return out


def labels_of(blocks: list[tuple[str, int, bool, bool, bool]]) -> list[str]:
    """The first pass over a page. Where no block has enough stop words, the page's language is unknown and long blocks
    with few links are good."""
    labels = [first_pass(*b) for b in blocks]
    if "good" not in labels and "near" not in labels:
        labels = ["good" if x == "bad" and len(b[0]) > LONG and b[1] <= LINKS * len(b[0]) and not b[3] else x for x, b in zip(labels, blocks)]
    return labels


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b[0] for b, keep in zip(blocks, second_pass(labels_of(blocks), [b[2] for b in blocks])) if keep)


def rules_used(page: str | None) -> list[tuple[str, bool]]:
    """The first pass's label of each block and whether the block is kept, for reports."""
    blocks = blocks_of(page or "")
    labels = labels_of(blocks)
    return list(zip(labels, second_pass(labels, [b[2] for b in blocks])))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page with its main text and that text's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, SCHEMA)
