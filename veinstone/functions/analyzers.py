"""Analysis chains from text to tokens, and the sort and identifier keys.

Index and query chains run over Arrow batches; the chains that need no Unicode tables are built-in expressions.
Word parts that stand for one word share its position, so phrases can be matched over them.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .batches import batched

#: Words and signs that carry no meaning for their chains: fixed values.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or s such t that the their then there these they this to was will with".split()
PUNCTUATION = ": ; & / = > < , . ( ) … » § • · -".split()
SYNONYMS = (("gb", "gib", "gigabyte", "gigabytes"), ("mb", "mib", "megabyte", "megabytes"), ("television", "televisions", "tv", "tvs"))
REWRITES = {"pixima": ("pixma",)}
PROTECTED = frozenset({"dontstems", "zwhacky"})
#: Positions between the values of a multi-valued field.
GAP = 100

_WORD = re.compile(r"\w+(?:['’]\w+)*")
_RUNS = re.compile(r"\d+|[^\W\d_]+")


def fold(text: str) -> str:
    """Case and accents removed."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def stem(word: str) -> str:
    """Plural forms to singular ones, nothing else."""
    if len(word) < 3 or word[-1] != "s" or word in PROTECTED:
        return word
    if word.endswith("ies"):
        return word if word[:-3].endswith(("a", "e")) else word[:-3] + "y"
    if word.endswith("es"):
        return word if word[-3] in "aeo" else word[:-1]
    return word if word[-2] in "us" else word[:-1]


def stem_forms(stemmed: str) -> list[str]:
    """All words of this stem."""
    return [w for w in dict.fromkeys((stemmed, stemmed + "s", stemmed[:-1] + "ies")) if stem(w) == stemmed]


def _with_stem(word: str) -> list[str]:
    return list(dict.fromkeys((word, stem(word))))


def text_tokens(text: str | None) -> list[tuple[int, str]]:
    """(position, token) of general text: each folded word and its stem."""
    return [(k, t) for k, m in enumerate(_WORD.finditer(text or "")) for t in _with_stem(fold(m[0]).replace("’", "'").removesuffix("'s"))]


def word_parts(word: str) -> list[str]:
    """Runs of letters and of digits; letters are cut where a small one meets a capital, so TVs stays whole."""
    out = []
    for run in _RUNS.findall(unicodedata.normalize("NFKC", word)):
        cuts = [0, *(k for k in range(1, len(run)) if run[k - 1].islower() and run[k].isupper()), len(run)]
        out += [run[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def english_tokens(text: str | None) -> list[tuple[int, str]]:
    """General text in which words are also cut at case changes, digits and signs, and synonyms share a position."""
    out, at = [], 0
    for word in (text or "").split():
        parts = [fold(p) for p in word_parts(re.sub(r"['’]s\b", "", word))]
        for part in parts:
            group = next((g for g in SYNONYMS if part in g), REWRITES.get(part, (part,)))
            out += [(at, t) for t in dict.fromkeys(s for g in group for s in _with_stem(g))]
            at += 1
    return out


def identifier_tokens(text: str | None) -> list[str]:
    """Parts, joined neighbours of one kind, and the whole of each identifier; file endings do not count."""
    out: list[str] = []
    for word in re.sub(r"\.?(xml|XML|sgm|SGM)", " ", text or "").split():
        parts = word_parts(word)
        runs = _RUNS.findall("".join(parts))
        out += [fold(t) for t in [*parts, *runs, "".join(parts)] if t]
    return list(dict.fromkeys(out))


_TOKENS = T.ArrayType(T.StructType().add("pos", T.IntegerType()).add("token", T.StringType()))
_positions = lambda f: lambda v: [{"pos": p, "token": t} for p, t in f(v)]
_tokens = batched(_positions(text_tokens), _TOKENS, pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string())])))
_english = batched(_positions(english_tokens), _TOKENS, pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string())])))
identifier_match = batched(identifier_tokens, T.ArrayType(T.StringType()), pa.list_(pa.string()))
nfc = batched(lambda s: None if s is None else unicodedata.normalize("NFC", s), T.StringType(), pa.string())


def analyze(c: Column, chain: str = "text") -> Column:
    """array<struct<pos, token>> of a text column."""
    return (_tokens if chain == "text" else _english)(c)


def analyze_values(c: Column, chain: str = "text") -> Column:
    """Tokens of all values of an array column, GAP positions apart, so that no phrase spans two values."""
    each = F.transform(c, lambda v, i: F.transform(analyze_one(v), lambda w, k: F.struct((k + i * GAP).alias("pos"), w.alias("token"))))
    return F.flatten(each)


#: Letters of the Latin blocks whose only difference from a plain letter is a mark, and that letter.
_MARKED = {chr(c): base for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFKD", chr(c))[0].lower()).isascii() and base.isalpha() and len(unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[1])}


def fold_column(c: Column) -> Column:
    """fold() as built-in expressions: small letters without marks."""
    plain = F.translate(F.lower(c), "".join(_MARKED), "".join(_MARKED.values()))
    ascii = F.octet_length(c) == F.length(c)  # nothing to fold, and much of a corpus
    return F.when(ascii, F.lower(c)).otherwise(F.regexp_replace(plain, r"\p{M}", ""))


def stem_column(w: Column) -> Column:
    """stem() as a built-in expression."""
    before = lambda n: F.substring(w, -n, 1)
    cut = lambda n: w.substr(F.lit(1), F.length(w) - n)
    ies = F.when(before(4).isin("a", "e") & (F.length(w) > 3), w).otherwise(F.concat(cut(3), F.lit("y")))
    es = F.when(before(3).isin("a", "e", "o"), w).otherwise(cut(1))
    s = F.when(before(2).isin("u", "s"), w).otherwise(cut(1))
    kept = (F.length(w) < 3) | ~w.endswith("s") | w.isin(*sorted(PROTECTED))
    return F.when(kept, w).when(w.endswith("ies"), ies).when(w.endswith("es"), es).otherwise(s)


def analyze_one(c: Column) -> Column:
    """Folded words of letters and digits as built-in expressions."""
    return F.filter(F.split(fold_column(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spell_tokens(c: Column) -> Column:
    """Distinct lower-case words without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def suggest_key(c: Column) -> Column:
    return F.lower(c)


def query_terms(text: str) -> list[str]:
    """Terms of a query with signs that stand alone removed."""
    return [t for t in unicodedata.normalize("NFC", text).split() if t not in PUNCTUATION and t != "--"]
