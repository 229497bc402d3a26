"""String functions on columns: identifiers, titles, persistent identifiers, links, labels and file names.

All are built-in expressions, apart from parameterize() and identifier(), whose Unicode folding needs Python and runs
over Arrow batches. A null stays null unless a function says otherwise; blank means null, empty or white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .batches import batched

NO_TITLE = "[NO TITLE PROVIDED]"
#: Letters in front of a file identifier that name a sub-collection: fixed values.
RARE_BOOKS = ("amernews", "comics", "macweek", "pn", "sanitary")
UNIVERSITY = ("a", "f", "pc", "sc", "scm", "v")


def presence(c: Column) -> Column:
    """Null for a blank value."""
    return F.when(~c.rlike(r"^\s*$"), c)


def parameterize_text(text: str) -> str:
    """Lower-case ASCII words joined by hyphens; letters without an ASCII form are dropped with the separators."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    folded = "".join(c if ord(c) < 128 else "?" for c in folded)
    return re.sub(r"-{2,}", "-", re.sub(r"[^A-Za-z0-9\-_]+", "-", folded)).strip("-").lower()


def identifier_text(values: Iterable[str | None], words: int = 5) -> str | None:
    """The first value that gives a name: its .xml ending dropped, its first words parameterised and joined."""
    for value in values:
        if value:
            parts = [p for p in map(parameterize_text, re.sub(r"\.xml$", "", value, flags=re.I).split()) if p]
            if parts:
                return "-".join(parts[:words])
    return None


parameterize = batched(lambda value: None if value is None else parameterize_text(value), StringType(), pa.string())
identifier_udf = batched(identifier_text, StringType(), pa.string())


def identifier(*values: Column) -> Column:
    """Null where no value gives a name; require_identifier() turns that into an error."""
    return identifier_udf(F.array(*values))


def ascii_identifier(*values: Column, words: int = 5) -> Column:
    """identifier() for ASCII values as built-in expressions, which stay inside generated code."""
    one = lambda v: F.array_join(F.slice(F.filter(F.transform(F.split(F.regexp_replace(v, r"(?i)\.xml$", ""), r"\s+"), lambda w: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[^A-Za-z0-9_-]+", "-"), "-{2,}", "-"), "^-|-$", ""))), lambda w: w != ""), 1, words), "-")
    return F.coalesce(*(F.nullif(one(v), F.lit("")) for v in values))


def require_identifier(c: Column) -> Column:
    return F.coalesce(c, F.raise_error(F.lit("no identifier could be made")))


def title(text: Column, date: Column) -> Column:
    """Title and date with one comma; a placeholder when both are blank."""
    clean = F.nullif(F.trim(F.regexp_replace(F.trim(text), r"\s*,\s*$", "")), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(", ", clean, F.nullif(F.trim(date), F.lit(""))), F.lit("")), F.lit(NO_TITLE))


def language(c: Column) -> Column:
    """A full stop that stands apart moves up to the word."""
    return F.trim(F.regexp_replace(c, r"\s+\.\s*$", "."))


def ark(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"ark:/\S+", 0), F.lit(""))


def ark_shoulder(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"ark:/\d*/([a-z]*\d).*", 1), F.lit(""))


def hyphenate_ark(c: Column, authority: str = r"\d+") -> Column:
    """Hyphens put into an identifier of 32 hex digits behind its shoulder; anything else unchanged."""
    h = lambda n: f"([0-9a-f]{{{n}}})"
    return F.regexp_replace(c, rf"(?i)^(ark:/{authority}/[a-z]\d){h(8)}{h(4)}{h(4)}{h(4)}{h(12)}$", "$1$2-$3-$4-$5-$6")


def is_ark(c: Column, authority: str = r"\d+") -> Column:
    return c.rlike(rf"(?i)^ark:/{authority}/[a-z]\d(?:[0-9a-f]{{32}}|[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})$")


def repository_code(code: Column, file_identifier: Column, shared: str = "speccoll") -> Column:
    """The code itself; for the shared code, a sub-collection by the identifier's leading letters."""
    letters = F.lower(F.regexp_extract(file_identifier, "(?i)^[A-Z]*", 0))
    return F.when(code != shared, code).when(letters.isin(*RARE_BOOKS), "rarebooks").when(letters.isin(*UNIVERSITY), "uarc").otherwise("manuscripts")


def link(href: Column, resolver: str) -> Column:
    """Trimmed; http links of the resolver become https, and bare object names get the resolver in front."""
    h = F.trim(href)
    host = re.escape(resolver.split("://")[1].rstrip("/"))
    return F.when(h.rlike(rf"^https?://{host}"), F.regexp_replace(h, "^http:", "https:")).when(h.rlike(r"^[a-z]{2}\d{3}[a-z]{2}\d{4}$"), F.concat(F.lit(resolver.rstrip("/") + "/"), h)).otherwise(h)


def digital_objects(c: Column, resolver: str) -> Column:
    """array<struct<label, href>> from JSON texts; blank texts are dropped and blank labels show the link."""
    parsed = F.transform(F.filter(c, lambda j: ~j.rlike(r"^\s*$")), lambda j: F.from_json(j, "label string, href string"))
    return F.transform(parsed, lambda o: F.struct(F.coalesce(presence(o["label"]), link(o["href"], resolver)).alias("label"), link(o["href"], resolver).alias("href")))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def truncate(c: Column, size: int, omission: str = "...") -> Column:
    """At most `size` characters with the omission, cut at a space where there is one."""
    head = F.substring(c, 1, size - len(omission) + 1)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.when(head.contains(" "), F.regexp_replace(head, r"\s\S*\z", "")).otherwise(F.substring(c, 1, size - len(omission))), F.lit(omission)))


def truncate_words(c: Column, words: int, separators: str = r"[\s,;]", omission: str = "...") -> Column:
    cut = F.regexp_extract(c, rf"(?s)^((?:.+?{separators}){{{words - 1}}}.+?){separators}.*$", 1)
    return F.when(cut == "", c).otherwise(F.concat(cut, F.lit(omission)))


def extent(c: Column) -> Column:
    return truncate_words(F.concat_ws("; ", c), 6)


def restrictions(c: Column, limit: int = 250) -> Column:
    """Paragraphs joined and, beyond the limit, cut at a space; a missing list is empty text."""
    return truncate(F.concat_ws(" ", c), limit, "")


def file_path(directory: Column, file_name: Column, kind: str) -> Column:
    """Path of a document's file; null without a directory or name."""
    path = F.when(directory.isNotNull() & file_name.isNotNull(), F.concat_ws("/", directory, file_name))
    if kind not in ("xml", "pdf"):
        raise ValueError(f"unknown file kind {kind}")
    return path if kind == "xml" else F.concat(F.regexp_replace(path, "(?i)xml$", ""), F.lit("pdf"))


def pdf_name(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, r"(?i)(\.xml|\.pdf)$", ""), F.lit(".pdf"))


def csv_name(prefix: str, day: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(day, "yyyyMMdd"), F.lit(".csv"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def tail_of(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def request_url(base: Column, path: Column) -> Column:
    return F.url_encode(F.concat(base, path, F.lit("?without_namespace=true")))


def role(c: Column) -> Column:
    """A role without its code in parentheses."""
    return F.when(c.contains(" ("), F.substring_index(c, " (", 1)).otherwise(c)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def sort_text(c: Column) -> Column:
    """Sort key: lower case, letters a-z and digits only."""
    return F.regexp_replace(F.trim(F.lower(c)), "[^a-z0-9]", "")
