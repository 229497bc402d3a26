"""Lookups, counts and records: points, dimensions, totals of collections and repositories, sets, and slices of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as S

#: Length from which on restrictions are cut: a fixed value.
RESTRICTION_CHARS = 250


# --- lookups


def document(docs: DataFrame, key, id_col: str = "id") -> DataFrame:
    """At most one row with the id, a literal or a column of one row's value."""
    return docs.where(F.col(id_col) == key).limit(1)


def with_repository(docs: DataFrame, repositories: DataFrame, name: str, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Each row with its repository's columns (behind repository_), found by any of the keys, the first of them first; null where there is none.

    repositories is the settings table: one row for each repository."""
    known = reduce(DataFrame.unionByName, [repositories.select(F.col(k).alias("_key"), F.lit(n).alias("_n"), F.struct("*").alias("_r")) for n, k in enumerate(keys)])
    one = known.where("_key is not null").groupBy("_key").agg(F.min_by("_r", F.struct("_n", F.to_json("_r"))).alias("_r"))
    out = docs.join(one, docs[name] == one["_key"], "left")
    return out.select(*docs.columns, *(F.col(f"_r.{c}").alias(f"repository_{c}") for c in repositories.columns))


def bookmarked(bookmarks: DataFrame, docs: DataFrame, document_id: str = "document_id", id_col: str = "id") -> DataFrame:
    """Bookmarks with their documents; those whose document is gone are left out."""
    return bookmarks.join(docs, bookmarks[document_id] == docs[id_col])


# --- counts


def hits(docs: DataFrame) -> DataFrame:
    """One row: the number of matches, whatever page is shown."""
    return docs.agg(F.count(F.lit(1)).alias("hits"))


def query_counts(docs: DataFrame, **queries: Column) -> DataFrame:
    """One row: how many rows each named query holds for, in one pass; a null answer does not count."""
    return docs.agg(*(F.count_if(c).alias(n) for n, c in queries.items()))


def collections(docs: DataFrame, level: Column | str = "level") -> Column | DataFrame:
    """One row: the number of collections."""
    c = F.col(level) if isinstance(level, str) else level
    return docs.agg(F.count_if(c == "Collection").alias("collections"))


def per_repository(repositories: DataFrame, docs: DataFrame, key: str, one: str = "collection", many: str = "collections") -> DataFrame:
    """Each repository with its number of documents and that number as a label; 0 where it has none."""
    counts = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return repositories.join(counts, key, "left").withColumn("n", n).withColumn("label", S.counted(F.col("n"), one, many))


def collection_totals(components: DataFrame, online: Column, changed: str, root: str = "_root_") -> DataFrame:
    """(_root_, components, online, last_indexed) of each collection."""
    return components.groupBy(F.col(root).alias("_root_")).agg(F.count(F.lit(1)).alias("components"), F.count_if(online).alias("online"), shown_day(F.max(changed)).alias("last_indexed"))


def shown_day(time: Column) -> Column:
    """The day of a time, as it is shown."""
    return F.to_date(time)


# --- sets


def unpublished(keys: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Different keys that are not published; a null key stays unless a null one is published."""
    other = published.select(F.col(published.columns[0]).alias("_other")).distinct()
    return keys.select(key).distinct().join(other, F.col(key).eqNullSafe(F.col("_other")), "left_anti")


def together(*sets: DataFrame) -> DataFrame:
    """All rows of several sets of settings, repeated ones included; columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


# --- records


def digest(key: Column | str) -> Column:
    """The hashed id: MD5 in small hexadecimal letters."""
    return F.md5(F.col(key) if isinstance(key, str) else key)


def dig(body: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a JSON text, or an empty list where an array is asked for and none is there; bad JSON has no values."""
    found = F.try_variant_get(F.try_parse_json(body), path, kind)
    return F.coalesce(found, F.array().cast(kind)) if kind.startswith("array") else found


def sliced(rows: DataFrame, fields: dict[str, str], small: tuple[str, ...] = ("code",)) -> DataFrame:
    """Records with some of their fields under new names (new name: field); a field that the rows lack is null, and the
    values of `small` are in small letters."""
    have = {c.lower(): c for c in rows.columns}
    of = lambda f: F.col(f"`{have[f.lower()]}`") if f.lower() in have else F.lit(None).cast("string")
    return rows.select(*((F.lower(of(f)) if n in small else of(f)).alias(n) for n, f in fields.items()))


def pairs(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value): of rows with one key the value of the last, by place; a null key is a key."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(value, place).alias("value"))


# --- checks and notes


def known_code(code: Column, codes: list[str]) -> Column:
    """The repository's code; a code that the settings do not have is an error, a null one stays null."""
    return F.when(code.isNull() | code.isin(*codes), code).otherwise(F.raise_error(F.concat(F.lit("unknown repository: "), code)))


def restrictions(notes: Column, link: str = "", most: int = RESTRICTION_CHARS) -> Column:
    """Notes in one line; a longer one is cut behind a word, and the link follows it."""
    line = F.array_join(F.coalesce(notes, F.array(F.lit(""))), " ")
    short = F.regexp_replace(F.substring(line, 1, most), r"\s\S*$", "")
    return F.when(F.length(line) > most, F.concat(short, F.lit(link))).otherwise(line)
