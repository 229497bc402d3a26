"""Deep pages by cursors: a cursor holds the whole sort key of the last row seen, and the next page is a filter, not an offset."""

from __future__ import annotations

import base64
import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, functions as F

Keys = list[tuple[str, str]]


def encode(row: Row, keys: Keys) -> str:
    """The cursor behind a row; keys: (column, asc or desc), of which the last must be unique."""
    plain = lambda v: {"at": v.isoformat()} if isinstance(v, datetime | date) else {"n": str(v)} if isinstance(v, Decimal) else v
    return base64.urlsafe_b64encode(json.dumps([[c, way, plain(row[c])] for c, way in keys]).encode()).decode()


def after(cursor: str, keys: Keys, docs: DataFrame) -> Column:
    """Rows that come later in the order, nulls last in both directions; a cursor of another order is refused."""
    parts = json.loads(base64.urlsafe_b64decode(cursor))
    if [p[:2] for p in parts] != [list(k) for k in keys]:
        raise ValueError("the cursor belongs to another order")
    later, same = F.lit(False), F.lit(True)
    bound = None
    for k, (column, way, value) in enumerate(parts):
        kind = docs.schema[column].dataType
        c = F.col(column)
        if value is None:  # nothing comes after a null but what has the same null and is later in the next keys
            same = same & c.isNull()
            continue
        v = F.lit(next(iter(value.values())) if isinstance(value, dict) else value).cast(kind)
        beyond = c > v if way == "asc" else c < v
        later = later | same & (beyond | c.isNull())
        same = same & (c == v)
        if not k and not docs.schema[column].nullable:
            bound = c >= v if way == "asc" else c <= v  # reaches the scan; the rest is decided on what it reads
    return later if bound is None else bound & later


def order(keys: Keys) -> list[Column]:
    return [F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c) for c, way in keys]


def page_after(docs: DataFrame, keys: Keys, cursor: str | None = None, rows: int = 250) -> DataFrame:
    """The next rows behind a cursor, the first ones without one. Only `rows` rows of each task are kept while sorting."""
    some = docs if cursor is None else docs.where(after(cursor, keys, docs))
    return some.orderBy(*order(keys)).limit(rows)


def walk(docs: DataFrame, keys: Keys, rows: int = 250):
    """All pages as lists of rows, one job each."""
    cursor = None
    while page := page_after(docs, keys, cursor, rows).collect():
        yield page
        cursor = encode(page[-1], keys)
