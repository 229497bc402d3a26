"""Records of the source's repositories, and small rules of views, bookmarks and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# --- repositories


def repository_rows(body: DataFrame, column: str = "body") -> DataFrame:
    """(code, uri, ark_shoulder, key) from JSON arrays of repositories; codes are in small letters."""
    shape = "array<struct<repo_code: string, uri: string, ark_shoulder: string, key: string>>"
    rows = body.select(F.explode(F.from_json(column, shape)).alias("r"))
    return rows.select(F.lower("r.repo_code").alias("code"), "r.uri", "r.ark_shoulder", "r.key")


def harvestable(repositories: DataFrame, listed: DataFrame) -> DataFrame:
    """Repositories whose code their configuration lists, as rows (config_set, code); without a list there are none."""
    return repositories.join(listed.select("config_set", "code").distinct(), ["config_set", "code"], "left_semi")


def find_repository(repositories: DataFrame, code: str, config_set: str = "default") -> DataFrame:
    """The first match by uri; no row where there is none."""
    return repositories.where((F.col("code") == code) & (F.col("config_set") == config_set)).orderBy("uri").limit(1)


def first_of_each(lists: Column) -> Column:
    """The first value of a list; null for an empty or missing one."""
    return F.get(lists, F.lit(0))


# --- scans


def scan_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key behind a value, for scans in pages: the filter reaches the scan, and no offset is read."""
    some = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return some.orderBy(key).limit(size)


def batch_number(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with a batch number, `size` keys wide: batches come from the key, so no task sees all rows."""
    return rows.withColumn("batch", F.floor(F.col(key) / size).cast("long"))


# --- views


def has_components(n: Column) -> Column:
    return F.coalesce(n.cast("int"), F.lit(0)) > 0


def is_online(flags: Column) -> Column:
    return F.coalesce(F.array_contains(flags, "true"), F.lit(False))


def embedded(links: Column, pattern: str) -> Column:
    """The first link that can be embedded, as a list of at most one; links: array<struct<label, href>>."""
    return F.slice(F.filter(links, lambda o: o["href"].rlike(pattern)), 1, 1)


def links_beside(links: Column, shown: Column) -> Column:
    """The links that the embedded one does not show already; a list of that one alone is hidden."""
    href = F.get(shown, F.lit(0))["href"]
    return F.when(F.size(shown) == 0, links).otherwise(F.filter(links, lambda o: o["href"] != href))


def unit_pill(level: Column, depth: Column, unit_id: Column) -> Column:
    """A collection's own identifier; null for components."""
    from .relational import is_collection

    return F.when(is_collection(level, depth), unit_id)


def address_in(address: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/8; false for anything else."""
    base, _, bits = network.partition("/")
    number = lambda parts: sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts.split(".")))
    size = 1 << (32 - int(bits or 32))
    parts = F.split(address, r"\.")
    value = sum((F.element_at(parts, k + 1).try_cast("long") * F.lit(1 << 8 * (3 - k)) for k in range(1, 4)), F.element_at(parts, 1).try_cast("long") * F.lit(1 << 24))
    valid = address.rlike(r"^(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    low = number(base) // size * size
    return F.coalesce(F.when(valid, value.between(low, low + size - 1)), F.lit(False))


def is_exempt(address: Column, networks: list[str]) -> Column:
    out = F.lit(False)
    for n in networks:
        out = out | address_in(address, n)
    return out


# --- bookmarks, downloads


def clear_for(rows: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """The rows that stay when all rows of some users go."""
    return rows.join(users.select(user).distinct(), user, "left_anti")


def page_only(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """An export carries the rows of the page that is shown."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def bookmark_notes(page: Column, shown: Column, total: Column) -> Column:
    """Names of the notes that a bookmark page shows: a disclaimer on the first page, a note when more are kept than shown."""
    return F.array_compact(F.array(F.when(page == 1, "disclaimer"), F.when(total > shown, "export_info")))


def download_link(id_col: Column, kind: str = "xml") -> Column:
    return F.format_string(f"/download/%s.{kind}", id_col)


def json_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """One JSON text for each row, of the columns that are asked for."""
    return docs.select(F.to_json(F.struct(*(columns or docs.columns))).alias("json"))


def severe_lines(log: Column) -> Column:
    """The lines of a formatter's log that say why it failed."""
    return F.filter(F.split(log, r"\r?\n"), lambda x: x.contains("SEVERE:"))


def convert_files(files: DataFrame, convert, is_valid=lambda data: bool(data)) -> DataFrame:
    """(path, content, error): a hook for an outside formatter, such as one that lays out PDF; convert(bytes) -> bytes.

    Each row is a file of its own; a failure or an invalid result is an error in the row and stops no other file.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    made = convert(data.as_py())
                    rows.append((path, made, None) if is_valid(made) else (path, None, "not valid"))
                except Exception as e:  # noqa: BLE001 the outside tool's failure is this row's
                    rows.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


# --- contents of a finding aid


def contents(docs: DataFrame, levels: tuple[str, ...] = ("series", "subseries"), level: str = "level") -> DataFrame:
    """(_root_, id, parent, depth, title, place): a block's table of contents of two levels, in document order.

    A second-level entry whose parent is not in the first level stands at the first."""
    from pyspark.sql import Window

    rows = docs.where(F.lower(level).isin(*levels))
    tops = rows.where(F.lower(level) == levels[0]).select(F.col("id").alias("_top"))
    rows = rows.join(tops, rows["_nest_parent_"] == tops["_top"], "left")
    place = F.row_number().over(Window.partitionBy("_root_").orderBy("sort_isi", "id"))
    return rows.select("_root_", "id", F.col("_top").alias("parent"), F.when(F.col("_top").isNull(), 1).otherwise(2).alias("depth"), "title", place.alias("place"))
