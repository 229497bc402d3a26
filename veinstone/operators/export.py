"""Exports: CSV rows, e-mail fields, Dublin Core, files by row, and display lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip_tags

#: CSV columns in order, and the fields they come from.
CSV_COLUMNS = {
    "id": "id", "repository": "repository_ssim", "collection_unitid": "collection_unitid_ssm", "ead_id": "ead_ssi", "level": "level_ssm", "title": "normalized_title_ssm",
    "date": "normalized_date_ssm", "containers": "containers_ssim", "description": "abstract_tesim", "extent": "extent_ssm",
}
_DUBLIN = {"identifier": "id", "title": "normalized_title_ssm", "creator": "creator_ssim", "date": "normalized_date_ssm", "description": "abstract_tesim", "language": "language_ssim", "coverage": "places_ssim", "subject": "access_subjects_ssim", "publisher": "repository_ssim"}


def csv_rows(docs: DataFrame) -> DataFrame:
    """The ten columns; lists are joined by |, tags are removed from title and description, and missing ones are empty."""
    out = []
    for name, field in CSV_COLUMNS.items():
        c = (F.concat_ws("|", field) if docs.schema[field].dataType.typeName() == "array" else F.col(field)) if field in docs.columns else F.lit("")
        out.append((strip_tags(c) if name in ("title", "description") else c).alias(name))
    return docs.select(*out)


def write_csv(docs: DataFrame, path: str) -> None:
    csv_rows(docs).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def present_fields(**fields: Column) -> Column:
    """array<struct<label, value>> of the fields that have a value."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in fields.items()]), lambda f: f["value"].isNotNull() & (f["value"] != ""))


def dublin_core(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(field).alias(f"dc_{name}") for name, field in _DUBLIN.items() if field in docs.columns])


def available_downloads(files: Column, disabled: Column) -> Column:
    """Files with a size, PDF before EAD; other kinds and disabled rows give none."""
    some = lambda kind: F.filter(files, lambda f: (f["type"] == kind) & (f["size"] > 0))
    return F.when(disabled, F.slice(files, 1, 0)).otherwise(F.concat(some("pdf"), some("ead")))


def write_files(rows: DataFrame, directory: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """Writes one file for each row with the cluster's file system; returns (file_name, written).

    Rows are grouped by name, so two attempts of a task write the same bytes to the same place.
    """
    target = directory.rstrip("/")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for n, data in zip(batch.column(0), batch.column(1)):
                where, path = fs.FileSystem.from_uri(f"{target}/{n.as_py()}")
                where.create_dir(path.rpartition("/")[0], recursive=True)
                with where.open_output_stream(path) as out:
                    out.write(data.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.as_py()) for x in batch.column(1)], pa.int64())], ["file_name", "written"])

    return rows.select(F.col(name).alias("file_name"), F.col(content).alias("content")).mapInArrow(run, "file_name string, written long")


# --- display of finding aids

#: Levels that are shown as series: fixed values.
SERIES_LEVELS = ("subcollection", "subgrp", "series", "subseries", "collection", "fonds", "recordgrp", "subfonds", "class")
ADMINISTRATIVE = ("accessrestrict", "userestrict", "custodhist", "accruals", "altformavail", "acqinfo", "processinfo", "appraisal", "originalsloc")
SECTIONS = ("did", "bioghist", "scopecontent", "arrangement", "fileplan", *ADMINISTRATIVE, "relatedmaterial", "separatedmaterial", "controlaccess", "otherfindaid", "phystech", "odd", "bibliography", "index", "dsc")


def section_order(tag: Column) -> Column:
    """A section's place in the display order; null for tags that are not shown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), tag), F.lit(0)).cast("int")


def is_series(level: Column, has_container: Column) -> Column:
    return F.coalesce(level.isin(*SERIES_LEVELS), F.lit(False)) | ((level == "otherlevel") & ~has_container)


def component_title(title: Column, date: Column, date_type: Column, online: Column) -> Column:
    shown = F.when(date_type == "bulk", F.concat(F.lit("("), date, F.lit(")"))).otherwise(date)
    comma = F.when((F.length(title) > 1) & (F.length(shown) > 1), F.concat(title, F.lit(", "), shown)).otherwise(F.concat(F.coalesce(title, F.lit("")), F.coalesce(shown, F.lit(""))))
    return F.concat(comma, F.when(online, " (online item available)").otherwise(""))


def first_title(titles: Column) -> Column:
    """The first title that is not for filing, else the first; titles: array<struct<type, value>>."""
    shown = F.filter(titles, lambda t: F.coalesce(t["type"] != "filing", F.lit(True)))
    return F.coalesce(F.get(shown, F.lit(0))["value"], F.get(titles, F.lit(0))["value"])


def object_title(children: Column, title: Column, href: Column) -> Column:
    return F.coalesce(F.nullif(children, F.lit("")), F.nullif(title, F.lit("")), href)


def node_id(own: Column, position: Column) -> Column:
    return F.coalesce(own, F.concat(F.lit("n"), position))


def indent(depth: Column, step: int = 8) -> Column:
    return F.least(F.greatest(depth, F.lit(1)), F.lit(12)) * step


#: Roman signs, the largest first: fixed values.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def list_number(n: Column, style: Column) -> Column:
    """A list item's mark: arabic, letters or roman numerals, else a bullet."""
    roman, rest = F.lit(""), n
    for value, mark in ROMAN:
        times = F.floor(rest / value)
        roman, rest = F.concat(roman, F.repeat(F.lit(mark), times.cast("int"))), rest % value
    # Letters count without a zero: z is followed by aa. A long has at most 14 of them.
    signs, rest = [], n.cast("long")
    for _ in range(14):
        signs.append(F.when(rest > 0, F.char((rest - 1) % 26 + 97)).otherwise(""))
        rest = F.floor((rest - 1) / 26)
    letter = F.concat(*reversed(signs))
    return F.when(style == "arabic", n.cast("string")).when(style == "upperalpha", F.upper(letter)).when(style == "loweralpha", letter).when(style == "upperroman", F.upper(roman)).when(style == "lowerroman", roman).otherwise("•")


def with_labels(rows: DataFrame, table: DataFrame, code: str, label: str) -> DataFrame:
    """A code's display name from a table (code, label), empty where there is none; for tag, language and source names."""
    return rows.join(table.select(F.col("code").alias(code), F.col("label").alias(label)), code, "left").withColumn(label, F.coalesce(label, F.lit("")))


def container_groups(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Numbers a list's runs, each of which starts at a labelled container."""
    from pyspark.sql import Window

    return rows.withColumn("run", F.sum(F.col("label").isNotNull().cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
