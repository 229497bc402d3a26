"""Document schema by field suffix, and the derived fields of an index document."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import text as S
from ..functions.analyzers import identifier_match


class Kind(NamedTuple):
    type: T.DataType
    stored: bool
    indexed: bool
    many: bool


_S, _I, _LONG = T.StringType(), T.IntegerType(), T.LongType()
#: Suffixes and what they say about a field; the longest fitting one counts.
SUFFIXES = {
    "_tesim": Kind(_S, True, True, True), "_tesm": Kind(_S, True, False, True), "_teim": Kind(_S, False, True, True), "_si": Kind(_S, False, True, False), "_sim": Kind(_S, False, True, True),
    "_ssm": Kind(_S, True, False, True), "_ssi": Kind(_S, True, True, False), "_ssim": Kind(_S, True, True, True), "_isim": Kind(_I, True, True, True), "_is": Kind(_I, True, False, False),
    "_ii": Kind(_I, False, True, False), "_isi": Kind(_I, True, True, False), "_sort": Kind(_S, False, True, False), "spell": Kind(_S, False, True, True), "suggest": Kind(_S, False, True, True),
}
CORE = {"id": _S, "_version_": _LONG, "timestamp": T.TimestampType(), "text": _S, "_root_": _S, "_nest_parent_": _S, "_nest_path_": _S, "identifier_search": _S, "unitid_identifier_match": _S, "ead_identifier_match": _S}
NOTES = "abstract accessrestrict accruals acqinfo altformavail appraisal arrangement bibliography bioghist custodhist did_note fileplan indexes materialspec note odd originalsloc physdesc physloc phystech processinfo relatedmaterial scopecontent separatedmaterial userestrict".split()
#: Derived fields and the fields that they copy: fixed values. Copies are not copied on.
COPIES = {
    "normalized_title_teim": ["normalized_title_ssm"], "place_teim": ["places_ssim"], "name_teim": ["names_ssim"], "subject_teim": ["access_subjects_ssim"], "container_teim": ["containers_ssim"],
    "identifier_search": ["id", "ead_ssi", "ref_ssm", "unitid_ssm"],
    "text": ["normalized_title_ssm", "places_ssim", "names_ssim", "access_subjects_ssim", "containers_ssim", *(f"{n}_tesim" for n in NOTES), "prefercite_tesim", "language_ssim", "parent_unittitles_tesim", "unitid_ssm"],
    "suggest": ["normalized_title_ssm", "collection_ssim", "names_ssim", "repository_ssim", "places_ssim", "access_subjects_ssim"],
}


def kind_of(field: str) -> Kind:
    """The field's kind; unknown names are an error."""
    if field in CORE:
        return Kind(CORE[field], field != "text", True, False)
    fits = [s for s in SUFFIXES if field.endswith(s)]
    if not fits and field.startswith("random_"):
        return Kind(_S, False, True, False)
    if not fits:
        raise ValueError(f"unknown field {field}")
    return SUFFIXES[max(fits, key=len)]


def schema_of(fields: list[str]) -> T.StructType:
    """A schema from field names."""
    made = [(f, kind_of(f)) for f in fields]
    return T.StructType([T.StructField(f, T.ArrayType(k.type) if k.many else k.type, f != "id") for f, k in made])


def stored(docs: DataFrame) -> DataFrame:
    """The fields that a search may return."""
    return docs.select(*[c for c in docs.columns if kind_of(c).stored])


def indexed(docs: DataFrame) -> DataFrame:
    """The fields that can be searched."""
    return docs.select(*[c for c in docs.columns if kind_of(c).indexed])


def derive(docs: DataFrame) -> DataFrame:
    """Adds the derived fields of the columns that are there: copies, sort keys and identifier tokens."""
    have = set(docs.columns)
    listed = lambda c: F.coalesce(F.col(c) if isinstance(docs.schema[c].dataType, T.ArrayType) else F.array_compact(F.array(F.col(c))), F.array().cast("array<string>"))
    new = {}
    for to, sources in COPIES.items():
        some = [listed(c) for c in sources if c in have]
        if some:
            new[to] = F.array_distinct(F.concat(*some)) if to == "suggest" else F.concat(*some)
    for to, source in (("unitid_identifier_match", "unitid_ssm"), ("ead_identifier_match", "ead_ssi")):
        if source in have:
            new[to] = identifier_match(F.array_join(listed(source), " "))
    for to, source in (("title_sort", "normalized_title_ssm"), ("date_sort", "normalized_date_ssm")):
        if source in have:
            new[to] = S.sort_text(F.get(F.col(source), F.lit(0)))
    return docs.withColumns(new)
