"""Finding aids in EAD XML as index documents: one row for the collection and one for each component.

Files are read whole, one row each, and walked in Arrow batches; nothing but the file being walked is held. The
mapping from elements to fields is this engine's own. Document type declarations with entities are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import NO_TITLE, identifier_text

_MANY = "level_ssm unitid_ssm title_ssm normalized_title_ssm normalized_date_ssm repository_ssim collection_ssim creator_ssim names_ssim geogname_ssim places_ssim access_subjects_ssim containers_ssim extent_ssm language_ssim has_online_content_ssim digital_objects_ssm ref_ssm parent_unittitles_tesim".split()
NOTES = "abstract accessrestrict acqinfo arrangement bioghist custodhist odd prefercite processinfo relatedmaterial scopecontent separatedmaterial userestrict".split()
_ONE = "id hashed_id_ssi _root_ _nest_parent_ _nest_path_ ead_ssi ark_id_ssi ark_shoulder_ssi".split()
SCHEMA = ", ".join([*(f"{c} string" for c in _ONE), "sort_isi int", "component_level_isim array<int>", "date_range_isim array<int>", *(f"{c} array<string>" for c in _MANY), *(f"{n}_tesim array<string>" for n in NOTES)])
_COMPONENT = re.compile(r"^c(0[1-9]|1[0-2])?$")
_URI = re.compile(r"^/repositories/\d+/(resources|archival_objects)/\d+$")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, repository) of all XML files below a folder; the repository is the parent folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("repository"))


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse(content: bytes) -> ET.Element:
    if b"<!ENTITY" in content:
        raise ValueError("entities are not allowed")
    root = ET.fromstring(content)
    for node in root.iter():
        node.tag = _name(node.tag)
        node.attrib = {_name(k): v for k, v in node.attrib.items()}
    return root


def _text(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _texts(node: ET.Element | None, path: str) -> list[str]:
    return [t for x in (node.findall(path) if node is not None else []) if (t := _text(x))]


def _years(did: ET.Element | None) -> list[int]:
    out: set[int] = set()
    for d in did.findall("unitdate") if did is not None else []:
        found = [int(y) for y in re.findall(r"(?:^|/)(\d{4})", d.get("normal", ""))]
        if found:
            out.update(range(min(found), max(found) + 1))
    return sorted(out)


def _fields(node: ET.Element, component: bool) -> dict:
    did = node.find("did")
    title = re.sub(r"\s*,\s*$", "", (_texts(did, "unittitle") or [""])[0])
    dates = [d for d in _texts(did, "unitdate")]
    href = next((x.get("href", "") for x in (did.findall("unitid[@type='ark']/extref") if did is not None else [])), "")
    ark = re.search(r"ark:/\S+", href)
    out = {
        "ark_id_ssi": ark[0] if ark else None,
        "level_ssm": [node.get("level", "")] if node.get("level") else [],
        "title_ssm": [title] if title else [],
        "normalized_date_ssm": [", ".join(dates)] if dates else [],
        "normalized_title_ssm": [", ".join(x for x in (title, ", ".join(dates)) if x) or NO_TITLE],
        "date_range_isim": _years(did),
        "unitid_ssm": [t for t in _texts(did, "unitid") if t not in ("Archival Resource Key", "Previous Archival Resource Key") and not _URI.match(t)],
        "extent_ssm": _texts(did, "physdesc/extent"),
        "language_ssim": [re.sub(r"\s+\.\s*$", ".", t).strip() for t in _texts(did, "langmaterial")],
        "containers_ssim": [f"{c.get('type', '')} {_text(c)}".strip() for c in (did.findall("container") if did is not None else [])],
        "creator_ssim": [t for t in _texts(did, "origination") if t.strip()],
        "names_ssim": [t for k in ("persname", "corpname", "famname") for t in _texts(node, f"controlaccess//{k}")],
        "geogname_ssim": _texts(node, "controlaccess//geogname"),
        "places_ssim": _texts(node, "controlaccess//geogname"),
        "access_subjects_ssim": [t for k in ("subject", "genreform", "function", "occupation") for t in _texts(node, f"controlaccess//{k}")],
        "ref_ssm": [node.get("id")] if node.get("id") else [],
    }
    if not component and ark:
        shoulder = re.search(r"ark:/\d*/([a-z]*\d).*", ark[0])
        out["ark_shoulder_ssi"] = shoulder[1] if shoulder else None
    daos = [d for tag in ("dao", "did/dao") for d in node.findall(tag)]
    out["digital_objects_ssm"] = [json.dumps({"label": _text(d) or d.get("title", ""), "href": d.get("href", "")}) for d in daos]
    out["has_online_content_ssim"] = ["true"] if daos else []
    for n in NOTES:
        out[f"{n}_tesim"] = _texts(did, n) + [t for x in node.findall(n) for t in (_texts(x, "p") or _texts(x, "."))]
    return out


def documents_of(content: bytes, repository: str | None) -> list[dict]:
    """The collection's row, then its components' rows in document order."""
    ead = parse(content)
    arch = ead.find("archdesc")
    if arch is None:
        raise ValueError("no archdesc")
    head = _fields(arch, False)
    ead_id = " ".join((ead.findtext("eadheader/eadid") or "").split())
    root = identifier_text([ead_id, *head["unitid_ssm"], *head["title_ssm"]])
    if root is None:
        raise ValueError("no identifier could be made")
    names = {"repository_ssim": _texts(arch, "did/repository") or ([repository] if repository else []), "collection_ssim": head["normalized_title_ssm"]}
    out = [head | names | {"id": root, "_root_": root, "ead_ssi": ead_id or None, "sort_isi": 0, "component_level_isim": [0], "_nest_path_": "/"}]

    def walk(node: ET.Element, parent: str, path: str, depth: int, titles: list[str]) -> None:
        for child in node:
            if child.tag == "dsc" and depth == 0:
                walk(child, parent, path, 0, titles)
            elif _COMPONENT.match(child.tag):
                fields = _fields(child, True)
                own = f"{root}_{child.get('id') or f'n{len(out)}'}"
                out.append(fields | names | {"id": own, "_root_": root, "_nest_parent_": parent, "_nest_path_": f"{path}components#{len(out)}", "ead_ssi": ead_id or None, "sort_isi": len(out), "component_level_isim": [depth + 1], "parent_unittitles_tesim": titles})
                walk(child, own, f"{path}components#{len(out) - 1}/", depth + 1, titles + fields["normalized_title_ssm"])

    walk(arch, root, "/", 0, head["normalized_title_ssm"])
    for d in out:
        d["hashed_id_ssi"] = hashlib.md5(d["id"].encode()).hexdigest()
    return out


def bad_files(files: DataFrame) -> DataFrame:
    """(path, error) of the files that give no documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    documents_of(content.as_py() or b"", None)
                except (ValueError, ET.ParseError) as e:
                    found.append((path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], ["path", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def to_documents(files: DataFrame, repository: str | None = None, skip_bad: bool = False) -> DataFrame:
    """Index documents of files (path, content, repository); a given repository wins.

    A bad file fails with its path, or gives no documents where bad ones are skipped; bad_files() lists those.
    """
    types = [f.dataType for f in files.sparkSession.createDataFrame([], SCHEMA).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    names, arrow = [x.split()[0] for x in SCHEMA.split(", ")], [to_arrow_type(t) for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, code in zip(*(batch.column(i) for i in range(3))):
                try:
                    docs = documents_of(content.as_py(), repository or code.as_py())
                except (ValueError, ET.ParseError) as e:
                    if skip_bad:
                        continue
                    raise ValueError(f"{path.as_py()}: {e}") from e
                for k in range(0, len(docs), 1000):
                    part = docs[k : k + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([d.get(n) for d in part], t) for n, t in zip(names, arrow)], names)

    return files.select("path", "content", "repository").mapInArrow(run, SCHEMA)


def without_namespace(content: bytes) -> bytes:
    """The file with local names only; schema locations go, and link behaviour is lower-cased; comments stay."""
    if b"<!ENTITY" in content:
        raise ValueError("entities are not allowed")
    builder = ET.TreeBuilder(insert_comments=True, insert_pis=True)
    root = ET.fromstring(content, ET.XMLParser(target=builder))
    for node in root.iter():
        if isinstance(node.tag, str):
            node.tag = _name(node.tag)
            kept = {_name(k): v for k, v in node.attrib.items() if _name(k) != "schemaLocation"}
            node.attrib.clear()
            node.attrib.update({k: v.lower() if k == "actuate" and v in ("onRequest", "onLoad") else v for k, v in kept.items()})
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def pretty(content: bytes) -> bytes:
    """The file with two spaces for each level and no blank text between elements."""
    root = ET.fromstring(content)
    ET.indent(root, "  ")
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def with_namespaces(content: bytes, default: str) -> bytes:
    """A default namespace on the root element where none is declared."""
    return content if re.search(rb"<ead\b[^>]*\sxmlns=", content) else re.sub(rb"<ead\b", f'<ead xmlns="{default}"'.encode(), content, count=1)
