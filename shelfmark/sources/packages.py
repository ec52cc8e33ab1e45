"""Structural checks and metadata of packaged documents, one content read for both."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.files import stem
from shelfmark.functions.metadata import isbn_from_identifiers, parse_number
from shelfmark.session import bound_batches
from shelfmark.sources.files import open_file

# Names and namespaces of the package format.
CONTAINER = "META-INF/container.xml"
MIMETYPE = "application/epub+zip"
OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
OCF = "{urn:oasis:names:tc:opendocument:xmlns:container}"
READABLE_TYPES = {"application/xhtml+xml", "text/html", "application/html+xml"}
READABLE_SUFFIXES = (".xhtml", ".html", ".htm")
# Fixed value: encodings tried for member names.
NAME_ENCODINGS = ("utf-8", "cp437", "latin-1")

_FOUND = (
    "ok boolean, errors array<string>, warnings array<string>, "
    "raw struct<title:string, sort_title:string, creators:array<string>, publisher:string, "
    "published_date:string, language:string, description:string, series:string, "
    "series_index:string, subjects:array<string>, "
    "identifiers:array<struct<scheme:string, text:string>>>, metadata_error string"
)
INSPECTED = f"path string, {_FOUND}"


class Broken(Exception):
    """A fault after which nothing more can be checked."""


def resolve_href(opf_path: str, href: str) -> str:
    """Archive member an href of the package document points to."""
    href = unquote(href.strip())
    if href.startswith("/"):
        return href.lstrip("/").replace("\\", "/")
    # leading ".." beyond the archive root are dropped, as by normalising an absolute path
    joined = posixpath.join("/", posixpath.dirname(opf_path), href)
    return posixpath.normpath(joined).lstrip("/").replace("\\", "/")


# The texts of findings.
MESSAGES = {
    "gone": "file not found",
    "empty": "file is empty",
    "no zip": "not a ZIP archive",
    "bad zip": "bad ZIP archive",
    "names": "unreadable ZIP member names: {0}",
    "data": "corrupt ZIP data: {0}",
    "archive": "corrupt ZIP archive: {0}",
    "member": "corrupt ZIP member: {0}",
    "member data": "corrupt ZIP member {0}: {1}",
    "no mimetype": "missing mimetype",
    "mimetype": "unexpected mimetype: {0!r}",
    "no container": "missing META-INF/container.xml",
    "no rootfile": "container.xml has no rootfile",
    "no opf": "OPF not found in archive: {0}",
    "xml": "invalid {0}: {1}",
    "no metadata": "OPF metadata section missing",
    "no spine": "OPF spine is empty",
    "no item": "spine itemref missing from manifest: {0}",
    "no content": "spine content missing from archive: {0}",
    "no body": "spine item is empty: {0}",
    "markup": "invalid spine markup in {0}: {1}",
    "unreadable": "spine has no readable HTML/XHTML content",
}
_DECLARED = re.compile(rb"""\A\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["'][^>]*\?>""")


def _say(key: str, *values) -> str:
    return MESSAGES[key].format(*values)


def parse_xml(body: bytes) -> ET.Element:
    """The root element; encodings the parser does not know are decoded by their declaration."""
    try:
        return ET.fromstring(body)
    except (ValueError, LookupError):
        declared = _DECLARED.match(body)
        if not declared:
            raise
        return ET.fromstring(body[declared.end() :].decode(declared[1].decode("ascii")))


class _Package(NamedTuple):
    """An open archive and its members by name: as stored, else in lower case; the first of equals."""

    archive: zipfile.ZipFile
    members: dict[str, str]

    @classmethod
    def of(cls, data: bytes) -> _Package:
        faults = []
        for encoding in NAME_ENCODINGS:
            try:
                archive = zipfile.ZipFile(io.BytesIO(data), metadata_encoding=encoding)
            except UnicodeError as fault:
                faults.append(fault)
                continue
            stored = [(name.replace("\\", "/"), name) for name in reversed(archive.namelist())]
            return cls(archive, {path.lower(): name for path, name in stored} | dict(stored))
        raise Broken(_say("names", faults[-1]))

    def body(self, path: str) -> bytes:
        try:
            return self.archive.read(self.members[path])
        except zlib.error as fault:
            raise Broken(_say("member data", path, fault)) from fault

    def tree(self, path: str, what: str) -> ET.Element:
        try:
            return parse_xml(self.body(path))
        except ET.ParseError as fault:
            raise Broken(_say("xml", what, fault)) from fault


def _damage(package: _Package) -> None:
    """Every member's check sum; the first fault ends the inspection."""
    kinds = {zlib.error: "data", RuntimeError: "archive", EOFError: "archive"}
    try:
        bad = package.archive.testzip()
    except tuple(kinds) as fault:
        key = next(key for kind, key in kinds.items() if isinstance(fault, kind))
        raise Broken(_say(key, fault)) from fault
    if bad is not None:
        raise Broken(_say("member", bad))


def _mimetype_warnings(package: _Package) -> list[str]:
    if "mimetype" not in package.members:
        return [_say("no mimetype")]
    found = package.body("mimetype").decode("utf-8", errors="replace").strip()
    return [] if found == MIMETYPE else [_say("mimetype", found)]


def _package_document(package: _Package) -> tuple[str, ET.Element]:
    if CONTAINER not in package.members:
        raise Broken(_say("no container"))
    roots = package.tree(CONTAINER, "container.xml").iter(OCF + "rootfile")
    paths = [path for el in roots if (path := el.get("full-path", "").strip().replace("\\", "/"))]
    if not paths:
        raise Broken(_say("no rootfile"))
    if paths[0] not in package.members:
        raise Broken(_say("no opf", paths[0]))
    return paths[0], package.tree(paths[0], "OPF XML")


def _values(elements: Iterable[ET.Element], *names: str) -> list[tuple[str, ...]]:
    """Trimmed attributes of each element that has the first of them."""
    rows = [tuple(el.get(name, "").strip() for name in names) for el in elements]
    return [row for row in rows if row[0]]


def _content_findings(package: _Package, member: str, media_type: str) -> tuple[bool, str | None]:
    """(has text to read, fault) of one content document."""
    if member not in package.members:
        return False, _say("no content", member)
    body = package.body(member)
    if not body.strip():
        return False, _say("no body", member)
    if media_type not in READABLE_TYPES and not member.lower().endswith(READABLE_SUFFIXES):
        return False, None
    try:
        parse_xml(body)
    except (ET.ParseError, ValueError, LookupError) as fault:
        return True, _say("markup", member, fault)
    return True, None


def _spine_faults(package: _Package, opf_path: str, opf: ET.Element) -> list[str]:
    rows = _values(opf.iterfind(f".//{OPF}manifest/{OPF}item"), "id", "href", "media-type")
    manifest = {name: (resolve_href(opf_path, href), kind) for name, href, kind in rows if href}
    order = [ref for (ref,) in _values(opf.iterfind(f".//{OPF}spine/{OPF}itemref"), "idref")]
    if not order:
        raise Broken(_say("no spine"))
    findings = [
        _content_findings(package, *manifest[ref]) if ref in manifest else (False, _say("no item", ref)) for ref in order
    ]
    faults = [fault for _, fault in findings if fault]
    return faults if any(has_text for has_text, _ in findings) else [*faults, _say("unreadable")]


def _metadata(opf: ET.Element) -> dict | None:
    block = next(opf.iter(OPF + "metadata"), None)
    if block is None:
        return None

    def texts(tag: str) -> list[str]:
        return [el.text.strip() for el in block.findall(DC + tag) if el.text and el.text.strip()]

    def first(tag: str) -> str | None:
        return next(iter(texts(tag)), None)

    # tool-written extras carry no namespace prefix in some packages
    extras = {}
    for el in [*block.findall("meta"), *block.findall(OPF + "meta")]:
        if el.get("name") and el.get("content"):
            extras.setdefault(el.get("name"), el.get("content").strip())
    return {
        "title": first("title"),
        "sort_title": extras.get("calibre:title_sort"),
        "creators": texts("creator"),
        "publisher": first("publisher"),
        "published_date": first("date"),
        "language": first("language"),
        "description": first("description"),
        "series": extras.get("calibre:series"),
        "series_index": extras.get("calibre:series_index"),
        "subjects": texts("subject"),
        "identifiers": [
            {"scheme": el.get(OPF + "scheme", ""), "text": (el.text or "").strip()}
            for el in block.findall(DC + "identifier")
        ],
    }


def inspect_package(data: bytes | None) -> dict:
    """Faults, warnings and raw metadata of one package; whatever is odd about it becomes a fault."""
    errors, warnings, raw, metadata_error = [], [], None, None
    try:
        if not data:
            raise Broken(_say("gone" if data is None else "empty"))
        if not zipfile.is_zipfile(io.BytesIO(data)):
            raise Broken(_say("no zip"))
        package = _Package.of(data)
        _damage(package)
        warnings += _mimetype_warnings(package)
        opf_path, opf = _package_document(package)
        raw = _metadata(opf)
        metadata_error = None if raw else _say("no metadata")
        errors += _spine_faults(package, opf_path, opf)
    except zipfile.BadZipFile:
        errors.append(_say("bad zip"))
    except (Broken, OSError) as fault:
        errors.append(str(fault))
    except Exception as fault:  # one odd file must not end the job
        errors.append(f"{type(fault).__name__}: {fault}")
    return {
        "ok": not errors,
        "errors": errors,
        "warnings": warnings,
        "raw": raw,
        "metadata_error": metadata_error,
    }


def _bytes_at(path: str) -> bytes | None:
    try:
        with open_file(path) as stream:
            return stream.read()
    except OSError:
        return None


def _findings(packages: Iterable[bytes | None], index: pd.Index) -> pd.DataFrame:
    columns = ["ok", "errors", "warnings", "raw", "metadata_error"]
    found = pd.DataFrame([inspect_package(data) for data in packages], columns=columns, index=index, dtype=object)
    return found.assign(ok=found["ok"].astype(bool))


def _inspect_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # one package at a time: by path, only the one under inspection is in memory
        packages = batch["content"] if "content" in batch else map(_bytes_at, batch["path"])
        found = _findings(packages, batch.index)
        yield found.assign(path=batch["path"])[["path", *found.columns]]


def inspect_packages(files: DataFrame) -> DataFrame:
    """(path[, content]) to faults and raw metadata.

    Without a ``content`` column each package is opened by its path inside the task, so that
    no file bytes pass through a shuffle before this step.
    """
    bound_batches(files.sparkSession)
    columns = ["path", "content"] if "content" in files.columns else ["path"]
    return files.select(*columns).mapInPandas(_inspect_batches, INSPECTED)


def _found_in(content: pd.Series) -> pd.DataFrame:
    return _findings(content, content.index)


def with_inspection(files: DataFrame) -> DataFrame:
    """Files that carry their bytes, with faults and raw metadata in place of these; other columns stay."""
    bound_batches(files.sparkSession)
    facts = [n for n in files.columns if n != "content"]
    # made here, as the names of its types are read by a session
    found = F.pandas_udf(_found_in, _FOUND)
    return files.withColumn("_found", found("content")).select(*facts, "_found.*")


def validation(inspected: DataFrame) -> DataFrame:
    return inspected.select("path", "ok", "errors", "warnings")


def _joined(values: Column, separator: str) -> Column:
    return F.nullif(F.array_join(values, separator), F.lit(""))


def metadata(inspected: DataFrame) -> DataFrame:
    """Catalogue fields of each package; the title falls back to the file's stem."""
    raw = F.col("raw")
    google = F.filter(
        raw["identifiers"], lambda e: (F.upper(e["scheme"]) == "GOOGLE") & (e["text"] != "")
    )
    return inspected.select(
        "path",
        F.coalesce(raw["title"], stem(F.col("path"))).alias("title"),
        raw["sort_title"].alias("sort_title"),
        _joined(raw["creators"], "; ").alias("authors"),
        raw["publisher"].alias("publisher"),
        raw["published_date"].alias("published_date"),
        isbn_from_identifiers(raw["identifiers"]).alias("isbn"),
        raw["language"].alias("language"),
        raw["description"].alias("description"),
        raw["series"].alias("series"),
        parse_number(raw["series_index"]).alias("series_index"),
        _joined(raw["subjects"], ", ").alias("tags"),
        F.try_element_at(google, F.lit(1))["text"].alias("provider_id"),
        F.array_compact(F.array("metadata_error")).alias("metadata_errors"),
    )


def resolve_href_column(opf_path: Column, href: Column) -> Column:
    """:func:`resolve_href` as a built-in column; an href with a broken escape stays as it is."""
    trimmed = F.btrim(href)
    decoded = F.coalesce(F.try_url_decode(F.replace(trimmed, F.lit("+"), F.lit("%2B"))), trimmed)
    clean = F.translate(decoded, "\\", "/")
    parts = F.split(
        F.concat_ws("/", F.regexp_extract(opf_path, r"\A(.*)/[^/]*\z", 1), clean), "/"
    )
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(part.isin("", "."), done)
        .otherwise(F.concat(done, F.array(part))),
    )
    absolute = F.regexp_replace(clean, r"\A/+", "")
    return F.when(clean.startswith("/"), absolute).otherwise(F.array_join(walked, "/"))
