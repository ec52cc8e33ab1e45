"""The test tables seen as a library: books, files, covers, users, favourites, packages, images.

Every row derives from a row of the given tables. The case expressions only spread states (moved,
changed, copied files, missing values) over the rows; no row is left out for its id.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable
from functools import cached_property
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from shelfmark.schema import BOOKS
from shelfmark.session import bound_batches, shared_folder
from shelfmark.sources import catalog

ROOTS = ["/lib"]
NOW = "2024-06-01T00:00:00+00:00"
EPOCH = 1_700_000_000


def _by(value: Column, choices: dict[int, Column], other: Column) -> Column:
    chain = None
    for key, result in choices.items():
        chain = F.when(value == key, result) if chain is None else chain.when(value == key, result)
    return chain.otherwise(other)


# --- packages and images made of a row's text ------------------------------------------------

_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_CONTAINER = (
    '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf" '
    'media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def _xml(text: str | None) -> str:
    return escape(_NOT_XML.sub(" ", text or ""))


def make_package(fault: int, title, creator, language, isbn, series_index, text) -> bytes:
    """A small package; ``fault`` 0-7 breaks it in one way, any other number leaves it sound."""
    if fault == 7:
        return b""
    if fault == 1:
        return b"no archive: " + (text or "").encode()
    metadata = "" if fault == 6 else (
        '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'
        f"<dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(creator)}</dc:creator>"
        "<dc:creator>Second Hand</dc:creator>"
        f"<dc:language>{_xml(language)}</dc:language>"
        f'<dc:identifier opf:scheme="UUID">u-{fault}</dc:identifier>'
        f"<dc:identifier>isbn: {isbn}</dc:identifier>"
        "<dc:subject>prose</dc:subject><dc:subject>letters</dc:subject>"
        f'<meta name="calibre:series" content="Shelf"/>'
        f'<meta name="calibre:series_index" content="{series_index}"/></metadata>'
    )
    refs = "" if fault == 0 else '<itemref idref="lost"/>' if fault == 3 else '<itemref idref="c1"/>'
    opf = (
        f'<package xmlns="http://www.idpf.org/2007/opf" version="2.0">{metadata}<manifest>'
        '<item id="c1" href="text/../chapter%201.xhtml" media-type="application/xhtml+xml"/></manifest>'
        f"<spine>{refs}</spine></package>"
    )
    chapter = "<html><body></html>" if fault == 4 else f"<html><body><p>{_xml(text)}</p></body></html>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        # a fixed date, so that equal packages have equal bytes
        def put(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)

        put("mimetype", "text/plain" if fault == 5 else "application/epub+zip")
        if fault != 2:
            put("META-INF/container.xml", _CONTAINER)
        put("OEBPS/content.opf", opf)
        put("OEBPS/chapter 1.xhtml", chapter)
    return out.getvalue()


@F.pandas_udf(BinaryType())
def _package_bytes(
    fault: pd.Series, title: pd.Series, creator: pd.Series, language: pd.Series,
    isbn: pd.Series, series_index: pd.Series, text: pd.Series,
) -> pd.Series:
    return pd.Series(list(map(make_package, fault, title, creator, language, isbn, series_index, text)))


def make_png(width: int, height: int, data: bytes, fault: int) -> bytes:
    """An RGB picture of the bytes; its first lines use each scan-line filter once."""
    stride = width * 3
    pixels = (data * (stride * height // max(len(data), 1) + 1))[: stride * height]
    if fault == 1:
        pixels = b"\xfa" * (stride * height)
    lines = b"".join(
        bytes([y if y < 5 and fault != 1 else 0]) + pixels[y * stride : (y + 1) * stride]
        for y in range(height)
    )

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    note = chunk(b"tEXt", b"Comment\0" + b"." * 600)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + note
        + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def make_image(kind: int, width: int, height: int, text: str) -> bytes:
    """PNG (0 text, 1 near white), JPEG header, GIF header, or no image; 5 is a tiny file."""
    data = (text or " ").encode()
    if kind in (0, 1):
        return make_png(width, height, data, kind)
    if kind == 2:
        frame = b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08"
        return frame + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 600
    if kind == 3:
        return b"GIF89a" + struct.pack("<HH", width, height) + b"\0" * 600
    return b"GIF89a" + struct.pack("<HH", width, height) if kind == 5 else b"none" + b"\0" * 600


@F.pandas_udf(BinaryType())
def _image_bytes(kind: pd.Series, width: pd.Series, height: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series(list(map(make_image, kind, width, height, text)))


# --- tables ----------------------------------------------------------------------------------


# Folders written in this session, by what they were made of.
_WRITTEN: dict[tuple, str] = {}
# Rows between two marks of these snapshots; pages lie between several marks even in small folders.
STEP = 64


class Library:
    """The bound tables of one data folder, each defined on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        bound_batches(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows dealt out evenly when a table is one small file that would keep one core busy.

        A table of many files has enough partitions and is left as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        c, text = F.col, F.concat
        i = c("doc_id")
        number = i.cast("string")
        name = _by(
            F.pmod(i, F.lit(4)),
            {
                0: text(number, F.lit(".epub")),
                1: text(F.lit("volume "), number, F.lit(".epub")),
                2: text(F.lit("bad:name?  "), number, F.lit(".epub")),
            },
            text(F.lit("Collected works "), number, F.lit(".epub")),
        )
        base = F.when(c("source") == "src19", "/archive").otherwise("/lib")
        folder = text(base, F.lit("/"), c("source"), F.lit("/"), c("lang"), F.lit("/shelf-"), F.pmod(i, F.lit(100)).cast("string"))
        return self.table("documents").withColumns(
            {
                "first_line": F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit("")),
                "name": name,
                "book_path": text(folder, F.lit("/"), name),
            }
        )

    @cached_property
    def books(self) -> DataFrame:
        return self.books_of(self.documents)

    def stored(self, kind: str, write: Callable[[str], None]) -> str:
        """A folder that ``write`` fills, once a session and state of the documents."""
        spark = self.spark
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        source = path_of(f"{self.folder}/documents.parquet")
        state = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source)
        made_of = (kind, spark.sparkContext.applicationId, self.folder, state.getModificationTime(), state.getLen())
        if made_of not in _WRITTEN:
            root = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
            write(root)
            target = path_of(root)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
            _WRITTEN[made_of] = root
        return _WRITTEN[made_of]

    @cached_property
    def snapshot(self) -> catalog.Snapshot:
        """The books as a stored snapshot with its indexes."""

        def write(root: str) -> None:
            catalog.write_catalog(self.spread_books, root, 1)
            catalog.write_indexes(self.spark, root, 1, ("title", "pages"), STEP)

        return catalog.Snapshot(self.spark, self.stored("library", write), 1)

    @cached_property
    def spread_books(self) -> DataFrame:
        """The books for work on their whole texts."""
        return self.books_of(self.spread(self.documents))

    @staticmethod
    def books_of(documents: DataFrame) -> DataFrame:
        c, text, lit = F.col, F.concat, F.lit
        i = c("doc_id")
        number = i.cast("string")
        mod = lambda n: F.pmod(i, lit(n))
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        year = text(lit("19"), two(mod(100)))
        month, day = two(mod(12) + 1), two(mod(28) + 1)
        words = [F.split_part(c("first_line"), lit(" "), lit(n)) for n in (1, 2)]
        pictures = _by(
            mod(4),
            {
                0: text(lit("data/covers/"), number, lit(".jpg")),
                1: text(lit("data/covers/"), two(mod(100)), lit("/"), number, lit(".png")),
                3: text(lit("data/covers/"), two(mod(100)), lit("/"), number, lit(".jpeg")),
            },
            lit(None),
        )
        columns = {
            "id": i,
            "file_path": c("book_path"),
            "file_name": c("name"),
            "format": _by(mod(97), {0: lit("doc"), 1: lit("EPUB")}, lit("epub")),
            "file_size": c("n_chars"),
            "file_mtime": F.timestamp_seconds(i + EPOCH),
            "content_hash": F.when(mod(19) != 0, F.sha1(c("text").cast("binary"))),
            "cover_path": pictures,
            "title": c("first_line"),
            "sort_title": F.when(mod(3) != 0, c("first_line")),
            "authors": F.when(mod(11) != 0, text(words[0], lit("; "), words[1])),
            "publisher": F.when(mod(5) == 0, text(lit("Éditions "), c("source"))).otherwise(text(c("source"), lit(" Press"))),
            "published_date": _by(
                mod(6),
                {
                    1: year,
                    2: F.concat_ws("-", year, month),
                    3: F.concat_ws("-", year, month, day),
                    4: text(F.concat_ws("-", year, month, day), lit("T00:00:00+00:00")),
                    5: text(lit("circa "), year),
                },
                lit(None),
            ),
            "isbn": F.when(mod(9) != 0, text(lit("978"), F.lpad(number, 10, "0"))),
            "language": F.when(mod(31) == 0, lit(None)).when(mod(29) == 0, lit(" ")).otherwise(c("lang")),
            "description": c("text"),
            "series": F.when(mod(8) == 0, text(lit("Series "), mod(40).cast("string"))),
            "series_index": F.when(mod(8) == 0, mod(48) / 16.0),
            "page_count": F.when(mod(7) != 0, F.floor(c("n_chars") / 1800)),
            "tags": text(c("lang"), lit(" prose, "), c("source")),
            "first_seen_at": text(lit("2024-01-"), day, lit("T00:00:00+00:00")),
            "last_scanned_at": text(lit("2024-02-"), day, lit("T"), two(mod(24)), lit(":00:00+00:00")),
            "is_missing": mod(17) == 0,
            "epub_validated": mod(2) == 0,
            "epub_deep_validated": mod(4) == 0,
            "epub_version2": mod(5) == 0,
        }
        return documents.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in BOOKS])

    @cached_property
    def toxic(self) -> DataFrame:
        return self.table("labels").where("toxic = 1").select("doc_id").distinct()

    @cached_property
    def inventory(self) -> DataFrame:
        """Files: documents that are not toxic (moved, revised, copied, touched or in place), and pages."""
        c, text, lit = F.col, F.concat, F.lit

        def file(path: Column, body: Column, size: Column, later: int) -> Column:
            return F.struct(
                path.alias("path"), size.alias("file_size"),
                F.timestamp_seconds(c("doc_id") + EPOCH + later).alias("file_mtime"),
                body.cast("binary").alias("content"),
            )

        here, body, size = c("book_path"), c("text"), c("n_chars")
        number = c("doc_id").cast("string")
        copies = text(lit("/lib/copies/"), c("lang"), lit("/"), c("name"))
        moved = text(lit("/lib/moved/"), c("source"), lit("/"), number, lit("-copy.epub"))
        states = _by(
            F.pmod(c("doc_id"), lit(10)),
            {
                1: F.array(file(moved, body, size, 86400)),
                2: F.array(file(here, text(body, lit(" (revised)")), size + 10, 3600)),
                3: F.array(file(here, body, size, 0), file(copies, body, size, 0)),
                4: F.array(file(here, body, size, 60)),
            },
            F.array(file(here, body, size, 0)),
        )
        kept = self.documents.join(self.toxic, "doc_id", "left_anti")
        pages = self.table("pages").select(
            text(lit("/lib/incoming/"), c("page_id").cast("string"), lit(".epub")).alias("path"),
            F.char_length("html").cast("bigint").alias("file_size"),
            F.timestamp_seconds(c("page_id") + EPOCH).alias("file_mtime"),
            c("html").cast("binary").alias("content"),
        )
        return kept.select(F.inline(states)).unionByName(pages)

    @cached_property
    def files(self) -> DataFrame:
        """The inventory without file bytes."""
        return self.inventory.drop("content")

    @cached_property
    def hashed(self) -> DataFrame:
        return self.inventory.select("path", F.sha1("content").alias("content_hash"))

    @cached_property
    def directories(self) -> DataFrame:
        """Every directory some book's path or file lies in."""
        from shelfmark.functions.files import ancestors

        paths = self.documents.select(F.col("book_path").alias("path")).unionByName(self.files.select("path"))
        return paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()

    @cached_property
    def covers(self) -> DataFrame:
        """Cover paths: flat or sharded for documents, strays for pages."""
        c, text, lit = F.col, F.concat, F.lit
        number = c("doc_id").cast("string")
        shard = F.lpad(F.pmod(c("doc_id"), lit(100)).cast("string"), 2, "0")
        flat = text(lit("covers/"), number, lit(".jpg"))
        deep = lambda ext: text(lit("covers/"), shard, lit("/"), number, lit(ext))
        places = _by(
            F.pmod(c("doc_id"), lit(4)),
            {0: F.array(flat), 1: F.array(deep(".png")), 2: F.array(flat, deep(".png"))},
            F.array(deep(".JPEG")),
        )
        stray = F.when(F.pmod(c("page_id"), lit(2)) == 0, text(lit("covers/cover-"), c("page_id").cast("string"), lit(".png"))).otherwise(
            text(lit("covers/"), (c("page_id") + 1_000_000_000).cast("string"), lit(".jpg"))
        )
        return self.documents.select(F.explode(places).alias("path")).unionByName(
            self.table("pages").select(stray.alias("path"))
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.trim("c_name").alias("username"), F.lit(NOW).alias("created_at")
        )

    @cached_property
    def favorites(self) -> DataFrame:
        n = self.table("documents").agg(F.count(F.lit(1))).scalar()
        return self.table("events").where("event_type = 'purchase'").select(
            "user_id", F.pmod(F.col("event_id"), n).alias("book_id")
        ).distinct()

    @cached_property
    def favorite_changes(self) -> DataFrame:
        """Clicks add and errors remove a favourite, in event order."""
        n = self.table("documents").agg(F.count(F.lit(1))).scalar()
        return self.table("events").where("event_type in ('click', 'error')").select(
            "user_id", F.pmod(F.col("event_id"), n).alias("book_id"),
            (F.col("event_type") == "click").alias("favorite"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def proposed(self) -> DataFrame:
        """One metadata proposal per labelled document."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        docs = self.table("documents").join(labels, "doc_id")
        return docs.select(
            F.col("doc_id").alias("id"),
            F.when(F.col("toxic") == 0, F.concat(F.lit("Title of "), "source")).alias("title"),
            F.concat(F.lit("Author "), F.col("lang")).alias("authors"),
            F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("publisher"),
            F.lit("1999").alias("published_date"),
            F.col("lang").alias("language"),
            F.lit(2.5).alias("series_index"),
            F.lit(NOW).alias("last_scanned_at"),
        )

    @cached_property
    def edits(self) -> DataFrame:
        """One manual edit per labelled document; toxic ones come without a title."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        docs = self.table("documents").join(labels, "doc_id")
        return docs.select(
            F.col("doc_id").alias("id"),
            F.when(F.col("toxic") == 0, F.concat(F.lit("  Edited "), "source", F.lit(" "))).otherwise(" ").alias("title"),
            F.when(F.col("quality") == 1, F.concat(F.lit("Editor "), "lang")).otherwise("  ").alias("authors"),
            F.when(F.col("quality") == 0, F.col("lang")).alias("genre"),
        )

    @cached_property
    def conversions(self) -> DataFrame:
        """One converter result per labelled document; low quality means failure."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        docs = self.table("documents").join(labels, "doc_id")
        i = F.col("doc_id")
        return docs.select(
            i.alias("id"),
            (F.col("quality") == 1).alias("ok"),
            F.sha1(F.concat(F.lit("v2 "), "text").cast("binary")).alias("content_hash"),
            (F.col("n_chars") + 3).alias("file_size"),
            F.timestamp_seconds(i + EPOCH + 7200).alias("file_mtime"),
            F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("data/covers/new/"), i.cast("string"), F.lit(".jpg"))).alias("cover_path"),
        )

    @cached_property
    def packages(self) -> DataFrame:
        """Every document as a package file (path, file_size, file_mtime, content), some broken."""
        return self.packages_of(self.spread(self.documents))

    @staticmethod
    def packages_of(documents: DataFrame) -> DataFrame:
        c, i = F.col, F.col("doc_id")
        return documents.select(
            c("book_path").alias("path"),
            "n_chars",
            F.timestamp_seconds(i + EPOCH + 1).alias("file_mtime"),
            _package_bytes(
                F.pmod(i, F.lit(12)), "first_line", "source", "lang",
                F.concat(F.lit("978"), F.lpad(i.cast("string"), 10, "0")),
                (F.pmod(i, F.lit(48)) / 16.0).cast("string"), "text",
            ).alias("content"),
        ).select("path", c("n_chars").alias("file_size"), "file_mtime", "content")

    @cached_property
    def images(self) -> DataFrame:
        """Every document as a cover image (path, content) of a size its length gives."""
        i, n = F.col("doc_id"), F.col("n_chars")
        return self.spread(self.documents).select(
            F.concat(F.lit("covers/"), i.cast("string"), F.lit(".img")).alias("path"),
            _image_bytes(
                F.pmod(i, F.lit(6)), (F.pmod(n, F.lit(120)) + 60).cast("int"), (F.pmod(n, F.lit(70)) + 60).cast("int"), "text"
            ).alias("content"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Every book as the text report of an external metadata tool."""
        c, lit = F.col, F.lit
        line = lambda key, value: F.concat(lit(f"{key:<20}: "), value)
        return self.books.select(
            "id",
            F.concat_ws(
                "\n",
                line("Title", c("title")),
                line("Title sort", c("sort_title")),
                line("Author(s)", F.replace(c("authors"), lit("; "), lit(" & "))),
                line("Publisher", c("publisher")),
                line("Languages", F.concat(c("language"), lit(", mul"))),
                line("Published", c("published_date")),
                line("Identifiers", F.concat(lit("google:x, ISBN: "), c("isbn"))),
                line("Series", c("series")),
                line("Number in series", c("series_index").cast("string")),
                line("Tags", c("tags")),
                line("Publisher", F.when(F.pmod(c("id"), lit(2)) == 0, "Second Publisher")),
                lit("a line without a separator"),
            ).alias("report"),
        )

    @cached_property
    def identifiers(self) -> DataFrame:
        """(id, identifiers) with an ISBN by scheme, by prefix, by shape, or none."""
        i = F.col("id")
        entry = lambda scheme, value: F.struct(F.lit(scheme).alias("scheme"), value.alias("text"))
        isbn = F.col("isbn")
        return self.books.select(
            "id",
            F.array(
                entry("UUID", F.concat(F.lit("u-"), i.cast("string"))),
                _by(
                    F.pmod(i, F.lit(3)),
                    {0: entry("ISBN", isbn), 1: entry("", F.concat(F.lit("isbn: "), isbn))},
                    entry("", isbn),
                ),
            ).alias("identifiers"),
        )
