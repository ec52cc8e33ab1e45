"""The catalogue's columns and its row rules."""

from __future__ import annotations

from pyspark.sql import types as T

# The file formats a catalogue row may have.
FORMATS = ("epub", "mobi", "azw3", "pdf")

BOOKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("file_mtime", T.TimestampType(), False),
        T.StructField("content_hash", T.StringType()),
        T.StructField("cover_path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("sort_title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("series_index", T.DoubleType()),
        T.StructField("page_count", T.LongType()),
        T.StructField("tags", T.StringType()),
        T.StructField("first_seen_at", T.StringType(), False),
        T.StructField("last_scanned_at", T.StringType(), False),
        T.StructField("is_missing", T.BooleanType(), False),
        T.StructField("epub_validated", T.BooleanType(), False),
        T.StructField("epub_deep_validated", T.BooleanType(), False),
        T.StructField("epub_version2", T.BooleanType(), False),
    ]
)

BOOK_COLUMNS = tuple(field.name for field in BOOKS)

VALIDATION_FLAGS = ("epub_validated", "epub_deep_validated", "epub_version2")

# What a listing shows. The description is left out so that lists never read it.
LIST_COLUMNS = (
    "id",
    "file_name",
    "format",
    "file_size",
    "title",
    "sort_title",
    "authors",
    "series",
    "series_index",
    "cover_path",
    "is_missing",
    "last_scanned_at",
)

# The text columns that are searched word by word.
SEARCH_COLUMNS = (
    "title",
    "sort_title",
    "authors",
    "publisher",
    "description",
    "isbn",
    "file_name",
    "series",
    "tags",
)

# Fields a metadata proposal may fill.
METADATA_FIELDS = (
    "title",
    "sort_title",
    "authors",
    "publisher",
    "published_date",
    "isbn",
    "language",
    "description",
    "series",
    "series_index",
    "tags",
)
