"""Bibliographic values as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import let, strip_space

# Fixed value: a bare ISBN-13 or ISBN-10.
_ISBN_SHAPE = r"\A(?:97[89]\d{10}|\d{9}[\dXx])\z"
# Fixed value: numbers as a person may write them.
_NUMBER = r"\A[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\z"
_LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"

# Field name of a captured report and the catalogue field it fills.
REPORT_FIELDS = {
    "title": "title",
    "title sort": "sort_title",
    "author(s)": "authors",
    "publisher": "publisher",
    "published": "published_date",
    "languages": "language",
    "comments": "description",
    "series": "series",
    "tags": "tags",
    "identifiers": "isbn",
    "number in series": "series_index",
}


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _clean_list(c: Column, separator: str, joiner: str) -> Column:
    parts = F.filter(F.transform(F.split(c, separator), strip_space), lambda p: p != "")
    return _none_if_empty(F.array_join(parts, joiner))


def normalize_authors(c: Column) -> Column:
    """``A & B`` to ``A; B``."""
    return _clean_list(c, "&", "; ")


def authors_for_fetch(c: Column) -> Column:
    """``A; B`` to ``A & B``."""
    return _clean_list(c, ";", " & ")


def first_language(c: Column) -> Column:
    return _none_if_empty(strip_space(F.split_part(c, F.lit(","), F.lit(1))))


def parse_number(c: Column) -> Column:
    """A number in tolerant notation, NULL when it is none."""
    bare = strip_space(c)
    word = F.lower(bare)
    sign = F.when(bare.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(bare.rlike(_NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        .when(word.rlike(r"\A[+-]?inf(inity)?\z"), sign * F.lit(float("inf")))
        .when(word.rlike(r"\A[+-]?nan\z"), F.lit(float("nan")))
    )


def isbn_from_identifiers(identifiers: Column) -> Column:
    """ISBN of an array of (scheme, text): marked by scheme, by prefix, or by its shape."""

    def isbn(entry: Column) -> Column:
        text = strip_space(F.coalesce(entry["text"], F.lit("")))
        tail = strip_space(F.regexp_extract(text, r"(?s)\A[^:]*:(.*)\z", 1))
        return (
            F.when((F.lower(entry["scheme"]) == "isbn") & (text != ""), text)
            .when(F.lower(text).startswith("isbn:"), tail)
            .when(text.rlike(_ISBN_SHAPE), text)
        )

    hits = F.filter(F.transform(identifiers, isbn), lambda value: value.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def isbn_from_list(c: Column) -> Column:
    """The ``isbn:`` entry of a comma-separated identifier list."""
    parts = F.transform(F.split(c, ","), strip_space)
    marked = F.filter(parts, lambda p: F.lower(p).startswith("isbn:"))
    return strip_space(
        F.regexp_extract(F.try_element_at(marked, F.lit(1)), r"(?s)\A[^:]*:(.*)\z", 1)
    )


def parse_tool_output(report: Column) -> Column:
    """A ``Key : value`` text report as a struct of catalogue fields; the last entry of a key wins."""
    lines = F.filter(F.split(report, _LINE_BREAK), lambda line: line.contains(":"))
    entries = F.transform(
        lines,
        lambda line: F.struct(
            F.lower(strip_space(F.split_part(line, F.lit(":"), F.lit(1)))).alias("key"),
            strip_space(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"),
        ),
    )

    shape = {
        "authors": normalize_authors,
        "language": first_language,
        "isbn": isbn_from_list,
        "series_index": lambda value: let(value, parse_number),
    }

    def fields(found: Column) -> Column:
        def last(name: str) -> Column:
            hits = F.filter(found, lambda e: e["key"] == name)
            return F.try_element_at(hits, F.lit(-1))["value"]

        return F.struct(
            *[
                shape.get(target, lambda value: value)(let(last(name), _none_if_empty)).alias(target)
                for name, target in REPORT_FIELDS.items()
            ]
        )

    return let(entries, fields)


def languages_to_json(languages: Column) -> Column:
    return F.to_json(languages)


def languages_from_json(text: Column) -> Column:
    """NULL unless the text is a JSON list."""
    return F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
