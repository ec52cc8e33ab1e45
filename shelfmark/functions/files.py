"""File and cover names as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import SPACE, clean_field, composed, let

# --- paths ---------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)[^/]*\z", 0)


# Stem and suffix of the last path part: the suffix is the last dot and what follows it; dot files
# and a trailing dot have none.
_PARTS = r"(?s)\A(?:.*/)?([^/]+?)(\.[^./]+)?\z"


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, _PARTS, 2)


def stem(name: Column) -> Column:
    return F.regexp_extract(name, _PARTS, 1)


def parent(path: Column) -> Column:
    """Directory part without the trailing slash; ``/`` for entries of the root."""
    cut = F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)
    return F.when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)


def keeper_key(path: Column) -> Column:
    """Of several copies the one with the greatest key stays: long name, long path, path."""
    return F.struct(
        F.char_length(base_name(path)).alias("name_len"),
        F.char_length(path).alias("path_len"),
        path.alias("path"),
    )


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest first, without ``/``."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.when(
        depth > 2,
        F.transform(
            F.sequence(depth - 1, F.lit(2), F.lit(-1)),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def under_roots(path: Column, roots: list[str]) -> Column:
    """The path is a root or lies below one; no wildcards."""
    test = F.lit(False)
    for root in roots:
        clean = root.rstrip("/") or "/"
        below = path.startswith(clean if clean == "/" else clean + "/")
        test = test | (path == clean) | below
    return test


# --- names ---------------------------------------------------------------------------------

# Dropped besides all control, format and unassigned characters.
_UNSAFE = r"""[\p{C}/\\<>:"|?*]"""
SHORT_STEM = 10
LONGEST_STEM = 180


def _clean_stem(name: Column, max_stem: int | None) -> Column:
    """The stem of a composed name (all of it without a suffix), cleaned and cut."""

    def cleaned(n: Column) -> Column:
        body = F.when(suffix(n) == "", n).otherwise(stem(n))
        body = F.regexp_replace(F.regexp_replace(body, _UNSAFE, ""), rf"{SPACE}+", " ")
        return F.btrim(body, F.lit(" ."))

    def named(body: Column) -> Column:
        return F.when(body == "", "unnamed").otherwise(body)

    def cut(body: Column) -> Column:
        return let(F.rtrim(F.left(body, F.lit(max_stem))), named)

    whole = let(let(name, cleaned), named)
    if max_stem is None:
        return whole
    return let(whole, lambda b: F.when(F.char_length(b) > max_stem, cut(b)).otherwise(b))


def sanitize_filename(name: Column, max_stem: int | None = None) -> Column:
    """A file name without unsafe characters, white space squeezed, ends free of blanks and dots."""
    return F.concat(_clean_stem(composed(name), max_stem), suffix(name))


def has_short_basename(name: Column, shorter_than: int = SHORT_STEM) -> Column:
    return (F.lower(suffix(name)) == ".epub") & (F.char_length(stem(name)) < shorter_than)


def _metadata_name(title: Column, authors: Column, publisher: Column, fallback: Column) -> Column:
    return F.concat(
        clean_field(title, fallback),
        F.lit(" - "),
        clean_field(authors, F.lit("Unknown Author")),
        F.lit("-("),
        clean_field(publisher, F.lit("Unknown Publisher")),
        F.lit(").epub"),
    )


def metadata_filename(title: Column, authors: Column, publisher: Column, fallback: Column) -> Column:
    """``title - authors-(publisher).epub`` with stand-ins for what is unknown."""
    raw = _metadata_name(*(composed(value) for value in (title, authors, publisher, fallback)))
    return F.concat(_clean_stem(raw, LONGEST_STEM), F.lit(".epub"))


def target_filename(
    name: Column,
    title: Column,
    authors: Column,
    publisher: Column,
    shorter_than: int = SHORT_STEM,
) -> Column:
    """The name a file should have: short ones are named after their metadata.

    The metadata name is cleaned twice, since its cut may leave a blank or a dot at the end.
    """
    short = metadata_filename(title, authors, publisher, stem(name))
    again = let(short, lambda n: F.concat(_clean_stem(n, LONGEST_STEM), suffix(n)))
    return F.when(has_short_basename(name, shorter_than), again).otherwise(
        sanitize_filename(name, LONGEST_STEM)
    )


# --- covers --------------------------------------------------------------------------------

# Image suffixes and the two prefixes a stored cover path may carry.
COVER_SUFFIXES = (".jpg", ".jpeg", ".png")
_COVER_PREFIX = r"\A(?:data/covers/|covers/)"


def cover_shard(book_id: Column) -> Column:
    return F.lpad(F.pmod(book_id, F.lit(100)).cast("string"), 2, "0")


def cover_storage_path(root: str, book_id: Column, ext: Column) -> Column:
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.concat(
        F.lit(root.rstrip("/") + "/"),
        cover_shard(book_id),
        F.lit("/"),
        book_id.cast("string"),
        F.lower(dotted),
    )


def cover_relative_path(book_id: Column, ext: Column) -> Column:
    """The path stored in the catalogue."""
    return cover_storage_path("data/covers", book_id, ext)


def cover_public_segment(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), _COVER_PREFIX, "")


def is_flat_cover(path: Column, root: str) -> Column:
    return parent(path) == root.rstrip("/")


def cover_book_id(path: Column) -> Column:
    """The id a cover file is named after, NULL when its stem is no whole number."""
    digits = F.regexp_extract(stem(path), rf"\A{SPACE}*([+-]?\d+(?:_\d+)*){SPACE}*\z", 1)
    return F.replace(F.nullif(digits, F.lit("")), F.lit("_"), F.lit("")).try_cast("bigint")


def cover_candidates(root: str, book_id: Column) -> Column:
    """All places a cover of this book may be: flat and sharded, with each suffix."""
    places = []
    for ext in COVER_SUFFIXES:
        places.append(F.concat(F.lit(root.rstrip("/") + "/"), book_id.cast("string"), F.lit(ext)))
        places.append(cover_storage_path(root, book_id, F.lit(ext)))
    return F.array(*places)


def cover_version(cover_mtime_seconds: Column, last_scanned_at: Column) -> Column:
    """Cache tag: the cover's modification second, else the scan time without punctuation."""
    return F.coalesce(
        cover_mtime_seconds.cast("string"), F.translate(last_scanned_at, ":-+", "")
    )
