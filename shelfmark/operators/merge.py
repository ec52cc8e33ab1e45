"""Changes to the catalogue: each function returns the next snapshot, nothing is updated in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import files as fn
from shelfmark.functions import text as tx
from shelfmark.operators.reconcile import drop_children
from shelfmark.operators.skew import HOT_ROWS, join_hot, number_by_digest
from shelfmark.schema import BOOK_COLUMNS, BOOKS, METADATA_FIELDS, VALIDATION_FLAGS
from shelfmark.session import cut_lineage
from shelfmark.sources.files import hashed


def _changed(books: DataFrame, changes: DataFrame, on: str, values: dict[str, Column]) -> DataFrame:
    """Books left-joined with at most one change row each; listed columns get new values."""
    joined = books.join(changes, on, "left")
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in books.columns])


def upsert_by_path(books: DataFrame, incoming: DataFrame, checked: bool = False, top_id: int | None = None) -> DataFrame:
    """Insert or update rows by ``file_path`` (unique in ``incoming``).

    An existing row takes every incoming column, also NULLs, but keeps its id and first sighting;
    its validation flags fall when size, time or hash changed, unless the incoming flags are those
    of a check of the new file (``checked``). New rows get the next ids in the
    order of their paths' digests, whatever the partitioning. ``top_id`` is the largest id given so far
    where ``books`` is only the part of the catalogue that ``incoming`` may touch.
    """
    c = F.col
    fields = [n for n in incoming.columns if n in BOOK_COLUMNS and n not in ("id", "first_seen_at")]
    marked = incoming.select(
        *[c(n).alias(n if n == "file_path" else f"new_{n}") for n in fields], F.lit(True).alias("hit")
    )
    hit = c("hit").isNotNull()
    differs = [
        ~c(n).eqNullSafe(c(f"new_{n}")) for n in ("file_size", "file_mtime", "content_hash") if n in fields
    ]
    moved = hit & reduce(lambda a, b: a | b, differs, F.lit(False))
    values = {n: F.when(hit, c(f"new_{n}")).otherwise(c(n)) for n in fields if n != "file_path"}
    values["is_missing"] = F.when(hit, F.lit(False)).otherwise(c("is_missing"))
    for flag in VALIDATION_FLAGS:
        if not (checked and flag in fields):
            values[flag] = F.when(moved, F.lit(False)).otherwise(values.get(flag, c(flag)))
    updated = _changed(books, marked, "file_path", values)

    fresh = incoming.join(books.select("file_path"), "file_path", "left_anti")
    numbered = number_by_digest(fresh, "file_path", "_n")
    top = books.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top_id is None else F.lit(top_id)
    given = {n: c(n) for n in fields}
    first_seen = c("first_seen_at") if "first_seen_at" in incoming.columns else c("last_scanned_at")
    given.update(
        id=top + c("_n"),
        first_seen_at=F.coalesce(first_seen, c("last_scanned_at")),
        is_missing=F.lit(False),
    )
    for flag in VALIDATION_FLAGS:
        given[flag] = F.coalesce(given.get(flag, F.lit(False)), F.lit(False))
    inserted = numbered.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BOOKS]
    )
    return updated.select(*BOOK_COLUMNS).unionByName(inserted)


def repoint(books: DataFrame, moves: DataFrame, clear_flags: bool = False) -> DataFrame:
    """Move rows to other files: ``moves`` has (id, file_path, file_size, file_mtime), ids unique."""
    c = F.col
    marked = moves.select(
        "id", c("file_path").alias("to_path"), c("file_size").alias("to_size"), c("file_mtime").alias("to_mtime")
    )
    hit = c("to_path").isNotNull()
    values = {
        "file_path": F.coalesce("to_path", "file_path"),
        "file_name": F.when(hit, fn.base_name(c("to_path"))).otherwise(c("file_name")),
        "file_size": F.coalesce("to_size", "file_size"),
        "file_mtime": F.coalesce("to_mtime", "file_mtime"),
        "is_missing": ~hit & c("is_missing"),
    }
    if clear_flags:
        values.update({flag: ~hit & c(flag) for flag in VALIDATION_FLAGS})
    return _changed(books, marked, "id", values)


def mark_presence(books: DataFrame, seen: DataFrame, roots: list[str]) -> DataFrame:
    """After a scan of ``roots``: rows below them without a file are missing, rows with one are not.

    ``seen`` has one ``path`` per file.
    """
    c = F.col
    marked = seen.select(c("path").alias("file_path"), F.lit(True).alias("hit"))
    gone = fn.under_roots(c("file_path"), roots) & c("hit").isNull()
    return _changed(
        books, marked, "file_path",
        {"is_missing": F.when(c("hit").isNotNull(), F.lit(False)).otherwise(c("is_missing") | gone)},
    )


def newly_missing(books: DataFrame, seen: DataFrame, roots: list[str]) -> DataFrame:
    c = F.col
    due = books.where(~c("is_missing") & fn.under_roots(c("file_path"), roots))
    return due.join(seen.select(c("path").alias("file_path")), "file_path", "left_anti")


def purge_rows(
    books: DataFrame, favorites: DataFrame, author_index: DataFrame, purged: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, favourites, author index) without the purged ids (unique)."""
    ids = purged.select("id")
    return (
        books.join(ids, "id", "left_anti"),
        drop_children(favorites, ids),
        drop_children(author_index, ids),
    )


def apply_favorites(favorites: DataFrame, changes: DataFrame) -> DataFrame:
    """Favourites (user_id, book_id) after changes (user_id, book_id, favorite, seq); the last counts."""
    keys = ["user_id", "book_id"]
    last = changes.groupBy(*keys).agg(F.max_by("favorite", "seq").alias("favorite"))
    kept = favorites.select(*keys).join(last, keys, "left_anti")
    return kept.unionByName(last.where(F.col("favorite")).select(*keys))


def edit_metadata(books: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, rejected edits) after manual edits (id, title, authors, genre), ids unique."""
    c = F.col

    def trimmed(name: str) -> Column:
        return F.nullif(tx.strip_space(c(name)), F.lit(""))

    clean = edits.select("id", trimmed("title").alias("t"), trimmed("authors").alias("a"), trimmed("genre").alias("g"))
    hit = c("t").isNotNull()
    edited = _changed(
        books, clean.where(hit), "id",
        {
            "title": F.coalesce("t", "title"),
            "sort_title": F.coalesce("t", "sort_title"),
            "authors": F.when(hit, c("a")).otherwise(c("authors")),
            "tags": F.when(hit, c("g")).otherwise(c("tags")),
        },
    )
    rejected = clean.where(~hit).select("id", F.lit("Title cannot be empty.").alias("detail"))
    return edited, rejected


# --- metadata proposals ----------------------------------------------------------------------


def _filled(c: Column, name: str) -> Column:
    return c.isNotNull() if name == "series_index" else ~tx.is_blank(c)


def _proposal(books: DataFrame, proposed: DataFrame) -> tuple[DataFrame, list[str]]:
    fields = [n for n in METADATA_FIELDS if n in proposed.columns]
    extra = [n for n in ("last_scanned_at", "cover_path") if n in proposed.columns]
    marked = proposed.select("id", *[F.col(n).alias(f"new_{n}") for n in [*fields, *extra]])
    return books.join(marked, "id", "left"), fields


def _conflicts(fields: list[str]) -> Column:
    c = F.col
    return F.array_compact(
        F.array(
            *[
                F.when(_filled(c(n), n) & (c(f"new_{n}") != c(n)), F.lit(n))
                for n in fields
            ]
        )
    )


def merge_conflicts(books: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, conflicts): filled fields a proposal would change, in field order."""
    joined, fields = _proposal(books, proposed)
    named = joined.select("id", _conflicts(fields).alias("conflicts"))
    return named.where(F.size("conflicts") > 0)


def merge_metadata(
    books: DataFrame, proposed: DataFrame, confirm: bool, refuse: bool = False
) -> DataFrame:
    """Fill empty fields from a proposal (unique ids); change filled ones only when confirmed.

    A NULL never clears a field. With ``refuse`` an unconfirmed row with conflicts stays as it is.
    """
    c = F.col
    joined, fields = _proposal(books, proposed)
    blocked = (F.size(_conflicts(fields)) > 0) if refuse and not confirm else F.lit(False)
    values = {}
    for n in fields:
        new, old = c(f"new_{n}"), c(n)
        take = new.isNotNull() & (F.lit(confirm) | ~_filled(old, n)) & ~blocked
        values[n] = F.when(take, new).otherwise(old)
    if "last_scanned_at" in proposed.columns:
        values["last_scanned_at"] = F.when(blocked, c("last_scanned_at")).otherwise(
            F.coalesce("new_last_scanned_at", "last_scanned_at")
        )
    if "cover_path" in proposed.columns:
        given = F.nullif(c("new_cover_path"), F.lit(""))
        values["cover_path"] = F.when(blocked, c("cover_path")).otherwise(F.coalesce(given, c("cover_path")))
    return joined.select(*[values.get(n, c(n)).alias(n) for n in books.columns])


# --- validation, conversion, hashes, descriptions --------------------------------------------


def mark_validated(books: DataFrame, valid: DataFrame, deep: bool = False) -> DataFrame:
    """Set the flags of the valid ids (unique)."""
    marked = valid.select("id", F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    flags = VALIDATION_FLAGS[: 2 if deep else 1]
    return _changed(books, marked, "id", {flag: F.col(flag) | hit for flag in flags})


def apply_conversion_results(
    books: DataFrame, favorites: DataFrame, author_index: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge results (id, ok, content_hash, file_size, file_mtime, cover_path) of a converter.

    Converted rows get the new file facts and flags; failed rows are purged with their children.
    """
    c = F.col
    good = results.where(c("ok")).select(
        "id", c("content_hash").alias("h"), c("file_size").alias("s"), c("file_mtime").alias("m"),
        c("cover_path").alias("p"), F.lit(True).alias("hit"),
    )
    hit = c("hit").isNotNull()
    refreshed = _changed(
        books, good, "id",
        {
            "content_hash": F.when(hit, c("h")).otherwise(c("content_hash")),
            "file_size": F.coalesce("s", "file_size"),
            "file_mtime": F.coalesce("m", "file_mtime"),
            "cover_path": F.coalesce("p", "cover_path"),
            "epub_validated": hit | c("epub_validated"),
            "epub_deep_validated": ~hit & c("epub_deep_validated"),
            "epub_version2": hit | c("epub_version2"),
        },
    )
    return purge_rows(refreshed, favorites, author_index, results.where(~c("ok")).select("id"))


def fresh_hashes(books: DataFrame, inventory: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(id, content_hash) of the rows without a hash whose file exists.

    ``matched`` is the match by path, where it is made already.
    """
    c = F.col
    if matched is None:
        rows = books.where(c("content_hash").isNull()).select("id", c("file_path").alias("path"))
        due = cut_lineage(inventory.select("path", "file_size").join(rows, "path"))
    else:
        due = matched.where(c("in_books") & c("in_files") & c("content_hash").isNull()).select("path", "file_size", "id")
    return hashed(due, inventory).where(c("content_hash").isNotNull()).select("id", "content_hash")


def backfill_split(
    books: DataFrame, fresh: DataFrame, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(accepted (id, content_hash), refused (id, other_id)) among freshly hashed rows.

    A hash another row has is refused; of several fresh rows with a new hash the lowest id wins.
    """
    c = F.col
    taken = (
        books.where(c("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("owner"))
    )
    firsts = fresh.groupBy("content_hash").agg(F.min("id").alias("first"))
    winner = firsts.join(taken, "content_hash", "left").select(
        "content_hash", F.coalesce("owner", "first").alias("winner")
    )
    judged = join_hot(fresh, winner, "content_hash", "inner", ["id"], hot_rows)
    accepted = judged.where(c("id") == c("winner")).select("id", "content_hash")
    refused = judged.where(c("id") != c("winner")).select("id", c("winner").alias("other_id"))
    return accepted, refused


def backfill_hashes(books: DataFrame, accepted: DataFrame) -> DataFrame:
    """Store accepted hashes (id, content_hash) and clear those rows' validation flags."""
    c = F.col
    marked = accepted.select("id", c("content_hash").alias("h"))
    hit = c("h").isNotNull()
    values = {"content_hash": F.coalesce("h", "content_hash")}
    values.update({flag: ~hit & c(flag) for flag in VALIDATION_FLAGS})
    return _changed(books, marked, "id", values)


def strip_descriptions(books: DataFrame) -> DataFrame:
    """Descriptions as plain text, and whether each changed (``description_changed``)."""
    c = F.col
    cleaned = books.withColumn("_plain", tx.plain_text(c("description")))
    changes = (F.coalesce(c("description"), F.lit("")) != "") & tx.needs_plain_text(
        c("description"), c("_plain")
    )
    return cleaned.withColumn("description_changed", changes).withColumn(
        "description", F.when(c("description_changed"), c("_plain")).otherwise(c("description"))
    ).drop("_plain")


# --- covers ----------------------------------------------------------------------------------


def cover_reshard_plan(covers: DataFrame, books: DataFrame, root: str = "data/covers") -> DataFrame:
    """(book_id, from_path, to_path, cover_path, action): one cover per book into its shard.

    A cover directly in the root is preferred, then the lowest path. ``cover_path`` is the value
    the row should store, NULL when it already does or there is no row.
    """
    c = F.col
    chosen = (
        covers.where(c("book_id").isNotNull())
        .groupBy("book_id")
        .agg(F.min(F.struct((~fn.is_flat_cover(c("path"), root)).alias("nested"), "path"))["path"].alias("from_path"))
    )
    rows = books.select(c("id").alias("book_id"), c("cover_path").alias("stored"), F.lit(True).alias("known"))
    placed = chosen.join(rows, "book_id", "left").select(
        "book_id", "from_path", "stored", "known",
        fn.cover_storage_path(root, c("book_id"), fn.suffix(c("from_path"))).alias("to_path"),
        fn.cover_relative_path(c("book_id"), fn.suffix(c("from_path"))).alias("wanted"),
    )
    action = (
        F.when(c("from_path") == c("to_path"), "keep")
        .when(c("known").isNull(), "move_orphan")
        .otherwise("move")
    )
    fix = F.when(c("known") & ~c("stored").eqNullSafe(c("wanted")), c("wanted"))
    bad = covers.where(c("book_id").isNull()).select(
        "book_id", c("path").alias("from_path"), F.lit(None).cast("string").alias("to_path"),
        F.lit(None).cast("string").alias("cover_path"), F.lit("unrecognized").alias("action"),
    )
    return placed.select("book_id", "from_path", "to_path", fix.alias("cover_path"), action.alias("action")).unionByName(bad)


# --- users -----------------------------------------------------------------------------------

LONGEST_USERNAME = 64


def register_users(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, rejected) after requests (seq, username, created_at); seq unique.

    Names are trimmed, at most 64 characters, unique ignoring ASCII case; the first request for a
    name wins. New ids follow the digest order of the folded names.
    """
    c = F.col
    clean = requests.withColumn("username", tx.strip_space(c("username"))).withColumn(
        "fold", tx.fold_nocase(c("username"))
    )
    problem = (
        F.when(F.coalesce(c("username"), F.lit("")) == "", "Username cannot be empty.")
        .when(F.char_length("username") > LONGEST_USERNAME, "Username must be 64 characters or fewer.")
    )
    checked = clean.withColumn("detail", problem)
    sound = checked.where(c("detail").isNull()).drop("detail")
    first = sound.groupBy("fold").agg(F.min("seq").alias("first_seq"))
    known = users.select(tx.fold_nocase(c("username")).alias("fold"), F.lit(True).alias("known"))
    facts = first.join(known, "fold", "left")
    judged = join_hot(sound, facts, "fold", "inner", ["seq"])
    wins = c("known").isNull() & (c("seq") == c("first_seq"))
    top = users.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = number_by_digest(judged.where(wins), "fold", "_n").select(
        (top + c("_n")).alias("id"), "username", "created_at"
    )
    taken = judged.where(~wins).select("seq", "username", F.lit("That username is already taken.").alias("detail"))
    rejected = checked.where(c("detail").isNotNull()).select("seq", "username", "detail").unionByName(taken)
    return users.select("id", "username", "created_at").unionByName(added), rejected


def delete_users(users: DataFrame, favorites: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, favourites) without the named users, ASCII case ignored."""
    c = F.col
    folds = names.select(tx.fold_nocase(tx.strip_space(c("username"))).alias("fold")).distinct()
    keyed = users.withColumn("fold", tx.fold_nocase(c("username")))
    gone = keyed.join(folds, "fold", "left_semi").select("id")
    kept = keyed.join(folds, "fold", "left_anti").drop("fold")
    return kept.select(*users.columns), drop_children(favorites, gone, "user_id")
