"""Whole jobs: scan, integrity check and clean-up, each from snapshot to snapshot plus a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import files as fn
from shelfmark.operators import merge, reconcile, stats
from shelfmark.schema import BOOK_COLUMNS, METADATA_FIELDS
from shelfmark.session import cut_lineage
from shelfmark.sources import packages
from shelfmark.sources.files import contents, with_content_hash
from shelfmark.sources.shelves import Shelves, few_ids

# Plan operation and the counter it adds to.
CLEANUP_COUNTERS = {
    "delete": "files_deleted",
    "repoint": "rows_updated",
    "index": "rows_indexed",
    "purge": "rows_purged",
    "remove_cover": "covers_removed",
    "backfill": "hashes_backfilled",
    "rename": "filenames_sanitized",
    "invalid": "invalid_epubs",
    "prune": "dirs_pruned",
    "strip": "descriptions_stripped",
}
ERROR_OPS = ("refuse", "backfill_refused")


@dataclass(frozen=True)
class ScanResult:
    books: DataFrame
    actions: DataFrame
    summary: DataFrame
    favorites: DataFrame | None = None
    author_index: DataFrame | None = None


@dataclass(frozen=True)
class IntegrityResult:
    books: DataFrame
    invalid: DataFrame
    removals: DataFrame


@dataclass(frozen=True)
class CleanupResult:
    books: DataFrame
    plan: DataFrame
    findings: DataFrame
    summary: DataFrame
    favorites: DataFrame | None = None
    author_index: DataFrame | None = None


def _without(children: DataFrame | None, gone: DataFrame) -> DataFrame | None:
    """Favourites or author tokens without those of purged ids."""
    return None if children is None else merge.drop_children(children, gone.select("id"))


def incoming_rows(files: DataFrame, inspected: DataFrame, now: str, validated: bool) -> DataFrame:
    """Catalogue rows for newly read files (path, file_size, file_mtime, content_hash)."""
    c = F.col
    found = packages.metadata(inspected).select("path", *METADATA_FIELDS)
    rows = files.select("path", "file_size", "file_mtime", "content_hash").join(found, "path")
    flags = [F.lit(True).alias("epub_validated"), F.lit(False).alias("epub_deep_validated")]
    return rows.select(
        c("path").alias("file_path"),
        fn.base_name(c("path")).alias("file_name"),
        F.ltrim(F.lower(fn.suffix(c("path"))), F.lit(".")).alias("format"),
        "file_size", "file_mtime", "content_hash",
        *METADATA_FIELDS,
        F.lit(now).alias("last_scanned_at"),
        *(flags if validated else []),
    )


def scan_job(
    books: DataFrame,
    inventory: DataFrame,
    roots: list[str],
    now: str,
    validate: bool = False,
    present: DataFrame | None = None,
    mark: bool = True,
    favorites: DataFrame | None = None,
    author_index: DataFrame | None = None,
    top_id: int | None = None,
    inspected: DataFrame | None = None,
) -> ScanResult:
    """Classify, read new files, merge, mark missing, count.

    A file that fails validation is reported with its faults, and its row, if any, is purged.
    With ``present`` the inventory is a part of the files and nothing is marked missing.
    Favourites and author tokens, where given, follow the purge. ``top_id``: see ``upsert_by_path``.
    ``inspected`` has what is in the files, where they are read already.
    """
    c = F.col
    sorted_files = cut_lineage(reconcile.classify(inventory, books, present=present, roots=roots))
    due = sorted_files.where(c("status") == "to_index")
    if inspected is None:
        inspected = cut_lineage(packages.inspect_packages(contents(due, inventory)))
    else:
        inspected = inspected.join(due.select("path"), "path", "left_semi")
    if validate:
        bad = inspected.where(~c("ok")).select("path", F.concat_ws("; ", "errors").alias("detail"))
    else:
        bad = inspected.where(F.lit(False)).select("path", F.lit("").alias("detail"))
    actions = sorted_files.join(bad, "path", "left").select(
        "path",
        F.when(c("detail").isNotNull(), "invalid").otherwise(c("status")).alias("status"),
        "book_id",
        F.when(c("detail").isNotNull(), c("path")).otherwise(c("delete_path")).alias("delete_path"),
        "detail",
    )
    good = due.join(bad.select("path"), "path", "left_anti")
    incoming = incoming_rows(good, inspected, now, validate)
    moved = sorted_files.where(c("status") == "repointed").select(
        c("book_id").alias("id"), c("path").alias("file_path"), "file_size", "file_mtime"
    )
    seen = inventory.select("path")
    state = merge.repoint(books, moved)
    purged = actions.where((c("status") == "invalid") & c("book_id").isNotNull()).select(c("book_id").alias("id")).distinct()
    state = state.join(purged, "id", "left_anti").select(*books.columns)
    merged = merge.upsert_by_path(state, incoming, checked=validate, top_id=top_id)
    whole = present is None and mark
    gone = merge.newly_missing(merged, seen, roots) if whole else None
    after = merge.mark_presence(merged, seen, roots if whole else [])
    return ScanResult(after, actions, stats.scan_summary(actions, gone), _without(favorites, purged), _without(author_index, purged))


def scan_part(store: Shelves, arrivals: DataFrame, now: str, validate: bool = True) -> tuple[DataFrame, ScanResult]:
    """A scan of some files (path, file_size, file_mtime, content) against the rows they may touch.

    These are the rows of the same paths and of the same contents; returned with the result, whose books are
    what becomes of them, and new rows. Nothing else of the catalogue is joined, and paths and hashes are all that is read of it.
    Bytes that the files carry are read once: they are hashed and inspected together, as a batch of a stream is made anew
    for each use of it and most of its files are new.
    """
    c = F.col
    facts = ["path", "file_size", "file_mtime", "content_hash"]
    hashed = with_content_hash(arrivals)
    inspected = None
    if "content" in arrivals.columns:
        inspected = hashed = cut_lineage(packages.with_inspection(hashed.select(*facts, "content")))
    files = hashed.select(*facts) if inspected is not None else cut_lineage(hashed.select(*facts))
    hashes = files.where(c("content_hash").isNotNull()).select("content_hash").distinct()
    landed = store.buckets_of(files.select(c("path").alias("file_path")))
    same_path = store.stored(landed).select("id", "bucket", "file_path").join(files.select(c("path").alias("file_path")), "file_path", "left_semi")
    same_content = store.stored().select("id", "bucket", "content_hash").join(hashes, "content_hash", "left_semi")
    ids = cut_lineage(same_path.select("id", "bucket").unionByName(same_content.select("id", "bucket")).distinct())
    held = [row.bucket for row in ids.select("bucket").distinct().collect()]
    related = cut_lineage(store.stored(held).join(few_ids(ids.select("id")), "id", "left_semi").select(*BOOK_COLUMNS))
    present = related.where(~c("is_missing")).select(c("file_path").alias("path")).unionByName(files.select("path")).distinct()
    top = max((entry[2] for entry in store.listed().values()), default=0)
    return related, scan_job(related, files, [], now, validate, present=present, top_id=top, inspected=inspected)


def removal_plan(invalid: DataFrame, inventory: DataFrame, covers: DataFrame, roots: list[str], cover_root: str) -> DataFrame:
    """(op, book_id, path) for invalid packages (path, book_id): file, row and covers, guarded by roots.

    A file outside the roots is refused, and then its row and covers stay.
    """
    c = F.col
    unique = invalid.dropDuplicates(["path"])
    there = inventory.select("path", F.lit(True).alias("there"))
    judged = unique.join(there, "path", "left").withColumn(
        "op",
        F.when(c("there").isNull(), "absent").when(fn.under_roots(c("path"), roots), "delete").otherwise("refuse"),
    )
    rows = judged.where((c("op") != "refuse") & c("book_id").isNotNull())
    pictures = reconcile.cover_removals(covers, rows.select(c("book_id").alias("id")), cover_root)
    return (
        judged.where(c("op") != "absent").select("op", "book_id", "path")
        .unionByName(rows.select(F.lit("purge").alias("op"), "book_id", "path"))
        .unionByName(pictures.select(F.lit("remove_cover").alias("op"), "book_id", "path"))
    )


# Files between two commits of a resumable validation.
BATCH_FILES = 50_000
_CHECKED = "path string, file_size long, file_mtime timestamp, ok boolean, detail string"
_FILE = ["path", "file_size", "file_mtime"]


def _inspected(files: DataFrame, inventory: DataFrame) -> DataFrame:
    found = packages.inspect_packages(contents(files, inventory))
    return found.select("path", "ok", F.concat_ws("; ", "errors").alias("detail"))


def checked_files(due: DataFrame, inventory: DataFrame, progress: str | None = None, batch_files: int = BATCH_FILES) -> DataFrame:
    """(path, ok, detail) of the files ``due`` (a written table: path, file_size, file_mtime).

    With ``progress``, a folder all executors share, results are stored there by path, size and time, one
    commit for each ``batch_files`` files or so. A run that finds results of the same files opens these no more, so a
    job that was stopped goes on after its last commit; a file that changed meanwhile is opened again.
    """
    if progress is None:
        return cut_lineage(_inspected(due, inventory))
    spark = due.sparkSession
    store = f"{progress.rstrip('/')}/checked"

    def done() -> DataFrame:
        # an append without files leaves no table behind
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_SUCCESS")
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], _CHECKED)
        return spark.read.schema(_CHECKED).parquet(store).dropDuplicates(_FILE)

    left = cut_lineage(due.select(*_FILE).join(done().select(*_FILE), _FILE, "left_anti"))
    slices = -(-left.count() // batch_files)
    for number in range(slices):
        some = left.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == number)
        _inspected(some, inventory).join(some, "path").select("path", "file_size", "file_mtime", "ok", "detail").write.mode("append").parquet(store)
    return done().join(due.select(*_FILE), _FILE, "left_semi").select("path", "ok", "detail")


def integrity_job(
    books: DataFrame,
    inventory: DataFrame,
    covers: DataFrame,
    roots: list[str],
    cover_root: str = "covers",
    deep: bool = False,
    progress: str | None = None,
    batch_files: int = BATCH_FILES,
) -> IntegrityResult:
    """Validate what is due, mark the good, list the bad, plan their removal. ``progress``: see ``checked_files``."""
    c = F.col
    queue = cut_lineage(reconcile.validation_queue(books, inventory, roots, deep))
    checked = checked_files(queue, inventory, progress, batch_files)
    # a file whose row is marked missing belongs to that row all the same
    named = cut_lineage(reconcile.path_to_id(checked, books))
    good = named.where(c("ok") & c("book_id").isNotNull()).select(c("book_id").alias("id"))
    bad_rows = named.where(~c("ok")).select("path", "book_id", "detail")
    return IntegrityResult(
        merge.mark_validated(books, good, deep),
        bad_rows,
        removal_plan(bad_rows.select("path", "book_id"), inventory, covers, roots, cover_root),
    )


def _plan(df: DataFrame, op: str, book_id=None, from_path=None, to_path=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(op).alias("op"),
        (none if book_id is None else book_id).cast("bigint").alias("book_id"),
        (none if from_path is None else from_path).cast("string").alias("from_path"),
        (none if to_path is None else to_path).cast("string").alias("to_path"),
    )


def _moved_files(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """The inventory after renames (from_path, to_path)."""
    moves = plan.select(F.col("from_path").alias("path"), "to_path")
    rest = [n for n in inventory.columns if n != "path"]
    return inventory.join(moves, "path", "left").select(F.coalesce("to_path", "path").alias("path"), *rest)


def cleanup_summary(plan: DataFrame) -> DataFrame:
    """One row of counters over the plan's operations."""
    op = F.col("op")
    tallies = [
        F.count_if(op == name).cast("bigint").alias(counter) for name, counter in CLEANUP_COUNTERS.items()
    ]
    return plan.agg(*tallies, F.count_if(op.isin(*ERROR_OPS)).cast("bigint").alias("errors"))


def cleanup_run(
    books: DataFrame,
    inventory: DataFrame,
    covers: DataFrame,
    dirs: DataFrame,
    roots: list[str],
    now: str,
    execute: bool = False,
    force_clean: bool = False,
    validate: bool = False,
    deep: bool = False,
    cover_root: str = "covers",
    favorites: DataFrame | None = None,
    author_index: DataFrame | None = None,
) -> CleanupResult:
    """Back-fill, strip, rename, audit, validate, dedupe, index, prune and force-clean, in this order.

    Packages are opened only with ``validate``: the broken are reported and their files, rows and
    covers removed, the good rows marked. Favourites and author tokens, where given, follow a purge.

    Without ``execute`` every step looks at the library as it is and only the plan is made. With
    it each step works on the snapshot and inventory the step before leaves behind; snapshots are
    written after the strip, after a validation and at the end.
    """
    c = F.col
    if force_clean and not execute:
        raise ValueError("force_clean needs execute")
    keep = (lambda df: cut_lineage(df)) if execute else (lambda df: df)

    matched = reconcile.match_paths(books, inventory)
    accepted, refused = merge.backfill_split(books, cut_lineage(merge.fresh_hashes(books, inventory, matched)))
    plan = [
        _plan(accepted, "backfill", c("id")),
        _plan(refused, "backfill_refused", c("id")),
    ]
    if execute:
        books = merge.backfill_hashes(books, accepted)

    # written with the marks, as both the plan and the next snapshot read them
    stripped = keep(merge.strip_descriptions(books))
    plan.append(_plan(stripped.where("description_changed"), "strip", c("id")))
    if execute:
        books = stripped.drop("description_changed")

    renames = keep(reconcile.rename_plan(books, inventory, roots, matched=matched))
    plan.append(_plan(renames, "rename", c("id"), c("from_path"), c("to_path")))
    if execute:
        facts = inventory.select(c("path").alias("from_path"), "file_size", "file_mtime")
        moves = renames.join(facts, "from_path").select("id", c("to_path").alias("file_path"), "file_size", "file_mtime")
        # not written: the next changes are by id too, so rows are exchanged once for all of them
        books = merge.repoint(books, moves, clear_flags=True)
        inventory = _moved_files(inventory, renames)
        matched = reconcile.match_paths(books, inventory)

    loose = reconcile.hashed_unindexed(matched, inventory)
    groups = cut_lineage(reconcile.content_groups(loose, matched))
    findings = reconcile.audit_report(books, inventory, covers, roots, loose, matched, groups)
    absent = matched.where(c("in_books") & ~c("in_files")).select("id")
    if validate:
        checked = integrity_job(books, inventory, covers, roots, cover_root, deep)
        removals = cut_lineage(checked.removals)
        plan.append(_plan(checked.invalid, "invalid", c("book_id"), c("path")))
        plan.append(removals.select("op", "book_id", c("path").alias("from_path"), F.lit(None).cast("string").alias("to_path")))
        if execute:
            removed = removals.where(c("op") == "delete").select("path")
            purged = removals.where(c("op") == "purge").select(c("book_id").alias("id")).distinct()
            pictures = removals.where(c("op") == "remove_cover").select("path")
            books = keep(checked.books.join(purged, "id", "left_anti").select(*books.columns))
            favorites, author_index = _without(favorites, purged), _without(author_index, purged)
            inventory = inventory.join(removed, "path", "left_anti")
            covers = covers.join(pictures, "path", "left_anti")
            # what is gone neither keeps a content nor is a copy of it
            matched = reconcile.match_paths(books, inventory)
            loose = cut_lineage(loose.join(removed, "path", "left_anti"))
            groups = cut_lineage(reconcile.content_groups(loose, matched))
            absent = matched.where(c("in_books") & ~c("in_files")).select("id")
    dedupe = keep(reconcile.dedupe_plan(loose, groups, roots))
    fresh = reconcile.new_files(groups)
    plan.append(dedupe)
    plan.append(_plan(fresh, "index", None, c("path")))
    moved_ids = dedupe.where(c("op") == "repoint").select("book_id")
    if execute:
        facts = inventory.select(c("path").alias("to_path"), "file_size", "file_mtime")
        moves = dedupe.where(c("op") == "repoint").join(facts, "to_path").select(
            c("book_id").alias("id"), c("to_path").alias("file_path"), "file_size", "file_mtime"
        )
        deleted = dedupe.where(c("op") == "delete").select(c("from_path").alias("path"))
        books = merge.repoint(books, moves, clear_flags=True)
        inventory = inventory.join(deleted, "path", "left_anti")
        top_id = None
        if force_clean:
            # rows without a file get none from the arrivals, so they leave before these are merged; their ids stay used
            doomed = cut_lineage(absent.join(moved_ids.select(c("book_id").alias("id")), "id", "left_anti"))
            top_id = books.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            lost = cut_lineage(books.join(doomed, "id", "left_semi").select("id", "file_path"))
            books = books.join(doomed, "id", "left_anti").select(*books.columns)
        arrivals = loose.join(fresh.select("path"), "path", "left_semi")
        inspected = cut_lineage(packages.inspect_packages(contents(arrivals, inventory)))
        books = keep(merge.upsert_by_path(books, incoming_rows(arrivals, inspected, now, validate), checked=validate, top_id=top_id))
    plan.append(_plan(reconcile.empty_dirs(dirs, inventory, roots), "prune", None, c("path")))

    if force_clean:
        favorites, author_index = _without(favorites, doomed), _without(author_index, doomed)
        plan.append(_plan(lost, "purge", c("id"), c("file_path")))
        plan.append(_plan(reconcile.orphan_covers(covers, books), "remove_cover", c("book_id"), c("path")))

    whole = plan[0]
    for step in plan[1:]:
        whole = whole.unionByName(step)
    return CleanupResult(books, whole, findings, cleanup_summary(whole), favorites, author_index)
