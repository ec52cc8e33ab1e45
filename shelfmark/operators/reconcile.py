"""Files against catalogue rows: classification, copies, audits and action plans.

Inputs: ``books`` is the catalogue; ``inventory`` has one row per file (path, file_size,
file_mtime and content or content_hash); paths are unique in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions import files as fn
from shelfmark.operators.skew import HOT_ROWS, join_hot, rank_by_id
from shelfmark.session import cut_lineage
from shelfmark.sources.files import hashed

# --- single joins ----------------------------------------------------------------------------


def unindexed_files(inventory: DataFrame, books: DataFrame) -> DataFrame:
    return inventory.join(books.select(F.col("file_path").alias("path")), "path", "left_anti")


def absent_rows(books: DataFrame, inventory: DataFrame) -> DataFrame:
    return books.join(inventory.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def on_disk(books: DataFrame, inventory: DataFrame) -> DataFrame:
    return books.join(inventory.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def out_of_root_rows(books: DataFrame, roots: list[str]) -> DataFrame:
    return books.where(~fn.under_roots(F.col("file_path"), roots))


def orphan_covers(covers: DataFrame, books: DataFrame) -> DataFrame:
    """Covers (path, book_id) whose name is no id, or an id the catalogue does not have.

    Names that are no id need no join, so they do not gather in its NULL partition.
    """
    columns = covers.columns
    numbered = covers.where(F.col("book_id").isNotNull())
    strays = numbered.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return covers.where(F.col("book_id").isNull()).unionByName(strays.select(*columns))


def path_to_id(paths: DataFrame, books: DataFrame) -> DataFrame:
    return paths.join(books.select(F.col("file_path").alias("path"), F.col("id").alias("book_id")), "path", "left")


def canonical_rows(books: DataFrame) -> DataFrame:
    """Per content hash the row with the lowest id, reduced before the exchange."""
    return (
        books.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min(F.struct("id", "file_path")).alias("row"))
        .select("content_hash", F.col("row.id").alias("canon_id"), F.col("row.file_path").alias("canon_path"))
    )


def hash_lookup(files: DataFrame, books: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files (path, content_hash) with the canonical row of their content, if any."""
    return join_hot(files, canonical_rows(books), "content_hash", "left", ["path"], hot_rows)


def hash_conflicts(fresh: DataFrame, books: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Freshly hashed rows (id, content_hash) whose content already belongs to another id.

    Per hash the two lowest ids are enough to name the lowest *other* id of any row.
    """
    owners = (
        books.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )
    # the second lowest id is needed only by the first row itself
    second = (
        join_hot(
            books.where(F.col("content_hash").isNotNull()).select("content_hash", "id"),
            owners.where(F.col("first_id") < F.col("last_id")).select("content_hash", "first_id"),
            "content_hash", "inner", ["id"], hot_rows,
        )
        .where(F.col("id") > F.col("first_id"))
        .groupBy("content_hash")
        .agg(F.min("id").alias("second_id"))
    )
    named = owners.join(second, "content_hash", "left").select("content_hash", "first_id", "second_id")
    other = F.when(F.col("id") != F.col("first_id"), F.col("first_id")).otherwise(F.col("second_id"))
    return (
        join_hot(fresh, named, "content_hash", "inner", ["id"], hot_rows)
        .select("id", "content_hash", other.alias("other_id"))
        .where(F.col("other_id").isNotNull())
    )


def drop_children(children: DataFrame, deleted: DataFrame, column: str = "book_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Child rows left after their parents (unique ids) were deleted."""
    spread = [c for c in children.columns if c != column] or [column]
    gone = deleted.select(F.col("id").alias(column))
    return join_hot(children, gone, column, "left_anti", spread, hot_rows).select(*children.columns)


# --- one match by path -----------------------------------------------------------------------

_MATCHED = ("id", "file_name", "title", "authors", "publisher", "content_hash", "is_missing")


def match_paths(books: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every path of the catalogue or the disk once, with what both know of it; written.

    ``in_books`` and ``in_files`` tell where it is. Unindexed files, absent rows, rows on disk, presence of a
    content's row and taken names are all read from this table, so the two sides meet in one join.
    """
    rows = books.select(F.col("file_path").alias("path"), *_MATCHED, F.lit(True).alias("in_books"))
    files = inventory.select("path", "file_size", "file_mtime", F.lit(True).alias("in_files"))
    both = rows.join(files, "path", "full_outer")
    flags = {flag: F.coalesce(flag, F.lit(False)) for flag in ("in_books", "in_files")}
    return cut_lineage(both.withColumns(flags))


# --- copies ----------------------------------------------------------------------------------


def files_by_hash(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every file with the size of its group of equal contents: one row per file, no lists.

    A file that could not be read has no hash, no group and no size. The hashes are written, as they are
    counted and joined; the largest group tells whether groups must be cut.
    """
    c = F.col
    rows = cut_lineage(files.select("path", "content_hash"))
    readable = rows.where(c("content_hash").isNotNull())
    sizes = cut_lineage(readable.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies")))
    crowded = sizes.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0] > hot_rows
    sized = join_hot(readable, sizes, "content_hash", "inner", ["path"], hot_rows) if crowded else readable.join(sizes, "content_hash")
    unread = rows.where(c("content_hash").isNull()).withColumn("copies", F.lit(None).cast("bigint"))
    return sized.select("content_hash", "path", "copies").unionByName(unread)


def keeper_paths(files: DataFrame) -> DataFrame:
    """Per content hash the copy that stays."""
    readable = files.where(F.col("content_hash").isNotNull())
    return readable.groupBy("content_hash").agg(F.max(fn.keeper_key(F.col("path")))["path"].alias("keeper"))


def _with_presence(canon: DataFrame, paths: DataFrame) -> DataFrame:
    """``canon`` with ``there``: its canon_path is among ``paths``.

    Contents the catalogue does not know have no such path, on a first scan that is all of them; a
    key of their own keeps them out of one task.
    """
    there = paths.select(F.col("path").alias("_there_path"), F.lit(True).alias("there"))
    key = F.coalesce(F.col("canon_path"), F.concat(F.lit("\x00"), F.col("content_hash")))
    return canon.join(there, key == F.col("_there_path"), "left").drop("_there_path").withColumn("there", F.coalesce("there", F.lit(False)))


def content_groups(unindexed: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per content of the unindexed files (path, content_hash): keeper, book, number of copies.

    Files and rows of equal contents are reduced in one grouping; a row's own presence comes with it.
    """
    c = F.col
    row = F.struct("id", "path", F.col("in_files").alias("there"))
    best = fn.keeper_key(c("path"))
    loose = unindexed.where(c("content_hash").isNotNull()).select("content_hash", best.alias("file"))
    rows = matched.where(c("in_books") & c("content_hash").isNotNull()).select("content_hash", row.alias("row"))
    groups = (
        loose.unionByName(rows, allowMissingColumns=True)
        .groupBy("content_hash")
        .agg(F.count("file").alias("files"), F.max("file").alias("best"), F.min("row").alias("canon"))
        .where(c("files") > 0)
        .select(
            "content_hash", "files", "best", c("canon.id").alias("book_id"), c("canon.path").alias("canon_path"),
            F.coalesce("canon.there", F.lit(False)).alias("there"),
        )
    )
    keeper = F.when(c("there"), F.greatest(c("best"), fn.keeper_key(c("canon_path")))).otherwise(c("best"))
    return groups.select(
        "content_hash",
        keeper["path"].alias("keeper"),
        "book_id",
        "canon_path",
        "there",
        (c("files") + c("there").cast("int") - 1).alias("n_remove"),
    )


def _duplicates(groups: DataFrame) -> DataFrame:
    c = F.col
    lone = c("book_id").isNull() | (c("canon_path") == c("keeper"))
    return groups.where((c("n_remove") > 0) | ~lone).select(
        "content_hash",
        "keeper",
        "n_remove",
        "book_id",
        (c("book_id").isNotNull() & (c("n_remove") == 0) & ~c("there")).alias("repoint_only"),
    )


def duplicate_groups(unindexed: DataFrame, matched: DataFrame) -> DataFrame:
    """Per content hash with copies or a moved book: keeper, files to remove (count), book."""
    return _duplicates(content_groups(unindexed, matched))


def duplicate_members(unindexed: DataFrame, matched: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The copies to remove, one row each: (content_hash, path, keeper)."""
    return _members(unindexed, cut_lineage(content_groups(unindexed, matched)), hot_rows)


def _members(unindexed: DataFrame, groups: DataFrame, hot_rows: int) -> DataFrame:
    """The number of files of each content is known, so only contents with copies are joined, and hot ones by parts."""
    c = F.col
    several = groups.where(c("n_remove") > 0).select("content_hash", "keeper", "n_remove")
    crowded = several.agg(F.coalesce(F.max("n_remove"), F.lit(0))).first()[0] > hot_rows
    files = unindexed.select("path", "content_hash")
    keepers = several.select("content_hash", "keeper")
    joined = join_hot(files, keepers, "content_hash", "inner", ["path"], hot_rows) if crowded else files.join(keepers, "content_hash")
    copies = joined.where(c("path") != c("keeper"))
    indexed = groups.where(c("there") & (c("canon_path") != c("keeper")))
    return copies.select("content_hash", "path", "keeper").unionByName(
        indexed.select("content_hash", c("canon_path").alias("path"), "keeper")
    )


def new_files(groups: DataFrame) -> DataFrame:
    """Keeper of each unindexed content the catalogue does not know."""
    return groups.where(F.col("book_id").isNull()).select("content_hash", F.col("keeper").alias("path"))


def dedupe_plan(unindexed: DataFrame, groups: DataFrame, roots: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(op, book_id, from_path, to_path): rows to repoint, copies to delete, deletes refused.

    ``groups`` are the contents' groups, one row each, written because both parts of the plan read them.
    """
    c = F.col
    moves = groups.where(c("book_id").isNotNull() & (c("canon_path") != c("keeper"))).select(
        F.lit("repoint").alias("op"), "book_id", c("canon_path").alias("from_path"), c("keeper").alias("to_path")
    )
    removes = _members(unindexed, groups, hot_rows).select(
        F.when(fn.under_roots(c("path"), roots), "delete").otherwise("refuse").alias("op"),
        F.lit(None).cast("bigint").alias("book_id"),
        c("path").alias("from_path"),
        F.lit(None).cast("string").alias("to_path"),
    )
    return moves.unionByName(removes)


# --- scan ------------------------------------------------------------------------------------


def classify(
    inventory: DataFrame,
    books: DataFrame,
    hot_rows: int = HOT_ROWS,
    present: DataFrame | None = None,
    roots: list[str] | None = None,
) -> DataFrame:
    """What a scan does with each file.

    ``present`` lists the paths that exist when ``inventory`` is only a part of the files. With
    ``roots``, a row's file outside them counts as there and is never deleted.

    Files whose size and time match their row are unchanged and are not read. The others are
    hashed once (the hashes are written, so that no later step reads a file again). Then per
    content: a hash the catalogue knows under another row makes the file a copy; the best free
    copy takes the row over (``repointed``) when the row's own file is gone or ranks lower, a
    copy that itself belongs to a row and ranks higher is a ``conflict``, the rest are
    ``duplicate``. Unknown content is indexed once (``to_index``): by the lowest existing row
    among its files, else by the best copy.
    """
    c = F.col
    rows = books.select(
        c("file_path").alias("path"),
        c("id").alias("existing_id"),
        c("file_size").alias("old_size"),
        c("file_mtime").alias("old_mtime"),
        c("content_hash").alias("old_hash"),
    )
    listed = inventory.select("path", "file_size", "file_mtime")
    paired = listed.join(rows, "path", "left")
    same = F.coalesce(
        (c("file_size") == c("old_size")) & (c("file_mtime") == c("old_mtime")), F.lit(False)
    )
    calm = paired.where(same).select(
        "path", "file_size", "file_mtime",
        F.lit(None).cast("string").alias("content_hash"),
        F.lit("unchanged").alias("status"), c("existing_id").alias("book_id"),
        F.lit(None).cast("string").alias("delete_path"),
    )
    due = cut_lineage(paired.where(~same).select("path", "file_size", "file_mtime", "existing_id", "old_hash"))
    suspects = cut_lineage(
        hashed(due, inventory).select("path", "file_size", "file_mtime", "content_hash", "existing_id", "old_hash")
    )

    free = c("existing_id").isNull()
    groups = suspects.where(c("content_hash").isNotNull()).groupBy("content_hash").agg(
        F.max(F.when(free, fn.keeper_key(c("path")))).alias("best_free"),
        F.min(F.when(~free, F.struct("existing_id", "path"))).alias("owner"),
    )
    canon = groups.join(canonical_rows(books), "content_hash", "left")
    paths = inventory if present is None else present
    inside_roots = F.coalesce(fn.under_roots(c("canon_path"), roots or []), F.lit(True))
    facts = _with_presence(canon, paths).select(
        "content_hash",
        c("best_free.path").alias("best_path"),
        F.coalesce("owner.path", "best_free.path").alias("index_path"),
        "canon_id",
        "canon_path",
        # a file outside the scanned roots was not looked at, so it counts as there
        (c("there") | (F.lit(False) if roots is None else ~inside_roots)).alias("there"),
        (F.lit(True) if roots is None else inside_roots).alias("scanned"),
    )
    judged = join_hot(suspects, facts, "content_hash", "left", ["path"], hot_rows)
    key = fn.keeper_key(c("path"))
    known = c("canon_id").isNotNull()
    foreign = known & (free | (c("canon_id") != c("existing_id")))
    outranks = F.when(foreign, ~c("there") | (key > fn.keeper_key(c("canon_path")))).otherwise(
        key > fn.keeper_key(c("index_path"))
    )
    status = (
        F.when(c("content_hash").isNull(), "error")
        .when(foreign & free & outranks & (c("path") == c("best_path")), "repointed")
        .when(foreign & ~free & outranks, "conflict")
        .when(foreign, "duplicate")
        .when(c("old_hash") == c("content_hash"), "unchanged")
        .when(c("path") == c("index_path"), "to_index")
        .when(~free & outranks, "conflict")
        .otherwise("duplicate")
    )
    moved = c("status") == "repointed"
    return judged.withColumn("status", status).select(
        "path", "file_size", "file_mtime", "content_hash", "status",
        F.when(moved, c("canon_id")).otherwise(c("existing_id")).alias("book_id"),
        F.when(moved & c("there") & c("scanned"), c("canon_path")).alias("delete_path"),
    ).unionByName(calm)


# --- queues ----------------------------------------------------------------------------------


def validation_queue(books: DataFrame, inventory: DataFrame, roots: list[str], deep: bool = False) -> DataFrame:
    """(path, book_id, file_size, file_mtime) to check: rows on disk not yet validated, then files without such a row.

    A missing row's file counts as a file; a validated row's file is left out. One left join by
    path decides, because paths are unique on both sides.
    """
    c = F.col
    flag = "epub_deep_validated" if deep else "epub_validated"
    rows = books.where(~c("is_missing")).select(
        c("file_path").alias("path"), c("id").alias("book_id"), c(flag).alias("done")
    )
    below = inventory.where(fn.under_roots(c("path"), roots)).select("path", "file_size", "file_mtime")
    due = below.join(rows, "path", "left").where(~F.coalesce("done", F.lit(False)))
    return due.select("path", "book_id", "file_size", "file_mtime")


def validated_count(books: DataFrame, deep: bool = False) -> DataFrame:
    flag = "epub_deep_validated" if deep else "epub_validated"
    return books.agg(F.count_if(~F.col("is_missing") & F.col(flag)).alias("skipped"))


def upgrade_queue(books: DataFrame, inventory: DataFrame, roots: list[str]) -> DataFrame:
    c = F.col
    due = books.where(
        ~c("is_missing")
        & (F.lower("format") == "epub")
        & ~c("epub_version2")
        & fn.under_roots(c("file_path"), roots)
    )
    return on_disk(due, inventory).select("id", "file_path", "file_name")


# --- names -----------------------------------------------------------------------------------


def rename_candidates(matched: DataFrame, roots: list[str]) -> DataFrame:
    """Rows on disk below the roots with the name their file should have.

    (id, file_path, file_name, disk_name, dir, wanted), from the match by path.
    """
    c = F.col
    named = matched.where(c("in_books") & c("in_files") & ~c("is_missing") & fn.under_roots(c("path"), roots))
    named = named.withColumn("disk_name", fn.base_name(c("path")))
    return named.select(
        "id", c("path").alias("file_path"), "file_name", "disk_name", fn.parent(c("path")).alias("dir"),
        fn.target_filename(c("disk_name"), c("title"), c("authors"), c("publisher")).alias("wanted"),
    )


def filename_fixes(matched: DataFrame, roots: list[str]) -> DataFrame:
    c = F.col
    rows = rename_candidates(matched, roots)
    return rows.where((c("wanted") != c("disk_name")) | (c("file_name") != c("wanted"))).select(
        "id", "file_path", "wanted"
    )


_NUMBERED = r"(?s)\A(.*) \((\d+)\)(\.[^.]+)?\z"


def _taken_numbers(inventory: DataFrame) -> DataFrame:
    """(dir, wanted, slot): the numbers of a name that files on disk have.

    A file takes number 1 of its own name and, spelled "stem (n).ext", number n of "stem.ext"; only plain
    spellings are in the way: "(2)", not "(02)".
    """
    c = F.col
    name, digits = c("name"), F.regexp_extract("name", _NUMBERED, 2)
    number = F.nullif(digits, F.lit("")).try_cast("bigint")
    bare = F.concat(F.regexp_extract("name", _NUMBERED, 1), F.regexp_extract("name", _NUMBERED, 3))
    places = F.array(
        F.struct(name.alias("wanted"), F.lit(1).cast("bigint").alias("slot")),
        F.struct(
            bare.alias("wanted"),
            F.when((number >= 2) & (digits == number.cast("string")), number).alias("slot"),
        ),
    )
    return (
        inventory.select(fn.parent(c("path")).alias("dir"), fn.base_name(c("path")).alias("name"))
        .select("dir", F.inline(places))
        .where(c("slot").isNotNull())
    )


def unique_names(claims: DataFrame, inventory: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Claims (id, dir, wanted, and what else they carry) with the name each gets: ``stem.ext``, ``stem (2).ext``, ...

    Claims of one name are served by id with the numbers no file on disk has. A name claimed once that no
    file has is given as it is; only the contested names are ranked and looked up among the files' numbers.
    """
    c = F.col
    carried = [n for n in claims.columns if n not in ("dir", "wanted")]
    names = claims.groupBy("dir", "wanted").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*carried)).alias("one"))
    there = inventory.select(
        fn.parent(c("path")).alias("dir"), fn.base_name(c("path")).alias("wanted"), F.lit(True).alias("there")
    )
    judged = cut_lineage(names.join(there, ["dir", "wanted"], "left"))
    free = (c("n") == 1) & c("there").isNull()
    lone = judged.where(free).select("dir", "wanted", "one.*").withColumn("final_name", c("wanted"))
    contested = judged.where(~free).select("dir", "wanted", "n")
    keys = ["dir", "wanted"]
    claimed = contested.agg(F.max("n")).first()[0]
    if claimed is None:
        return lone.select(*claims.columns, "final_name")
    names = contested.select(*keys)
    slots = cut_lineage(_taken_numbers(inventory).join(names, keys, "left_semi"))
    most = max(claimed, slots.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    if most > hot_rows:
        numbered = _numbers_of_hot(join_hot(claims, names, keys, "left_semi", ["id"], hot_rows), slots, hot_rows)
    else:
        numbered = _numbers(claims.join(names, keys, "left_semi"), slots)
    stem, ext = fn.stem(c("wanted")), fn.suffix(c("wanted"))
    final = F.when(c("number") == 1, c("wanted")).otherwise(
        F.concat(stem, F.lit(" ("), c("number").cast("string"), F.lit(")"), ext)
    )
    return lone.unionByName(numbered.withColumn("final_name", final).drop("number")).select(*claims.columns, "final_name")


def _numbers(claims: DataFrame, slots: DataFrame) -> DataFrame:
    """Contested claims with their ``number``; a name's claims and taken numbers meet in one task, in one exchange.

    The k-th claim gets k plus the number of taken numbers up to there: the j-th taken number has
    slot - j free ones before it, so it shifts every claim after these.
    """
    c = F.col
    keys = ["dir", "wanted"]
    rows = claims.withColumn("kind", F.lit(1)).unionByName(slots.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition(*keys)
    rank = F.dense_rank().over(Window.partitionBy(*keys, "kind").orderBy("slot", "id")).cast("bigint")
    ranked = rows.withColumn("rank", rank).withColumn("at", F.when(c("kind") == 1, c("rank")).otherwise(c("slot") - c("rank") + 1))
    along = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.coalesce(F.max(F.when(c("kind") == 0, c("rank"))).over(along), F.lit(0))
    return ranked.withColumn("number", c("at") + passed).where(c("kind") == 1).select(*claims.columns, "number")


def _numbers_of_hot(claims: DataFrame, slots: DataFrame, hot_rows: int) -> DataFrame:
    """The same where one name is claimed by more rows than a task should see."""
    c = F.col
    keys = ["dir", "wanted"]
    rows = cut_lineage(claims)
    ranked = rank_by_id(rows, keys, "id", "turn", hot_rows)
    taken = cut_lineage(slots.distinct())
    # free numbers before the j-th taken one: slot - j
    gaps = rank_by_id(taken, keys, "slot", "j", hot_rows).select(*keys, (c("slot") - c("j")).alias("free_before"), "j")
    # merge turns and gaps on one axis, in order: a gap shifts every later turn
    axis = ranked.withColumnRenamed("turn", "at").withColumns({"is_turn": F.lit(1), "j": F.lit(0).cast("bigint")})
    axis = axis.unionByName(
        gaps.groupBy(*keys, "free_before")
        .agg(F.max("j").alias("j"))
        .select(*keys, (c("free_before") + 1).alias("at"), F.lit(0).alias("is_turn"), "j"),
        allowMissingColumns=True,
    )
    shifted = _running_max(axis, hot_rows).where(c("is_turn") == 1)
    return shifted.withColumn("number", c("at") + c("shift")).select(*claims.columns, "number")


def _running_max(axis: DataFrame, hot_rows: int) -> DataFrame:
    """Running maximum of ``j`` along ``at`` per name, gaps before turns, in ranges of ``at``."""
    keys = ["dir", "wanted"]
    ranged = axis.withColumn("_range", F.floor((F.col("at") - 1) / hot_rows))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy(*keys, "_range")
        .agg(F.max("j").alias("_top"))
        .select(*keys, "_range", F.coalesce(F.max("_top").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy("at", "is_turn")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("_run", F.max("j").over(inside))
        .join(before, [*keys, "_range"])
        .withColumn("shift", F.greatest("_run", "_base"))
        .drop("_range", "_run", "_base")
    )


def rename_plan(
    books: DataFrame, inventory: DataFrame, roots: list[str], hot_rows: int = HOT_ROWS, matched: DataFrame | None = None
) -> DataFrame:
    """(id, from_path, to_path): renames that give every file its wanted, unused name.

    A row whose file is named well but that stores another file name stays where it is (from = to): the
    move mends the stored name. ``matched`` is the match by path, where it is made already.
    """
    c = F.col
    matched = match_paths(books, inventory) if matched is None else matched
    # the names are worked out once and written; they are read several times
    rows = cut_lineage(
        rename_candidates(matched, roots).where((c("wanted") != c("disk_name")) | (c("file_name") != c("disk_name")))
        .select("id", "file_path", "dir", "wanted", (c("wanted") == c("disk_name")).alias("stale"))
    )
    claims = rows.where(~c("stale")).select("id", "dir", "wanted", "file_path")
    named = unique_names(claims, matched.where("in_files").select("path"), hot_rows)
    path = F.concat(F.when(c("dir") == "/", "").otherwise(c("dir")), F.lit("/"), c("final_name"))
    kept = rows.where(c("stale")).select("id", c("file_path").alias("from_path"), c("file_path").alias("to_path"))
    return named.select("id", c("file_path").alias("from_path"), path.alias("to_path")).unionByName(kept)


# --- directories and covers ------------------------------------------------------------------


def empty_dirs(dirs: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """Directories (path) below a root, not a root itself, with no file at any depth."""
    c = F.col
    used = files.select(F.explode(fn.ancestors(c("path"))).alias("path")).distinct()
    cleaned = [r.rstrip("/") or "/" for r in roots]
    below = dirs.select("path").where(fn.under_roots(c("path"), roots) & ~c("path").isin(cleaned))
    return below.distinct().join(used, "path", "left_anti").select(
        "path", F.size(F.split("path", "/")).cast("bigint").alias("depth")
    )


def force_clean_plan(
    books: DataFrame, inventory: DataFrame, covers: DataFrame, repointed: DataFrame
) -> DataFrame:
    """(op, book_id, path): absent rows that were not repointed, then covers of no surviving row."""
    c = F.col
    gone = absent_rows(books, inventory).join(repointed.select(c("book_id").alias("id")), "id", "left_anti")
    kept = books.select("id").join(gone.select("id"), "id", "left_anti")
    return gone.select(F.lit("purge").alias("op"), c("id").alias("book_id"), c("file_path").alias("path")).unionByName(
        orphan_covers(covers, kept).select(F.lit("remove_cover").alias("op"), "book_id", "path")
    )


def cover_removals(covers: DataFrame, removed: DataFrame, root: str) -> DataFrame:
    """Cover files of removed books (unique ids), at any of the places a cover may be."""
    c = F.col
    places = removed.select(
        c("id").alias("book_id"), F.explode(fn.cover_candidates(root, c("id"))).alias("path")
    )
    return covers.select("path").join(places, "path").select("book_id", "path")


# --- audit -----------------------------------------------------------------------------------


def _finding(df: DataFrame, kind: str, book_id: Column, path: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        book_id.cast("bigint").alias("book_id"),
        path.alias("path"),
        detail.cast("string").alias("detail"),
    )


def hashed_unindexed(matched: DataFrame, inventory: DataFrame) -> DataFrame:
    """The unindexed files of a match with their hashes, read once and written."""
    loose = matched.where(~F.col("in_books")).select("path", "file_size", "file_mtime")
    return cut_lineage(hashed(loose, inventory).select("path", "file_size", "file_mtime", "content_hash"))


def audit_report(
    books: DataFrame,
    inventory: DataFrame,
    covers: DataFrame,
    roots: list[str],
    loose: DataFrame | None = None,
    matched: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """All findings of an audit as one table: (kind, book_id, path, detail).

    All but the covers are read from one match by path and one grouping by content. Only the
    unindexed files are hashed, once. ``matched``, ``loose`` and ``groups`` pass in what is made already.
    """
    c = F.col
    none = F.lit(None)
    matched = match_paths(books, inventory) if matched is None else matched
    loose = hashed_unindexed(matched, inventory) if loose is None else loose
    groups = cut_lineage(content_groups(loose, matched)) if groups is None else groups
    absent = matched.where(c("in_books") & ~c("in_files"))
    tests = F.array_compact(
        F.array(
            F.when(c("content_hash").isNull(), F.lit("null_hash")),
            F.when(~fn.under_roots(c("path"), roots), F.lit("out_of_root")),
        )
    )
    rows = matched.where("in_books").select("id", "path", F.explode(tests).alias("kind"))
    return (
        _finding(loose, "unindexed", none, c("path"), none)
        .unionByName(
            _finding(
                _duplicates(groups), "duplicate_group",
                c("book_id"), c("keeper"), F.concat(c("n_remove").cast("string"), F.lit(" to remove")),
            )
        )
        .unionByName(_finding(new_files(groups), "new_file", none, c("path"), c("content_hash")))
        .unionByName(_finding(absent, "absent", c("id"), c("path"), F.when(c("is_missing"), "missing")))
        .unionByName(rows.select("kind", c("id").alias("book_id"), "path", none.cast("string").alias("detail")))
        .unionByName(_finding(orphan_covers(covers, books), "orphan_cover", c("book_id"), c("path"), none))
        .unionByName(_finding(filename_fixes(matched, roots), "filename_fix", c("id"), c("file_path"), c("wanted")))
    )
