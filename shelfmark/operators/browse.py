"""Sorting, paging and neighbours of a filtered listing.

Order contract: the sort key, then the id ascending. SQL NULLs come first ascending and last
descending, except for publication dates and page counts, which put them last either way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from shelfmark.functions.text import fold_nocase
from shelfmark.operators import search
from shelfmark.operators.skew import any_of, all_of
from shelfmark.operators.search import BrowseContext, Indexes
from shelfmark.schema import LIST_COLUMNS
from shelfmark.session import cut_lineage

Part = tuple[Column, str]


# A snapshot stores the title key under this name.
TITLE_KEY = "title_key"
SORTS = ("title", "author", "published", "size", "pages", "scanned")


def title_key() -> Column:
    c = F.col
    return fold_nocase(F.coalesce(F.nullif(c("sort_title"), F.lit("")), F.nullif(c("title"), F.lit("")), c("file_name")))


def sort_keys(sort: str, sort_dir: str = "", title: Column | None = None) -> list[Part]:
    """Key expressions with their directions, the id last. ``title`` is a stored title key."""
    way = search.direction(sort, sort_dir)
    c = F.col
    keys = {
        "title": [(title_key() if title is None else title, way)],
        "author": [(fold_nocase(c("authors")), way)],
        "published": [(c("published_date").isNull(), "asc"), (c("published_date"), way)],
        "size": [(c("file_size"), way)],
        "pages": [(c("page_count").isNull(), "asc"), (c("page_count"), way)],
        "scanned": [(c("last_scanned_at"), way)],
    }
    return [*keys.get(sort, keys["title"]), (c("id"), "asc")]


def ordering(parts: list[Part], reverse: bool = False) -> list[Column]:
    """ORDER BY columns; reversing turns direction and NULL place around."""
    up = "desc" if reverse else "asc"
    return [
        key.asc_nulls_first() if way == up else key.desc_nulls_last() for key, way in parts
    ]


def _beyond(parts: list[Part], anchor: list[Column], after: bool) -> Column:
    """Rows strictly after (or before) the anchor in list order, NULLs included."""
    options = []
    for i, (key, way) in enumerate(parts):
        same = [k.eqNullSafe(a) for (k, _), a in zip(parts[:i], anchor)]
        at = anchor[i]
        if (way == "asc") == after:
            further = (key > at) | (at.isNull() & key.isNotNull())
        else:
            further = (key < at) | (key.isNull() & at.isNotNull())
        options.append(all_of([*same, F.coalesce(further, F.lit(False))]))
    return any_of(options)


def _anchor(books: DataFrame, book_id: int, parts: list[Part]) -> Column:
    """The sort key of one visible book as a scalar sub-query, NULL when there is none."""
    named = F.struct(*[key.alias(f"k{i}") for i, (key, _) in enumerate(parts)])
    one = books.where((F.col("id") == book_id) & ~F.col("is_missing"))
    return one.agg(F.max(named).alias("anchor")).scalar()


def _on_side(books: DataFrame, view: DataFrame, book_id: int, parts: list[Part], after: bool) -> DataFrame:
    anchor = _anchor(books, book_id, parts)
    values = [anchor.getField(f"k{i}") for i in range(len(parts))]
    return view.where(anchor.isNotNull() & _beyond(parts, values, after))


def list_view(books: DataFrame) -> DataFrame:
    return books.select(*LIST_COLUMNS)


def page_offset(view: DataFrame, sort: str, sort_dir: str, page: int, page_size: int) -> DataFrame:
    """Page N by position."""
    rows = view.orderBy(*ordering(sort_keys(sort, sort_dir)))
    return rows.offset((page - 1) * page_size).limit(page_size) if page > 1 else rows.limit(page_size)


def page_after(
    books: DataFrame, view: DataFrame, book_id: int, sort: str, sort_dir: str, page_size: int
) -> DataFrame:
    """The rows that follow a book, without counting past the ones before it."""
    parts = sort_keys(sort, sort_dir)
    return _on_side(books, view, book_id, parts, True).orderBy(*ordering(parts)).limit(page_size)


def page_before(
    books: DataFrame, view: DataFrame, book_id: int, sort: str, sort_dir: str, page_size: int
) -> DataFrame:
    """The rows just before a book, in list order."""
    parts = sort_keys(sort, sort_dir)
    nearest = _on_side(books, view, book_id, parts, False)
    return (
        nearest.orderBy(*ordering(parts, reverse=True)).limit(page_size).orderBy(*ordering(parts))
    )


# ---- order statistics of a stored listing ---------------------------------------------------

# Rows between two marks: what a page far down sorts and skips at most.
MARK_STEP = 4096


def order_marks(view: DataFrame, sort: str, sort_dir: str = "", step: int = MARK_STEP) -> DataFrame:
    """(position, k0, ..., id): every ``step``-th row of a listing in its order, the first one included.

    The listing is range-partitioned by its order and the id, written once, and numbered by the sizes of
    the ranges before a row's; only one row per range is exchanged.
    """
    keys = sort_keys(sort, sort_dir)[:-1]
    names = [f"k{i}" for i in range(len(keys))]
    named = view.select(*[key.alias(name) for name, (key, _) in zip(names, keys)], "id")
    order = ordering([*((F.col(name), way) for name, (_, way) in zip(names, keys)), (F.col("id"), "asc")])
    rows = cut_lineage(
        named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    position = (F.col("_at") - F.col("_first") + F.col("_shift") + 1).alias("position")
    # one row per range
    return rows.join(F.broadcast(shifts), "_part").select(position, *names, "id").where((F.col("position") - 1) % step == 0)


def page_by_marks(view: DataFrame, marks: DataFrame, sort: str, sort_dir: str, page: int, page_size: int) -> DataFrame:
    """Page N of the whole listing that ``marks`` describes: only rows between the two marks around it are sorted.

    The bounds on the first key reach the scan; fewer rows are skipped than lie between two marks.
    """
    title = F.col(TITLE_KEY) if TITLE_KEY in view.columns else None
    parts = sort_keys(sort, sort_dir, title)
    start = (page - 1) * page_size
    mark, at = F.struct(*marks.columns), F.col("position")
    near = marks.agg(
        F.max_by(mark, F.when(at <= start + 1, at)).alias("below"), F.min_by(mark, F.when(at > start + page_size, at)).alias("beyond")
    ).first()
    if near.below is None:
        return view.limit(0)

    def literals(mark: Row) -> list[Column]:
        return [F.lit(mark[f"k{i}"]) for i in range(len(parts) - 1)] + [F.lit(mark.id)]

    (first, way), lowest = parts[0], literals(near.below)
    is_lowest = all_of([key.eqNullSafe(value) for (key, _), value in zip(parts, lowest)])
    rows = view.where(is_lowest | _beyond(parts, lowest, True)).where(_within(first, way, near.below.k0, after=True))
    if near.beyond is not None:
        rows = rows.where(_beyond(parts, literals(near.beyond), False)).where(_within(first, way, near.beyond.k0, after=False))
    return rows.orderBy(*ordering(parts)).offset(start + 1 - near.below.position).limit(page_size)


def _within(key: Column, way: str, bound, after: bool) -> Column:
    """What a mark says of the first key alone, in a form that a scan takes; NULLs are least."""
    if bound is None:
        return key.isNull() if (way == "asc") != after else F.lit(True)
    if (way == "asc") == after:
        return key >= bound
    return (key <= bound) | key.isNull()


def random_page(view: DataFrame, page_size: int, seed: int | None = None) -> DataFrame:
    return view.orderBy(F.rand(seed)).limit(page_size)


def with_position(page: DataFrame, sort: str, sort_dir: str) -> DataFrame:
    """Numbers the rows of ONE page (never more rows than the largest page size)."""
    return page.withColumn(
        "position",
        F.row_number().over(Window.orderBy(*ordering(sort_keys(sort, sort_dir)))).cast("bigint"),
    )


@dataclass(frozen=True)
class Shelf:
    """What a stored snapshot offers besides its rows: the indexes, and the marks of an order if it has them."""

    indexes: Indexes
    marks: Callable[[str, str], DataFrame | None]


def browse_rows(
    books: DataFrame,
    ctx: BrowseContext,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
    after_id: int | None = None,
    before_id: int | None = None,
    seed: int | None = None,
    shelf: Shelf | None = None,
) -> tuple[DataFrame, str]:
    """The page a request asks for, and how it was found: after, before, marks, offset or random.

    ``after_id`` wins over ``before_id``; an anchor outside the view falls back to the page
    number. Whether an anchor is inside is one point lookup. What ``shelf`` stores of the same snapshot
    answers words, authors, ids, and page numbers of the whole listing.
    """
    ctx = ctx.normalized()
    indexes = shelf.indexes if shelf else None
    view = search.browse_filter(books, ctx, favorites, user_id, indexes)
    if ctx.sort == "random":
        return random_page(view, ctx.page_size, seed), "random"

    def usable(anchor: int | None) -> bool:
        if anchor is None:
            return False
        return not search.book_in_view(books, anchor, ctx, favorites, user_id, indexes).isEmpty()

    def one(anchor: int) -> DataFrame:
        return books if indexes is None else indexes.rows_of([anchor])

    how = (ctx.sort, ctx.sort_dir, ctx.page_size)
    if usable(after_id):
        return page_after(one(after_id), view, after_id, *how), "after"
    if usable(before_id):
        return page_before(one(before_id), view, before_id, *how), "before"
    marks = shelf.marks(ctx.sort, ctx.sort_dir) if shelf and not ctx.is_filtered else None
    if marks is not None:
        return page_by_marks(view, marks, ctx.sort, ctx.sort_dir, ctx.page, ctx.page_size), "marks"
    return page_offset(view, ctx.sort, ctx.sort_dir, ctx.page, ctx.page_size), "offset"


def browse(
    books: DataFrame,
    ctx: BrowseContext,
    stats: DataFrame,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
    after_id: int | None = None,
    before_id: int | None = None,
    seed: int | None = None,
    exact_count: bool = False,
    shelf: Shelf | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A page and its one-row summary: filtered_count, library_total, page, count_exact, languages.

    The count of a filtered listing is exact only when the page is not full, because counting
    would read the whole listing; ``exact_count`` asks for it all the same. The page is made once: its
    rows (at most the largest page size) are written, and the summary counts what was written.
    """
    ctx = ctx.normalized()
    page_rows, _ = browse_rows(books, ctx, favorites, user_id, after_id, before_id, seed, shelf)
    page_rows = cut_lineage(list_view(page_rows))
    size, start = F.lit(ctx.page_size), F.lit((ctx.page - 1) * ctx.page_size)
    shown = page_rows.agg(F.count(F.lit(1)).alias("_shown"))
    total = F.col("library_total")
    words_used = bool(search.asked_terms(ctx))
    if not ctx.is_filtered:
        count, exact = total, F.lit(True)
    elif ctx.sort == "random" and words_used and not exact_count:
        count, exact = size.cast("bigint"), F.lit(False)
    elif ctx.sort == "random" or exact_count:
        counted = search.browse_filter(books, ctx, favorites, user_id, shelf.indexes if shelf else None)
        count, exact = counted.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(True)
    else:
        count, exact = start + F.col("_shown"), F.col("_shown") < size
    last = F.greatest(F.lit(1), F.ceil(count / size))
    clamped = F.lit(ctx.page) if ctx.sort == "random" else F.when(
        exact, F.least(F.lit(ctx.page), last)
    ).otherwise(F.lit(ctx.page))
    # both sides are single rows by construction
    summary = stats.select(
        shown.select("_shown").scalar().alias("_shown"), "library_total", "languages"
    ).select(
        count.cast("bigint").alias("filtered_count"),
        total.alias("library_total"),
        clamped.cast("bigint").alias("page"),
        exact.alias("count_exact"),
        "languages",
    )
    return page_rows, summary


def neighbors(
    books: DataFrame,
    book_id: int,
    ctx: BrowseContext,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
    shelf: Shelf | None = None,
) -> DataFrame:
    """One row (prev_id, next_id) of a book in the filtered, sorted listing.

    NULLs for a random order and for a book outside the listing.
    """
    ctx = ctx.normalized()
    nobody = F.lit(None).cast("bigint")
    if ctx.sort == "random":
        return books.sparkSession.range(1).select(nobody.alias("prev_id"), nobody.alias("next_id"))
    parts = sort_keys(ctx.sort, ctx.sort_dir)
    indexes = shelf.indexes if shelf else None
    view = search.browse_filter(books, ctx, favorites, user_id, indexes)
    one = books if indexes is None else indexes.rows_of([book_id])
    inside = search.book_in_view(books, book_id, ctx, favorites, user_id, indexes).agg(
        (F.count(F.lit(1)) > 0).alias("_inside")
    )

    def nearest(after: bool, side: str) -> DataFrame:
        rows = _on_side(one, view, book_id, parts, after).orderBy(
            *ordering(parts, reverse=not after)
        )
        return rows.limit(1).select(F.lit(side).alias("side"), "id")

    # at most two rows meet here
    both = nearest(False, "prev").unionByName(nearest(True, "next"))
    found = inside.scalar()
    return both.agg(
        F.max(F.when(F.col("side") == "prev", F.col("id"))).alias("_prev"),
        F.max(F.when(F.col("side") == "next", F.col("id"))).alias("_next"),
    ).select(
        F.when(found, F.col("_prev")).alias("prev_id"),
        F.when(found, F.col("_next")).alias("next_id"),
    )


def positions(view: DataFrame, sort: str, sort_dir: str = "", partitions: int | None = None) -> DataFrame:
    """Every book of the listing with its position and both neighbours.

    The listing is range-partitioned by its order (the id makes every key unique, so equal sort
    keys split too) and written once; each range is numbered on its own. Only one row per range
    is exchanged to shift the numbers and to join the ends of adjacent ranges.
    """
    keys = sort_keys(sort, sort_dir)[:-1]
    named = view.select(*[key.alias(f"k{i}") for i, (key, _) in enumerate(keys)], "id")
    parts = [(F.col(f"k{i}"), way) for i, (_, way) in enumerate(keys)]
    order = ordering([*parts, (F.col("id"), "asc")])
    spread = named.repartitionByRange(partitions, *order) if partitions else named.repartitionByRange(*order)
    ranges = cut_lineage(
        spread.sortWithinPartitions(*order).select(
            "id",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("seq"),
        )
    )
    # one row per range
    ends = ranges.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("id", "seq").alias("first_id"),
        F.max_by("id", "seq").alias("last_id"),
    )
    along = Window.orderBy("part")
    edges = ends.select(
        "part",
        F.coalesce(
            F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("shift"),
        F.lag("last_id").over(along).alias("id_before"),
        F.lead("first_id").over(along).alias("id_behind"),
    )
    inside = Window.partitionBy("part").orderBy("seq")
    return (
        ranges.withColumns(
            {
                "_rank": F.row_number().over(inside),
                "_prev": F.lag("id").over(inside),
                "_next": F.lead("id").over(inside),
            }
        )
        .join(F.broadcast(edges), "part")
        .select(
            "id",
            (F.col("_rank") + F.col("shift")).cast("bigint").alias("position"),
            F.coalesce("_prev", "id_before").alias("prev_id"),
            F.coalesce("_next", "id_behind").alias("next_id"),
        )
    )
