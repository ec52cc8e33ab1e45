"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.metadata import languages_from_json, languages_to_json
from shelfmark.functions.text import fold_nocase
from shelfmark.operators.search import BrowseContext, books_with_author_words, browse_filter, visible


def filtered_count(
    books: DataFrame,
    ctx: BrowseContext,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
) -> DataFrame:
    found = browse_filter(books, ctx, favorites, user_id)
    return found.agg(F.count(F.lit(1)).alias("filtered_count"))


def distinct_languages(books: DataFrame) -> DataFrame:
    named = visible(books).where(F.trim("language") != "")
    return named.select("language").distinct()


def language_counts(books: DataFrame) -> DataFrame:
    """(language, n) of the visible books."""
    return visible(books).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """One row: total and language list, from counts (language, n) of any parts of the books.

    The list is in ASCII case-insensitive order. Counts are added up per language first, so that
    the final row only gathers distinct languages.
    """
    per_language = counts.groupBy("language").agg(F.sum("n").alias("n"))
    named = F.when(F.trim("language") != "", F.struct(fold_nocase(F.col("language")).alias("key"), "language"))
    return per_language.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("library_total"),
        F.sort_array(F.collect_list(named)).alias("sorted"),
    ).select("library_total", F.col("sorted.language").alias("languages"))


def library_stats(books: DataFrame) -> DataFrame:
    """One row: visible total and language list."""
    return stats_of_counts(language_counts(books))


def stats_snapshot(books: DataFrame) -> DataFrame:
    """The statistics as they are stored: the language list as JSON text."""
    return library_stats(books).select(
        F.lit(1).alias("id"),
        "library_total",
        languages_to_json(F.col("languages")).alias("languages"),
        F.current_timestamp().alias("refreshed_at"),
    )


def read_stats(snapshot: DataFrame, books: DataFrame) -> DataFrame:
    """Stored statistics; what is absent or no JSON list is computed from the catalogue.

    The one stored row is looked at first, so that a good one costs no scan of the catalogue.
    Both inputs have at most one row, so they are gathered, not joined.
    """
    stored = snapshot.where(F.col("id") == 1).select(
        F.lit(1).alias("rank"), "library_total", languages_from_json(F.col("languages")).alias("languages")
    )
    if not stored.where("library_total is not null and languages is not null").isEmpty():
        return stored.select("library_total", "languages")
    computed = library_stats(books).select(F.lit(2).alias("rank"), "library_total", "languages")
    both = stored.unionByName(computed)
    return both.agg(
        F.min_by("library_total", "rank").alias("library_total"),
        F.min_by("languages", F.when(F.col("languages").isNotNull(), F.col("rank"))).alias("languages"),
    )


def favorites_per_user(favorites: DataFrame) -> DataFrame:
    return favorites.groupBy("user_id").agg(F.count("book_id").alias("favorite_count"))


def list_users(users: DataFrame, favorites: DataFrame) -> DataFrame:
    """All users with their number of favourites, counted before the join."""
    counts = favorites_per_user(favorites).withColumnRenamed("user_id", "id")
    return users.join(counts, "id", "left").select(
        "id", "username", "created_at", F.coalesce("favorite_count", F.lit(0)).cast("bigint").alias("favorite_count")
    )


def purged_favorites(favorites: DataFrame, purged: DataFrame) -> DataFrame:
    """Favourites lost per purged book (``purged``: unique ids), counted before the join."""
    counts = favorites.groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return purged.select("id").join(counts, "id", "left").select(
        F.col("id").alias("book_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("favorites_lost")
    )


def token_prefix_count(index: DataFrame, text: str) -> DataFrame:
    return books_with_author_words(index, text).agg(F.count(F.lit(1)).alias("books"))


def _tally(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(test).cast("bigint").alias(name) for name, test in conditions.items()]


def scan_summary(classified: DataFrame, marked_missing: DataFrame | None = None) -> DataFrame:
    """Counters of a scan over its (path, status, delete_path) rows."""
    status = F.col("status")
    row = classified.agg(
        F.count(F.lit(1)).alias("scanned"),
        *_tally(
            {
                "added_or_updated": status.isin("to_index", "repointed"),
                "skipped": status == "duplicate",
                "unchanged": status == "unchanged",
                "conflicts": status == "conflict",
                "invalid_epubs": status == "invalid",
                "errors": status == "error",
                "files_deleted": F.col("delete_path").isNotNull(),
            }
        ),
    )
    if marked_missing is None:
        return row
    gone = marked_missing.agg(F.count(F.lit(1)).alias("n")).scalar()
    return row.withColumn("marked_missing", gone)


def upgrade_summary(books: DataFrame, queue: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Counters of a package upgrade; without results every candidate counts as converted."""
    old = ~F.col("is_missing") & (F.lower("format") == "epub") & F.col("epub_version2")
    skipped = books.agg(F.count_if(old)).scalar()
    candidates = queue.agg(F.count(F.lit(1)).alias("candidates"))
    if results is None:
        done, gone = F.col("candidates"), F.lit(0).cast("bigint")
    else:
        done = results.agg(F.count_if(F.col("ok"))).scalar()
        gone = results.agg(F.count_if(~F.col("ok"))).scalar()
    return candidates.select(
        "candidates",
        done.alias("converted"),
        gone.alias("removed"),
        skipped.alias("skipped_converted"),
    )
