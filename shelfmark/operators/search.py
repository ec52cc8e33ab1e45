"""Search and filter predicates over the catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import text as tx
from shelfmark.operators.postings import Term, books_with_terms, match_terms, phrases, search_name
from shelfmark.operators.skew import all_of, any_of
from shelfmark.schema import SEARCH_COLUMNS
from shelfmark.session import cut_lineage

# Page sizes on offer, sort keys and the direction each starts with.
PAGE_SIZES = (10, 25, 50, 100, 200)
DEFAULT_PAGE_SIZE = 100
DEFAULT_DIRECTION = {
    "title": "asc",
    "author": "asc",
    "published": "desc",
    "size": "desc",
    "pages": "desc",
    "scanned": "desc",
}
# The columns each search box looks at.
TITLE_COLUMNS = ("title", "sort_title", "file_name")
PUBLISHER_COLUMNS = ("publisher",)
GENRE_COLUMNS = ("tags",)


@dataclass(frozen=True)
class BrowseContext:
    """What a visitor typed, chose and where they are."""

    title: str = ""
    author: str = ""
    publisher: str = ""
    genre: str = ""
    language: str = ""
    sort: str = "title"
    sort_dir: str = ""
    page: int | str = 1
    page_size: int | str = ""
    favorites_only: bool = False

    def normalized(self) -> BrowseContext:
        sort = self.sort or "title"
        page = str(self.page).strip()
        size = str(self.page_size).strip()
        size = int(size) if size.isdecimal() else DEFAULT_PAGE_SIZE
        return replace(
            self,
            sort=sort,
            sort_dir=direction(sort, self.sort_dir),
            page=max(1, int(page)) if page.isdecimal() else 1,
            page_size=size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE,
        )

    @property
    def is_filtered(self) -> bool:
        typed = (self.title, self.author, self.publisher, self.genre)
        return any(t.strip() for t in typed) or bool(self.language) or self.favorites_only


def direction(sort: str, asked: str) -> str:
    if sort == "random":
        return "asc"
    return asked if asked in ("asc", "desc") else DEFAULT_DIRECTION.get(sort, "asc")


# --- derived search columns ------------------------------------------------------------------


def with_search_columns(books: DataFrame) -> DataFrame:
    """The catalogue with one word string per searchable column and the author words."""
    return books.withColumns(
        {
            **{search_name(c): tx.token_string(F.col(c)) for c in SEARCH_COLUMNS},
            "author_words": tx.author_tokens(F.col("authors")),
        }
    )


def _author_words(books: DataFrame) -> Column:
    if "author_words" in books.columns:
        return F.col("author_words")
    return tx.author_tokens(F.col("authors"))


# --- predicates ------------------------------------------------------------------------------


def visible(books: DataFrame) -> DataFrame:
    return books.where(~F.col("is_missing"))


def match_words(books: DataFrame, columns: tuple[str, ...], text: str) -> Column | None:
    """Every word of ``text`` begins a word of some column; None when the text asks for nothing."""
    terms = [Term(columns, phrase) for phrase in phrases(text)]
    return match_terms(books, terms) if terms else None


def match_author(books: DataFrame, text: str) -> Column:
    """Every author word of ``text`` begins one of the book's author words."""
    words = _author_words(books)

    def begins(prefix: str) -> Column:
        return F.exists(words, lambda w: w.startswith(prefix))

    return all_of([begins(p) for word in text.split() for p in tx.query_author_tokens(word)])


def match_substring(columns: tuple[str, ...], text: str) -> Column:
    """Every word of ``text`` occurs in some column, ASCII case ignored; ``%`` and ``_`` are live."""

    def like(column: str, word: str) -> Column:
        pattern = "%" + word.replace("\\", "\\\\") + "%"
        folded = "".join(ch.lower() if ch.isascii() else ch for ch in pattern)
        return F.coalesce(tx.fold_nocase(F.col(column)).like(folded), F.lit(False))

    return all_of([any_of([like(c, w) for c in columns]) for w in text.split()])


def books_with_author_words(index: DataFrame, text: str) -> DataFrame:
    """Ids of books that have, for every author word of ``text``, a token it begins.

    One pass over the (book_id, token) index; on a token-sorted index only the matching ranges
    are read. The rows are reduced to one per book before they are exchanged.
    """
    prefixes = list(dict.fromkeys(p for w in text.split() for p in tx.query_author_tokens(w)))
    hits = index.where(any_of([F.col("token").startswith(p) for p in prefixes]))
    seen = [F.bool_or(F.col("token").startswith(p)).alias(f"_p{i}") for i, p in enumerate(prefixes)]
    if not prefixes:
        return index.select("book_id").distinct()
    return (
        hits.groupBy("book_id")
        .agg(*seen)
        .where(all_of([F.col(f"_p{i}") for i in range(len(prefixes))]))
        .select("book_id")
    )


def only_favorites(books: DataFrame, favorites: DataFrame, user_id: int) -> DataFrame:
    own = favorites.where(F.col("user_id") == user_id).select(F.col("book_id").alias("id"))
    return books.join(own, "id", "left_semi")


def _boxes(ctx: BrowseContext) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return ((ctx.title, TITLE_COLUMNS), (ctx.publisher, PUBLISHER_COLUMNS), (ctx.genre, GENRE_COLUMNS))


def asked_terms(ctx: BrowseContext) -> list[Term]:
    """What the title, publisher and genre boxes ask of the words."""
    return [Term(columns, phrase) for text, columns in _boxes(ctx) for phrase in phrases(text)]


def value_condition(ctx: BrowseContext) -> Column:
    """The filters no index answers: visible rows, the language, and substrings where no box has a word."""
    tests = [~F.col("is_missing")]
    if not asked_terms(ctx):
        # nothing to look up by word: fall back to substrings
        tests += [match_substring(columns, text) for text, columns in _boxes(ctx) if text.strip()]
    if ctx.language:
        tests.append(F.col("language") == ctx.language)
    return all_of(tests)


def filter_condition(books: DataFrame, ctx: BrowseContext) -> Column:
    """All text and value filters of a request as one predicate."""
    tests = [value_condition(ctx), match_terms(books, asked_terms(ctx))]
    if ctx.author.strip():
        tests.append(match_author(books, ctx.author))
    return all_of(tests)


# Ids a request takes to the driver and reads by key, at most; more are joined, by a broadcast up to the second bound.
KEPT_IDS = 2_000
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Indexes:
    """The index tables stored beside a snapshot, and its rows by id."""

    authors: DataFrame
    postings: DataFrame
    rows_of: Callable[[list[int]], DataFrame]

    def hits(self, ctx: BrowseContext) -> DataFrame | None:
        """(book_id) of what the text boxes ask for; None when they ask for nothing."""
        found = None
        if terms := asked_terms(ctx):
            found = books_with_terms(self.postings, terms)
        if any(tx.query_author_tokens(word) for word in ctx.author.split()):
            by_author = books_with_author_words(self.authors, ctx.author)
            found = by_author if found is None else found.join(by_author, "book_id", "left_semi")
        return found

    def candidates(self, books: DataFrame, hits: DataFrame) -> DataFrame:
        """The books of ``hits``: read by id if these are few, else by a join."""
        many = cut_lineage(hits.select(F.col("book_id").alias("id")))
        ids = [row.id for row in many.limit(KEPT_IDS + 1).collect()]
        if len(ids) <= KEPT_IDS:
            return self.rows_of(ids)
        return books.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "id", "left_semi")


def browse_filter(
    books: DataFrame,
    ctx: BrowseContext,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
    indexes: Indexes | None = None,
) -> DataFrame:
    """The visible books a request asks for.

    With ``indexes`` (of the same snapshot as ``books``) words and authors are looked up there: what they
    yield is narrowed to a user's favourites and only then read by id.
    """
    own = None
    if ctx.favorites_only and user_id is not None and favorites is not None:
        own = favorites.where(F.col("user_id") == user_id).select("book_id")
    if indexes is None:
        found = books.where(filter_condition(books, ctx))
        return found if own is None else only_favorites(found, favorites, user_id)
    hits = indexes.hits(ctx)
    if own is not None:
        hits = own.distinct() if hits is None else hits.join(own, "book_id", "left_semi")
    rows = books if hits is None else indexes.candidates(books, hits)
    return rows.where(value_condition(ctx))


def book_in_view(
    books: DataFrame,
    book_id: int,
    ctx: BrowseContext,
    favorites: DataFrame | None = None,
    user_id: int | None = None,
    indexes: Indexes | None = None,
) -> DataFrame:
    """One row when the book passes the filter, none otherwise; the row holds all that is asked, so no word index is read."""
    one = books.where(F.col("id") == book_id) if indexes is None else indexes.rows_of([book_id])
    return browse_filter(one, ctx, favorites, user_id).select("id").limit(1)


# --- index tables ----------------------------------------------------------------------------


def author_index(books: DataFrame) -> DataFrame:
    """The inverted author index: one row per book and author word."""
    return books.select(
        F.col("id").alias("book_id"), F.explode(_author_words(books)).alias("token")
    )


def sync_author_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after the authors of the ``changed`` books were replaced."""
    kept = index.join(changed.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return kept.unionByName(author_index(changed))


def join_hits(books: DataFrame, hits: DataFrame) -> DataFrame:
    """Books joined with the ids (book_id) a word index yields."""
    return books.join(hits.select(F.col("book_id").alias("id")), "id")
