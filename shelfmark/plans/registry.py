"""All queries by name, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import display, files as fn, metadata as md, text as tx
from shelfmark.operators import browse, merge, quality, reconcile, search, stats
from shelfmark.operators.postings import Term, books_with_terms, build_postings, phrases
from shelfmark.operators.search import BrowseContext
from shelfmark.plans import jobs
from shelfmark.plans.bindings import NOW, ROOTS, Library
from shelfmark.plans.oracle import LIB, ORDERS, author_words, base, clean_list, fold, key, sql, words
from shelfmark.schema import LIST_COLUMNS
from shelfmark.session import cut_lineage, shared_folder
from shelfmark.sources import catalog, files as fs, images, packages, shelves
from shelfmark.sources.shelves import Shelves
from shelfmark.streaming.arrivals import merge_arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
LISTED = ", ".join(LIST_COLUMNS)
USER = 7


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[Library], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Library(spark, folder))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return build

    return add


def _long(name: str):
    return c(name).cast("bigint").alias(name)


# --- sources and sinks -----------------------------------------------------------------------


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_TABLE_ROWS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS table_rows FROM {t}" for t in _TABLES)


def _rows_of_files(lib, found: DataFrame) -> DataFrame:
    """(name, table_rows) of listed table files, their rows counted by the file they come from."""
    paths = [lib.table(t).select(fs.plain_path(c("_metadata.file_path")).alias("path")) for t in _TABLES]
    rows = paths[0]
    for more in paths[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("table_rows"))
    return found.join(counts, "path", "left").select(fn.base_name(c("path")).alias("name"), F.coalesce("table_rows", F.lit(0)).alias("table_rows"))


@query("inventory_scan", f"SELECT name, table_rows, NULL AS error FROM ({_TABLE_ROWS}) UNION ALL SELECT 'absent', NULL, 'path not found'")
def _(lib):
    found, errors = fs.inventory(lib.spark, [lib.folder, lib.folder + "/absent"], (".parquet",))
    return _rows_of_files(lib, found).withColumn("error", F.lit(None).cast("string")).unionByName(
        errors.select(fn.base_name(c("path")).alias("name"), F.lit(None).cast("bigint").alias("table_rows"), c("detail").alias("error"))
    )


@query("content_hash", "SELECT path, content_hash FROM inventory")
def _(lib):
    return fs.with_content_hash(lib.inventory).select("path", "content_hash")


@query("catalog_read", "SELECT id, file_path, file_name, content_hash, is_missing FROM books")
def _(lib):
    return catalog.load_catalog(lib.books)


@query("book_lookup", f"SELECT {LISTED}, description FROM books WHERE id = 34")
def _(lib):
    return catalog.get_book(lib.snapshot.rows_of([34]), 34, include_missing=True).select(*LIST_COLUMNS, "description")


@query("cover_inventory", "SELECT path, book_id FROM cover_ids")
def _(lib):
    return fs.with_cover_ids(lib.covers)


@query(
    "catalog_write",
    f"""SELECT {LISTED}, {words('title')} AS tok_title, array_to_string(list_sort(list_distinct({author_words('authors')})), ' ') AS author_list
        FROM books""",
)
def _(lib):
    root = f"{shared_folder(lib.spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    catalog.write_catalog(lib.books, root, 1)
    stored, _ = catalog.read_catalog(lib.spark, root)
    return stored.select(
        *LIST_COLUMNS, "tok_title", F.array_join(F.array_sort("author_words"), " ").alias("author_list")
    )


@query(
    "constraint_report",
    """SELECT 'format' AS rule, id::VARCHAR AS key, 1::BIGINT AS n FROM books WHERE format NOT IN ('epub', 'mobi', 'azw3', 'pdf')
       UNION ALL SELECT 'file_size', id::VARCHAR, 1 FROM books WHERE file_size < 0
       UNION ALL SELECT 'page_count', id::VARCHAR, 1 FROM books WHERE page_count < 0
       UNION ALL SELECT 'unique_file_path', file_path, count(*) FROM books GROUP BY file_path HAVING count(*) > 1
       UNION ALL SELECT 'unique_content_hash', content_hash, count(*) FROM books WHERE content_hash IS NOT NULL
         GROUP BY content_hash HAVING count(*) > 1""",
)
def _(lib):
    return quality.constraint_violations(lib.books)


@query("list_projection", f"SELECT {LISTED} FROM books")
def _(lib):
    return browse.list_view(lib.books)


# --- filters ---------------------------------------------------------------------------------


@query("visible_books", f"SELECT {LISTED} FROM books WHERE NOT is_missing")
def _(lib):
    return browse.list_view(search.visible(lib.books))


def _found(lib, **ctx):
    return search.browse_filter(lib.books, BrowseContext(**ctx)).select("id", "title", "publisher", "tags", "authors")


def _found_stored(lib, favorites=None, **ctx):
    """The same over a written snapshot, through its indexes."""
    shelf = lib.snapshot.shelf
    found = search.browse_filter(lib.snapshot.books, BrowseContext(**ctx), favorites, USER, shelf.indexes)
    return found.select("id", "title", "publisher", "tags", "authors")


def _found_sql(*tests: str) -> str:
    return "SELECT id, title, publisher, tags, authors FROM books WHERE NOT is_missing AND " + " AND ".join(tests)


def _any_word(columns: tuple[str, ...], needle: str) -> str:
    return "(" + " OR ".join(f"contains({words(col)}, ' {needle}')" for col in columns) + ")"


TITLES = ("title", "sort_title", "file_name")


@query("fts_title_search", _found_sql(_any_word(TITLES, "th"), _any_word(TITLES, "e"), _any_word(TITLES, "wor")))
def _(lib):
    return _found_stored(lib, title='Th É* "wor')


@query(
    "fts_multi_field",
    _found_sql(_any_word(TITLES, "le"), _any_word(("publisher",), "editions"), _any_word(("tags",), "fr prose")),
)
def _(lib):
    return _found_stored(lib, title="le", publisher="éditions", genre="fr.Prose")


def _author_sql(*prefixes: str) -> str:
    tests = " AND ".join(
        f"id IN (SELECT book_id FROM author_index WHERE starts_with(token, '{p}'))" for p in prefixes
    )
    return _found_sql(tests)


@query("author_prefix_search", _author_sql("th", "an"))
def _(lib):
    return _found_stored(lib, author="Án'TH")


@query("fts_author_search", _found_sql(_any_word(("authors",), "the"), _any_word(("authors",), "a")))
def _(lib):
    terms = [Term(("authors",), phrase) for phrase in phrases("the a")]
    found = lib.snapshot.shelf.indexes.candidates(lib.snapshot.books, books_with_terms(lib.snapshot.postings, terms))
    return search.visible(found).select("id", "title", "publisher", "tags", "authors")


@query(
    "like_fallback_search",
    _found_sql(
        "(" + " OR ".join(f"{fold(col)} LIKE '%the_e%'" for col in TITLES) + ")",
        "(" + " OR ".join(f"{fold(col)} LIKE '%é%n%'" for col in TITLES) + ")",
    ).replace("'%the_e%'", "'%t_e%'"),
)
def _(lib):
    books = search.visible(lib.books)
    return books.where(search.match_substring(TITLES, "T_E é%N")).select("id", "title", "publisher", "tags", "authors")


@query("language_filter", _found_sql("language = 'fr'"))
def _(lib):
    return _found(lib, language="fr")


@query("favorites_only", _found_sql(f"id IN (SELECT book_id FROM favorites WHERE user_id = {USER})"))
def _(lib):
    ctx = BrowseContext(favorites_only=True)
    return search.browse_filter(lib.books, ctx, lib.favorites, USER).select("id", "title", "publisher", "tags", "authors")


@query(
    "combined_filter",
    _found_sql(
        _any_word(TITLES, "e"), _any_word(("publisher",), "src"), _any_word(("tags",), "prose"),
        "id IN (SELECT book_id FROM author_index WHERE starts_with(token, 'e'))",
        "language = 'fr'",
        "id IN (SELECT book_id FROM favorites)",
    ),
)
def _(lib):
    # favourites of anyone: the pairs are reduced to one user before the filter
    anyone = lib.favorites.select(F.lit(USER).alias("user_id"), "book_id").distinct()
    return _found_stored(
        lib, anyone, title="e", publisher="src", genre="prose", author="É", language="fr", favorites_only=True
    )


@query(
    "book_in_view",
    f"""SELECT id FROM books WHERE id = (SELECT min(id) FROM books WHERE NOT is_missing AND language = 'fr')
        AND NOT is_missing AND language = 'fr' AND {_any_word(('tags',), 'prose')}""",
)
def _(lib):
    first = lib.books.where(~c("is_missing") & (c("language") == "fr")).agg(F.min("id")).first()[0]
    ctx = BrowseContext(language="fr", genre="prose")
    # an id no book has, when none is French
    return search.book_in_view(lib.snapshot.books, -1 if first is None else first, ctx, indexes=lib.snapshot.shelf.indexes)


@query("under_roots", f"SELECT id, file_path FROM books WHERE {LIB}")
def _(lib):
    return lib.books.where(fn.under_roots(c("file_path"), ROOTS)).select("id", "file_path")


_QUEUE = """
    SELECT i.path, b.id AS book_id FROM inventory i
    LEFT JOIN (SELECT * FROM books WHERE NOT is_missing) b ON b.file_path = i.path
    WHERE (i.path = '/lib' OR starts_with(i.path, '/lib/')) AND NOT coalesce(b.{flag}, false)"""


@query("validation_queue", _QUEUE.format(flag="epub_validated"))
def _(lib):
    return reconcile.validation_queue(lib.books, lib.files, ROOTS).select("path", "book_id")


@query("validation_queue_deep", _QUEUE.format(flag="epub_deep_validated"))
def _(lib):
    return reconcile.validation_queue(lib.books, lib.files, ROOTS, deep=True).select("path", "book_id")


@query("validation_skipped", "SELECT count(*) AS skipped FROM books WHERE NOT is_missing AND epub_validated")
def _(lib):
    return reconcile.validated_count(lib.books)


@query(
    "upgrade_queue",
    f"""SELECT id, file_path, file_name FROM books WHERE NOT is_missing AND lower(format) = 'epub' AND NOT epub_version2
        AND {LIB} AND file_path IN (SELECT path FROM inventory)""",
)
def _(lib):
    return reconcile.upgrade_queue(lib.books, lib.files, ROOTS)


# --- search index ----------------------------------------------------------------------------


@query(
    "author_tokens",
    f"SELECT id, array_to_string(list_sort(list_distinct({author_words('authors')})), ' ') AS tokens FROM books",
)
def _(lib):
    return lib.books.select(
        "id", F.array_join(F.array_sort(tx.author_tokens(c("authors"))), " ").alias("tokens")
    )


@query("author_index_build", "SELECT book_id, token FROM author_index")
def _(lib):
    return search.author_index(lib.books)


@query(
    "author_index_sync",
    f"""SELECT book_id, token FROM author_index WHERE book_id NOT IN (SELECT id FROM edits WHERE title IS NOT NULL)
        UNION ALL SELECT DISTINCT id, unnest({author_words('authors')}) FROM edits WHERE title IS NOT NULL""",
)
def _(lib):
    edited, rejected = merge.edit_metadata(lib.books, lib.edits)
    changed = edited.join(lib.edits.join(rejected, "id", "left_anti").select("id"), "id", "left_semi")
    return search.sync_author_index(search.author_index(lib.books), changed)


@query(
    "text_index_build",
    "SELECT id, "
    + ", ".join(
        f"{words(col)} AS tok_{col}"
        for col in ("title", "sort_title", "authors", "publisher", "description", "isbn", "file_name", "series", "tags")
    )
    + " FROM books",
)
def _(lib):
    indexed = search.with_search_columns(lib.spread_books)
    return indexed.select("id", *[n for n in indexed.columns if n.startswith("tok_")])


_INDEXED = ("title", "sort_title", "authors", "publisher", "description", "isbn", "file_name", "series", "tags")


@query(
    "postings_build",
    "SELECT token, field, book_id, array_to_string(list_sort(list(place)), ',') AS positions FROM ("
    + " UNION ALL ".join(
        f"SELECT id AS book_id, '{col}' AS field, unnest(string_split(trim({words(col)}), ' ')) AS token,"
        f" generate_subscripts(string_split(trim({words(col)}), ' '), 1) - 1 AS place FROM books"
        for col in _INDEXED
    )
    + ") WHERE token <> '' GROUP BY token, field, book_id",
)
def _(lib):
    return build_postings(lib.spread_books).withColumn("positions", F.array_join("positions", ","))


@query(
    "phrase_search",
    f"SELECT id, title FROM books WHERE contains({words('description')}, ' of the') AND NOT is_missing",
)
def _(lib):
    hits = books_with_terms(lib.snapshot.postings, [Term(("description",), ("of", "the"))])
    return search.visible(lib.snapshot.shelf.indexes.candidates(lib.snapshot.books, hits)).select("id", "title")


@query(
    "token_prefix_counts",
    """SELECT count(*) AS books FROM (SELECT book_id FROM author_index GROUP BY book_id
       HAVING bool_or(starts_with(token, 'th')) AND bool_or(starts_with(token, 'e')))""",
)
def _(lib):
    return stats.token_prefix_count(search.author_index(lib.books), "Th é")


# --- joins -----------------------------------------------------------------------------------


@query("search_join", f"SELECT {LISTED} FROM books WHERE {_any_word(('title',), 'the')}")
def _(lib):
    hits = books_with_terms(lib.snapshot.postings, [Term(("title",), phrase) for phrase in phrases("the")])
    return browse.list_view(search.join_hits(lib.books, hits))


@query(
    "semi_join_in",
    f"""SELECT id, title FROM books WHERE id IN (SELECT book_id FROM author_index WHERE starts_with(token, 'e'))
        AND id IN (SELECT book_id FROM favorites WHERE user_id = {USER})""",
)
def _(lib):
    hits = search.books_with_author_words(search.author_index(lib.books), "e").select(c("book_id").alias("id"))
    return search.only_favorites(lib.books.join(hits, "id", "left_semi"), lib.favorites, USER).select("id", "title")


@query(
    "users_with_favorites",
    """SELECT u.id, u.username, u.created_at, count(f.book_id) AS favorite_count
       FROM users u LEFT JOIN favorites f ON f.user_id = u.id GROUP BY u.id, u.username, u.created_at""",
)
def _(lib):
    return stats.list_users(lib.users, lib.favorites)


@query("unindexed_files", "SELECT path, file_size FROM unindexed")
def _(lib):
    return reconcile.unindexed_files(lib.files, lib.books).select("path", "file_size")


@query("absent_rows", "SELECT id, file_path FROM books WHERE file_path NOT IN (SELECT path FROM inventory)")
def _(lib):
    return reconcile.absent_rows(lib.books, lib.files).select("id", "file_path")


@query(
    "orphan_covers",
    "SELECT path FROM cover_ids WHERE book_id IS NULL OR book_id NOT IN (SELECT id FROM books)",
)
def _(lib):
    return reconcile.orphan_covers(fs.with_cover_ids(lib.covers), lib.books).select("path")


@query(
    "hash_lookup",
    "SELECT i.path, i.content_hash, c.canon_id, c.canon_path FROM inventory i LEFT JOIN canon c USING (content_hash)",
)
def _(lib):
    return reconcile.hash_lookup(lib.hashed, lib.books).select("path", "content_hash", "canon_id", "canon_path")


@query("path_to_id", "SELECT i.path, b.id AS book_id FROM inventory i LEFT JOIN books b ON b.file_path = i.path")
def _(lib):
    return reconcile.path_to_id(lib.files.select("path"), lib.books)


@query(
    "hash_conflicts",
    """SELECT f.id, f.content_hash, min(b.id) AS other_id
       FROM (SELECT b.id, i.content_hash FROM books b JOIN inventory i ON i.path = b.file_path) f
       JOIN books b ON b.content_hash = f.content_hash AND b.id <> f.id GROUP BY f.id, f.content_hash""",
)
def _(lib):
    paths = lib.books.select("id", c("file_path").alias("path"))
    fresh = lib.hashed.join(paths, "path").select("id", "content_hash")
    return reconcile.hash_conflicts(fresh, lib.books)


@query("out_of_root_rows", f"SELECT id, file_path FROM books WHERE NOT {LIB}")
def _(lib):
    return reconcile.out_of_root_rows(lib.books, ROOTS).select("id", "file_path")


@query("cascade_delete", "SELECT user_id, book_id FROM favorites WHERE book_id NOT IN (SELECT id FROM books WHERE is_missing)")
def _(lib):
    return reconcile.drop_children(lib.favorites, lib.books.where("is_missing").select("id"))


# --- aggregates ------------------------------------------------------------------------------


@query("filtered_count", f"SELECT count(*) AS filtered_count FROM books WHERE NOT is_missing AND {_any_word(TITLES, 'the')}")
def _(lib):
    return stats.filtered_count(lib.books, BrowseContext(title="the"))


_LANGUAGES = f"""(SELECT array_to_string(list(language ORDER BY {fold('language')}, language), ',')
    FROM (SELECT DISTINCT language FROM books WHERE NOT is_missing AND trim(language) <> ''))"""
_STATS = f"SELECT (SELECT count(*) FROM books WHERE NOT is_missing) AS library_total, {_LANGUAGES} AS languages"


@query("library_stats", _STATS)
def _(lib):
    return stats.library_stats(lib.books).select("library_total", F.array_join("languages", ",").alias("languages"))


@query(
    "distinct_languages",
    "SELECT DISTINCT language FROM books WHERE NOT is_missing AND trim(language) <> ''",
)
def _(lib):
    return stats.distinct_languages(lib.books)


@query("stats_cache_read", _STATS)
def _(lib):
    # the stored list is damaged, so it is computed again; the stored total is used
    damaged = stats.stats_snapshot(lib.books).withColumn("languages", F.lit("not json"))
    read = stats.read_stats(damaged, lib.books)
    return read.select("library_total", F.array_join("languages", ",").alias("languages"))


@query("favorites_per_user", "SELECT user_id, count(*) AS favorite_count FROM favorites GROUP BY user_id")
def _(lib):
    return stats.favorites_per_user(lib.favorites)


@query(
    "files_by_hash",
    "SELECT content_hash, path, count(*) OVER (PARTITION BY content_hash) AS copies FROM unindexed",
)
def _(lib):
    return reconcile.files_by_hash(fs.with_content_hash(reconcile.unindexed_files(lib.inventory, lib.books)))


@query("keeper_path", f"SELECT content_hash, arg_max(path, {key('path')}) AS keeper FROM inventory GROUP BY content_hash")
def _(lib):
    return reconcile.keeper_paths(lib.hashed)


@query(
    "scan_summary",
    f"""SELECT count(*) AS scanned, count(*) FILTER (status IN ('to_index', 'repointed')) AS added_or_updated,
        count(*) FILTER (status = 'duplicate') AS skipped, count(*) FILTER (status = 'unchanged') AS unchanged,
        count(*) FILTER (status = 'conflict') AS conflicts, 0::BIGINT AS invalid_epubs,
        count(*) FILTER (status = 'error') AS errors, count(delete_path) AS files_deleted,
        (SELECT count(*) FROM books WHERE NOT is_missing AND {LIB} AND file_path NOT IN (SELECT path FROM inventory)) AS marked_missing
        FROM classified""",
)
def _(lib):
    gone = merge.newly_missing(lib.books, lib.files, ROOTS)
    return stats.scan_summary(reconcile.classify(lib.inventory, lib.books), gone)


@query(
    "upgrade_summary",
    f"""SELECT (SELECT count(*) FROM books WHERE NOT is_missing AND lower(format) = 'epub' AND NOT epub_version2
          AND {LIB} AND file_path IN (SELECT path FROM inventory)) AS candidates,
        (SELECT count(*) FROM conversions WHERE ok) AS converted, (SELECT count(*) FROM conversions WHERE NOT ok) AS removed,
        (SELECT count(*) FROM books WHERE NOT is_missing AND lower(format) = 'epub' AND epub_version2) AS skipped_converted""",
)
def _(lib):
    return stats.upgrade_summary(lib.books, reconcile.upgrade_queue(lib.books, lib.files, ROOTS), lib.conversions)


@query(
    "purged_favorites",
    """SELECT b.id AS book_id, count(f.user_id) AS favorites_lost FROM books b LEFT JOIN favorites f ON f.book_id = b.id
       WHERE b.is_missing GROUP BY b.id""",
)
def _(lib):
    return stats.purged_favorites(lib.favorites, lib.books.where("is_missing"))


# --- neighbours and ranks --------------------------------------------------------------------

_MIDDLE = 40


@query(
    "neighbor_ids",
    f"""SELECT prev_id, next_id FROM (SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
        FROM books WHERE NOT is_missing AND {_any_word(('tags',), 'prose')} WINDOW w AS (ORDER BY {ORDERS['title']}))
        WHERE id = {_MIDDLE}""",
)
def _(lib):
    return browse.neighbors(lib.snapshot.books, _MIDDLE, BrowseContext(genre="prose"), shelf=lib.snapshot.shelf)


def _positions_sql(sort: str) -> str:
    return f"""SELECT id, row_number() OVER w AS position, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
        FROM books WHERE NOT is_missing WINDOW w AS (ORDER BY {ORDERS[sort]})"""


@query(
    "neighbor_all",
    _positions_sql("title").replace("NOT is_missing WINDOW", f"NOT is_missing AND {_any_word(TITLES, 'e')} WINDOW"),
)
def _(lib):
    return browse.positions(search.browse_filter(lib.books, BrowseContext(title="e")), "title")


def _sorted(sort: str):
    @query(f"sort_{sort}", _positions_sql(sort))
    def _(lib):
        return browse.positions(search.visible(lib.books), sort)


for _sort in ORDERS:
    _sorted(_sort)


@query("canonical_row", "SELECT content_hash, canon_id, canon_path FROM canon")
def _(lib):
    return reconcile.canonical_rows(lib.books)


@query(
    "unique_target_names",
    """SELECT id, dir, CASE WHEN n = 1 THEN wanted ELSE regexp_replace(wanted, '\\.epub$', '') || ' (' || n || ').epub' END AS final_name
       FROM (SELECT id, source AS dir, lang || '.epub' AS wanted,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) + (lang = 'fr')::INT
           + CASE WHEN lang = 'en' AND row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) >= 2 THEN 1 ELSE 0 END AS n
         FROM (SELECT doc_id AS id, * FROM documents))""",
)
def _(lib):
    # every document claims "<lang>.epub" in its source's folder; fr.epub and "en (2).epub" exist there
    docs = lib.table("documents")
    claims = docs.select(c("doc_id").alias("id"), c("source").alias("dir"), F.concat("lang", F.lit(".epub")).alias("wanted"))
    there = docs.select("source").distinct().select(
        F.explode(F.array(F.concat("source", F.lit("/fr.epub")), F.concat("source", F.lit("/en (2).epub")))).alias("path")
    )
    return reconcile.unique_names(claims, there).select("id", "dir", "final_name")


@query("first_hash_wins", "SELECT id, content_hash, winner, id = winner AS accepted FROM backfill")
def _(lib):
    fresh = merge.fresh_hashes(lib.books, lib.inventory)
    accepted, refused = merge.backfill_split(lib.books, fresh)
    yes = accepted.select("id", c("id").alias("winner"), F.lit(True).alias("accepted"))
    no = refused.select("id", c("other_id").alias("winner"), F.lit(False).alias("accepted"))
    return yes.unionByName(no).join(fresh, "id").select("id", "content_hash", "winner", "accepted")


# --- pages -----------------------------------------------------------------------------------

_SHOWN = "id, title, sort_title, file_name, authors"


def _page_sql(order: str, limit: str, tests: str = "true") -> str:
    return f"""SELECT {LISTED}, row_number() OVER (ORDER BY {order}) AS position FROM (
        SELECT * FROM books WHERE NOT is_missing AND {tests} ORDER BY {order} {limit})"""


def _page(rows: DataFrame, sort: str, sort_dir: str = "") -> DataFrame:
    return browse.with_position(rows, sort, sort_dir).select(*LIST_COLUMNS, "position")


@query("page_offset", _page_sql(ORDERS["title"], "LIMIT 50 OFFSET 50"))
def _(lib):
    return _page(browse.page_offset(search.visible(lib.books), "title", "", 2, 50), "title")


@query("page_marks", _page_sql(ORDERS["title"], "LIMIT 25 OFFSET 475"))
def _(lib):
    """A page far down, between two stored marks."""
    ctx = BrowseContext(sort="title", page=20, page_size=25)
    rows, _ = browse.browse_rows(lib.snapshot.books, ctx, shelf=lib.snapshot.shelf)
    return _page(rows, "title")


@query("page_marks_desc", _page_sql(ORDERS["pages"], "LIMIT 50 OFFSET 100"))
def _(lib):
    ctx = BrowseContext(sort="pages", page=3, page_size=50)
    rows, _ = browse.browse_rows(lib.snapshot.books, ctx, shelf=lib.snapshot.shelf)
    return _page(rows, "pages")


def _around_sql(anchor: int, after: bool, size: int) -> str:
    order = ORDERS["pages"]
    side = "r.n > a.n AND r.n <= a.n + {0}" if after else "r.n < a.n AND r.n >= a.n - {0}"
    return f"""WITH ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM books WHERE NOT is_missing)
        SELECT {', '.join('r.' + n for n in LIST_COLUMNS)}, row_number() OVER (ORDER BY r.n) AS position
        FROM ranked r JOIN (SELECT n FROM ranked WHERE id = {anchor}) a ON {side.format(size)}"""


def _nested(text: str) -> str:
    """A query with its own WITH, as a sub-query so that the bound tables can go in front."""
    return f"SELECT * FROM ({text})"


@query("page_after", _nested(_around_sql(41, True, 25)))
def _(lib):
    books = lib.snapshot.books
    return _page(browse.page_after(lib.snapshot.rows_of([41]), search.visible(books), 41, "pages", "", 25), "pages")


@query("page_before", _nested(_around_sql(41, False, 25)))
def _(lib):
    books = lib.snapshot.books
    return _page(browse.page_before(lib.snapshot.rows_of([41]), search.visible(books), 41, "pages", "", 25), "pages")


@query("random_page")
def _(lib):
    return browse.list_view(browse.random_page(search.visible(lib.books), 25, seed=5))


@query("random_page_members", "SELECT least(25, count(*)) AS shown, least(25, count(*)) AS visible, least(25, count(*)) AS distinct_ids FROM books WHERE NOT is_missing")
def _(lib):
    """A random page is full, holds visible books only, and none twice."""
    page = browse.random_page(search.visible(lib.books), 25).select("id", "is_missing")
    return page.agg(F.count(F.lit(1)).alias("shown"), F.count_if(~c("is_missing")).alias("visible"), F.count_distinct("id").alias("distinct_ids"))


_BROWSED = BrowseContext(title="e", language="fr", sort="title", page=2, page_size=25)
_BROWSED_SQL = f"language = 'fr' AND {_any_word(TITLES, 'e')}"


@query("browse_page", _page_sql(ORDERS["title"], "LIMIT 25 OFFSET 25", _BROWSED_SQL))
def _(lib):
    snapshot = lib.snapshot
    rows, _ = browse.browse(snapshot.books, _BROWSED, stats.library_stats(snapshot.books), shelf=snapshot.shelf)
    return _page(rows, "title")


@query(
    "browse_summary",
    f"""SELECT CASE WHEN n < 25 THEN 25 + n ELSE 25 + 25 END::BIGINT AS filtered_count, library_total,
        CASE WHEN n < 25 THEN least(2, greatest(1, ceil((25 + n) / 25))) ELSE 2 END::BIGINT AS page, n < 25 AS count_exact, languages
        FROM (SELECT greatest(0, least(25, count(*) - 25)) AS n FROM books WHERE NOT is_missing AND {_BROWSED_SQL}),
        ({_STATS})""",
)
def _(lib):
    snapshot = lib.snapshot
    _, summary = browse.browse(snapshot.books, _BROWSED, stats.library_stats(snapshot.books), shelf=snapshot.shelf)
    return summary.withColumn("languages", F.array_join("languages", ","))


@query(
    "path_order",
    "SELECT path, lower(path) AS sort_path FROM inventory",
)
def _(lib):
    return lib.files.select("path", F.lower("path").alias("sort_path")).orderBy("sort_path", "path")


# --- set operations --------------------------------------------------------------------------


@query(
    "union_distinct_paths",
    """SELECT file_path AS path FROM books WHERE NOT is_missing AND NOT epub_validated
       UNION SELECT path FROM unindexed""",
)
def _(lib):
    pending = lib.books.where(~c("is_missing") & ~c("epub_validated")).select(c("file_path").alias("path"))
    return pending.unionByName(reconcile.unindexed_files(lib.files, lib.books).select("path")).distinct()


@query(
    "except_validated",
    "SELECT path FROM inventory EXCEPT SELECT file_path FROM books WHERE NOT is_missing AND epub_validated",
)
def _(lib):
    done = lib.books.where(~c("is_missing") & c("epub_validated")).select(c("file_path").alias("path"))
    return lib.files.select("path").join(done, "path", "left_anti")


@query("multi_root_union", _TABLE_ROWS)
def _(lib):
    """Roots that overlap list a file once."""
    found, _ = fs.inventory(lib.spark, [lib.folder, lib.folder + "/documents.parquet", lib.folder], (".parquet",))
    return _rows_of_files(lib, found)


# --- merges ----------------------------------------------------------------------------------

_FLAGS = "is_missing, epub_validated, epub_deep_validated, epub_version2"


def _state(books: DataFrame, *extra: str) -> DataFrame:
    return books.select(
        "id", "file_path", "file_size", F.unix_micros("file_mtime").alias("file_mtime"), "content_hash",
        *_FLAGS.split(", "), *extra,
    )


_STATE = f"id, file_path, file_size, file_mtime, content_hash, {_FLAGS}"


@query(
    "upsert_by_path",
    f"""SELECT b.id, b.file_path, coalesce(i.file_size, b.file_size) AS file_size, coalesce(i.file_mtime, b.file_mtime) AS file_mtime,
          CASE WHEN i.path IS NULL THEN b.content_hash ELSE i.content_hash END AS content_hash,
          b.is_missing AND i.path IS NULL AS is_missing, b.epub_validated AND NOT changed AS epub_validated,
          b.epub_deep_validated AND NOT changed AS epub_deep_validated, b.epub_version2 AND NOT changed AS epub_version2,
          first_seen_at, CASE WHEN i.path IS NULL THEN last_scanned_at ELSE '{NOW}' END AS last_scanned_at
        FROM (SELECT b.*, i.* EXCLUDE (file_size, file_mtime, content_hash), i.path IS NOT NULL AND (i.file_size IS DISTINCT FROM b.file_size
              OR i.file_mtime IS DISTINCT FROM b.file_mtime OR i.content_hash IS DISTINCT FROM b.content_hash) AS changed
              FROM books b LEFT JOIN inventory i ON i.path = b.file_path) b LEFT JOIN inventory i ON i.path = b.file_path
        UNION ALL
        SELECT (SELECT max(id) FROM books) + row_number() OVER (ORDER BY md5(path)), path, file_size, file_mtime, content_hash,
          false, false, false, false, '{NOW}', '{NOW}' FROM unindexed""",
)
def _(lib):
    incoming = fs.with_content_hash(lib.inventory).select(
        c("path").alias("file_path"), fn.base_name(c("path")).alias("file_name"), F.lit("epub").alias("format"),
        "file_size", "file_mtime", "content_hash", F.lit(NOW).alias("last_scanned_at"),
    )
    return _state(merge.upsert_by_path(lib.books, incoming), "first_seen_at", "last_scanned_at")


_MOVES = "(SELECT book_id, path, file_size, file_mtime FROM classified WHERE status = 'repointed')"


def _repoint_sql(clear: bool) -> str:
    flag = lambda n: f"b.{n} AND m.path IS NULL AS {n}" if clear else f"b.{n}"
    return f"""SELECT b.id, coalesce(m.path, b.file_path) AS file_path, coalesce(m.file_size, b.file_size) AS file_size,
        coalesce(m.file_mtime, b.file_mtime) AS file_mtime, b.content_hash, b.is_missing AND m.path IS NULL AS is_missing,
        {flag('epub_validated')}, {flag('epub_deep_validated')}, {flag('epub_version2')},
        coalesce(regexp_extract(m.path, '[^/]*$'), b.file_name) AS file_name
        FROM books b LEFT JOIN {_MOVES} m ON m.book_id = b.id"""


def _moves(lib) -> DataFrame:
    moved = reconcile.classify(lib.inventory, lib.books).where(c("status") == "repointed")
    return moved.select(c("book_id").alias("id"), c("path").alias("file_path"), "file_size", "file_mtime")


@query("repoint", _repoint_sql(False))
def _(lib):
    return _state(merge.repoint(lib.books, _moves(lib)), "file_name")


@query("repoint_clearing_flags", _repoint_sql(True))
def _(lib):
    return _state(merge.repoint(lib.books, _moves(lib), clear_flags=True), "file_name")


@query(
    "mark_missing",
    f"""SELECT b.id, CASE WHEN i.path IS NOT NULL THEN false ELSE is_missing OR {LIB} END AS is_missing
        FROM books b LEFT JOIN inventory i ON i.path = b.file_path""",
)
def _(lib):
    return merge.mark_presence(lib.books, lib.files, ROOTS).select("id", "is_missing")


@query(
    "mark_present",
    "SELECT b.id, is_missing AND i.path IS NULL AS is_missing FROM books b LEFT JOIN inventory i ON i.path = b.file_path",
)
def _(lib):
    return merge.mark_presence(lib.books, lib.files, []).select("id", "is_missing")


@query(
    "purge_rows",
    """SELECT 'book' AS kind, id AS book_id, NULL::BIGINT AS user_id, NULL AS token FROM books WHERE NOT is_missing
       UNION ALL SELECT 'favorite', book_id, user_id, NULL FROM favorites WHERE book_id NOT IN (SELECT id FROM books WHERE is_missing)
       UNION ALL SELECT 'token', book_id, NULL, token FROM author_index WHERE book_id NOT IN (SELECT id FROM books WHERE is_missing)""",
)
def _(lib):
    books, favorites, index = merge.purge_rows(
        lib.books, lib.favorites, search.author_index(lib.books), lib.books.where("is_missing")
    )
    nobody, nothing = F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("token")
    return (
        books.select(F.lit("book").alias("kind"), c("id").alias("book_id"), nobody, nothing)
        .unionByName(favorites.select(F.lit("favorite").alias("kind"), "book_id", "user_id", nothing))
        .unionByName(index.select(F.lit("token").alias("kind"), "book_id", nobody, "token"))
    )


@query(
    "set_favorites",
    """SELECT user_id, book_id FROM favorites WHERE (user_id, book_id) NOT IN (SELECT (user_id, book_id) FROM changes)
       UNION ALL SELECT user_id, book_id FROM changes GROUP BY user_id, book_id HAVING arg_max(favorite, seq)""",
)
def _(lib):
    return merge.apply_favorites(lib.favorites, lib.favorite_changes)


@query(
    "edit_metadata",
    """SELECT b.id, coalesce(e.title, b.title) AS title, coalesce(e.title, b.sort_title) AS sort_title,
         CASE WHEN e.title IS NULL THEN b.authors ELSE e.authors END AS authors,
         CASE WHEN e.title IS NULL THEN b.tags ELSE e.genre END AS tags FROM books b LEFT JOIN edits e USING (id)""",
)
def _(lib):
    return merge.edit_metadata(lib.books, lib.edits)[0].select("id", "title", "sort_title", "authors", "tags")


@query("edit_rejections", "SELECT id, 'Title cannot be empty.' AS detail FROM edits WHERE title IS NULL")
def _(lib):
    return merge.edit_metadata(lib.books, lib.edits)[1]


_PROPOSED = ("title", "authors", "publisher", "published_date", "language", "series_index")


def _filled(n: str) -> str:
    return f"b.{n} IS NOT NULL" + ("" if n == "series_index" else f" AND trim(b.{n}) <> ''")


def _conflict(n: str) -> str:
    return f"(p.{n} IS NOT NULL AND {_filled(n)} AND p.{n} <> b.{n})"


_CONFLICT_LIST = (
    "concat_ws(',', " + ", ".join(f"CASE WHEN {_conflict(n)} THEN '{n}' END" for n in _PROPOSED) + ")"
)


def _merge_sql(confirm: bool, refuse: bool) -> str:
    blocked = f"({_CONFLICT_LIST} <> '')" if refuse else "false"
    picks = [
        f"CASE WHEN p.{n} IS NOT NULL AND NOT {blocked} AND ({'true' if confirm else f'NOT ({_filled(n)})'}) THEN p.{n} ELSE b.{n} END AS {n}"
        for n in _PROPOSED
    ]
    scan = f"CASE WHEN {blocked} THEN b.last_scanned_at ELSE coalesce(p.last_scanned_at, b.last_scanned_at) END AS last_scanned_at"
    return f"SELECT b.id, {', '.join(picks)}, {scan} FROM books b LEFT JOIN proposed p USING (id)"


def _merged(lib, **how):
    return merge.merge_metadata(lib.books, lib.proposed, **how).select("id", *_PROPOSED, "last_scanned_at")


@query("merge_metadata", _merge_sql(False, False))
def _(lib):
    return _merged(lib, confirm=False)


@query("merge_metadata_confirmed", _merge_sql(True, False))
def _(lib):
    return _merged(lib, confirm=True)


@query("merge_metadata_refusing", _merge_sql(False, True))
def _(lib):
    return _merged(lib, confirm=False, refuse=True)


@query(
    "merge_conflicts",
    f"SELECT id, conflicts FROM (SELECT id, {_CONFLICT_LIST} AS conflicts FROM books b JOIN proposed p USING (id)) WHERE conflicts <> ''",
)
def _(lib):
    found = merge.merge_conflicts(lib.books, lib.proposed)
    return found.select("id", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    "mark_validated",
    """SELECT id, epub_validated OR id IN (SELECT doc_id FROM marks WHERE quality = 1) AS epub_validated,
       epub_deep_validated OR id IN (SELECT doc_id FROM marks WHERE quality = 1) AS epub_deep_validated FROM books""",
)
def _(lib):
    good = lib.conversions.where("ok").select("id")
    return merge.mark_validated(lib.books, good, deep=True).select("id", "epub_validated", "epub_deep_validated")


@query(
    "apply_conversion_results",
    """SELECT b.id, b.file_path, coalesce(v.file_size, b.file_size) AS file_size, coalesce(v.file_mtime, b.file_mtime) AS file_mtime,
         coalesce(v.content_hash, b.content_hash) AS content_hash, is_missing, b.epub_validated OR v.id IS NOT NULL AS epub_validated,
         b.epub_deep_validated AND v.id IS NULL AS epub_deep_validated, b.epub_version2 OR v.id IS NOT NULL AS epub_version2,
         coalesce(v.cover_path, b.cover_path) AS cover_path
       FROM books b LEFT JOIN conversions v ON v.id = b.id WHERE v.id IS NULL OR v.ok""",
)
def _(lib):
    books, _, _ = merge.apply_conversion_results(
        lib.books, lib.favorites, search.author_index(lib.books), lib.conversions
    )
    return _state(books, "cover_path")


@query(
    "backfill_hashes",
    """SELECT b.id, coalesce(b.content_hash, f.content_hash) AS content_hash, b.epub_validated AND f.id IS NULL AS epub_validated,
         b.epub_deep_validated AND f.id IS NULL AS epub_deep_validated, b.epub_version2 AND f.id IS NULL AS epub_version2
       FROM books b LEFT JOIN (SELECT * FROM backfill WHERE id = winner) f ON f.id = b.id""",
)
def _(lib):
    accepted, _ = merge.backfill_split(lib.books, merge.fresh_hashes(lib.books, lib.inventory))
    after = merge.backfill_hashes(lib.books, accepted)
    return after.select("id", "content_hash", "epub_validated", "epub_deep_validated", "epub_version2")


@query("strip_descriptions")
def _(lib):
    pages = lib.table("pages").select(c("page_id").alias("id"), c("html").alias("description"))
    texts = lib.spread_books.select("id", "description")
    return merge.strip_descriptions(pages.unionByName(texts))


# Texts without an entity or a tag, which SQL can squeeze; the others need an HTML parser.
_UNMARKED = "NOT contains(description, '&') AND NOT regexp_matches(description, '<[a-zA-Z/!]')"
_SQUEEZED = r"nullif(trim(regexp_replace(description, '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), ' '), '')"


def _unmarked(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(~c(text).contains("&") & ~c(text).rlike("<[a-zA-Z/!]"))


@query(
    "strip_unmarked",
    f"""SELECT id, CASE WHEN description <> '' AND {_SQUEEZED} IS DISTINCT FROM description THEN {_SQUEEZED} ELSE description END AS description,
          description <> '' AND {_SQUEEZED} IS DISTINCT FROM description AS description_changed
        FROM books WHERE {_UNMARKED}""",
)
def _(lib):
    texts = lib.spread_books.select("id", "description", c("description").alias("before"))
    return _unmarked(merge.strip_descriptions(texts), "before").drop("before")


@query(
    "plain_text_unmarked",
    f"SELECT id, {_SQUEEZED} AS plain, description IS DISTINCT FROM {_SQUEEZED} AS needed FROM books WHERE {_UNMARKED}",
)
def _(lib):
    texts = lib.spread_books.select("id", "description", tx.plain_text(c("description")).alias("plain"))
    needed = tx.needs_plain_text(c("description"), c("plain")).alias("needed")
    return _unmarked(texts.select("id", "description", "plain", needed), "description").drop("description")


@query(
    "rename_plan",
    "SELECT id, file_path AS from_path, to_path FROM renames",
)
def _(lib):
    return reconcile.rename_plan(lib.books, lib.files, ROOTS)


@query(
    "cover_reshard_plan",
    """WITH chosen AS (SELECT book_id, arg_min(path, row(regexp_replace(path, '/[^/]*$', '') <> 'covers', path)) AS from_path
         FROM cover_ids WHERE book_id IS NOT NULL GROUP BY book_id),
       placed AS (SELECT c.book_id, from_path, b.id, b.cover_path AS stored,
         lpad((c.book_id % 100)::VARCHAR, 2, '0') || '/' || c.book_id || lower(regexp_extract(from_path, '\\.[^.]*$')) AS place
         FROM chosen c LEFT JOIN books b ON b.id = c.book_id)
       SELECT book_id, from_path, 'covers/' || place AS to_path,
         CASE WHEN id IS NOT NULL AND stored IS DISTINCT FROM 'data/covers/' || place THEN 'data/covers/' || place END AS cover_path,
         CASE WHEN from_path = 'covers/' || place THEN 'keep' WHEN id IS NULL THEN 'move_orphan' ELSE 'move' END AS action FROM placed
       UNION ALL SELECT NULL, path, NULL, NULL, 'unrecognized' FROM cover_ids WHERE book_id IS NULL""".replace(
        "WITH chosen", "SELECT * FROM (WITH chosen"
    )
    + ")",
)
def _(lib):
    return merge.cover_reshard_plan(fs.with_cover_ids(lib.covers), lib.books, "covers")


_REQUESTS = """(SELECT s_suppkey AS seq, '  ' || CASE WHEN s_suppkey % 3 = 0 THEN upper(n_name) WHEN s_suppkey % 3 = 1 THEN ''
    ELSE s_name END || ' ' AS raw FROM supplier JOIN nation ON n_nationkey = s_nationkey
    UNION ALL SELECT c_custkey + 1000000000, upper(c_name) FROM customer)"""
_JUDGED = f"""(SELECT seq, trim(raw) AS username, {fold('trim(raw)')} AS f,
    trim(raw) <> '' AND seq = min(seq) OVER (PARTITION BY {fold('trim(raw)')})
      AND {fold('trim(raw)')} NOT IN (SELECT {fold('username')} FROM users) AS wins FROM {_REQUESTS})"""


def _requests(lib) -> DataFrame:
    """Suppliers and their nations ask for accounts, and so do all existing customers again."""
    i = c("s_suppkey")
    named = lib.table("supplier").join(lib.table("nation"), c("n_nationkey") == c("s_nationkey"))
    ask = named.select(
        i.cast("bigint").alias("seq"),
        F.concat(
            F.lit("  "), F.when(F.pmod(i, F.lit(3)) == 0, F.upper("n_name")).when(F.pmod(i, F.lit(3)) == 1, "").otherwise(c("s_name")), F.lit(" ")
        ).alias("username"),
    )
    again = lib.table("customer").select((c("c_custkey") + 1_000_000_000).alias("seq"), F.upper("c_name").alias("username"))
    return ask.unionByName(again).withColumn("created_at", F.lit(NOW))


@query(
    "register_users",
    f"""SELECT id, username FROM users UNION ALL
        SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY md5(f)), username FROM {_JUDGED} WHERE wins""",
)
def _(lib):
    return merge.register_users(lib.users, _requests(lib))[0].select("id", "username")


@query(
    "register_rejections",
    f"""SELECT seq, username, CASE WHEN username = '' THEN 'Username cannot be empty.' ELSE 'That username is already taken.' END AS detail
        FROM {_JUDGED} WHERE NOT wins""",
)
def _(lib):
    return merge.register_users(lib.users, _requests(lib))[1]


_ACTIVE = "(SELECT DISTINCT upper(c_name) AS n FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(
    "delete_users",
    f"""SELECT 'user' AS kind, id AS user_id, NULL::BIGINT AS book_id FROM users WHERE upper(username) NOT IN (SELECT n FROM {_ACTIVE})
        UNION ALL SELECT 'favorite', user_id, book_id FROM favorites
        WHERE user_id NOT IN (SELECT id FROM users WHERE upper(username) IN (SELECT n FROM {_ACTIVE}))""",
)
def _(lib):
    names = lib.table("customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit(" "), F.upper("c_name")).alias("username"))
    users, favorites = merge.delete_users(lib.users, lib.favorites, names)
    return users.select(
        F.lit("user").alias("kind"), c("id").alias("user_id"), F.lit(None).cast("bigint").alias("book_id")
    ).unionByName(favorites.select(F.lit("favorite").alias("kind"), "user_id", "book_id"))


# --- reconciliation --------------------------------------------------------------------------


@query("classify_scan", "SELECT path, content_hash, status, book_id, delete_path FROM classified")
def _(lib):
    return reconcile.classify(lib.inventory, lib.books).select("path", "content_hash", "status", "book_id", "delete_path")


def _loose(lib) -> tuple[DataFrame, DataFrame]:
    """The match by path, and the hashed files no row has."""
    matched = reconcile.match_paths(lib.books, lib.files)
    return matched, reconcile.hashed_unindexed(matched, lib.inventory)


@query(
    "duplicate_groups",
    """SELECT content_hash, keeper, n_remove::BIGINT AS n_remove, book_id, book_id IS NOT NULL AND n_remove = 0 AND NOT there AS repoint_only
       FROM listed_groups""",
)
def _(lib):
    matched, loose = _loose(lib)
    return reconcile.duplicate_groups(loose, matched).withColumn("n_remove", _long("n_remove"))


@query("duplicate_members", "SELECT content_hash, path, keeper FROM copy_members")
def _(lib):
    matched, loose = _loose(lib)
    return reconcile.duplicate_members(loose, matched)


_NEW_FILES = f"""SELECT content_hash, arg_max(path, {key('path')}) AS path FROM unindexed
    WHERE content_hash NOT IN (SELECT content_hash FROM canon) GROUP BY content_hash"""


@query("new_files", _NEW_FILES)
def _(lib):
    matched, loose = _loose(lib)
    return reconcile.new_files(reconcile.content_groups(loose, matched))


_DEDUPE = """SELECT 'repoint' AS op, book_id, canon_path AS from_path, keeper AS to_path FROM copy_groups
    WHERE book_id IS NOT NULL AND canon_path <> keeper
    UNION ALL SELECT CASE WHEN starts_with(path, '/lib/') THEN 'delete' ELSE 'refuse' END, NULL, path, NULL FROM copy_members"""


@query("dedupe_plan", _DEDUPE)
def _(lib):
    matched, loose = _loose(lib)
    return reconcile.dedupe_plan(loose, cut_lineage(reconcile.content_groups(loose, matched)), ROOTS)


@query(
    "empty_dir_plan",
    """SELECT path, len(string_split(path, '/')) AS depth FROM dir_parts
       WHERE starts_with(path, '/lib/') AND path NOT IN (SELECT path FROM used_dirs)""",
)
def _(lib):
    return reconcile.empty_dirs(lib.directories, lib.files, ROOTS)


@query(
    "force_clean_plan",
    """SELECT 'purge' AS op, id AS book_id, file_path AS path FROM books b
       WHERE file_path NOT IN (SELECT path FROM inventory) AND id NOT IN (SELECT book_id FROM classified WHERE status = 'repointed')
       UNION ALL
       SELECT 'remove_cover', book_id, path FROM cover_ids WHERE book_id IS NULL OR book_id NOT IN (
         SELECT id FROM books WHERE file_path IN (SELECT path FROM inventory)
           OR id IN (SELECT book_id FROM classified WHERE status = 'repointed'))""",
)
def _(lib):
    moved = reconcile.classify(lib.inventory, lib.books).where("status = 'repointed'").select("book_id")
    return reconcile.force_clean_plan(lib.books, lib.files, fs.with_cover_ids(lib.covers), moved)


_AUDIT = f"""SELECT 'unindexed' AS kind, NULL::BIGINT AS book_id, path, NULL AS detail FROM unindexed
    UNION ALL SELECT 'duplicate_group', book_id, keeper, n_remove || ' to remove' FROM listed_groups
    UNION ALL SELECT 'new_file', NULL, path, content_hash FROM ({_NEW_FILES})
    UNION ALL SELECT 'absent', id, file_path, CASE WHEN is_missing THEN 'missing' END FROM books WHERE file_path NOT IN (SELECT path FROM inventory)
    UNION ALL SELECT 'null_hash', id, file_path, NULL FROM books WHERE content_hash IS NULL
    UNION ALL SELECT 'out_of_root', id, file_path, NULL FROM books WHERE NOT {LIB}
    UNION ALL SELECT 'orphan_cover', book_id, path, NULL FROM cover_ids WHERE book_id IS NULL OR book_id NOT IN (SELECT id FROM books)
    UNION ALL SELECT 'filename_fix', id, file_path, wanted FROM fixes WHERE wanted <> file_name"""


@query("audit_report", _AUDIT)
def _(lib):
    return reconcile.audit_report(lib.books, lib.inventory, fs.with_cover_ids(lib.covers), ROOTS)


# --- file contents ---------------------------------------------------------------------------

# what is wrong with a package, by the way it was broken
_FAULTS = {
    0: "OPF spine is empty",
    1: "not a ZIP archive",
    2: "missing META-INF/container.xml",
    3: "spine itemref missing from manifest: lost; spine has no readable HTML/XHTML content",
    4: "invalid spine markup in OEBPS/chapter 1.xhtml: mismatched tag: line 1, column 14",
    7: "file is empty",
}
_FAULT = "CASE doc_id % 12 " + " ".join(f"WHEN {n} THEN '{text}'" for n, text in _FAULTS.items()) + " ELSE '' END"


@query(
    "validate_packages",
    f"""SELECT book_path AS path, doc_id % 12 NOT IN ({', '.join(map(str, _FAULTS))}) AS ok, {_FAULT} AS errors,
        CASE WHEN doc_id % 12 = 5 THEN 'unexpected mimetype: ''text/plain''' ELSE '' END AS warnings FROM docs""",
)
def _(lib):
    checked = packages.validation(packages.inspect_packages(lib.packages))
    return checked.select("path", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


_READ = "(doc_id % 12 NOT IN (1, 2, 6, 7))"


@query(
    "extract_metadata",
    f"""SELECT book_path AS path, CASE WHEN {_READ} THEN coalesce(trim(first_line), regexp_replace(name, '\\.epub$', ''))
          ELSE regexp_replace(name, '\\.epub$', '') END AS title,
        CASE WHEN {_READ} THEN source || '; Second Hand' END AS authors, CASE WHEN {_READ} THEN lang END AS language,
        CASE WHEN {_READ} THEN '978' || lpad(doc_id::VARCHAR, 10, '0') END AS isbn, CASE WHEN {_READ} THEN 'Shelf' END AS series,
        CASE WHEN {_READ} THEN (doc_id % 48) / 16.0::DOUBLE END AS series_index, CASE WHEN {_READ} THEN 'prose, letters' END AS tags,
        CASE WHEN doc_id % 12 = 6 THEN 'OPF metadata section missing' ELSE '' END AS metadata_errors FROM docs""",
)
def _(lib):
    read = packages.metadata(packages.inspect_packages(lib.packages))
    return read.select(
        "path", "title", "authors", "language", "isbn", "series", "series_index", "tags",
        F.array_join("metadata_errors", "; ").alias("metadata_errors"),
    )


@query(
    "parse_tool_output",
    f"""SELECT id, title, sort_title, {clean_list("replace(authors, '; ', ' & ')", '&', '; ')} AS authors,
         CASE WHEN id % 2 = 0 THEN 'Second Publisher' ELSE publisher END AS publisher, published_date,
         nullif(trim(language), '') AS language, series, series_index, tags, isbn FROM books""",
)
def _(lib):
    parsed = lib.reports.select("id", md.parse_tool_output(c("report")).alias("r")).select("id", "r.*")
    return parsed.select("id", "title", "sort_title", "authors", "publisher", "published_date", "language", "series", "series_index", "tags", "isbn")


@query(
    "screen_covers",
    """SELECT path, width, height, reason IS NULL AS usable, reason FROM (
         SELECT *, CASE WHEN kind = 5 THEN 'too few bytes' WHEN kind = 1 THEN 'near white' WHEN kind = 4 THEN 'unknown format'
           WHEN width < 100 OR height < 100 THEN 'too small' END AS reason
         FROM (SELECT 'covers/' || doc_id || '.img' AS path, doc_id % 6 AS kind,
           CASE WHEN doc_id % 6 <> 4 THEN (n_chars % 120 + 60)::INT END AS width,
           CASE WHEN doc_id % 6 <> 4 THEN (n_chars % 70 + 60)::INT END AS height FROM documents))""",
)
def _(lib):
    return images.screen_covers(lib.images)


# --- jobs ------------------------------------------------------------------------------------


# Packages differ from their rows in time, so all are read. Equal bytes (empty files, text that is no archive)
# are one content, indexed by the lowest row; of these the broken lose their row, the sound are read anew.
_SCANNED = f"""
    SELECT *, doc_id = min(doc_id) OVER (PARTITION BY CASE doc_id % 12 WHEN 7 THEN 'empty' WHEN 1 THEN 'none ' || text ELSE doc_id::VARCHAR END) AS first,
      doc_id % 12 IN ({', '.join(map(str, _FAULTS))}) AS broken
    FROM docs"""


@query(
    "scan_job",
    f"""SELECT b.id, b.file_path, CASE WHEN first THEN n_chars ELSE file_size END AS file_size,
          CASE WHEN first THEN (doc_id + 1700000001) * 1000000 ELSE file_mtime END AS file_mtime, false AS is_missing,
          first OR epub_validated AS epub_validated, NOT first AND epub_deep_validated AS epub_deep_validated, NOT first AND epub_version2 AS epub_version2,
          CASE WHEN NOT first THEN b.title WHEN {_READ} THEN coalesce(trim(first_line), regexp_replace(name, '\\.epub$', ''))
            ELSE regexp_replace(name, '\\.epub$', '') END AS title,
          CASE WHEN NOT first THEN b.authors WHEN {_READ} THEN source || '; Second Hand' END AS authors,
          CASE WHEN first THEN '{NOW}' ELSE last_scanned_at END AS last_scanned_at
        FROM books b JOIN ({_SCANNED}) d ON d.doc_id = b.id WHERE NOT (first AND broken)""",
)
def _(lib):
    result = jobs.scan_job(lib.books, lib.packages, ROOTS, NOW, validate=True)
    return _state(result.books, "title", "authors", "last_scanned_at").drop("content_hash")


_BROKEN = f"""SELECT i.path, b.id AS book_id FROM (SELECT book_path AS path FROM docs WHERE doc_id % 12 IN ({', '.join(map(str, _FAULTS))})) i
    LEFT JOIN books b ON b.file_path = i.path
    WHERE starts_with(i.path, '/lib/') AND NOT coalesce(b.epub_validated AND NOT b.is_missing, false)"""
_REMOVED = f"""SELECT 'delete' AS op, book_id, path FROM ({_BROKEN}) UNION ALL SELECT 'purge', book_id, path FROM ({_BROKEN})
    UNION ALL SELECT 'remove_cover', c.book_id, c.path FROM cover_ids c JOIN ({_BROKEN}) b USING (book_id)
    WHERE regexp_matches(c.path, '^covers/([0-9][0-9]/)?[0-9]+[.](jpg|jpeg|png|gif|webp)$')"""


@query("integrity_job", _REMOVED)
def _(lib):
    """In batches whose results are stored; the second run finds them and opens nothing."""
    progress = f"{shared_folder(lib.spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    covers = fs.with_cover_ids(lib.covers)
    for _ in range(2):
        result = jobs.integrity_job(lib.books, lib.packages, covers, ROOTS, progress=progress, batch_files=max(1, lib.table("documents").count() // 3))
    return result.removals


@query(
    "integrity_state",
    f"""SELECT id, is_missing, epub_validated OR (NOT is_missing AND starts_with(file_path, '/lib/') AND id NOT IN (SELECT book_id FROM ({_BROKEN})))
          OR (is_missing AND starts_with(file_path, '/lib/') AND id NOT IN (SELECT book_id FROM ({_BROKEN}))) AS epub_validated,
          favorites, tokens
        FROM books b LEFT JOIN (SELECT book_id AS id, count(*) AS favorites FROM favorites GROUP BY book_id) f USING (id)
        LEFT JOIN (SELECT book_id AS id, count(*) AS tokens FROM author_index GROUP BY book_id) t USING (id)
        WHERE id NOT IN (SELECT book_id FROM ({_BROKEN}))""",
)
def _(lib):
    """What is left when the removals are carried out: rows, their marks, favourites and author words."""
    result = jobs.integrity_job(lib.books, lib.packages, fs.with_cover_ids(lib.covers), ROOTS)
    purged = result.removals.where("op = 'purge'").select(c("book_id").alias("id")).distinct()
    books, favorites, tokens = merge.purge_rows(result.books, lib.favorites, search.author_index(lib.books), purged)
    counts = [df.groupBy(c("book_id").alias("id")).agg(F.count(F.lit(1)).alias(name)) for df, name in ((favorites, "favorites"), (tokens, "tokens"))]
    return books.select("id", "is_missing", "epub_validated").join(counts[0], "id", "left").join(counts[1], "id", "left")


def _cleanup(lib, **how) -> jobs.CleanupResult:
    return jobs.cleanup_run(lib.books, lib.inventory, fs.with_cover_ids(lib.covers), lib.directories, ROOTS, NOW, **how)


_PLAN = f"""SELECT 'backfill' AS op, id AS book_id, NULL AS from_path, NULL AS to_path FROM backfill WHERE id = winner
    UNION ALL SELECT 'backfill_refused', id, NULL, NULL FROM backfill WHERE id <> winner
    UNION ALL SELECT 'rename', id, file_path, to_path FROM renames
    UNION ALL {_DEDUPE}
    UNION ALL SELECT 'index', NULL, path, NULL FROM ({_NEW_FILES})
    UNION ALL SELECT 'prune', NULL, path, NULL FROM dir_parts
      WHERE starts_with(path, '/lib/') AND path NOT IN (SELECT path FROM used_dirs)"""


@query("cleanup_dry_run", _PLAN)
def _(lib):
    # descriptions need an HTML parser; strip_descriptions checks that step
    return _cleanup(lib).plan.where(c("op") != "strip")


@query("cleanup_run")
def _(lib):
    return _cleanup(lib, execute=True, force_clean=True).plan


# Over packages, whose faults are known: equal bytes are one content, every row has its file and no file is unindexed.
_BACKFILLED = """SELECT id, id = min(id) OVER (PARTITION BY CASE id % 12 WHEN 7 THEN 'empty' WHEN 1 THEN 'none ' || description ELSE id::VARCHAR END) AS accepted
    FROM books WHERE content_hash IS NULL"""


@query(
    "cleanup_summary",
    f"""SELECT count(*) FILTER (op = 'delete') AS files_deleted, 0::BIGINT AS rows_updated, 0::BIGINT AS rows_indexed,
          count(*) FILTER (op = 'purge') AS rows_purged, count(*) FILTER (op = 'remove_cover') AS covers_removed,
          (SELECT count(*) FROM ({_BACKFILLED}) WHERE accepted) AS hashes_backfilled,
          (SELECT count(*) FROM wanted_names WHERE wanted <> {base('file_path')} AND {LIB} AND id IN (SELECT id FROM books WHERE NOT is_missing)) AS filenames_sanitized,
          (SELECT count(*) FROM ({_BROKEN})) AS invalid_epubs,
          (SELECT count(*) FROM dir_parts WHERE starts_with(path, '/lib/') AND path NOT IN (
            SELECT array_to_string(p[1:n], '/') FROM (SELECT p, unnest(range(2, len(p))) AS n FROM (SELECT string_split(book_path, '/') AS p FROM docs)))) AS dirs_pruned,
          (SELECT count(*) FROM ({_BACKFILLED}) WHERE NOT accepted) AS errors
        FROM ({_REMOVED})""",
)
def _(lib):
    run = jobs.cleanup_run(lib.books, lib.packages, fs.with_cover_ids(lib.covers), lib.directories, ROOTS, NOW, validate=True)
    return run.summary.drop("descriptions_stripped")


@query(
    "cleanup_validated",
    f"""SELECT 'invalid' AS op, book_id, path FROM ({_BROKEN}) UNION ALL {_REMOVED}""",
)
def _(lib):
    run = jobs.cleanup_run(lib.books, lib.packages, fs.with_cover_ids(lib.covers), lib.directories, ROOTS, NOW, validate=True)
    ops = ("invalid", "delete", "purge", "remove_cover", "refuse")
    return run.plan.where(c("op").isin(*ops)).select("op", "book_id", c("from_path").alias("path"))


_LANDED = f"""
    SELECT doc_id, doc_id % 2 AS batch, '/lib/arrivals/' || doc_id || '.epub' AS path, n_chars,
      CASE WHEN {_READ} THEN coalesce(trim(first_line), doc_id::VARCHAR) ELSE doc_id::VARCHAR END AS title,
      CASE WHEN {_READ} THEN source || '; Second Hand' END AS authors, CASE WHEN {_READ} THEN lang END AS lang
    FROM docs WHERE doc_id % 12 NOT IN ({', '.join(map(str, _FAULTS))})"""


# Hashes of packages are left out: SQL cannot make a package. Sound packages get the next ids, batch after batch.
@query(
    "stream_arrivals",
    f"""SELECT id, file_path, file_size, file_mtime, {_FLAGS}, title, authors FROM books
        UNION ALL
        SELECT (SELECT max(id) FROM books) + row_number() OVER (ORDER BY batch, md5(path)), path, n_chars, (doc_id + 1700000001) * 1000000,
          false, true, false, false, title, authors
        FROM ({_LANDED})""",
)
def _(lib):
    store, _ = _streamed(lib)
    return _state(store.books(), "title", "authors").drop("content_hash")


@query(
    "stream_stats",
    f"""SELECT (SELECT count(*) FROM books WHERE NOT is_missing) + (SELECT count(*) FROM ({_LANDED})) AS library_total,
        (SELECT string_agg(language, ',' ORDER BY {fold('language')}, language) FROM (
          SELECT language FROM books WHERE NOT is_missing AND trim(language) <> ''
          UNION SELECT lang FROM ({_LANDED}) WHERE trim(lang) <> '')) AS languages""",
)
def _(lib):
    """The statistics of the streamed catalogue, added up from the counts of its buckets."""
    store, _ = _streamed(lib)
    return store.stats().withColumn("languages", F.array_join("languages", ","))


@query(
    "stream_rewrites",
    f"""SELECT 2::BIGINT AS versions, count(*) FILTER (batch = 0) AS first_rows, count(*) FILTER (batch = 1) AS second_rows, 0::BIGINT AS repeated
        FROM ({_LANDED})""",
)
def _(lib):
    """What each batch of the stream added, from the versions it left; the stream run again adds nothing."""
    store, again = _streamed(lib)
    rows = [Shelves(lib.spark, store.root, v).stored().agg(F.count(F.lit(1))).first()[0] for v in (3, 4, 5)]
    figures = (store.version - 3, rows[1] - rows[0], rows[2] - rows[1], again().version - store.version)
    return lib.spark.createDataFrame([figures], "versions long, first_rows long, second_rows long, repeated long")


def _streamed(lib):
    """A store at version 3 after a stream of two batches of arrivals, and what runs the stream again.

    Each half of the documents lands in as many files as the table has partitions, so that all cores write and read them.
    """

    def run(base: str) -> Shelves:
        landed = lib.spark.readStream.schema(lib.table("documents").schema).parquet(f"{base}/landed")
        stream = lib.packages_of(_as_new(lib, landed))
        merge_arrivals(stream, f"{base}/catalog", f"{base}/progress", NOW).awaitTermination()
        return Shelves(lib.spark, f"{base}/catalog")

    def write(base: str) -> None:
        shelves.create(lib.spread_books, f"{base}/catalog", 3, 16)
        documents = lib.spread(lib.table("documents"))
        # the even documents first; what has landed since the last run is one batch
        for half in (0, 1):
            landing = documents.where(F.pmod("doc_id", F.lit(2)) == half)
            landing.write.mode("append").option("compression", "zstd").parquet(f"{base}/landed")
            run(base)

    base = lib.stored("arrivals", write)
    return Shelves(lib.spark, f"{base}/catalog"), lambda: run(base)


def _as_new(lib, documents: DataFrame) -> DataFrame:
    """Arriving documents as files that land in a new folder."""
    number = c("doc_id").cast("string")
    return documents.withColumns(
        {
            "first_line": F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit("")),
            "book_path": F.concat(F.lit("/lib/arrivals/"), number, F.lit(".epub")),
        }
    )


# --- scalar functions ------------------------------------------------------------------------


@query("fold_nocase", f"SELECT id, {fold('title')} AS folded FROM books")
def _(lib):
    return lib.books.select("id", tx.fold_nocase(c("title")).alias("folded"))


@query("plain_text")
def _(lib):
    return lib.table("pages").select("page_id", tx.plain_text(c("html")).alias("plain"))


@query("needs_plain_text")
def _(lib):
    pages = lib.table("pages").select("page_id", "html", tx.plain_text(c("html")).alias("plain"))
    return pages.select("page_id", tx.needs_plain_text(c("html"), c("plain")).alias("needed"))


@query(
    "sanitize_filename",
    """SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(file_name, '\\.epub$', ''), '[\\p{C}/\\\\<>:"|?*]', '', 'g'),
       '[\\s\\p{Z}]+', ' ', 'g'), ' .'), ''), 'unnamed') || '.epub' AS clean_name FROM books""",
)
def _(lib):
    return lib.books.select("id", fn.sanitize_filename(c("file_name")).alias("clean_name"))


@query(
    "has_short_basename",
    "SELECT id, length(regexp_replace(file_name, '\\.epub$', '')) < 10 AS short_name FROM books",
)
def _(lib):
    return lib.books.select("id", fn.has_short_basename(c("file_name")).alias("short_name"))


@query("metadata_filename", "SELECT id, wanted FROM wanted_names WHERE length(regexp_replace(file_name, '\\.epub$', '')) < 10")
def _(lib):
    short = lib.books.where(fn.has_short_basename(c("file_name")))
    name = fn.metadata_filename(c("title"), c("authors"), c("publisher"), fn.stem(c("file_name")))
    return short.select("id", fn.sanitize_filename(name).alias("wanted"))


@query("target_filename", f"SELECT id, wanted, wanted <> file_name AS needs_update FROM wanted_names")
def _(lib):
    wanted = fn.target_filename(c("file_name"), c("title"), c("authors"), c("publisher"))
    return lib.books.select("id", wanted.alias("wanted")).join(lib.books.select("id", "file_name"), "id").select(
        "id", "wanted", (c("wanted") != c("file_name")).alias("needs_update")
    )


_SIZE = """CASE WHEN s >= 1048576 THEN printf('%.2f MB', s / 1048576.0::DOUBLE)
    WHEN s >= 1024 THEN printf('%.1f KB', s / 1024.0::DOUBLE) ELSE s || ' B' END"""


@query("format_size", f"SELECT id, s, {_SIZE} AS size_text FROM (SELECT id, unnest([file_size, file_size * 997, file_size * 64]) AS s FROM books)")
def _(lib):
    sizes = lib.books.select("id", F.explode(F.array(c("file_size"), c("file_size") * 997, c("file_size") * 64)).alias("s"))
    return sizes.select("id", "s", display.format_size(c("s")).alias("size_text"))


@query(
    "format_published_date",
    """SELECT id, CASE WHEN p IS NULL OR trim(p) = '' THEN '' WHEN regexp_full_match(p, '\\d{4}') THEN p
         WHEN regexp_full_match(p, '\\d{4}-\\d{2}') THEN strftime(strptime(p || '-01', '%Y-%m-%d'), '%B %Y')
         WHEN regexp_full_match(p, '\\d{4}-\\d{2}-\\d{2}(T.*)?') THEN strftime(strptime(left(p, 10), '%Y-%m-%d'), '%-d %B %Y')
         ELSE p END AS shown FROM (SELECT id, published_date AS p FROM books)""",
)
def _(lib):
    return lib.books.select("id", display.format_published_date(c("published_date")).alias("shown"))


_SHARD = "lpad((id % 100)::VARCHAR, 2, '0')"


@query("cover_shard", f"SELECT id, {_SHARD} AS shard FROM books")
def _(lib):
    return lib.books.select("id", fn.cover_shard(c("id")).alias("shard"))


@query("cover_storage_path", f"SELECT id, '/srv/covers/' || {_SHARD} || '/' || id || '.jpg' AS place, '/srv/covers/' || {_SHARD} || '/' || id || '.png' AS bare FROM books")
def _(lib):
    return lib.books.select(
        "id",
        fn.cover_storage_path("/srv/covers/", c("id"), F.lit(".JPG")).alias("place"),
        fn.cover_storage_path("/srv/covers", c("id"), F.lit("png")).alias("bare"),
    )


@query("cover_relative_path", f"SELECT id, 'data/covers/' || {_SHARD} || '/' || id || '.png' AS place FROM books")
def _(lib):
    return lib.books.select("id", fn.cover_relative_path(c("id"), F.lit(".png")).alias("place"))


@query("cover_public_segment", "SELECT id, substr(cover_path, 13) AS segment FROM books")
def _(lib):
    return lib.books.select("id", fn.cover_public_segment(c("cover_path")).alias("segment"))


@query("is_flat_cover", "SELECT path, len(string_split(path, '/')) = 2 AS flat FROM covers")
def _(lib):
    return lib.covers.select("path", fn.is_flat_cover(c("path"), "covers").alias("flat"))


@query("cover_book_id", "SELECT path, book_id FROM cover_ids")
def _(lib):
    return lib.covers.select("path", fn.cover_book_id(c("path")).alias("book_id"))


@query(
    "cover_version",
    """SELECT b.id, coalesce((CASE WHEN v.path IS NOT NULL THEN v.doc_id + 1700000000 END)::VARCHAR,
         replace(replace(replace(last_scanned_at, ':', ''), '-', ''), '+', '')) AS version
       FROM books b LEFT JOIN (SELECT DISTINCT path, try_cast(regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS BIGINT) AS doc_id FROM covers) v
         ON 'data/' || v.path = b.cover_path""",
)
def _(lib):
    # a cover's modification time is its book's number of seconds after the epoch of the bindings
    dated = fs.with_cover_ids(lib.covers).select(
        F.concat(F.lit("data/"), "path").alias("cover_path"), (c("book_id") + 1_700_000_000).alias("seconds")
    )
    books = lib.books.select("id", "cover_path", "last_scanned_at")
    # books without a cover find nothing; a key of their own keeps them out of one task
    key = F.coalesce(c("cover_path"), F.concat(F.lit("\x00"), c("id").cast("string")))
    joined = books.join(dated.withColumnRenamed("cover_path", "dated_path"), key == c("dated_path"), "left")
    return joined.select("id", fn.cover_version(c("seconds"), c("last_scanned_at")).alias("version"))


@query("isbn_from_identifiers", "SELECT id, isbn FROM books")
def _(lib):
    return lib.identifiers.select("id", md.isbn_from_identifiers(c("identifiers")).alias("isbn"))


@query(
    "normalize_authors",
    f"""SELECT id, {clean_list("replace(authors, '; ', ' &  ')", '&', '; ')} AS listed,
        {clean_list('authors', ';', ' & ')} AS fetchable FROM books""",
)
def _(lib):
    amp = F.replace(c("authors"), F.lit("; "), F.lit(" &  "))
    return lib.books.select(
        "id", md.normalize_authors(amp).alias("listed"), md.authors_for_fetch(c("authors")).alias("fetchable")
    )


@query("first_language", "SELECT id, nullif(trim(language), '') AS first_language FROM books")
def _(lib):
    return lib.books.select("id", md.first_language(F.concat("language", F.lit(", mul"))).alias("first_language"))


@query("parse_series_index", "SELECT id, try_cast(trim(v) AS DOUBLE) AS number FROM (SELECT id, unnest([' ' || series_index || ' ', title, id || 'e-1']) AS v FROM books)")
def _(lib):
    raw = F.array(
        F.concat(F.lit(" "), c("series_index").cast("string"), F.lit(" ")), c("title"), F.concat(c("id").cast("string"), F.lit("e-1"))
    )
    return lib.books.select("id", F.explode(raw).alias("v")).select("id", md.parse_number(c("v")).alias("number"))


@query(
    "display_card",
    f"""SELECT id, coalesce(title, file_name) AS card_title, coalesce(authors, 'Unknown author') AS card_author,
        coalesce(series || ' #' || printf('%g', series_index), '') AS card_series,
        upper(format) AS card_format, {_SIZE} AS card_size FROM (SELECT *, file_size AS s FROM books)""",
)
def _(lib):
    card = display.display_card({n: c(n) for n in lib.books.columns})
    return lib.books.select("id", card.alias("card")).select("id", "card.*")


@query("languages_json", f"SELECT '[\"' || replace({_LANGUAGES}, ',', '\",\"') || '\"]' AS json_text, {_LANGUAGES} AS back")
def _(lib):
    text = stats.library_stats(lib.books).select(md.languages_to_json(c("languages")).alias("json_text"))
    return text.select("json_text", F.array_join(md.languages_from_json(c("json_text")), ",").alias("back"))


@query("resolve_href", "SELECT id, 'OEBPS/' || source || '/a b+' || id || '.xhtml' AS member FROM (SELECT doc_id AS id, source FROM documents)")
def _(lib):
    docs = lib.table("documents")
    href = F.concat(F.lit("../../../OEBPS/./x/../"), c("source"), F.lit("/a%20b+"), c("doc_id").cast("string"), F.lit(".xhtml"))
    return docs.select(c("doc_id").alias("id"), packages.resolve_href_column(F.lit("OEBPS/deep/content.opf"), href).alias("member"))


@query("is_blank", "SELECT id, language IS NULL OR trim(language) = '' AS blank FROM books")
def _(lib):
    return lib.books.select("id", tx.is_blank(c("language")).alias("blank"))


@query(
    "path_parts",
    """SELECT path, regexp_extract(path, '[^/]*$') AS base_name, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem,
       lower(regexp_extract(path, '\\.[^./]*$')) AS suffix, regexp_replace(path, '/[^/]*$', '') AS parent FROM inventory""",
)
def _(lib):
    p = c("path")
    return lib.files.select(
        "path", fn.base_name(p).alias("base_name"), fn.stem(p).alias("stem"),
        F.lower(fn.suffix(p)).alias("suffix"), fn.parent(p).alias("parent"),
    )


@query(
    "clean_field",
    "SELECT id, coalesce(nullif(trim(regexp_replace(description, '[\\s\\p{Z}]+', ' ', 'g')), ''), 'nothing') AS field FROM books",
)
def _(lib):
    return lib.spread_books.select("id", tx.clean_field(c("description"), F.lit("nothing")).alias("field"))


@query(
    "cover_candidates",
    f"""SELECT DISTINCT book_id, path FROM (SELECT id AS book_id, unnest(['covers/' || id || '.jpg', 'covers/' || id || '.jpeg', 'covers/' || id || '.png',
        'covers/' || {_SHARD} || '/' || id || '.jpg', 'covers/' || {_SHARD} || '/' || id || '.jpeg', 'covers/' || {_SHARD} || '/' || id || '.png']) AS path
        FROM books WHERE is_missing) WHERE path IN (SELECT path FROM covers)""",
)
def _(lib):
    return reconcile.cover_removals(lib.covers, lib.books.where("is_missing"), "covers")
