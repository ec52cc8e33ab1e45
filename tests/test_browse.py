import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import browse, search, stats
from shelfmark.operators.search import BrowseContext
from shelfmark.session import cut_lineage


@pytest.fixture(scope="module")
def shelf(make_books):
    rows = []
    for i in range(1, 41):
        rows.append(
            dict(
                id=i, title=["Alpha", "beta", "Éclair", None, "Beta"][i % 5], authors=[None, "zoe", "Adam Vall", "adam"][i % 4],
                published_date=[None, "1999", "2001-02"][i % 3], page_count=[None, 10, 20, 10][i % 4],
                file_size=i % 7, last_scanned_at=f"2024-01-0{i % 3 + 1}", language=["en", "fr"][i % 2],
                publisher="Éditions Nord", tags="prose, old", is_missing=i % 13 == 0,
            )
        )
    return cut_lineage(make_books(*rows))


def ids(df):
    return [r.id for r in df.select("id").collect()]


SORTS = ["title", "author", "published", "size", "pages", "scanned", "no such sort"]


@pytest.mark.parametrize("sort,way", list(itertools.product(SORTS, ["asc", "desc"])))
def test_keyset_pages_equal_offset_pages(shelf, sort, way):
    view = search.visible(shelf)
    whole = ids(view.orderBy(*browse.ordering(browse.sort_keys(sort, way))))
    assert len(whole) == 37
    for at in (0, 9, 20, 36):
        anchor = whole[at]
        assert ids(browse.page_after(shelf, view, anchor, sort, way, 10)) == whole[at + 1 : at + 11]
        assert ids(browse.page_before(shelf, view, anchor, sort, way, 10)) == whole[max(0, at - 10) : at]
    assert ids(browse.page_offset(view, sort, way, 2, 10)) == whole[10:20]
    placed = {r.id: r for r in browse.positions(view, sort, way, partitions=5).collect()}
    for n, book in enumerate(whole):
        want = (n + 1, whole[n - 1] if n else None, whole[n + 1] if n + 1 < len(whole) else None)
        assert (placed[book].position, placed[book].prev_id, placed[book].next_id) == want


def test_null_places(shelf):
    view = search.visible(shelf)
    for way in ("asc", "desc"):
        rows = view.orderBy(*browse.ordering(browse.sort_keys("pages", way))).collect()
        assert rows[-1].page_count is None and rows[0].page_count is not None
    asc = view.orderBy(*browse.ordering(browse.sort_keys("author", "asc"))).collect()
    assert asc[0].authors is None and asc[-1].authors is not None


def test_neighbors(make_books):
    books = make_books(dict(id=1, title="Alpha"), dict(id=2, title="Beta"), dict(id=3, title="Gamma", language="fr"))

    def near(book, **ctx):
        return tuple(browse.neighbors(books, book, BrowseContext(**ctx)).collect()[0])

    assert near(2) == (1, 3)
    assert near(1) == (None, 2)
    assert near(2, sort_dir="desc") == (3, 1)
    assert near(2, language="fr") == (None, None)
    assert near(2, sort="random") == (None, None)


def test_browse_counts(make_books):
    books = cut_lineage(make_books(*[dict(id=i, title=f"Book {i:02d}", authors="Eric Vall", language="en") for i in range(1, 16)]))
    figures = stats.library_stats(books)

    def run(**kw):
        anchors = {k: kw.pop(k) for k in ("after_id", "before_id", "exact_count") if k in kw}
        rows, summary = browse.browse(books, BrowseContext(page_size=10, **kw), figures, **anchors)
        return ids(rows), summary.collect()[0]

    found, s = run(author="eric vall")
    assert found == list(range(1, 11)) and (s.filtered_count, s.count_exact) == (10, False)
    found, s = run(author="eric vall", page=2)
    assert found == [11, 12, 13, 14, 15] and (s.filtered_count, s.count_exact, s.page) == (15, True, 2)
    found, s = run()
    assert (s.filtered_count, s.library_total, s.count_exact, s.languages) == (15, 15, True, ["en"])
    found, s = run(page=9)
    assert found == [] and s.page == 2
    found, s = run(author="vall", exact_count=True)
    assert (s.filtered_count, s.count_exact) == (15, True)
    assert run(after_id=10, page=2)[0] == [11, 12, 13, 14, 15]
    assert run(before_id=11)[0] == list(range(1, 11))
    assert run(after_id=99, before_id=11)[0] == list(range(1, 11))
    assert run(after_id=99)[0] == list(range(1, 11))
    found, s = run(sort="random", title="book")
    assert len(found) == 10 and (s.filtered_count, s.count_exact) == (10, False)
    found, s = run(sort="random", author="vall")
    assert (s.filtered_count, s.count_exact) == (15, True)


def test_filters(shelf):
    def found(**ctx):
        return set(ids(search.browse_filter(shelf, BrowseContext(**ctx))))

    everything = found()
    assert found(title="ECL") == set(ids(search.visible(shelf).where("title = 'Éclair'")))
    assert found(publisher="editions", genre="pro ol") == everything
    assert found(title=".") == set()
    assert found(title='"') == set()  # falls back to a substring nobody has
    assert found(title='"', publisher="nord") == everything
    assert found(author="a'va") == set(ids(search.visible(shelf).where("authors = 'Adam Vall'")))
    assert found(author="!!") == everything and BrowseContext(author="!!").is_filtered
    assert found(language="EN") == set()


def test_author_index(shelf, spark):
    index = search.author_index(shelf)
    hits = search.books_with_author_words(index, "adam va")
    assert {r.book_id for r in hits.collect()} == set(ids(shelf.where("authors = 'Adam Vall'")))
    changed = shelf.where("id = 2").withColumn("authors", F.lit("New Name"))
    after = search.sync_author_index(index, changed)
    assert {r.token for r in after.where("book_id = 2").collect()} == {"new", "name"}
    assert after.where("book_id <> 2").count() == index.where("book_id <> 2").count()


def test_context_defaults():
    ctx = BrowseContext(sort="size", page="x", page_size="33").normalized()
    assert (ctx.sort_dir, ctx.page, ctx.page_size) == ("desc", 1, 100)
    assert BrowseContext(page="3", page_size="50", sort_dir="up").normalized().page == 3


def test_stats(make_books, spark):
    books = make_books(dict(id=1, language="fr"), dict(id=2, language="en"), dict(id=3, language=" "), dict(id=4, language="de", is_missing=True))
    row = stats.library_stats(books).collect()[0]
    assert (row.library_total, row.languages) == (3, ["en", "fr"])
    none = stats.stats_snapshot(books).where("false")
    assert stats.read_stats(none, books).collect()[0] == row
    old = spark.createDataFrame([(1, 99, '["x"]')], "id int, library_total long, languages string")
    assert tuple(stats.read_stats(old, books).collect()[0]) == (99, ["x"])


def test_plans(lib, spark, tmp_path):
    """No cross product and no Python on the browse path; a page is a top-k, filters reach the scan."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    stored = search.with_search_columns(lib.books).limit(0)
    folder = str(tmp_path)
    stored.write.mode("overwrite").parquet(folder)
    books = spark.read.parquet(folder)
    ctx = BrowseContext(title="the", author="a", language="fr", page_size=25)
    rows, _ = browse.browse_rows(books, ctx)
    plan = browse.list_view(rows)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Cartesian" not in plan
    assert "EqualTo(language,fr)" in plan and "description" not in plan
    after = browse.page_after(books, search.visible(books), 3, "size", "", 25)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "NestedLoop" not in plan
