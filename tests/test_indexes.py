"""Stored word postings, author words, keys and marks answer like a scan of the books."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import browse, search
from shelfmark.operators.postings import Term, books_with_terms, build_postings, phrases, sync_postings
from shelfmark.operators.search import BrowseContext
from shelfmark.sources import catalog

STEP = 7


def ids(df):
    return [r.id for r in df.select("id").collect()]


@pytest.fixture(scope="module")
def stored(spark, make_books, tmp_path_factory):
    """150 books in many small files, their words few, so that they often meet."""
    rng = random.Random(11)
    words = ["the", "sea", "seas", "Éa", "of", "world", "wor", "a", "l'été", "x-ray", "THE", "_b_", "12"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n))) or None
    rows = [
        dict(
            id=i * 3, title=text(6), sort_title=text(4), authors=rng.choice([None, "Eric Vall", "Vall; Ann O'Ve", "ánn_ _x"]), publisher=text(3),
            description=text(30), tags=text(4), language=rng.choice(["en", "fr", None]), page_count=rng.choice([None, 10, 20]),
            published_date=rng.choice([None, "1999", "2001"]), file_size=rng.randrange(4), last_scanned_at=f"2024-01-0{rng.randrange(1, 4)}",
            is_missing=rng.random() < 0.1,
        )
        for i in range(1, 151)
    ]
    root = str(tmp_path_factory.mktemp("stored"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    catalog.write_catalog(make_books(*rows), root, 3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    catalog.write_indexes(spark, root, step=STEP)
    return catalog.Snapshot(spark, root)


ASKED = [
    dict(title="the"), dict(title="th sea"), dict(title='the "sea'), dict(title="sea.of"), dict(title="the-the"), dict(title="l'été"), dict(title="L'et"),
    dict(title="of.the.s"), dict(title="."), dict(title='"'), dict(title="wor", genre="a"), dict(publisher="x-r", language="fr"),
    dict(author="vall"), dict(author="va er"), dict(author="!!"), dict(author="o'v", title="e"), dict(author="ánn_"), dict(title="12 b"), dict(),
    dict(title="nothing"), dict(title='"', publisher="the"), dict(genre='*"'),
]


@pytest.mark.parametrize("asked", ASKED, ids=str)
def test_indexes_agree_with_scan(stored, asked):
    ctx = BrowseContext(**asked)
    want = sorted(ids(search.browse_filter(stored.books, ctx)))
    assert sorted(ids(search.browse_filter(stored.books, ctx, indexes=stored.shelf.indexes))) == want


def test_indexes_with_favorites_and_joins(spark, stored, monkeypatch):
    liked = spark.createDataFrame([(7, i) for i in range(0, 460, 6)] + [(8, 3), (7, 6)], "user_id long, book_id long")
    for asked in (dict(title="the"), dict(), dict(author="vall", language="en")):
        ctx = BrowseContext(favorites_only=True, **asked)
        want = sorted(ids(search.browse_filter(stored.books, ctx, liked, 7)))
        assert sorted(ids(search.browse_filter(stored.books, ctx, liked, 7, stored.shelf.indexes))) == want
    # more hits than are taken to the driver: a join
    monkeypatch.setattr(search, "KEPT_IDS", 3)
    ctx = BrowseContext(title="the")
    found = search.browse_filter(stored.books, ctx, indexes=stored.shelf.indexes)
    assert sorted(ids(found)) == sorted(ids(search.browse_filter(stored.books, ctx)))
    assert "Join" in found._jdf.queryExecution().executedPlan().toString()


def test_phrases():
    assert phrases('the "sea of* x-ray . "') == [("the",), ("sea",), ("of",), ("x", "ray"), ()]


def test_postings_hold_every_word(stored):
    rows = build_postings(stored.books, ("title", "description")).collect()
    got = {(r.book_id, r.field, place): r.token for r in rows for place in r.positions}
    want = {}
    for r in stored.books.select("id", "tok_title", "tok_description").collect():
        for field in ("title", "description"):
            want.update({(r.id, field, i): w for i, w in enumerate(r[f"tok_{field}"].split())})
    assert got == want and len(got) > 500
    assert stored.postings.where("field in ('title', 'description')").count() == len(rows)


def test_postings_sync(spark, stored):
    changed = stored.books.where("id = 9").withColumn("tok_title", F.lit(" brand new"))
    after = sync_postings(stored.postings, changed)
    assert [r.book_id for r in books_with_terms(after, [Term(("title",), ("brand", "ne"))]).collect()] == [9]
    assert after.where("book_id <> 9").count() == stored.postings.where("book_id <> 9").count()
    assert books_with_terms(after, []).count() == after.select("book_id").distinct().count()


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_ranges_reach_the_scan(stored):
    """A request reads word ranges of the index, never the word strings of the books."""
    hits = _plan(stored.shelf.indexes.hits(BrowseContext(title="sea", author="va er")))
    assert "StringStartsWith(token,sea)" in hits and "StringStartsWith(token,va)" in hits and "StringStartsWith(token,er)" in hits
    phrase = _plan(books_with_terms(stored.postings, [Term(("title",), ("the", "se"))]))
    assert "EqualTo(token,the)" in phrase and "StringStartsWith(token,se)" in phrase and "Python" not in phrase
    found = _plan(search.browse_filter(stored.books, BrowseContext(title="sea"), indexes=stored.shelf.indexes))
    assert "tok_title" not in found.split("ReadSchema")[-1] or "Contains" not in found


def _scanned(df):
    """Files and rows the last book scan of a query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.apply(0)
    metrics = leaf.metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_lookup_reads_one_row_group(stored):
    """One of 64 files, and in it the rows of one row group."""
    files = stored.books.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 40
    one = stored.rows_of([90])
    assert ids(one) == [90]
    number, rows = _scanned(one)
    assert number == 1 and rows <= max(f["count"] for f in files)
    assert sorted(ids(stored.rows_of([3, 450, 90, 4]))) == [3, 90, 450]
    assert ids(stored.rows_of([])) == [] and ids(stored.rows_of([5])) == []


@pytest.mark.parametrize("sort,way", list(itertools.product(browse.SORTS, ["asc", "desc"])))
def test_marked_pages_equal_offset_pages(stored, sort, way):
    view = search.visible(stored.books)
    whole = ids(view.orderBy(*browse.ordering(browse.sort_keys(sort, way))))
    marks = stored.marks(sort, way)
    assert marks.count() == -(-len(whole) // STEP)
    for page, size in ((1, 10), (2, 10), (5, 25), (3, 3), (len(whole) // 10 + 1, 10), (999, 10)):
        got = ids(browse.page_by_marks(view, marks, sort, way, page, size))
        assert got == whole[(page - 1) * size : page * size]


def test_deep_page_sorts_only_between_marks(stored):
    rows, how = browse.browse_rows(stored.books, BrowseContext(page=12, page_size=10), shelf=stored.shelf)
    assert how == "marks"
    plan = _plan(rows)
    assert "GreaterThanOrEqual(title_key" in plan and "LessThanOrEqual(title_key" in plan
    skipped = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" in skipped and "110" not in skipped.split("Offset")[1][:8]
    _, how = browse.browse_rows(stored.books, BrowseContext(page=2, page_size=10, title="the"), shelf=stored.shelf)
    assert how == "offset"


def test_browse_over_a_snapshot(spark, stored):
    figures = spark.range(1).select(F.lit(150).cast("long").alias("library_total"), F.array(F.lit("en")).alias("languages"))
    for ctx in (BrowseContext(page=3, page_size=10), BrowseContext(title="the", page_size=10), BrowseContext(author="vall", sort="size", page=2, page_size=10)):
        with_shelf = browse.browse(stored.books, ctx, figures, shelf=stored.shelf)
        without = browse.browse(stored.books, ctx, figures)
        assert ids(with_shelf[0]) == ids(without[0]) and with_shelf[1].collect() == without[1].collect()
    whole = ids(search.visible(stored.books).orderBy(*browse.ordering(browse.sort_keys("pages"))))
    ctx = BrowseContext(sort="pages", page_size=10)
    rows, how = browse.browse_rows(stored.books, ctx, after_id=whole[20], shelf=stored.shelf)
    assert how == "after" and ids(rows) == whole[21:31]
    near = browse.neighbors(stored.books, whole[20], ctx, shelf=stored.shelf).collect()[0]
    assert tuple(near) == (whole[19], whole[21])


def test_complete_versions_are_never_written_again(spark, make_books, tmp_path):
    root, books = str(tmp_path), make_books(dict(id=1, title="One"))
    target = catalog.write_catalog(books, root, 2)
    with pytest.raises(FileExistsError):
        catalog.write_catalog(books.limit(0), root, 2)
    assert catalog.read_catalog(spark, root)[0].count() == 1
    # what a failed attempt left is replaced
    (tmp_path / "v=00000002" / "authors" / "_SUCCESS").unlink()
    assert catalog.latest_version(spark, root) is None
    assert catalog.write_catalog(books, root, 2) == target and catalog.latest_version(spark, root) == 2


def test_empty_library(spark, make_books, tmp_path):
    catalog.write_catalog(make_books(dict(id=1)).limit(0), str(tmp_path), 0)
    catalog.write_indexes(spark, str(tmp_path), sorts=("title",))
    snapshot = catalog.Snapshot(spark, str(tmp_path))
    assert ids(search.browse_filter(snapshot.books, BrowseContext(title="x"), indexes=snapshot.shelf.indexes)) == []
    assert ids(snapshot.rows_of([1])) == []
    assert ids(browse.browse_rows(snapshot.books, BrowseContext(page=2), shelf=snapshot.shelf)[0]) == []
    assert snapshot.marks("size") is None


def test_postings_of_repeated_and_null_ids(spark):
    from shelfmark.operators import postings

    rows = [(1, " a b a", " x"), (1, " a", None), (2, " b", " "), (None, " a", " x y"), (None, " c a", " x"), (3, " ", " z")]
    books = spark.createDataFrame(rows, "id long, tok_title string, tok_tags string")
    want = sorted([
        ("a", "title", 1, [0, 0, 2]), ("b", "title", 1, [1]), ("x", "tags", 1, [0]), ("b", "title", 2, [0]), ("z", "tags", 3, [0]),
        ("a", "title", None, [0, 1]), ("c", "title", None, [0]), ("x", "tags", None, [0, 0]), ("y", "tags", None, [1]),
    ], key=str)
    columns = ("title", "tags")
    for found in (postings.build_postings(books, columns), postings.postings_of(postings.posting_blocks(books, columns))):
        assert sorted([tuple(r) for r in found.select("token", "field", "book_id", "positions").collect()], key=str) == want


def test_postings_are_not_regrouped(stored):
    """Words are gathered where their book is, and stored by blocks: fewer rows than postings."""
    assert "Exchange" not in _plan(build_postings(stored.books))
    blocks = stored.spark.read.parquet(f"{stored.folder}/postings")
    assert blocks.count() < stored.postings.count() == blocks.agg(F.sum(F.size("ids"))).first()[0]
