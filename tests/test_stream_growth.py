"""A store that grows by streams: what a batch writes, and how often its files are made."""

from __future__ import annotations

import random
import re
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from shelfmark.functions.text import token_string
from shelfmark.operators import stats
from shelfmark.plans import registry
from shelfmark.plans.bindings import Library, make_package
from shelfmark.schema import BOOKS
from shelfmark.sources import packages, shelves
from shelfmark.streaming.arrivals import merge_arrivals


def package(title: str, text: str = "text") -> bytes:
    return make_package(9, title, "Some One", "en", "9780000000001", "1.5", text)


def _written(spark, store) -> int:
    """Rows that this version wrote."""
    return spark.read.schema("id long").parquet(store._at("rows")).count()


def test_new_rows_are_parts_beside_the_others(spark, make_books, tmp_path):
    books = make_books(*[dict(id=i, title=f"Book {i}", language="en") for i in range(1, 41)])
    nothing = books.where("id < 0")
    first = shelves.create(books, str(tmp_path), 3, buckets=4)
    second = first.change(nothing, make_books(*[dict(id=i, title="New", language="fr") for i in range(41, 45)]))
    # the rows that were there are not written again
    assert _written(spark, second) == 4
    assert sum(len(parts) for parts in second.parts().values()) > 4
    assert sorted(r.id for r in second.books().collect()) == list(range(1, 45))
    assert second.stored().where("id = 41").first().tok_title == " new"
    assert sum(entry[1] for entry in second.listed().values()) == 44 and max(entry[2] for entry in second.listed().values()) == 44
    # a changed row makes one part of its bucket, rows that come twice stay two
    bucket = second.stored().where("id = 41").first().bucket
    edited = second.books().where("id = 41").withColumn("title", F.lit("Newer"))
    third = second.change(second.books().where("id = 41"), edited.unionByName(edited))
    assert list(third.parts()[bucket]) == [5] and _written(spark, third) == third.listed()[bucket][1]
    assert {b: p for b, p in third.parts().items() if b != bucket} == {b: p for b, p in second.parts().items() if b != bucket}
    assert sorted(r.id for r in third.books().collect()) == sorted([*range(1, 45), 41])
    assert [r.tok_title for r in third.stored().where("id = 41").collect()] == [" newer"] * 2
    for store in (first, second, third):
        assert store.stats().collect() == stats.library_stats(store.books()).collect()


def test_parts_of_a_bucket_stay_few(spark, make_books, tmp_path):
    store = shelves.create(make_books(dict(id=1)), str(tmp_path), 0, buckets=1)
    nothing, written = make_books(dict(id=1)).where("id < 0"), 0
    for i in range(2, 9):
        store = store.change(nothing, make_books(dict(id=i)))
        written += _written(spark, store)
    # the sizes are those of a binary counter; with the whole bucket each time 35 rows would be written
    assert list(store.parts()[0].values()) == [8] and written == 2 + 1 + 4 + 1 + 2 + 1 + 8
    assert sorted(r.id for r in store.books().collect()) == list(range(1, 9))


def test_a_new_store_is_written_without_an_exchange(make_books):
    plan = shelves._fresh(make_books(*[dict(id=i, title="T") for i in range(9)]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_of_a_batch_are_made_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder, one, other = str(calls), package("One"), package("Other")

    @F.pandas_udf(BinaryType())
    def body(path: pd.Series) -> pd.Series:
        for p in path:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(p)
        return path.map({"/lib/a.epub": one, "/lib/b.epub": other, "/lib/copy of a.epub": one, "/lib/bad.epub": b"no zip"}.get)

    shelves.create(spark.createDataFrame([], BOOKS), f"{tmp_path}/catalog", 0, buckets=2)
    paths = ["/lib/a.epub", "/lib/b.epub", "/lib/copy of a.epub", "/lib/bad.epub", "/lib/gone.epub"]
    spark.createDataFrame([(p, 3) for p in paths], "path string, file_size long").write.parquet(f"{tmp_path}/landed")
    landed = spark.readStream.schema("path string, file_size long").parquet(f"{tmp_path}/landed")
    arrivals = landed.select("path", "file_size", F.timestamp_seconds(F.lit(1)).alias("file_mtime"), body("path").alias("content"))
    merge_arrivals(arrivals, f"{tmp_path}/catalog", f"{tmp_path}/progress", "now").awaitTermination()
    assert sorted(p.read_text() for p in calls.iterdir()) == sorted(paths)
    found = shelves.Shelves(spark, f"{tmp_path}/catalog").books().collect()
    assert sorted(r.title for r in found) == ["One", "Other"] and all(r.file_size == 3 for r in found)


def test_inspection_beside_other_columns_equals_inspection(spark):
    rows = [("a", package("A", "B & C"), 1), ("b", b"no zip", None), ("c", b"", 3), ("d", None, 4), (None, package("E"), 5)]
    files = spark.createDataFrame(rows, "path string, content binary, n long")
    both = packages.with_inspection(files)
    assert both.columns == ["path", "n", *packages.inspect_packages(files).columns[1:]]
    assert sorted(map(str, both.drop("n").collect())) == sorted(map(str, packages.inspect_packages(files).collect()))
    assert sorted((r.path or "", r.n) for r in both.collect()) == sorted((p or "", n) for p, _, n in rows)


def test_documents_land_in_many_files(spark, tmp_path):
    docs = [(i, f"Title {i}\nwords of {i}", "en", "src1", 20) for i in range(48)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    store, again = registry._streamed(Library(spark, str(tmp_path)))
    folder = store.root.removesuffix("/catalog") + "/landed"
    files = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name")).agg(F.collect_set(F.pmod("doc_id", F.lit(2))).alias("halves")).collect()
    assert len(files) > 2 and all(len(r.halves) == 1 for r in files)
    assert store.version == 5 and again().version == 5
    # the sound ones of each half: 6, 8 and 10, and 5, 9 and 11 of twelve
    counts = [shelves.Shelves(spark, store.root, v).books().count() for v in (3, 4, 5)]
    assert counts == [48, 48 + 12, 48 + 24]


def test_words_of_texts_of_single_bytes(spark):
    """Texts of single bytes take a way of their own; with a letter of two bytes at the end they do not."""
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(128), 32, 97])) for _ in range(rng.randrange(9))) for _ in range(300)]
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", token_string(F.col("t")).alias("own"), token_string(F.concat("t", F.lit(" é"))).alias("other")
    )
    for r in words.collect():
        wanted = "".join(f" {w}" for w in re.findall("[a-z0-9]+", r.t.lower()))
        assert (r.own, r.other) == (wanted or " ", wanted + " e")
