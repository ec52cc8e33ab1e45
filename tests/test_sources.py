import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import reconcile, stats
from shelfmark.plans import jobs
from shelfmark.plans.bindings import make_image, make_package, make_png
from shelfmark.schema import BOOKS
from shelfmark.sources import catalog, files as fs, images, packages, shelves
from shelfmark.streaming.arrivals import merge_arrivals, read_arrivals


def package(title="A Title", fault=9):
    return make_package(fault, title, "Some One", "en", "9780000000001", "1.5", "text")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    (root / "deep").mkdir(parents=True)
    (root / "one.epub").write_bytes(package("One"))
    (root / "deep" / "two.EPUB").write_bytes(package("Two"))
    (root / "deep" / "broken.epub").write_bytes(b"no zip")
    (root / "note.txt").write_text("x")
    return root


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_inventory(spark, tree):
    found, errors = fs.inventory(spark, [str(tree), str(tree / "deep"), str(tree / "absent")])
    assert names(found) == ["broken.epub", "one.epub", "two.EPUB"]
    assert [r.detail for r in errors.collect()] == ["path not found"]
    assert names(fs.inventory(spark, [str(tree / "one.epub")])[0]) == ["one.epub"]
    assert fs.inventory(spark, [str(tree / "absent")])[0].count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    by_path = fs.with_content_hash(found).select("path", "content_hash")
    by_bytes = fs.with_content_hash(fs.inventory(spark, [str(tree)], content=True)[0]).select("path", "content_hash")
    assert sorted(by_path.collect()) == sorted(by_bytes.collect())


def test_inspection(spark):
    data = {
        "ok": package(), "empty": b"", "zip": b"nope", "spine": package(fault=0), "container": package(fault=2),
        "ref": package(fault=3), "markup": package(fault=4), "type": package(fault=5), "plain": package(None),
    }
    broken = bytearray(package())
    broken[broken.index(b"OEBPS/chapter") + 40] ^= 0xFF
    data["crc"] = bytes(broken)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container")
    data["xml"] = out.getvalue()
    df = spark.createDataFrame([(f"/lib/{k}.epub", bytearray(v)) for k, v in data.items()], "path string, content binary")
    inspected = packages.inspect_packages(df)
    got = {r.path[5:-5]: r for r in packages.validation(inspected).collect()}
    assert got["ok"].ok and got["ok"].errors == [] and got["ok"].warnings == []
    assert got["empty"].errors == ["file is empty"]
    assert got["zip"].errors == ["not a ZIP archive"]
    assert got["spine"].errors == ["OPF spine is empty"]
    assert got["container"].errors == ["missing META-INF/container.xml"]
    assert got["ref"].errors == ["spine itemref missing from manifest: lost", "spine has no readable HTML/XHTML content"]
    assert got["markup"].errors[0].startswith("invalid spine markup in OEBPS/chapter 1.xhtml")
    assert got["type"].ok and got["type"].warnings == ["unexpected mimetype: 'text/plain'"]
    assert not got["crc"].ok and "corrupt ZIP" in got["crc"].errors[0]
    assert got["xml"].errors[0].startswith("invalid container.xml") and got["xml"].warnings == ["missing mimetype"]
    meta = {r.path[5:-5]: r for r in packages.metadata(inspected).collect()}
    ok = meta["ok"]
    assert (ok.title, ok.authors, ok.isbn, ok.series, ok.series_index, ok.tags) == (
        "A Title", "Some One; Second Hand", "9780000000001", "Shelf", 1.5, "prose, letters",
    )
    assert meta["plain"].title == "plain" and meta["zip"].title == "zip"


def test_covers(spark):
    big = {
        "text": make_image(0, 120, 110, "abc é" * 50), "white": make_png(120, 110, b"x", 1), "jpeg": make_image(2, 300, 200, ""),
        "gif": make_image(3, 99, 400, ""), "none": make_image(4, 0, 0, ""), "tiny": make_image(5, 500, 500, ""),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in big.items()], "path string, content binary")
    got = {r.path: (r.width, r.height, r.usable, r.reason) for r in images.screen_covers(df).collect()}
    assert got == {
        "text": (120, 110, True, None), "white": (120, 110, False, "near white"), "jpeg": (300, 200, True, None),
        "gif": (99, 400, False, "too small"), "none": (None, None, False, "unknown format"), "tiny": (500, 500, False, "too few bytes"),
    }


def test_png_filters_restore_every_pixel():
    """The same picture under each scan-line filter has the same luminance."""
    import random
    import struct
    import zlib

    rng = random.Random(1)
    width, height, step = 7, 6, 3
    pixels = [[rng.randrange(256) for _ in range(width * step)] for _ in range(height)]

    def paeth(a, b, c):
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    def encode(kind):
        out = b""
        for y, row in enumerate(pixels):
            above = pixels[y - 1] if y else [0] * len(row)
            line = []
            for i, v in enumerate(row):
                left, corner = (row[i - step], above[i - step]) if i >= step else (0, 0)
                guess = [0, left, above[i], (left + above[i]) // 2, paeth(left, above[i], corner)][kind]
                line.append((v - guess) & 255)
            out += bytes([kind, *line])
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
        header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")

    grey = [sum(row[i : i + 3]) // 3 for row in pixels for i in range(0, len(row), 3)]
    want = (sum(grey) / len(grey), sum(g >= 235 for g in grey) / len(grey), sum(g < 80 for g in grey) / len(grey))
    for kind in range(5):
        assert images.png_luminance(encode(kind)) == want


def test_scan_twice_and_snapshots(spark, tree, tmp_path):
    empty = spark.createDataFrame([], BOOKS)
    found, _ = fs.inventory(spark, [str(tree)])
    first = jobs.scan_job(empty, found, [str(tree)], "t1", validate=True)
    status = {os.path.basename(r.path): (r.status, r.detail) for r in first.actions.collect()}
    assert status == {"one.epub": ("to_index", None), "two.EPUB": ("to_index", None), "broken.epub": ("invalid", "not a ZIP archive")}
    root = str(tmp_path / "catalog")
    assert catalog.latest_version(spark, root) is None
    catalog.write_catalog(first.books, root, 1)
    assert catalog.latest_version(spark, root) == 1
    books, index = catalog.read_catalog(spark, root)
    assert sorted(r.title for r in books.collect()) == ["One", "Two"]
    assert all(r.epub_validated for r in books.collect())
    assert {r.token for r in index.collect()} == {"some", "one", "second", "hand"}
    plain = catalog.plain(books)
    again = reconcile.classify(found.where(~F.col("path").contains("broken")), plain)
    assert {r.status for r in again.collect()} == {"unchanged"}
    os.remove(tree / "one.epub")
    later, _ = fs.inventory(spark, [str(tree)])
    second = jobs.scan_job(plain, later, [str(tree)], "t2", validate=True)
    assert {r.title: r.is_missing for r in second.books.collect()} == {"One": True, "Two": False}
    assert second.summary.collect()[0].marked_missing == 1


def test_integrity_and_cleanup(lib, spark):
    covers = fs.with_cover_ids(lib.covers)
    result = jobs.integrity_job(lib.books, lib.packages, covers, ["/lib"])
    bad = {r.path: r for r in result.invalid.collect()}
    queue = {r.path for r in reconcile.validation_queue(lib.books, lib.packages, ["/lib"]).collect()}
    assert set(bad) <= queue and bad
    before = {r.file_path for r in lib.books.where("epub_validated").collect()}
    after = {r.file_path for r in result.books.where("epub_validated").collect()}
    indexed = {r.file_path for r in lib.books.collect()}
    assert after == before | ((queue - set(bad)) & indexed)
    removals = {(r.op, r.path) for r in result.removals.collect()}
    assert {path for op, path in removals if op == "delete"} == set(bad)
    with pytest.raises(ValueError):
        jobs.cleanup_run(lib.books, lib.inventory, covers, lib.directories, ["/lib"], "t", force_clean=True)


def test_validation_goes_on_where_it_stopped(spark, make_files, tmp_path, monkeypatch):
    """Stopped after its first commit, a second run opens only the rest; a changed file is opened again."""
    from shelfmark.sources import packages as pk

    opened = tmp_path / "opened"
    opened.mkdir()
    real = pk.inspect_packages

    def counting(files):
        # the paths each call opens, as files of their own
        paths = [r.path for r in files.select("path").collect()]
        (opened / f"{len(list(opened.iterdir()))}").write_text("\n".join(paths))
        if len(list(opened.iterdir())) == stop_at:
            raise RuntimeError("stopped")
        return real(files)

    monkeypatch.setattr(jobs.packages, "inspect_packages", counting)
    files = make_files(*[(f"/lib/{i}.epub", package(str(i)) if i % 3 else b"no zip") for i in range(30)])
    due = files.drop("content")
    progress = str(tmp_path / "progress")
    stop_at = 3
    with pytest.raises(RuntimeError):
        jobs.checked_files(due, files, progress, 8)
    stop_at = -1
    got = {r.path: r.ok for r in jobs.checked_files(due, files, progress, 8).collect()}
    assert got == {f"/lib/{i}.epub": i % 3 != 0 for i in range(30)}
    calls = [p.read_text().split() for p in sorted(opened.iterdir(), key=lambda p: int(p.name))]
    lost = calls.pop(2)
    seen = [path for paths in calls for path in paths]
    assert sorted(seen) == sorted(got) and len(lost) > 0
    assert jobs.checked_files(due, files, progress, 8).count() == 30 and len(list(opened.iterdir())) == len(calls) + 1
    changed = due.withColumn("file_size", F.when(F.col("path") == "/lib/4.epub", F.lit(1)).otherwise(F.col("file_size")))
    assert jobs.checked_files(changed, files, progress, 8).count() == 30
    assert (opened / str(len(calls) + 1)).read_text().split() == ["/lib/4.epub"]
    assert jobs.checked_files(due.limit(0), files, str(tmp_path / "none"), 8).count() == 0


def test_executed_cleanup_leaves_nothing_to_do(make_books, spark):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    data = {
        "/lib/a/Kim.epub": package("Kim"), "/lib/b/kim copy, longer.epub": package("Kim"), "/lib/b/brand new file.epub": package("New"),
        "/lib/c/a sound long name.epub": package("Sound"),
    }
    files = spark.createDataFrame([(p, len(d), day, bytearray(d)) for p, d in data.items()], "path string, file_size long, file_mtime timestamp, content binary")
    books = make_books(
        dict(id=1, file_path="/lib/a/Kim.epub", title="Kim", authors="Rudyard Kipling", publisher="Penguin", description="<b>x</b>"),
        dict(id=2, file_path="/lib/gone/absent file.epub", title="Gone"),
        dict(id=3, file_path="/lib/c/a sound long name.epub", title="Sound"),
    )
    covers = fs.with_cover_ids(spark.createDataFrame([("covers/1.jpg",), ("covers/2.jpg",), ("covers/x.jpg",)], "path string"))
    dirs = spark.createDataFrame([("/lib/a",), ("/lib/gone",)], "path string")
    run = jobs.cleanup_run(books, files, covers, dirs, ["/lib"], "t", execute=True, force_clean=True)
    ops = sorted((r.op, r.book_id, r.from_path, r.to_path) for r in run.plan.na.fill("-").na.fill(-1).collect())
    assert ops == [
        ("backfill", 1, "-", "-"), ("backfill", 3, "-", "-"),
        ("delete", -1, "/lib/b/kim copy, longer.epub", "-"),
        ("index", -1, "/lib/b/brand new file.epub", "-"),
        ("prune", -1, "/lib/gone", "-"),
        ("purge", 2, "/lib/gone/absent file.epub", "-"),
        ("remove_cover", -1, "covers/x.jpg", "-"), ("remove_cover", 2, "covers/2.jpg", "-"),
        ("rename", 1, "/lib/a/Kim.epub", "/lib/a/Kim - Rudyard Kipling-(Penguin).epub"),
        ("strip", 1, "-", "-"),
    ]
    state = {r.id: (r.file_name, r.title, r.description) for r in run.books.collect()}
    assert state == {
        1: ("Kim - Rudyard Kipling-(Penguin).epub", "Kim", "x"), 3: ("a sound long name.epub", "Sound", None),
        4: ("brand new file.epub", "New", None),
    }
    counted = run.summary.collect()[0]
    assert (counted.files_deleted, counted.rows_indexed, counted.rows_purged, counted.covers_removed, counted.errors) == (1, 1, 1, 2, 0)


def test_cleanup_validates_when_asked(make_books, spark):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    data = {
        "/lib/a/a sound long name.epub": package("Sound"), "/lib/b/a broken long name.epub": b"no zip",
        "/lib/b/a new broken file.epub": package("New", 0), "/lib/b/a new sound file.epub": package("Fresh"),
    }
    files = spark.createDataFrame([(p, len(d), day, bytearray(d)) for p, d in data.items()], "path string, file_size long, file_mtime timestamp, content binary")
    books = make_books(
        dict(id=1, file_path="/lib/a/a sound long name.epub", title="Sound"),
        dict(id=2, file_path="/lib/b/a broken long name.epub", title="Broken"),
        dict(id=3, file_path="/lib/gone/a lost long name.epub", title="Lost"),
    )
    covers = fs.with_cover_ids(spark.createDataFrame([("covers/1.jpg",), ("covers/2.jpg",)], "path string"))
    dirs = spark.createDataFrame([("/lib/a",)], "path string")
    favorites = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "user_id long, book_id long")
    index = spark.createDataFrame([(1, "kim"), (2, "lee"), (3, "may")], "book_id long, token string")
    run = jobs.cleanup_run(
        books, files, covers, dirs, ["/lib"], "t", execute=True, force_clean=True, validate=True, favorites=favorites, author_index=index
    )
    ops = sorted((r.op, r.book_id or 0, r.from_path) for r in run.plan.where("op <> 'backfill'").collect())
    assert ops == [
        ("delete", 0, "/lib/b/a new broken file.epub"), ("delete", 2, "/lib/b/a broken long name.epub"),
        ("index", 0, "/lib/b/a new sound file.epub"),
        ("invalid", 0, "/lib/b/a new broken file.epub"), ("invalid", 2, "/lib/b/a broken long name.epub"),
        ("purge", 2, "/lib/b/a broken long name.epub"), ("purge", 3, "/lib/gone/a lost long name.epub"),
        ("remove_cover", 2, "covers/2.jpg"),
    ]
    assert {(r.title, r.epub_validated) for r in run.books.collect()} == {("Sound", True), ("Fresh", True)}
    counted = run.summary.collect()[0]
    assert (counted.invalid_epubs, counted.files_deleted, counted.rows_purged, counted.covers_removed) == (2, 2, 2, 1)
    assert [tuple(r) for r in run.favorites.select("user_id", "book_id").collect()] == [(7, 1)]
    assert [tuple(r) for r in run.author_index.select("book_id", "token").collect()] == [(1, "kim")]


def test_scan_purge_takes_children_along(make_books, make_files, spark):
    books = make_books(dict(id=1, file_path="/lib/x.epub"), dict(id=2, file_path="/lib/y.epub"))
    favorites = spark.createDataFrame([(7, 1), (7, 2)], "user_id long, book_id long")
    files = make_files(("/lib/x.epub", b"no zip"), ("/lib/y.epub", package("Y")))
    run = jobs.scan_job(books, files, ["/lib"], "t", validate=True, favorites=favorites)
    assert [r.book_id for r in run.favorites.collect()] == [2]


def test_stream(spark, tree, tmp_path):
    root, progress = str(tmp_path / "catalog"), str(tmp_path / "progress")
    shelves.create(spark.createDataFrame([], BOOKS), root, 3, buckets=8)

    def run(checkpoint=progress):
        merge_arrivals(read_arrivals(spark, str(tree), 2), root, checkpoint, "now").awaitTermination()
        store = shelves.Shelves(spark, root)
        return store.version, sorted(r.title for r in store.books().collect())

    # three files, two a batch
    assert run() == (5, ["One", "Two"])
    (tree / "three.epub").write_bytes(package("Three"))
    assert run() == (6, ["One", "Three", "Two"])
    assert run() == (6, ["One", "Three", "Two"])
    # the stream's last batch again, after a failure that lost the checkpoint's commit
    commits = tmp_path / "progress" / "commits"
    for name in ("2", ".2.crc"):
        (commits / name).unlink(missing_ok=True)
    assert run() == (6, ["One", "Three", "Two"])
    ids = [r.id for r in shelves.Shelves(spark, root).books().collect()]
    assert sorted(ids) == [1, 2, 3]


def _files(folder):
    return {p.name: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_store_rewrites_only_touched_buckets(spark, make_books, tmp_path):
    books = make_books(*[dict(id=i, title=f"Book {i}", language=["en", "fr", None][i % 3], is_missing=i % 5 == 0) for i in range(1, 41)])
    first = shelves.create(books, str(tmp_path), 3, buckets=8)
    old = _files(tmp_path / "rows")
    # derived columns of rows that stay are carried over, whatever they hold
    edited = books.where("id = 7").withColumn("title", F.lit("New")).withColumn("language", F.lit("de"))
    second = first.change(books.where("id in (7, 8)"), edited)
    bucket = second.stored().where("id = 7").first().bucket
    gone = first.stored().where("id = 8").first().bucket
    assert second.version == 4 and [b for b, entry in second.listed().items() if entry[0] == 4] == sorted({bucket, gone})
    assert {k: v for k, v in _files(tmp_path / "rows").items() if k in old} == old
    assert second.books().count() == 39 and first.books().count() == 40
    row = second.stored().where("id = 7").first()
    assert (row.tok_title, row.title_key) == (" new", "new")
    for store in (first, second):
        assert store.stats().collect() == stats.library_stats(store.books()).collect()
        plan = store.stats()._jdf.queryExecution().executedPlan().toString()
        assert "/rows/" not in plan and "file_path" not in plan
    # nothing changed: no bucket is rewritten; the largest id stays known when its row goes
    third = second.change(second.books().where("id = 40"), second.books().where("id = 40"))
    assert third.version == 5 and all(entry[0] < 5 for entry in third.listed().values())
    fourth = third.change(third.books().where("id = 40"), third.books().where("id < 0"))
    assert max(entry[2] for entry in fourth.listed().values()) == 40
    emptied = fourth.change(fourth.books(), fourth.books().where("id < 0"))
    assert emptied.books().count() == 0 and emptied.stats().first().library_total == 0


def test_partial_scan_equals_whole_scan(spark, make_books, make_files, tmp_path):
    """Known, moved, changed, copied, broken and new files against a store and against the whole catalogue."""
    a, b, d = package("A"), package("B"), package("D")
    sha = lambda data: hashlib.sha1(data).hexdigest()
    books = make_books(
        dict(id=1, file_path="/lib/a.epub", content_hash=sha(a), file_size=1), dict(id=2, file_path="/lib/b.epub", content_hash=sha(b), is_missing=True),
        dict(id=3, file_path="/lib/c.epub", content_hash="0" * 40), dict(id=5, file_path="/lib/e.epub", content_hash=sha(d)),
        dict(id=9, file_path="/lib/other.epub", content_hash="1" * 40),
    )
    files = make_files(
        ("/lib/a.epub", a), ("/lib/moved-to-a-longer-name.epub", b), ("/lib/c.epub", package("C2")), ("/lib/d-copy.epub", d),
        ("/lib/new.epub", package("N")), ("/lib/new copy.epub", package("N")), ("/lib/bad.epub", b"no zip"), ("/lib/e.epub", b"broken now"),
    )
    store = shelves.create(books, str(tmp_path), 0, buckets=4)
    before, part = jobs.scan_part(store, files, "t")
    present = books.where("not is_missing").select(F.col("file_path").alias("path")).unionByName(files.select("path")).distinct()
    whole = jobs.scan_job(books, files, [], "t", True, present=present)
    after = store.change(before, part.books)
    assert sorted(map(tuple, after.books().collect()), key=str) == sorted(map(tuple, whole.books.collect()), key=str)
    assert sorted(map(tuple, part.actions.collect()), key=str) == sorted(map(tuple, whole.actions.collect()), key=str)
    assert before.where("id = 9").count() == 0


def test_paths_of_cluster_storage_are_split_by_hand():
    from shelfmark.sources.files import split_path

    assert split_path("/data/Kim - Rudyard.epub") == ("file", "", "/data/Kim - Rudyard.epub")
    assert split_path("file:///data/a b%20.epub") == ("file", "", "/data/a b%20.epub")
    assert split_path("file:/data/a.epub") == ("file", "", "/data/a.epub")
    assert split_path("s3a://bucket/x y/ä.epub") == ("s3a", "bucket", "/x y/ä.epub")
    assert split_path("hdfs://name:8020/x y.epub") == ("hdfs", "name:8020", "/x y.epub")


def test_odd_packages_are_findings_not_errors():
    import io
    import zipfile

    from shelfmark.plans.bindings import make_package
    from shelfmark.sources.packages import inspect_package

    sound = make_package(9, "T", "A", "en", "1", 1.0, "text")
    assert sound == make_package(9, "T", "A", "en", "1", 1.0, "text")

    def with_chapter(body: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(sound)) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                new.writestr(name, body if name.endswith(".xhtml") else old.read(name))
        return out.getvalue()

    page = '<?xml version="1.0" encoding="{0}"?><html><body><p>本</p></body></html>'
    assert inspect_package(with_chapter(page.format("Shift_JIS").encode("shift_jis")))["ok"]
    odd = inspect_package(with_chapter(page.format("no-such-code").encode()))
    assert not odd["ok"] and len(odd["errors"]) == 1


def test_jpeg_size_skips_segments_and_fill_bytes():
    from shelfmark.sources.images import jpeg_size

    frame = b"\xff\xc0\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + bytes(10)
    assert jpeg_size(b"\xff\xd8\xff\xe0\x00\x06\xff\xc0ab\xff" + frame) == (200, 300)
    assert jpeg_size(b"\xff\xd8\xff\xda" + frame) is None
    assert jpeg_size(b"\xff\xd8") is None


def test_png_filters_equal_the_rule_by_bytes():
    import random

    import numpy as np

    from shelfmark.sources.images import _unfilter

    def plain(kind, line, above, step):
        out = list(line)
        for i, value in enumerate(out):
            left, corner = (out[i - step], above[i - step]) if i >= step else (0, 0)
            aim = left + above[i] - corner
            guess = [0, left, above[i], (left + above[i]) // 2, min((left, above[i], corner), key=lambda v: abs(aim - v))][kind]
            out[i] = (value + guess) & 0xFF
        return out

    rng = random.Random(4)
    for channels in (1, 3, 4):
        for width, height, allowed in ((7, 5, range(5)), (1, 6, range(5)), (9, 1, (3, 4)), (5, 4, (0, 1, 2))):
            kinds = [rng.choice(list(allowed)) for _ in range(height)]
            lines = [[rng.randrange(256) for _ in range(width * channels)] for _ in range(height)]
            above = first = [rng.randrange(256) for _ in range(width * channels)]
            want = []
            for kind, line in zip(kinds, lines):
                above = plain(kind, line, above, channels)
                want.append(above)
            shape = lambda rows: np.array(rows, np.uint8).reshape(-1, width, channels)
            got = _unfilter(np.array(kinds, np.uint8), shape(lines), shape([first])[0])
            assert got.reshape(height, -1).tolist() == want


def test_file_contents_reach_python_in_small_batches(spark):
    """Whatever the session allows, the bytes of a batch are bounded when packages are opened or covers measured."""
    from shelfmark.session import BATCH_BYTES
    from shelfmark.sources import images, packages

    files = spark.range(30, numPartitions=1).selectExpr("cast(id as string) AS path", "cast(repeat('x', 1048576) as binary) AS content")
    for opened in (packages.inspect_packages, images.screen_covers):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1g")
        opened(files)
        sizes = files.mapInPandas(lambda batches: (b.assign(n=b["content"].map(len).sum())[["n"]][:1] for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 30 << 20
        assert max(r.n for r in sizes) <= int(BATCH_BYTES) + (1 << 20)
