import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from shelfmark.operators import merge, quality, reconcile, search
from shelfmark.operators.skew import join_hot, number_by_digest, rank_by_id
from shelfmark.plans import jobs
from shelfmark.sources import files as fs

DAY, LATER = datetime(2024, 1, 1), datetime(2024, 1, 2)


def sha(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- skew helpers ----------------------------------------------------------------------------


def test_join_hot_equals_a_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.where("k is not null and id % 2 = 0 or k = 'hot'").select("k").distinct().withColumn("v", F.length("k"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        split = join_hot(left, right, "k", how, ["id"], hot_rows=7)
        assert rows(split, *plain.columns) == rows(plain, *plain.columns), how


def test_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("id"), F.when(F.col("id") < 400, "a").otherwise("b").alias("k"))
    got = rank_by_id(df, ["k"], "id", "n", hot_rows=9)
    for key in "ab":
        ordered = sorted(r.id for r in df.where(F.col("k") == key).collect())
        assert {r.id: r.n for r in got.where(F.col("k") == key).collect()} == {v: i + 1 for i, v in enumerate(ordered)}
    named = spark.range(200).select(F.col("id").cast("string").alias("p"))
    want = sorted((str(i) for i in range(200)), key=lambda p: hashlib.md5(p.encode()).hexdigest())
    assert {r.p: r.n for r in number_by_digest(named, "p", "n").collect()} == {p: i + 1 for i, p in enumerate(want)}


def test_unique_names_equal_the_sequential_rule(spark):
    claims = [(i, "/d", "a.epub") for i in range(1, 30)] + [(40, "/d", "b"), (41, "/e", "a.epub"), (42, "/d", "b")]
    there = ["/d/a.epub", "/d/a (3).epub", "/d/a (4).epub", "/d/a (9).epub", "/d/a (02).epub", "/d/b (2)", "/e/x.epub"]
    taken, want = set(there), {}
    for i, folder, name in claims:
        stem, dot, ext = name.partition(".")
        n, candidate = 1, f"{folder}/{name}"
        while candidate in taken:
            n += 1
            candidate = f"{folder}/{stem} ({n}){dot}{ext}"
        taken.add(candidate)
        want[i] = candidate.rsplit("/", 1)[1]
    df = spark.createDataFrame(claims, "id long, dir string, wanted string")
    disk = spark.createDataFrame([(p,) for p in there], "path string")
    for hot in (3, 1_000_000):
        got = {r.id: r.final_name for r in reconcile.unique_names(df, disk, hot).collect()}
        assert got == want


# --- copies ----------------------------------------------------------------------------------


def test_keeper_and_groups(make_books, make_files):
    books = make_books(
        dict(id=1, file_path="/lib/gone.epub", content_hash=sha(b"x")),
        dict(id=2, file_path="/lib/here.epub", content_hash=sha(b"y")),
    )
    files = make_files(
        ("/lib/moved-file.epub", b"x"), ("/lib/here.epub", b"y"), ("/lib/here-too.epub", b"y"),
        ("/lib/n1.epub", b"z"), ("/lib/n1-long.epub", b"z"), ("/out/y.epub", b"y"), ("/lib/solo.epub", b"s"),
    )
    matched = reconcile.match_paths(books, files)
    loose = reconcile.hashed_unindexed(matched, files)
    groups = reconcile.content_groups(loose, matched)
    got = rows(reconcile.duplicate_groups(loose, matched), "keeper", "n_remove", "book_id", "repoint_only")
    assert got == [
        ("/lib/here-too.epub", 2, 2, False), ("/lib/moved-file.epub", 0, 1, True), ("/lib/n1-long.epub", 1, None, False),
    ]
    for hot in (1, 1_000_000):
        plan = reconcile.dedupe_plan(loose, groups, ["/lib"], hot)
        assert rows(plan, "op", "book_id", "from_path", "to_path") == [
            ("delete", None, "/lib/here.epub", None),
            ("delete", None, "/lib/n1.epub", None),
            ("refuse", None, "/out/y.epub", None),
            ("repoint", 1, "/lib/gone.epub", "/lib/moved-file.epub"),
            ("repoint", 2, "/lib/here.epub", "/lib/here-too.epub"),
        ]
    assert rows(reconcile.new_files(groups), "path") == [("/lib/n1-long.epub",), ("/lib/solo.epub",)]
    tie = make_files(("/books/a/same.epub", b"1"), ("/books/longer/same.epub", b"1"))
    assert rows(reconcile.keeper_paths(fs.with_content_hash(tie)), "keeper") == [("/books/longer/same.epub",)]


def test_classification(make_books, make_files):
    books = make_books(
        dict(id=1, file_path="/lib/calm.epub", file_size=4, content_hash="not read"),
        dict(id=2, file_path="/lib/short.epub", file_size=9, content_hash=sha(b"move")),
        dict(id=3, file_path="/lib/touched.epub", file_size=9, content_hash=sha(b"same")),
        dict(id=4, file_path="/lib/changed.epub", content_hash=sha(b"old")),
        dict(id=5, file_path="/lib/gone.epub", content_hash=sha(b"lost")),
        dict(id=6, file_path="/lib/clash-much-longer.epub", content_hash=sha(b"other")),
        dict(id=7, file_path="/lib/clash.epub", file_size=5, content_hash=sha(b"clash")),
    )
    files = make_files(
        ("/lib/calm.epub", b"calm"), ("/lib/short.epub", b"move", LATER), ("/lib/much-longer-name.epub", b"move"),
        ("/lib/s.epub", b"move"), ("/lib/touched.epub", b"same", LATER), ("/lib/changed.epub", b"new!"),
        ("/lib/back.epub", b"lost"), ("/lib/clash.epub", b"clash"), ("/lib/clash-much-longer.epub", b"clash", LATER),
        ("/lib/fresh.epub", b"f"), ("/lib/fresh-copy.epub", b"f"), ("/lib/changed-too.epub", b"new!"),
    )
    for hot in (1, 1_000_000):
        got = {r.path: (r.status, r.book_id, r.delete_path) for r in reconcile.classify(files, books, hot).collect()}
        assert got == {
            "/lib/calm.epub": ("unchanged", 1, None),
            "/lib/short.epub": ("unchanged", 2, None),
            "/lib/much-longer-name.epub": ("repointed", 2, "/lib/short.epub"),
            "/lib/s.epub": ("duplicate", None, None),
            "/lib/touched.epub": ("unchanged", 3, None),
            "/lib/changed.epub": ("to_index", 4, None),
            "/lib/changed-too.epub": ("duplicate", None, None),
            "/lib/back.epub": ("repointed", 5, None),
            "/lib/clash.epub": ("unchanged", 7, None),
            "/lib/clash-much-longer.epub": ("conflict", 6, None),
            "/lib/fresh-copy.epub": ("to_index", None, None),
            "/lib/fresh.epub": ("duplicate", None, None),
        }


def test_empty_dirs(spark):
    dirs = spark.createDataFrame([("/r",), ("/r/nested",), ("/r/nested/empty",), ("/r/e",), ("/r/e/e2",), ("/o/x",)], "path string")
    files = spark.createDataFrame([("/r/nested/keep.epub",)], "path string")
    assert rows(reconcile.empty_dirs(dirs, files, ["/r"]), "path") == [("/r/e",), ("/r/e/e2",), ("/r/nested/empty",)]


def test_constraints(make_books):
    books = make_books(
        dict(id=1, format="doc", content_hash="h"), dict(id=2, file_size=-1, content_hash="h"), dict(id=3, page_count=-2, file_path="/lib/2.epub"),
    )
    assert rows(quality.constraint_violations(books), "rule", "key", "n") == [
        ("file_size", "2", 1), ("format", "1", 1), ("page_count", "3", 1), ("unique_content_hash", "h", 2), ("unique_file_path", "/lib/2.epub", 2),
    ]


# --- merges ----------------------------------------------------------------------------------


def test_metadata_merge(make_books, spark):
    books = make_books(dict(id=1, title="Old", series_index=0.0), dict(id=2, title=" "))
    proposed = spark.createDataFrame(
        [(1, "New", "P", 1.0, "later", ""), (2, "Given", None, None, None, "c.jpg")],
        "id long, title string, publisher string, series_index double, last_scanned_at string, cover_path string",
    )
    assert rows(merge.merge_conflicts(books, proposed), "id", "conflicts") == [(1, ["title", "series_index"])]
    names = ("id", "title", "publisher", "series_index", "last_scanned_at", "cover_path")
    two = (2, "Given", None, None, "2024-01-01", "c.jpg")
    assert rows(merge.merge_metadata(books, proposed, False), *names) == [(1, "Old", "P", 0.0, "later", None), two]
    assert rows(merge.merge_metadata(books, proposed, True), *names) == [(1, "New", "P", 1.0, "later", None), two]
    assert rows(merge.merge_metadata(books, proposed, False, refuse=True), *names)[0] == (1, "Old", None, 0.0, "2024-01-01", None)


def test_repoint_and_presence(make_books, make_files, spark):
    books = make_books(
        dict(id=1, file_path="/lib/a.epub", epub_validated=True, epub_version2=True, is_missing=True, title="T"),
        dict(id=2, file_path="/lib_x/b.epub"), dict(id=3, file_path="/lib/c.epub", is_missing=True),
    )
    moves = spark.createDataFrame([(1, "/lib/new.epub", 5, LATER)], "id long, file_path string, file_size long, file_mtime timestamp")
    names = ("id", "file_name", "file_size", "is_missing", "epub_validated", "epub_version2", "title")
    assert rows(merge.repoint(books, moves), *names)[0] == (1, "new.epub", 5, False, True, True, "T")
    assert rows(merge.repoint(books, moves, True), *names)[0] == (1, "new.epub", 5, False, False, False, "T")
    seen = spark.createDataFrame([("/lib/c.epub",)], "path string")
    assert rows(merge.mark_presence(books, seen, ["/lib"]), "id", "is_missing") == [(1, True), (2, False), (3, False)]


def test_upsert_is_idempotent(make_books, make_files, spark):
    books = make_books(dict(id=5, file_path="/lib/a.epub", content_hash="h", file_size=1, epub_validated=True, title="T"))
    incoming = spark.createDataFrame(
        [("/lib/a.epub", "a.epub", "epub", 2, LATER, "h2", None, "now"), ("/lib/n.epub", "n.epub", "epub", 3, LATER, "n", "N", "now")],
        "file_path string, file_name string, format string, file_size long, file_mtime timestamp, content_hash string, title string, last_scanned_at string",
    )
    once = merge.upsert_by_path(books, incoming)
    names = ("id", "file_path", "content_hash", "title", "first_seen_at", "last_scanned_at", "epub_validated")
    assert rows(once, *names) == [
        (5, "/lib/a.epub", "h2", None, "2024-01-01", "now", False), (6, "/lib/n.epub", "n", "N", "now", "now", False),
    ]
    assert rows(merge.upsert_by_path(once, incoming), *once.columns) == rows(once, *once.columns)


def test_backfill_first_id_wins(make_books, make_files):
    books = make_books(
        dict(id=1, file_path="/lib/1.epub"), dict(id=2, file_path="/lib/2.epub"), dict(id=3, file_path="/lib/3.epub", content_hash=sha(b"k"), epub_validated=True),
        dict(id=4, file_path="/lib/4.epub"), dict(id=5, file_path="/lib/none.epub"),
    )
    files = make_files(("/lib/1.epub", b"x"), ("/lib/2.epub", b"x"), ("/lib/4.epub", b"k"))
    for hot in (1, 1_000_000):
        accepted, refused = merge.backfill_split(books, merge.fresh_hashes(books, files), hot)
        assert rows(accepted, "id", "content_hash") == [(1, sha(b"x"))]
        assert rows(refused, "id", "other_id") == [(2, 1), (4, 3)]
    after = merge.backfill_hashes(books, accepted)
    assert rows(after, "id", "content_hash", "epub_validated")[0] == (1, sha(b"x"), False)


def test_users(spark):
    users = spark.createDataFrame([(3, "Ann", "t")], "id long, username string, created_at string")
    asks = spark.createDataFrame(
        [(1, " ann ", "n"), (2, "Bob", "n"), (3, "BOB", "n"), (4, "  ", "n"), (5, "x" * 65, "n"), (6, "Él", "n"), (7, "él", "n")],
        "seq long, username string, created_at string",
    )
    added, refused = merge.register_users(users, asks)
    assert sorted(r.username for r in added.collect()) == ["Ann", "Bob", "Él", "él"]
    assert sorted(r.id for r in added.collect()) == [3, 4, 5, 6]
    assert [r.seq for r in refused.orderBy("seq").collect()] == [1, 3, 4, 5]
    favorites = spark.createDataFrame([(3, 1), (9, 1)], "user_id long, book_id long")
    left, kept = merge.delete_users(users, favorites, spark.createDataFrame([(" ANN",)], "username string"))
    assert left.count() == 0 and rows(kept, "user_id") == [(9,)]


def test_favorites_and_purge(make_books, spark):
    favorites = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, book_id long")
    changes = spark.createDataFrame(
        [(1, 1, True, 1), (1, 1, False, 2), (2, 5, True, 1), (1, 2, True, 9)], "user_id long, book_id long, favorite boolean, seq long"
    )
    assert rows(merge.apply_favorites(favorites, changes), "user_id", "book_id") == [(1, 2), (2, 1), (2, 5)]
    books = make_books(dict(id=1, authors="A B"), dict(id=2, authors="C"))
    left, kept, index = merge.purge_rows(books, favorites, search.author_index(books), books.where("id = 1"))
    assert rows(left, "id") == [(2,)] and rows(kept, "book_id") == [(2,)] and rows(index, "token") == [("c",)]


def test_descriptions(make_books):
    books = make_books(dict(id=1, description="<p>One</p>"), dict(id=2, description="Plain"), dict(id=3, description="&amp; more"), dict(id=4, description=" "))
    got = rows(merge.strip_descriptions(books), "id", "description", "description_changed")
    assert got == [(1, "One", True), (2, "Plain", False), (3, "& more", True), (4, " ", False)]


def test_cover_reshard(make_books, spark):
    books = make_books(dict(id=1, cover_path="data/covers/1.jpg"), dict(id=102, cover_path="data/covers/02/102.png"))
    covers = fs.with_cover_ids(
        spark.createDataFrame([("data/covers/1.jpg",), ("data/covers/01/1.png",), ("data/covers/02/102.png",), ("data/covers/9.jpg",), ("data/covers/x.jpg",)], "path string")
    )
    got = rows(merge.cover_reshard_plan(covers, books), "from_path", "to_path", "cover_path", "action")
    assert got == [
        ("data/covers/02/102.png", "data/covers/02/102.png", None, "keep"),
        ("data/covers/1.jpg", "data/covers/01/1.jpg", "data/covers/01/1.jpg", "move"),
        ("data/covers/9.jpg", "data/covers/09/9.jpg", None, "move_orphan"),
        ("data/covers/x.jpg", None, None, "unrecognized"),
    ]


def test_removal_plan_guards_roots(make_files, spark):
    bad = spark.createDataFrame([("/lib/a.epub", 1), ("/lib/a.epub", 1), ("/out/b.epub", 2), ("/lib/none.epub", 3)], "path string, book_id long")
    files = make_files(("/lib/a.epub", b"a"), ("/out/b.epub", b"b"))
    covers = spark.createDataFrame([("covers/01/1.png",), ("covers/2.jpg",)], "path string")
    got = rows(jobs.removal_plan(bad, files, covers, ["/lib"], "covers"), "op", "book_id", "path")
    assert got == [
        ("delete", 1, "/lib/a.epub"), ("purge", 1, "/lib/a.epub"), ("purge", 3, "/lib/none.epub"),
        ("refuse", 2, "/out/b.epub"), ("remove_cover", 1, "covers/01/1.png"),
    ]


def test_unreadable_files_are_no_copies_of_each_other(spark, make_books):
    table = [(f"/lib/{n}.epub", None, 1, None) for n in "abc"] + [("/lib/d.epub", "h", 1, None)]
    files = spark.createDataFrame(table, "path string, content_hash string, file_size long, file_mtime timestamp")
    books = make_books({"id": 1, "file_path": "/lib/z.epub", "content_hash": "q"})
    matched = reconcile.match_paths(books, files)
    assert [r.path for r in reconcile.new_files(reconcile.content_groups(files, matched)).collect()] == ["/lib/d.epub"]
    assert reconcile.duplicate_groups(files, matched).count() == 0
    assert {r.copies for r in reconcile.files_by_hash(files).collect()} == {None, 1}


def test_scan_leaves_files_outside_its_roots(spark, make_books, make_files):
    data = b"same bytes"
    import hashlib

    books = make_books({"id": 1, "file_path": "/other/long name here.epub", "content_hash": hashlib.sha1(data).hexdigest()})
    files = make_files(("/lib/a.epub", data))
    inside = reconcile.classify(files, books, roots=["/lib"]).first()
    assert (inside.status, inside.delete_path) == ("duplicate", None)
    assert reconcile.classify(files, books).first().status == "repointed"


# --- plans -----------------------------------------------------------------------------------


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def exchanges(df):
    import re

    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", plan_of(df)))


def test_audit_reads_one_match(make_books, make_files, spark):
    books = make_books(dict(id=1, file_path="/lib/gone.epub", content_hash=sha(b"x")), dict(id=2, file_path="/lib/here by now.epub"))
    files = make_files(("/lib/moved-file.epub", b"x"), ("/lib/here by now.epub", b"y"))
    covers = fs.with_cover_ids(spark.createDataFrame([("covers/1.jpg",)], "path string"))
    report = reconcile.audit_report(books, files, covers, ["/lib"])
    # covers against ids; the match and the grouping are written and read
    assert exchanges(report) <= 2
    listed = reconcile.match_paths(books, files)
    assert exchanges(reconcile.content_groups(reconcile.hashed_unindexed(listed, files), listed)) <= 1
    kinds = sorted((r.kind, r.book_id or 0) for r in report.collect())
    assert kinds == [("absent", 1), ("duplicate_group", 1), ("null_hash", 2), ("unindexed", 0)]


def test_bytes_are_never_exchanged(make_books, make_files, monkeypatch):
    """No exchange of what is hashed holds file bytes, whether the paths are few or many."""
    from pyspark.sql import functions as F

    books = make_books(dict(id=1, file_path="/lib/a.epub", content_hash=sha(b"x")), dict(id=2, file_path="/lib/b.epub"))
    files = make_files(("/lib/a.epub", b"x"), ("/lib/b.epub", b"y"), ("/lib/c.epub", b"x"))
    paths = files.select("path", "file_size")
    want = {"/lib/a.epub": sha(b"x"), "/lib/b.epub": sha(b"y"), "/lib/c.epub": sha(b"x")}
    for few in (100_000, 1):
        monkeypatch.setattr(fs, "FEW_PATHS", few)
        got = fs.hashed(paths, files)
        assert {r.path: r.content_hash for r in got.collect()} == want
        plan = plan_of(got)
        assert plan.count("sha1(") == 1
        below = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
        assert not any("content#" in line for line in below)
        if few == 1:
            # bytes end where they are hashed
            assert "content_hash" in plan and plan.index("Exchange") < plan.index("sha1(")
        assert {r.id for r in merge.fresh_hashes(books, files).collect()} == {2}
        assert {r.status for r in reconcile.classify(files, books).collect()} >= {"to_index"}
    assert fs.contents(paths.where("path like '%a.epub'"), files.withColumn("x", F.lit(1))).columns == ["path", "content"]


def test_packs_hold_even_bytes(spark, monkeypatch):
    import random
    from pyspark.sql import functions as F

    rng = random.Random(2)
    sizes = [rng.randrange(1, 1000) for _ in range(400)] + [50_000, 70_000, 10_000, 0]
    files = spark.createDataFrame([(f"/f/{i}", n) for i, n in enumerate(sizes)], "path string, file_size long")
    dealt = fs.packed(files, 10_000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.path, r.file_size) for r in dealt) == sorted((f"/f/{i}", n) for i, n in enumerate(sizes))
    tasks = {}
    for r in dealt:
        tasks.setdefault(r.task, []).append(r.file_size)
    assert all(len([n for n in held if n]) == 1 for held in tasks.values() if max(held) >= 10_000)
    assert all(sum(held) <= 11_000 for held in tasks.values() if max(held) < 10_000) and len(tasks) >= 20
    assert fs.packed(files.limit(0)).count() == 0 and fs.packed(files.where("file_size = 0")).count() == 1


def test_names_are_ranked_only_where_contested(spark):
    claims = spark.createDataFrame([(i, "/d", f"name {i}.epub") for i in range(50)] + [(90, "/d", "two.epub"), (91, "/d", "two.epub")], "id long, dir string, wanted string")
    disk = spark.createDataFrame([("/d/name 7.epub",), ("/e/name 8.epub",)], "path string")
    named = reconcile.unique_names(claims, disk)
    got = {r.id: r.final_name for r in named.collect()}
    assert got[7] == "name 7 (2).epub" and got[8] == "name 8.epub" and (got[90], got[91]) == ("two.epub", "two (2).epub")
    assert exchanges(named) <= 5
    free = reconcile.unique_names(claims.where("id < 5"), disk)
    assert "Window" not in plan_of(free) and exchanges(free) == 0


def test_stale_names_are_mended_where_they_are(make_books, make_files):
    books = make_books(
        dict(id=1, file_path="/lib/a long good name.epub", file_name="another name.epub", title="T"), dict(id=2, file_path="/lib/a sound long name.epub", title="S"),
        dict(id=3, file_path="/lib/Kim.epub", title="Kim", authors="Rudyard Kipling", publisher="Penguin"),
    )
    files = make_files(("/lib/a long good name.epub", b"x"), ("/lib/a sound long name.epub", b"y"), ("/lib/Kim.epub", b"z"))
    plan = reconcile.rename_plan(books, files, ["/lib"])
    assert rows(plan, "id", "from_path", "to_path") == [
        (1, "/lib/a long good name.epub", "/lib/a long good name.epub"), (3, "/lib/Kim.epub", "/lib/Kim - Rudyard Kipling-(Penguin).epub"),
    ]
    facts = files.select("path", "file_size", "file_mtime").withColumnRenamed("path", "from_path")
    moves = plan.join(facts, "from_path").selectExpr("id", "to_path AS file_path", "file_size", "file_mtime")
    after = merge.repoint(books, moves, clear_flags=True)
    moved = files.join(plan.selectExpr("from_path AS path", "to_path"), "path", "left").selectExpr("coalesce(to_path, path) AS path", "file_size", "file_mtime")
    matched = reconcile.match_paths(after, moved)
    assert reconcile.filename_fixes(matched, ["/lib"]).count() == 0
