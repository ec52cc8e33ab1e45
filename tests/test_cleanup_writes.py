from shelfmark.plans import jobs, registry
from shelfmark.plans.bindings import Library


def test_cleanup_writes_whole_rows_after_the_strip_and_at_the_end(spark, monkeypatch):
    library = Library(spark, "/root/testdata/sf0.001")
    wide = []
    cut = jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: ("description" in df.columns and wide.append(1)) or cut(df))
    run = registry._cleanup(library, execute=True, force_clean=True)
    ops = {r.op for r in run.plan.select("op").distinct().collect()}
    assert len(wide) == 2 and {"strip", "rename", "repoint", "purge", "index"} <= ops
    purged = {r.book_id for r in run.plan.where("op = 'purge'").collect()}
    left = [r.id for r in run.books.select("id").collect()]
    # ids of purged rows are not given again
    assert not purged & set(left) and len(left) == len(set(left))
