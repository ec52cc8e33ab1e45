"""Source mixing, filter audit and Merkle manifest against plain versions, with odd rows."""

import random

import brute
import pytest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, part string, name string, size int, tree int, A int"


def odd_rows(n=160, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiouß" for c in ("", "X", "n")]
    out = []
    for i in range(n):
        kind = i % 9
        text = " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 30, 199, 200, 260))))
        text = [text, None, "", text + "\nline\n\n", "same text\nfor many", "same text\nfor many", text + " #", "SHOUT " * 210, " \t " + text][kind]
        source = [None, "", "a", "b", "é", "hot", "hot", "hot"][rng.randrange(8)]
        out.append((None if i % 40 == 7 else i, source, [None, "", "en", "fr"][rng.randrange(4)], None if i % 11 == 0 else i, text))
    # repeated rows, equal ids with other texts, a very long text
    return out + [out[4], out[4], out[10], (4, "hot", "en", 4, "same text\nfor many"), (5, "hot", "en", 1, "x"), (900, "b", "fr", 9, "lorem ipsum\n" * 40000)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (7, None, 1), (5000, 1, 1)]


@pytest.fixture(scope="module")
def table(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame([(*r, "p", "n", 1, 2, 3) for r in rows], COLUMNS).repartition(5)


def same_rows(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_mixing(table):
    from shelfmark.llm import source_mixing as mixing

    rows, docs = table
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.mix(docs).select(*names).collect()
    want = brute.mixed([(d, s, t) for d, s, _, _, t in rows])
    key = lambda r: tuple((x is not None, x) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert all(r[4] <= 2 * r[1] for r in got)
    # the same rows in another layout, and an empty table
    again = mixing.mix(docs.repartition(3, "text")).select(*names).collect()
    assert sorted(map(tuple, again), key=key) == got
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_clamps_all(spark):
    from shelfmark.llm import source_mixing as mixing

    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x y z"), (3, "c", None)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(docs, share=5.0).collect()}
    assert got == {1: (4.0, 4), 2: (6.0, 6), 3: (0.0, 0)}
    # one source may be repeated four times
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(docs, weights=(1, 3), share=1.6, max_epochs=4).collect()}
    assert got == {1: (2.0, 2), 2: (6.0, 6), 3: (0.0, 0)}


def test_mixed_texts(table):
    from shelfmark.llm import source_mixing as mixing

    rows, docs = table
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, taken = {}, {}
    for r in out.select("doc_id", "text").collect():
        assert any(d == r.doc_id and (t or "").startswith(r.text) for d, _, _, _, t in rows)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
    for r in mixing.mix(docs).where("taken > 0").collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert got == taken


def test_audit(spark, table, monkeypatch):
    from shelfmark.llm import filter_audit

    rows, docs = table
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute.audited([(d, lang, t) for d, _, lang, _, t in rows], LABELS)
    same_rows(filter_audit.audit(docs, labels).collect(), want)
    judged = filter_audit.judged(docs, labels)
    short = filter_audit.postings(judged, width=3)
    assert short.where("size(A) > 3").count() == 0 and short.count() > 10
    whole = {r.part: sorted(map(tuple, r.cells)) for r in filter_audit.part_cells(filter_audit.postings(judged)).collect()}
    assert {r.part: sorted(map(tuple, r.cells)) for r in filter_audit.part_cells(short).collect()} == whole
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_galloping_merge():
    from shelfmark.llm.filter_audit import cells, gallop

    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 50))) for _ in range(rng.randrange(1, 8))]
        want = {}
        for x in {i for ids in lists for i in ids}:
            mask = sum(1 << k for k, ids in enumerate(lists) if x in ids)
            want[mask] = want.get(mask, 0) + 1
        assert cells(lists) == want
    ids = sorted(rng.sample(range(1000), 300))
    for bound in range(0, 1001, 7):
        for at in (0, 5, 299):
            if ids[at] < bound:
                end = gallop(ids, at, bound)
                assert all(i < bound for i in ids[at:end]) and (end == len(ids) or ids[end] >= bound)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def proofs(docs, **more):
    from shelfmark.llm import merkle_manifest as merkle

    tree = merkle.manifest(docs, changed=merkle.without_newlines(docs), **more)
    return tree, merkle.prove(tree, digest_only=True).select(*MERKLE).collect()


def test_manifest(table, monkeypatch):
    from shelfmark.llm import merkle_manifest as merkle

    rows, docs = table
    want = brute.merkle(rows)
    tree, got = proofs(docs)
    same_rows(got, want)
    assert any(not r.verified for r in got) and any(r.verified for r in got)
    # several rounds of building
    monkeypatch.setattr(merkle, "LEVELS", 1)
    same_rows(proofs(docs)[1], want)
    empty, none = proofs(docs.limit(0))
    assert none == [] and empty.root is None


def test_manifest_of_one(table):
    rows, docs = table
    same_rows(proofs(docs.where("doc_id = 900"))[1], brute.merkle([r for r in rows if r[0] == 900]))
    same_rows(proofs(docs.where("source = 'hot'"))[1], brute.merkle([r for r in rows if r[1] == "hot"]))


def test_proofs_of_some(table):
    """Proofs of a few leaves, any partition: the siblings alone lead from the leaf to the root."""
    from shelfmark.llm import merkle_manifest as merkle
    from pyspark.sql import functions as F

    rows, docs = table
    tree = merkle.manifest(docs)
    some = tree.leaves.where("doc_id % 17 = 3").withColumn("_part", F.col("doc_id") % 3)
    got = merkle.prove(tree, some).collect()
    assert len(got) == sum(d is not None and d % 17 == 3 for d, *_ in rows)
    assert all(r.verified and r.derived_root == tree.root for r in got)
    want = {r[0]: r[4] for r in brute.merkle(rows)}
    assert all(brute.sha("".join(r.proof)) == want[r.doc_id] for r in got)


def test_minimal_union():
    import numpy as np
    from shelfmark.llm.merkle_manifest import missing

    asked = {level: places.tolist() for level, places in missing(np.array([4, 0, 4]), 11)}
    # leaves 0 and 4 of 11: their runs, then node 2 and 3 of four, then the last of two
    assert asked == {0: [1, 2, 3, 5], 1: [2], 2: [1]}
    assert list(missing(np.array([0]), 1)) == []
