"""Operators against plain Python versions, with nulls, empty and long texts, ties and repeated rows."""

import random

import brute
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiouäß"]
    passage = " ".join(rng.choices(words, k=40))
    texts = ["", " \n ", "ß", "short one", passage, passage, f"x {passage} y", f"{passage}\n{passage}", "a" * 400, ("ab" * 150) + "é" * 120]
    texts += [" ".join(rng.choices(words, k=n)) for n in (5, 19, 20, 3000)] + ["line\nline\nother line\n\nline # 5 $ <b>" * 3, "<|endoftext|> x<|endoftext|>", "日本語 naïve space \x1c\x85"]
    rows = [(i, t) for i, t in enumerate(texts)]
    table = [(i, t, "h1", "en", i) for i, t in rows] + [(100, None, None, None, 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, lang string, spans int").repartition(4)
    return [*rows, (100, None)], docs


def test_quality_counts(spark, odd):
    from shelfmark.llm.quality_rules import COUNTS, judged

    rows, docs = odd
    got = sorted(judged(docs).select("doc_id", *COUNTS, "base_failed").collect())
    assert [tuple(r) for r in got] == sorted((d, *brute.quality(t)) for d, t in rows)
    assert judged(docs.limit(0)).count() == 0


def test_repeated_bytes(spark, odd, monkeypatch):
    from shelfmark.llm import suffix_array_dedup as dedup

    rows, docs = odd
    want = sorted(r[:5] for r in brute.repeats(rows))
    names = [f"_llm_{n}" for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    assert sorted(tuple(r) for r in dedup.cut_documents(docs).select("doc_id", *names).collect()) == want
    # ranks dealt out in parts
    monkeypatch.setattr(dedup, "HOT", 1)
    assert sorted(tuple(r) for r in dedup.cut_documents(docs).select("doc_id", *names).collect()) == want
    assert dedup.without_repeats(docs).columns == docs.columns


def test_contamination(spark, odd):
    from shelfmark.llm.benchmark_decontamination import contamination

    rows, docs = odd
    items = [(1, rows[4][1]), (2, "Short ONE!"), (3, None), (4, "..."), (5, rows[4][1][20:90]), (5, "ß"), (None, "naïve")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs.union(docs.where("doc_id = 6")), table).drop("text_key").collect()
    assert sorted(map(tuple, got)) == sorted(brute.contaminated([*rows, rows[6]], items))
    assert contamination(docs, table.limit(0)).where("contaminated").count() == 0


def test_bpe_and_round_trip(spark, odd):
    import public_tokenizers

    from shelfmark.llm import bpe_codec

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows, docs = odd
    assert sorted(map(tuple, bpe_codec.digests(docs, path).collect())) == sorted(brute.bpe(rows, path))
    shared = bpe_codec.share(spark, path)
    back = bpe_codec.decode(bpe_codec.encode(docs, shared), shared).collect()
    assert {r.doc_id: r.text for r in back} == {d: t or "" for d, t in rows}


def test_warc_captures(spark, tmp_path):
    from shelfmark.llm import warc_transactions as warc

    big, tail = "é" * 600, "a\r\n\r\nWARC/1.1\r\n\r\nb" * 80
    rows = [(1, "http://a/ b", big), (2, None, big), (5, "http://c", big), (3, "u", None), (4, "v", ""), (6, "w", tail), (7, "x", tail), (8, "y", "s"), (9, "z", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), pages_per_archive=2)
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    found = {int(r.metadata.block.split("pageId: ")[1].split("\r\n")[0]): r for r in got}
    assert {k for k, r in found.items() if r.record_type == "revisit"} == {1, 2, 6}
    assert all(r.request is not None for r in got) and bytes(found[7].payload) == tail.encode()
    assert found[1].refers_to == found[5].record_id and found[6].original.payload_bytes == len(tail)
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "w")).limit(0)).count() == 0


def test_turns_without_numbers_are_not_one_block(spark):
    """5,000 turns of one conversation, none numbered: in the order of role and text, spread over parts of the sort."""
    from shelfmark.llm import chat_formatting as chat
    from shelfmark.llm.common import sorted_runs, written

    turns = spark.range(5000).selectExpr("CAST(1 AS bigint) AS conv_id", "CAST(null AS bigint) AS turn", "'u' AS role", "lpad(CAST(id AS string), 5, '0') AS text")
    got = {r.i: (r.text, r.part) for r in chat.numbered(turns.unionByName(turns)).collect()}
    assert len(got) == 5000 and all(got[i + 1] == (f"{i:05d}", i // chat.BLOCK) for i in range(5000))
    rows = written(turns.selectExpr("conv_id AS conv", "-1 AS turn", "role", "text"))
    _, runs = sorted_runs(rows, ["conv"], ["turn", "role", "text"])
    assert runs.where("_n > 0").count() > 1
    assert chat.render(turns.limit(0)).count() == 0


def test_repeated_pages_meet_once(spark, tmp_path):
    """Equal rows give equal records: each comes back, and none meets all others."""
    from pyspark.sql import functions as F

    from shelfmark.llm import warc_transactions as warc

    big = "x" * 1500
    pages = spark.range(2000).select(F.lit(5).cast("long").alias("page_id"), F.lit("http://a").alias("url"), F.lit(big).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(3, "http://b", big), (4, "http://b", "small")], "page_id long, url string, html string"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w")).drop("payload"))
    assert {(r.record_type, r["count"]) for r in got.groupBy("record_type").count().collect()} == {("response", 2001), ("revisit", 1)}
    one = got.where("record_type = 'revisit'").first()
    assert one.original.payload_bytes == 1500 and "pageId: 5" in one.original.fields
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "w")).limit(0)).count() == 0


def test_maximal_conversations(spark):
    from shelfmark.llm.chat_formatting import render

    turns = [("u", "a"), ("v", "b"), ("u", None), (None, "<|im_end|>")]
    rows = [(1, i, *t) for i, t in enumerate(turns[:2])] + [(2, i, *t) for i, t in enumerate(turns)] + [(3, i * 7, *t) for i, t in enumerate(turns)]
    rows += [(4, 0, "u", "a"), (4, 0, "u", "a"), (5, 0, "u", "z"), (None, None, "u", "a"), (6, 0, "u", ""), *((9, i, "u", str(i)) for i in range(600))]
    got = render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 4), (5, 1), (6, 1), (9, 600)}
    assert sorted(r.part for r in got if r.conv_id == 9) == [0, 1, 2]
    assert next(r.rendered for r in got if r.conv_id == 2).endswith("<|im_start|>unknown\n< |im_end|><|im_end|>\n")


def test_toxicity_lexicon_and_held_out_rows(spark):
    from shelfmark.llm import toxicity

    lexicon = toxicity.Lexicon(["moron", "worth*"])
    assert lexicon.match("moron") == (0, 0) and lexicon.match("moren") == (1, 0) and lexicon.match("mron") == (1, 0)
    assert lexicon.match("worthless") == (0, 1) and lexicon.match("wrthless") == (1, 1) and lexicon.match("morons") == (1, 0)
    assert lexicon.match("motron") == (1, 0) and lexicon.match("mrn") is None
    out = toxicity.op6_toxicity(spark, DATA).collect()
    assert len(out) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    model = toxicity.fit(spark.createDataFrame([], "text string, toxic int, pick long"))
    assert toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).count() == 2


def test_toxic_beginning_of_a_long_word():
    from shelfmark.llm import toxicity

    lexicon = toxicity.Lexicon(["worth*"])
    word = b"worthless" + b"glued" * 20
    assert lexicon.of(word) == (0, 0) and word not in lexicon.seen
    assert toxicity.features_of("so " + word.decode(), lexicon)[2] > 0


def test_language_of_held_out_rows(spark):
    from shelfmark.llm import language_id

    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    out = [r for r in language_id.op7_language_id(spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) > 0.95 * len(out)
    model = language_id.fit(spark.createDataFrame([("the and", "en", 1), ("le et", "fr", 2)], "text string, lang string, pick long"), sample=9)
    texts = spark.createDataFrame([(1, None), (2, "12 €!"), (3, "the"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(texts, model).collect()} == {1: "und", 2: "und", 3: "en", 4: "und"}


def test_lm_base_and_model(spark, monkeypatch):
    import math
    from collections import Counter

    import public_tokenizers

    from shelfmark.llm import lm_scoring as lm

    monkeypatch.setattr(lm, "STEPS", 5)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts, model = lm.fit(docs.where("doc_id % 5 > 0").selectExpr("text", "doc_id as pick"), public_tokenizers.path("byte_bpe_50k.tiktoken"), frequent=500)
    extra = spark.createDataFrame([(-1, None), (-2, "the"), (-2, "the")], docs.schema)
    out = lm.score(docs.union(extra), counts, model).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen = Counter()
    for d, t in rows:
        if d % 5:
            seen.update([*brute.words(t), ""])
    total = sum(seen.values())
    text_of = dict(rows) | {-1: None, -2: "the"}
    assert len(out) == len(rows) + 3
    for r in out:
        tokens = [*brute.words(text_of[r.doc_id]), ""]
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(seen[w] > 0 for w in tokens), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_lm_probabilities_sum_to_one_and_look_back_only():
    import numpy as np

    from shelfmark.llm import lm_scoring as lm

    size = 300
    kind, inside = lm.classes_of(np.arange(size)[::-1].astype(float), {bytes([i % 256, i // 256]): i for i in range(size - 1)})
    by_class = np.bincount(kind, minlength=lm.CLASSES) + 1e-12
    model = lm.new_model(size, np.log(by_class / by_class.sum()))
    start = np.array([size - 1, 5, 9, 7])
    every = [np.append(start, i) for i in range(size)]
    last = lm.log_probabilities(model, kind, inside, every) - lm.log_probabilities(model, kind, inside, [start])[0]
    assert abs((10**last).sum() - 1) < 1e-4
    place, fresh = lm.windows_of(np.array([1, 16, 17, 40]))
    scored = place[fresh]
    assert sorted(scored.tolist()) == list(range(1 + 16 + 17 + 40))


def test_lm_context_weights_learn_from_every_text(spark):
    import numpy as np
    import public_tokenizers

    from shelfmark.llm import lm_scoring as lm

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = lm.read_ranks(path)
    # one text for each of these ids, which no other text has
    ids = {i: p.decode() for p, i in ranks.items() if p[:1] == b" " and p[1:].isascii() and p[1:].isalpha() and p.islower()}
    some = sorted(ids)[:4000]
    learning = spark.createDataFrame([(ids[i], i * 2654435761) for i in some], "text string, pick long")
    _, value = lm.fit(learning, path)
    start = lm.new_model(len(ranks) + 1, np.zeros(lm.CLASSES))
    for name in ("q", "k", "v", "own"):
        assert (value["model"][name][some] != start[name][some]).any(axis=1).all()


def test_lm_every_text_trains_once_whatever_the_size(spark):
    import numpy as np
    import public_tokenizers

    from shelfmark.llm import lm_scoring as lm
    from shelfmark.llm.common import Words

    ranks = lm.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = len(ranks)
    kind, _ = lm.classes_of(np.zeros(end + 1), ranks)
    rows = [(f"small corpus number {i} of a few words", i) for i in range(lm.STEPS)]
    value = {"ranks": ranks, "end": end, "kind": kind}
    model = lm.new_model(end + 1, np.zeros(lm.CLASSES))
    got = lm.trained(spark.createDataFrame(rows, "text string, pick long").coalesce(1), model, value)
    state, encode = lm.new_state({n: x.copy() for n, x in lm.new_model(end + 1, np.zeros(lm.CLASSES)).items()}), lm._encoder(type("", (), {"value": dict(value)}))
    for step, (text, _) in enumerate(rows):
        stream = lm.streams_of(Words([text.encode()]), 1, encode, end)
        lm.train(state, stream, kind, np.zeros(end + 1, np.int64), lm.RATE * (1 - 0.8 * step / lm.STEPS))
    for name in model:
        assert np.allclose(got[name], state[name], atol=1e-5)
