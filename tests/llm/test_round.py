import random

import brute
import numpy as np
import public_tokenizers


def test_new_pieces_are_merged_together(monkeypatch):
    from tokenizers import Tokenizer

    from shelfmark.llm import bpe_codec

    path = public_tokenizers.path("byte_bpe_50k.json")
    dice = random.Random(5)
    letters = "abcdeiorstuy éß日本😀'09.,\n\t"
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 90))) for _ in range(300)]
    texts += ["", "<|endoftext|>a<|endoftext|><|endoftext|> b", "x" * 63, "x" * 64, "x" * 65, "é" * 200, " the" * 3, "aaaa" * 16]
    codec = bpe_codec.Codec(bpe_codec.read_vocabulary(path))
    alone = []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda symbols: alone.append(len(symbols)) or merge(symbols))
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(codec.encode_all(texts)) == expected
    # only the pieces too wide for an array of trees are merged one by one
    assert alone and min(alone) > bpe_codec.WIDEST
    assert [codec.encode(t) for t in texts] == expected
    assert all(len(p) <= 64 for p in codec.seen)
    pieces = [bytes(dice.choices(b"abcest ", k=dice.randint(1, 40))) for _ in range(500)]
    got = [np.frombuffer(x, np.uint32).tolist() for x in codec.merge_all(pieces)]
    assert got == [merge([codec.bytes_to_ids[b] for b in p]) for p in pieces]


def test_lm_cuts_each_text_into_ids_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shelfmark.llm import lm_scoring as lm

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = lm.read_ranks(path)
    texts = ["The quick brown fox", "a  b c 　d\x85e don't l'été 日本 😀 \x1cq", "", None, "Zero ~~ line\nthe quick"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pick", F.col("doc_id"))
    cuts = []
    cut = lm._encode_batches
    monkeypatch.setattr(lm, "_encode_batches", lambda shared: cuts.append(1) or cut(shared))
    with_ids = lm.encoded(docs, ranks)
    encode = lm._encoder(type("", (), {"value": {"ranks": ranks}}))
    for row in with_ids.collect():
        words = [w.encode() for w in brute.words(row.text)]
        assert lm._stream(row["_llm_ids"], len(ranks)).tolist() == [len(ranks), *(i for x in lm.ids_of_words(words, encode) for i in x), len(ranks)]
    counts, model = lm.fit(with_ids, path)
    out = lm.score(with_ids.drop("pick"), counts, model).collect()
    # counts, rounds of training and scores all read the ids that were written
    assert len(cuts) == 1 and len(out) == len(texts) and all(r.score < 0 for r in out)


def test_lm_slopes_are_those_of_the_cross_entropy():
    from shelfmark.llm import lm_scoring as lm

    size = 60
    dice = np.random.default_rng(3)
    state = lm.new_state(lm.new_model(size, np.zeros(lm.CLASSES)))
    kind = dice.integers(0, lm.CLASSES, size)
    ids = dice.integers(0, size, (5, lm.CONTEXT))
    scored, goal = np.arange(0, ids.size, 2), kind[dice.integers(0, size, -(-ids.size // 2))]

    def loss() -> float:
        hidden, _ = lm.attended(state, lm.side_by_side(state), ids)
        logits = (hidden[scored] @ state["out"] + state["bias"]).astype(float)
        return float((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(goal)), goal]).mean())

    dense, places = lm._slopes(state, lm.side_by_side(state), ids, scored, goal)
    by_id = np.zeros((size, places.shape[1]))
    np.add.at(by_id, ids.ravel(), places)
    found = {**dense, **dict(zip(lm.TABLES, np.split(by_id, lm._EDGES[1:-1], axis=1)))}
    for name in ("q", "k", "v", "own", "mix", "out", "bias"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        kept, step = state[name][at], np.float32(0.05)
        state[name][at] = kept + step
        more = loss()
        state[name][at] = kept - step
        less = loss()
        state[name][at] = kept
        assert abs((more - less) / (2 * step) - found[name][at]) < 0.05 * abs(found[name][at]) + 1e-5


def test_texts_cross_the_exchange_packed():
    import pyarrow as pa

    from shelfmark.llm import suffix_array_dedup as sa

    texts = ["one two three four five six seven " * 20, "é" * 300, "plain text that no one else has, " * 12]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array([11, 12, 13]), pa.array(texts)], names=["doc_id", "text_key", "text"])
    (packed,) = sa._pack_batches([batch])
    assert sum(map(len, packed.column("packed").to_pylist())) < sum(len(t.encode()) for t in texts) / 2
    owner, rank, begin, end, data, begins = sa.window_anchors([t.encode() for t in texts])
    lists = pa.array([sa.signed(rank[owner == i]).tolist() for i in range(3)], pa.list_(pa.int64()))
    (out,) = sa._context_batches(sa.LENGTH, sa.ANCHOR)([packed.append_column("ranks", lists)])
    whole = [texts[i].encode()[b - begins[i] : e - begins[i] + sa.LENGTH] for i, b, e in zip(owner.tolist(), begin.tolist(), end.tolist())]
    assert out.column("bytes").to_pylist() == whole
    assert out.column("rank").to_pylist() == sa.signed(rank).tolist()
    assert set(zip(out.column("doc_id").to_pylist(), out.column("text_key").to_pylist())) == {(1, 11), (None, 12), (3, 13)}


def test_rare_shingles_meet_by_48_bits_and_lose_no_link(spark, monkeypatch):
    import pyarrow as pa

    from shelfmark.llm import ngram_jaccard_join as join

    dice = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = dice.choices(words, k=40)
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join([*text, "end"])), (3 * i + 2, " ".join(dice.choices(words, k=30)))]
    empty = type("", (), {"value": (np.zeros(0, np.int64), np.zeros(0, np.int64))})
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    meets = np.concatenate([b.column("meet").to_numpy() for b in join._prefix_batches(join.WORDS, empty)([batch])])
    assert len(meets) and meets.min() >= 0 and meets.max() < 1 << 48
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.jaccard_components(docs).collect())
    assert sum(d != c for d, _, c in expected) >= 60
    # very few bits: nearly all shingles fall together, which only makes regions larger
    monkeypatch.setattr(join, "MEET_BITS", 3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.jaccard_components(docs).collect()) == expected
