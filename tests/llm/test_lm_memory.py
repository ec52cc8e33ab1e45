"""Cutting into ids and scoring hold little of a batch at a time, and the ids stay those of each word alone."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from shelfmark.llm import lm_scoring as lm
from shelfmark.llm.common import LOWER, Words

RANKS = lm.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
END = len(RANKS)


class Shared:
    def __init__(self, **value) -> None:
        self.value = value


def _peak(run, batch: pa.RecordBatch) -> int:
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows
    return peak


def test_memory_does_not_follow_the_size_of_a_batch(spark):
    dice = random.Random(5)
    words = ["".join(dice.choices("abcdeilmnorstuéü", k=dice.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(dice.choices(words, k=500)) for _ in range(2_400)]
    kind, inside = lm.classes_of(np.zeros(END + 1), RANKS)
    scoring = Shared(
        end=END, kind=kind, inside=inside, model=lm.new_model(END + 1, np.zeros(lm.CLASSES)), total=100, distinct=10, ends=5,
        codes=np.zeros(0, np.int64), counts=np.zeros(0, np.int64),
    )
    cutting = Shared(ranks=RANKS, end=END)
    lm._encoder(cutting)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    coded = pa.Table.from_batches(lm._encode_batches(cutting)(iter([batch]))).combine_chunks().to_batches()[0]
    half = coded.slice(0, len(texts) // 2)
    for run, whole, part in (
        (lm._encode_batches(cutting), batch, batch.slice(0, len(texts) // 2)), (lm._score_batches(scoring), coded.drop_columns("_llm_size"), half.drop_columns("_llm_size")),
    ):
        few, many = _peak(run, part), _peak(run, whole)
        assert many < few * 1.5 and many < 100 << 20
    lm.encoded(spark.createDataFrame([("a b",)], "text string"), RANKS)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_ids_of_words_cut_together_are_those_of_each_word(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED", 40)
    dice = random.Random(1)
    texts = [b"", b"\x1c", b"ab\xff c \xc3", b" lead", b"\xff\x85 a", "Zero ~~ line\nthe 日本 😀 \x1cq d\x85e a　b".encode()]
    texts += ["".join(dice.choices("ab é\x85\x1c　\x7f\x00\n\t'1,日", k=dice.randint(0, 40))).encode() for _ in range(400)]
    encode = lm._encoder(Shared(ranks=RANKS))
    cut = lm.CutWords(RANKS, END, encode)
    for first in range(0, len(texts), 50):
        some = texts[first : first + 50]
        ids, edges = cut.ids(Words(some))
        for text, a, b in zip(some, edges[:-1], edges[1:]):
            words = text.translate(LOWER).split()
            assert ids[a:b].tolist() == [i for x in lm.ids_of_words(words, encode) for i in x]
