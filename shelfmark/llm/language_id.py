"""Language ID: nearest of several clustered centroids per language, cosine of TF-IDF n-gram vectors.

A text is lower-cased, every run of other characters than letters becomes a space, and its byte
2-grams and 3-grams are counted in ``BUCKETS`` hashed places. Document frequencies are taken over all
learning texts; centroids come from spherical k-means over at most about ``SAMPLE`` labelled texts of
each language (chosen by a hash of the id; languages with fewer give all). The prediction is the
language of the nearest centroid; a text farther from it than ``REJECT`` of the centroid's own sample is
flagged ``rejected``. Only text and non-null lang of learning rows are read.

Null texts and texts without a letter are ``und`` with score 0. Whole texts count; rows are
independent, so nothing is shuffled when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import blocks, bytes_of, documents, held_back, mix

BUCKETS = 8192
SAMPLE = 600
CLUSTERS = 3
REJECT = 0.005
UNDETERMINED = "und"

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_LETTER = regex.compile(r"\p{L}")


def counts_of(texts: list[bytes], buckets: int) -> np.ndarray:
    """n-gram counts by text and bucket."""
    data = _FOLD[np.frombuffer(b" \n".join(texts) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + np.array([2] * (len(texts) - 1) + [1]))
    keep = (data != 32) | (np.concatenate(([0], data[:-1])) != 32)
    data, owner = data[keep].astype(np.uint64), owner[keep]
    out = np.zeros(len(texts) * buckets, np.float32)
    for size in (2, 3):
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | data[i : i + n]
        inside = owner[:n] == owner[size - 1 :]
        place = (mix(code[inside]) >> np.uint64(40)) % np.uint64(buckets)
        out += np.bincount(owner[:n][inside] * buckets + place.astype(np.int64), minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), buckets)


def vectors_of(texts: list[bytes], weight: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts_of(texts, len(weight))) * weight
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _small_blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of bounded bytes and bounded numbers of texts, as each text has a full vector."""
    for first, some in blocks(texts):
        for i in range(0, len(some), 256):
            yield first + i, some[i : i + 256]


def _frequency_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, some in _small_blocks(bytes_of(batch.column("text"))):
                total += (counts_of(some, buckets) > 0).sum(axis=0)
                rows += len(some)
        # bucket -1 holds the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets)), pa.array(np.concatenate(([rows], total)))], names=["bucket", "n"])

    return run


def clustered(rows: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means; starts from texts far from each other."""
    chosen = [rows.mean(axis=0)]
    for _ in range(min(clusters, len(rows)) - 1):
        chosen.append(rows[np.argmin(np.max(rows @ np.array(chosen).T, axis=1))])
    centroids = np.array(chosen, np.float32)
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(rows @ centroids.T, axis=1)
        centroids = np.array([rows[nearest == i].mean(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def fit(learning: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, clusters: int = CLUSTERS) -> dict | None:
    """The model from (text, lang, pick) rows, all labelled; pick orders the sample. None without rows."""
    counted = learning.select("text").mapInArrow(_frequency_batches(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, counted.collect()))
    rows = found.pop(-1, 0)
    per_language = {r["lang"]: r["count"] for r in learning.groupBy("lang").count().collect()}
    if not rows:
        return None
    frequency = np.array([found.get(i, 0) for i in range(buckets)], float)
    weight = (np.log((1 + rows) / (1 + frequency)) + 0.1).astype(np.float32)
    share = F.lit(0.0)
    for language, n in per_language.items():
        share = F.when(F.col("lang") == language, sample / n).otherwise(share)
    picked = learning.where(F.pmod(F.col("pick"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", F.col("text").cast("binary").alias("text")).toArrow()
    languages = np.array(picked.column("lang").to_pylist(), object)
    vectors = np.concatenate([vectors_of(some, weight) for _, some in _small_blocks([t or b"" for t in picked.column("text").to_pylist()])] or [np.zeros((0, buckets), np.float32)])
    names, centroids, limits = [], [], []
    for language in sorted(per_language):
        own = vectors[languages == language]
        own = own[np.linalg.norm(own, axis=1) > 0] if len(own) else own
        if not len(own):
            continue
        centers = clustered(own, clusters)
        close = own @ centers.T
        nearest = close.argmax(axis=1)
        for i in range(len(centers)):
            mine = close[nearest == i, i]
            names.append(language)
            limits.append(float(np.quantile(mine, REJECT)) if len(mine) else 0.0)
        centroids.append(centers)
    if not names:
        return None
    return {"weight": weight, "names": names, "centroids": np.concatenate(centroids).astype(np.float32), "limits": np.array(limits)}


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            names, scores, rejected = [], [], []
            for _, some in _small_blocks(texts):
                if model is None:
                    close = np.zeros((len(some), 1), np.float32)
                else:
                    close = vectors_of(some, model["weight"]) @ model["centroids"].T
                best = close.argmax(axis=1)
                for text, i, score in zip(some, best.tolist(), close[np.arange(len(some)), best].tolist()):
                    letters = model is not None and _LETTER.search(text.decode("utf-8", "replace")) is not None
                    names.append(model["names"][i] if letters else UNDETERMINED)
                    scores.append(min(max(score, 0.0), 1.0) if letters else 0.0)
                    rejected.append(not letters or score < model["limits"][i])
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[batch.schema.names[i] for i in keep] + ["lang_pred", "score", "rejected"],
            )

    return run


def predict(texts: DataFrame, model: dict | None) -> DataFrame:
    """lang_pred, score and rejected in place of ``text``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != "text")
    return texts.mapInArrow(_predict_batches(shared), fields + "lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = held_back(3, 1)
    learning = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(learning.select("text", "lang", F.xxhash64("doc_id").alias("pick")))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
