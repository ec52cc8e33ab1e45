"""Quality rules: rules on each text, and a verdict on each host from the rates at which its texts fail.

The failures of a host are aggregated (sums, combined before the exchange, so one host may hold any
share of the rows). The rates of all hosts give a beta prior by the method of moments: with mean m
and variance v of the rates, its weight is m(1 - m)/v - 1, held between 1 and 10,000. A host's rate
is shrunk to (failed + weight m) / (texts + weight). Texts of a host above ``HOST_LIMIT`` go.

A null or empty text has no words and fails. A document without a host is judged by itself only.
Repeated rows are judged and counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import SPACES, Words, blocks, bytes_of, checked, documents, mix, tidy, written

MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
HOST_LIMIT = 0.5
# Fixed value: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def text_counts(texts: list[bytes], window: int = WINDOW) -> dict[str, np.ndarray]:
    words = Words(texts, fold=False)
    n = len(texts)
    edges = np.concatenate(([0], words.ends_of_texts))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[edges[1:]] - sums[edges[:-1]]

    chars = _STARTS_CHAR[words.data] & ~np.isin(words.data, list(SPACES))
    hashes, first = words.windows(window)
    own = mix(hashes ^ mix(words.text[first].astype(np.uint64) + np.uint64(1)))
    _, group, times = np.unique(own, return_inverse=True, return_counts=True)
    again = first[times[group] > 1] if len(first) else first
    size = len(words.hash) + window + 1
    covered = np.cumsum(np.bincount(again, minlength=size) - np.bincount(again + window, minlength=size))[: len(words.hash)] > 0
    return {
        "n_words": words.count,
        "word_chars": total(chars),
        "n_symbols": total(_IS_SYMBOL[words.data]),
        "n_dup_lines": np.fromiter(map(_repeated_lines, texts), np.int64, n),
        "n_repeat_words": np.bincount(words.text[covered], minlength=n),
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [text_counts(some) for _, some in blocks(bytes_of(batch.column("text")))]
        counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + counts, names=[batch.schema.names[i] for i in keep] + list(COUNTS)
        )


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, counts, base_failed, host, host_rate, kept, text_key) for each row of ``docs``."""
    narrow = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("text_key"), "text")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    rows = narrow.mapInArrow(tidy(_count_batches), f"doc_id long, host string, text_key long, {counts}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed))
    hosts = written(
        rows.where("host is not null").groupBy("host").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
        )
    )
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(10000.0).alias("weight")
    )
    m, weight = prior.first() or (None, None)
    m, weight = (0.0, 1.0) if m is None else (m, weight)
    verdicts = checked(written(hosts.select("host", ((F.col("failed") + weight * m) / (F.col("n") + weight)).alias("host_rate"))))
    # rows without a host have nothing to find; they are spread by their text
    spread = F.coalesce(F.col("host"), F.concat(F.lit("\x00"), F.col("text_key").cast("string")))
    verdicts = verdicts.withColumnRenamed("host", "_llm_host")
    joined = rows.join(verdicts, spread == F.col("_llm_host"), "left").drop("_llm_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= limit))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules and their host's verdict keep."""
    gone = checked(written(judged(docs, host).where(~F.col("kept")).select(F.col("doc_id").alias("_llm_id"), F.col("host").alias("_llm_host"), F.col("text_key").alias("_llm_key")).distinct()))
    matched = (
        F.col("doc_id").eqNullSafe(F.col("_llm_id")) & F.col(host).cast("string").eqNullSafe(F.col("_llm_host")) & (F.xxhash64("text") == F.col("_llm_key"))
    )
    return docs.join(gone, matched, "left_anti")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = judged(documents(spark, folder))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, unnest(range(0, greatest(len(ws) - 7, 0))) AS i, ws FROM w),
keyed AS (SELECT r, i, array_to_string(ws[i + 1:i + 8], ' ') AS k FROM win),
twice AS (SELECT r, unnest(list(i)) AS i FROM keyed GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + s.j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) s GROUP BY r),
base AS (
  SELECT d.r, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, x -> length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), x -> regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), x -> regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w ON w.r = d.r LEFT JOIN covered ON covered.r = d.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(10000.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS weight FROM moments),
rates AS (SELECT source, (failed + weight * m) / (n + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM f LEFT JOIN rates ON rates.source = f.source
"""
