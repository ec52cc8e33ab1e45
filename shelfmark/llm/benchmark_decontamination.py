"""Benchmark decontamination: winnowed fingerprints find candidate windows, equal words confirm them.

Only DataFrame functions. Words are lower-cased in A-Z. A window is ten consecutive words of an item,
or all words of a shorter one. Each ten-word window has six 5-gram hashes, and its fingerprint is
the smallest: equal windows have equal fingerprints, so every shared span of ten words is found.
A shorter item is fingerprinted whole; texts then give the grams of just those lengths too.
Texts keep each fingerprint once, join them with those of the items, and only texts with a match
are read again: the starts of the matched fingerprints are extended to whole windows, which are
joined with the items' windows on their words.

Fingerprints and windows of the items are broadcast only below ``BROADCAST_ROWS``; above, the joins
shuffle. Null or empty texts and items have no words. Items without an id hit words but are not
listed. Repeated rows come back as often as they are there.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import checked, documents, text_id, written

WINDOW = 10
GRAM = 5
# Fixed value: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    ascii_only = F.char_length(text) == F.octet_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(folded, BETWEEN), ""), F.array().cast("array<string>"))


def _starts(length: Column, size: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(length >= size, F.sequence(F.lit(0), length - size)).otherwise(none)


def _gram_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` words."""
    return F.transform(_starts(F.size(words), size), lambda i: F.xxhash64(F.lit(size), *[words[i + j] for j in range(size)]))


def _winnowed(grams: Column) -> Column:
    """The smallest gram hash of each window of ten words."""
    span = WINDOW - GRAM + 1
    return F.transform(_starts(F.size(grams), span), lambda i: F.least(*[grams[i + j] for j in range(span)]))


def _tokenised(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """``keys``, words, and per window length an array ``f<length>`` of fingerprints by start."""
    out = df.select(*keys, words_of(F.col("text")).alias("words")).withColumn("grams", _gram_hashes(F.col("words"), GRAM))
    shorter = {f"f{m}": _gram_hashes(F.col("words"), m) for m in lengths}
    return out.withColumns({f"f{WINDOW}": _winnowed(F.col("grams")), **shorter}).drop("grams")


def _window(words: Column, start: Column, size: int) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def _start_if(wanted):
    return lambda fingerprint, i: F.when(wanted(fingerprint), i)


def _windows(rows: DataFrame, keys: list[str], lengths: list[int], wanted) -> DataFrame:
    """A row per start of a window: keys, start, size, words joined; ``wanted(size)`` tells by fingerprint."""
    parts = []
    for m in [WINDOW, *lengths]:
        # the fingerprints are the argument, as inside the function they would be made for each start
        starts = F.array_compact(F.transform(F.col(f"f{m}"), _start_if(wanted(m))))
        exploded = rows.select(*keys, "words", F.explode_outer(starts).alias("start")).where("start is not null")
        parts.append(exploded.select(*keys, "start", F.lit(m).alias("size"), _window(F.col("words"), F.col("start"), m).alias("window")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    sized = items.select("item_id", "text", F.size(words_of(F.col("text"))).alias("n"))
    found = sized.where((F.col("n") > 0) & (F.col("n") < WINDOW)).select("n").distinct().collect()
    lengths = sorted(r["n"] for r in found)
    item_rows = _tokenised(sized, ["item_id", "n"], lengths)
    item_windows = written(
        _windows(item_rows, ["item_id", "n"], lengths, lambda m: lambda _: F.col("n") == m if m < WINDOW else F.col("n") >= m)
        .select("item_id", "window").distinct()
    )
    prints = [item_rows.select(F.explode_outer(f"f{WINDOW}").alias("print"))]
    prints += [item_rows.where(F.col("n") == m).select(F.explode_outer(f"f{m}")) for m in lengths]
    every = prints[0]
    for more in prints[1:]:
        every = every.union(more)
    fingerprints = checked(written(every.where("print is not null").distinct().withColumn("matched", F.lit(True))))

    keyed = docs.select("doc_id", text_id().alias("text_key"), "text")
    names = [f"f{m}" for m in [WINDOW, *lengths]]
    own = _tokenised(keyed, ["doc_id", "text_key"], lengths).select(
        "doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"),
        # the null at the end stands for the text itself
        F.explode_outer(F.array_append(F.array_distinct(F.concat(*names)), F.lit(None).cast("bigint"))).alias("print"),
    )
    matched = own.join(fingerprints, "print", "left").where("matched or print is null")
    texts = written(
        matched.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"), F.count_if(F.col("print").isNull()).alias("copies"), F.collect_set("print").alias("prints")
        )
    )
    candidates = checked(
        texts.where(F.size("prints") > 0)
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "prints")
    )
    again = keyed.join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    again = _tokenised(again, ["doc_id", "text_key", "prints"], lengths)
    windows = _windows(
        again, ["doc_id", "text_key"], lengths, lambda m: lambda fingerprint: F.array_contains(F.col("prints"), fingerprint)
    )
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    hits = windows.join(checked(item_windows), "window").groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    hits = written(hits).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a word inside a window of an item."""
    found = contamination(docs, items).where("contaminated")
    gone = checked(written(found.select(F.col("doc_id").alias("_llm_id"), F.col("text_key").alias("_llm_key")).distinct()))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (text_id() == F.col("_llm_key")), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return contamination(documents(spark, folder), items).drop("text_key")


OP2_SQL = r"""
WITH item AS (
  SELECT row_number() OVER () AS r, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
iw AS (
  SELECT item_id, least(len(ws), 10) AS size, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS i FROM item WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, size, array_to_string(ws[i + 1:i + size], ' ') AS win FROM iw),
sizes AS (SELECT DISTINCT size FROM wins),
dw AS (SELECT r, size, ws, unnest(range(0, greatest(len(ws) - size + 1, 0))) AS i FROM doc, sizes),
dwin AS (SELECT r, size, i, array_to_string(ws[i + 1:i + size], ' ') AS win FROM dw),
hit AS (SELECT r, i, dwin.size, item_id FROM dwin JOIN wins ON wins.win = dwin.win AND wins.size = dwin.size),
pos AS (SELECT r, unnest(range(i, i + size)) AS p FROM hit),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM pos GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n ON n.r = doc.r LEFT JOIN it ON it.r = doc.r
"""
