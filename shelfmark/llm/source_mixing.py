"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources ordered by code point (null last) weigh 3, 1, 2, 3, 1, 2, ... A mix of ``SHARE`` times all words is
dealt out by weight. A source whose part would be above ``MAX_EPOCHS`` times its words is clamped there and
what it leaves is dealt out again among the others, until none is above. Each round is one sum over
the source table: with clamped words C and free weight W, the level is (total - C) / W.

A source's goal is its target rounded to whole words. Every document is taken goal // words times whole.
What is left of the goal takes the documents once more in the order of a seeded digest of their id, up
to the word: the last one reached is taken in part (its first words), so that the words taken of
a source are its goal. Running sums are made in ``BUCKETS`` even ranges of the digest, with one sum
per source and range before them, so that a source may hold any share of the rows.

A null text has no words; documents of no words and sources of no words are taken 0 times. Rows with the
same id are ordered by size and text; rows equal in all of these are interchangeable. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.common import documents, place, sorted_runs, written

# Weights in the order of the sources, parts of all words, repetitions at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
# Hexadecimal digits of the digest that make a range: 4,096 ranges a source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, name, size, draw, text_key): ``name`` is the source without nulls, ``draw`` gives the order.

    ``carried`` columns follow as ``_llm_<column>``.
    """
    source = F.col("source").cast("string")
    return written(
        docs.select(
            "doc_id", source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("name"),
            word_count().alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"),
            F.xxhash64("text").alias("text_key"),
            *(F.col(c).alias(f"_llm_{c}") for c in carried),
        )
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(name, source_size, weight, target) for each source.

    If even all sources at ``max_epochs`` fall short of ``share``, all are clamped.
    """
    sources = written(sized.groupBy("name").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("name") == "n"))
    at, runs = sorted_runs(sources, [], ["last", "name"])
    cycle = F.array(*map(F.lit, weights))
    ranked = place(at, runs, [], "rank").withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = written(ranked.select("name", "source_size", "weight", (F.col("source_size") * max_epochs).alias("cap")))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        # all at or above their cap at this level stay there, as the level only rises
        above = F.col("cap") < F.col("weight") * F.lit(level)
        held, free, n = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count_if(above),
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - held) / free
    target = F.when(F.col("cap") < F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    part = F.col("weight") * F.lit(total - held) / F.lit(free) if free else F.col("cap").cast("double")
    return ranked.select("name", "source_size", "weight", target.otherwise(part).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, carried: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, taken): ``whole`` repetitions, ``taken`` words.

    ``taken - whole * size`` words are taken of one repetition more. ``carried`` columns follow as ``_llm_<column>``.
    """
    sized = sizes(docs, seed, carried)
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    wanted = (
        targets(sized, **options).withColumn("whole", whole.cast("bigint"))
        .withColumn("rest", (goal - F.col("whole") * F.col("source_size")).cast("bigint"))
    )
    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    ranges = sized.groupBy("name", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    ranges = written(ranges.join(wanted, "name"))
    inside = (
        Window.partitionBy("name", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = sized.withColumn("bucket", bucket).join(ranges, ["name", "bucket"])
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return rows.withColumn("taken", F.col("whole") * F.col("size") + extra).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "taken", *(f"_llm_{c}" for c in carried)
    )


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once per repetition, the last one with its first words if it is in part."""
    columns = tuple(docs.columns)
    rows = mix(docs, seed, columns, **options).where("taken > 0")
    part = F.col("taken") - F.col("whole") * F.col("size")
    # each word with the white space before it
    cut = F.array_join(F.slice(F.regexp_extract_all("_llm_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, part.cast("int")), "")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("whole") + (part > 0).cast("bigint"))))
    in_part = (F.col("copy") > F.col("whole")) & (part < F.col("size"))
    text = F.when(in_part, cut).otherwise(F.col("_llm_text"))
    return copies.select(*(text.alias(c) if c == "text" else F.col(f"_llm_{c}").alias(c) for c in columns))


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw, hash(text) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS total FROM s),
lined AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS held, sum(weight) OVER upward AS free
  FROM w WINDOW before AS (ORDER BY 2.0 * source_size / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upward AS (ORDER BY 2.0 * source_size / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT held, free FROM lined WHERE weight * (total - held) / free <= 2 * source_size ORDER BY 2.0 * source_size / weight, r LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN 2 * source_size < weight * (total - line.held) / line.free THEN (2 * source_size)::DOUBLE
      ELSE weight * (total - line.held) / line.free END AS target
  FROM w, line),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, goal - whole * source_size - earlier)))::BIGINT AS taken
FROM run JOIN g ON g.source IS NOT DISTINCT FROM run.source
"""
