"""Chat formatting: collapse cumulative snapshots of conversations, render the maximal ones.

Only DataFrame functions. A conversation's turns are numbered in the order of (turn, role, text). The
rolling hash after turn i is the exclusive or of two 64-bit hashes of (j, role, text) over j <= i. A
conversation goes when its last hash is the hash of a proper prefix of a longer one; of equal
conversations the smallest id stays. Anti-joins do both, on keys made distinct before.

Turns are numbered by their place in a range-partitioned sort. Hashes are taken in blocks of ``BLOCK`` turns and
shifted by the blocks before, and what is rendered is one row per block, so that one conversation, its turns numbered
or not, may hold any share of all turns.
Repeated rows of one conversation count once; turns without a number come first; rows without a
conversation id are one conversation. Null role and text differ from empty ones in the hash and are
rendered as ``unknown`` and empty. Marker strings inside a text are broken up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.common import place, sorted_runs, written

BLOCK = 256
START = "<|im_start|>"
END = "<|im_end|>"
_LEAST = -(1 << 63)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, part, i, role, text, p1, p2): turns by number with the rolling hash up to each."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_LEAST)).alias("conv"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(_LEAST)).alias("turn"), "role", "text",
    )
    at, runs = sorted_runs(written(rows.distinct()), ["conv"], ["turn", "role", "text"])
    rows = place(at, runs, ["conv"], "place").withColumn("i", F.col("place") + 1)
    turn = ["i", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    rows = rows.select("conv", "i", "role", "text", F.floor((F.col("i") - 1) / BLOCK).alias("part"), F.xxhash64(*turn).alias("h1"), F.xxhash64(F.lit(7), *turn).alias("h2"))
    rows = written(rows)
    sums = written(rows.groupBy("conv", "part").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2")))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = written(sums.select("conv", "part", *[F.coalesce(F.bit_xor(s).over(before), zero).alias(s) for s in ("s1", "s2")]))
    inside = Window.partitionBy("conv", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.bit_xor("h1").over(inside)).withColumn("r2", F.bit_xor("h2").over(inside))
    return rows.join(sums, ["conv", "part"]).select(
        "conv", "part", "i", "role", "text", F.col("r1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("p2")
    )


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with rolling hashes, the conversations that stay with their number of turns)."""
    rows = written(numbered(turns))
    last = written(rows.groupBy("conv").agg(F.max(F.struct("i", "p1", "p2")).alias("last")))
    full = last.select("conv", "last.*")
    distinct = written(full.groupBy("i", "p1", "p2").agg(F.min("conv").alias("conv")))
    # a prefix is proper where the conversation goes on behind it
    lengths = full.select("conv", F.col("i").alias("n"))
    proper = written(rows.select("conv", "i", "p1", "p2").join(lengths, "conv").where("i < n").select("i", "p1", "p2").distinct())
    kept = distinct.join(proper, ["i", "p1", "p2"], "left_anti").select("conv", F.col("i").alias("n_turns"))
    return rows, written(kept)


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of the maximal conversations, ``BLOCK`` turns a part."""
    rows, kept = maximal(turns)
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), clean, F.lit(f"{END}\n"))
    parts = rows.join(kept, "conv").groupBy("conv", "part", "n_turns").agg(
        F.array_sort(F.collect_list(F.struct("i", piece.alias("piece")))).alias("pieces")
    )
    return parts.select(
        F.nullif("conv", F.lit(_LEAST)).alias("conv_id"), "part", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("rendered")
    )


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return render(spark.read.parquet(f"{folder}/conversations.parquet"))


OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
k AS (SELECT *, coalesce(strlen(role)::VARCHAR, '-') || ':' || coalesce(role, '') || coalesce(strlen(text)::VARCHAR, '-') || ':' || coalesce(text, '') AS part FROM n),
p AS (SELECT *, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
  count(*) OVER (PARTITION BY conv_id) AS len FROM k),
proper AS (SELECT DISTINCT i, prefix FROM p WHERE i < len),
whole AS (SELECT i, prefix, min(conv_id) AS conv_id FROM p WHERE i = len GROUP BY i, prefix),
kept AS (SELECT w.conv_id, w.i AS n_turns FROM whole w LEFT JOIN proper q ON q.i = w.i AND q.prefix = w.prefix WHERE q.i IS NULL)
SELECT n.conv_id, ((n.i - 1) // 256)::BIGINT AS part, kept.n_turns::BIGINT AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY n.i) AS rendered
FROM n JOIN kept ON kept.conv_id IS NOT DISTINCT FROM n.conv_id
GROUP BY n.conv_id, (n.i - 1) // 256, kept.n_turns
"""
