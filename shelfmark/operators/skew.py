"""Joins and numbering that stay spread out when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows one task should see of a single key. Beyond it the key is split.
HOT_ROWS = 1_000_000
_NULL_PARTS = 997


def join_hot(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    how: str,
    spread: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join on ``key`` (one or more columns) where ``left`` may hold very many rows of one key.

    ``right`` holds at most a few rows per key. A key with more than ``hot_rows`` left rows is cut
    into parts by the hash of the ``spread`` columns, and its right rows are copied to each part.
    The list of such keys is broadcast: it has fewer than ``rows of left / hot_rows`` entries,
    whatever the data. Left rows without a key match nothing and are spread as well.
    """
    keys = [key] if isinstance(key, str) else key
    known = all_of([F.col(k).isNotNull() for k in keys])
    hot = (
        left.where(known)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    slot = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    lone = F.pmod(F.xxhash64(*spread), F.lit(_NULL_PARTS)).cast("int")
    spread_left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_slot", F.when(known, slot).otherwise(lone)
    )
    copied_right = (
        right.where(known)
        .join(F.broadcast(hot), keys, "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return spread_left.drop("_parts").join(copied_right, [*keys, "_slot"], how).drop("_slot")


def rank_by_id(
    df: DataFrame, keys: list[str], id_col: str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based rank by ``id_col`` (unique, whole numbers) within ``keys``.

    Rows are ranked inside id ranges of ``hot_rows`` and shifted by the number of rows of the key
    in earlier ranges, so that no task sorts more than ``hot_rows`` rows of one key.
    """
    ranged = df.withColumn("_range", F.floor(F.col(id_col) / hot_rows))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(id_col)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(shifts, [*keys, "_range"])
        .withColumn(out, (F.col("_rank") + F.col("_shift")).cast("bigint"))
        .drop("_range", "_rank", "_shift")
    )


def number_by_digest(df: DataFrame, key: str, out: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of the MD5 of a unique text column.

    The first three hex digits make 4,096 even groups; each is numbered on its own and shifted by
    the size of the groups before it. The shifts are a table of at most 4,096 rows.
    """
    digested = df.withColumn("_digest", F.md5(F.col(key).cast("binary"))).withColumn(
        "_group", F.substring("_digest", 1, 3)
    )
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        digested.groupBy("_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_group").orderBy("_digest", key)
    return (
        digested.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(shifts), "_group")
        .withColumn(out, (F.col("_rank") + F.col("_shift")).cast("bigint"))
        .drop("_digest", "_group", "_rank", "_shift")
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
