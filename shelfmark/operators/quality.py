"""Row rules of the catalogue as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.schema import FORMATS


def constraint_violations(books: DataFrame) -> DataFrame:
    """(rule, key, n): rows breaking a value rule by id, and values that should be unique.

    The value rules are one pass over the table; the uniqueness rules count before exchanging.
    """
    c = F.col
    rules = {
        "format": ~c("format").isin(*FORMATS),
        "file_size": c("file_size") < 0,
        "page_count": c("page_count") < 0,
        "is_missing": c("is_missing").isNull(),
    }
    broken = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]),
        lambda rule: rule.isNotNull(),
    )
    rows = books.select(
        F.explode(broken).alias("rule"),
        c("id").cast("string").alias("key"),
        F.lit(1).cast("bigint").alias("n"),
    )
    for column in ("file_path", "content_hash"):
        again = (
            books.where(c(column).isNotNull())
            .groupBy(c(column).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where(c("n") > 1)
            .select(F.lit(f"unique_{column}").alias("rule"), "key", "n")
        )
        rows = rows.unionByName(again)
    return rows
