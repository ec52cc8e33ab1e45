"""Filter interaction audit: what each filter removes, alone and behind others, in every order.

Rows are numbered; the ids of ``RANGE`` consecutive numbers make a range. Per part (language) and range there is one
row of sorted posting lists: the ids that fail each filter, and those of good and of toxic documents. One
galloping k-way merge walks the lists together: it takes the least head, and where a single list has it,
searches (in doubling steps, then by bisection) how far that list runs before the next head. It
yields the size of each cell, the ids that are in exactly these lists. Cells are summed over ranges; unions
and differences of filters are sums of disjoint cells: what filter f removes behind the filters P is all
cells with f and none of P. So every number of the report is exact, and a range bounds a list's length
whatever share of the rows a part or a text has.

Which rows fail: A under 200 words; B fewer distinct words than half the words; C more than 3 capital
letters A-Z per 100 code points; D any of ``#$%&*|``; E a text that a row with a smaller id has. A
null text is empty (and equal to other empty ones); a null id is neither smaller nor larger; a null language is
part "". Rows with the same id don't fail E by each other. A document is good or toxic if any of its label rows says
so; rows without id have no label. Repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import documents, written

# Ids of one posting list at most.
RANGE = 4096
FILTERS = "ABCDE"
# The lists of a range: the filters, then what documents may be lost.
LISTS = (*FILTERS, "good", "toxic")

# The filters' limits and patterns.
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3
MARKS = r"[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, A, B, C, D) for each row; ``text_key`` is the text's SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.withColumn("n", F.size("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"),
        (F.col("n") < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.col("n")).alias("B"),
        (100 * capitals > MAX_CAPITALS * F.length("text")).alias("C"),
        F.col("text").rlike(MARKS).alias("D"),
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``failures`` with E, good and toxic.

    The copies of a text are counted before they are exchanged; only texts with a smallest id and more rows
    are joined back, so a large group of copies is a large key of the left side alone.
    """
    rows = written(failures(docs))
    copies = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = written(copies.where("n > 1 and first_id is not null").drop("n"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marks = written(marks.where("label_id is not null and (good or toxic)"))
    false = F.lit(False)
    return (
        rows.join(copies, "text_key", "left").join(marks, rows["doc_id"] == marks["label_id"], "left")
        .select(
            "doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first_id"), false).alias("E"),
            F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"),
        )
    )


def postings(rows: DataFrame, lists: tuple[str, ...] = LISTS, width: int = RANGE) -> DataFrame:
    """(part, range, n, and one sorted array of row numbers for each of ``lists``) from rows with these flags."""
    numbered = written(rows.select("part", *lists).withColumn("id", F.monotonically_increasing_id()))
    span = F.floor(F.col("id") / width).alias("range")
    return numbered.groupBy("part", span).agg(
        F.count(F.lit(1)).alias("n"), *(F.array_sort(F.collect_list(F.when(F.col(c), F.col("id")))).alias(c) for c in lists)
    )


def gallop(ids: list[int], at: int, bound: int) -> int:
    """The first place from ``at`` on whose id is not below ``bound``."""
    step = 1
    while at + step < len(ids) and ids[at + step] < bound:
        step *= 2
    return bisect_left(ids, bound, at + step // 2, min(at + step, len(ids)))


def cells(lists: list[list[int]]) -> dict[int, int]:
    """How many ids are in exactly the lists of each bit mask, for sorted lists of distinct ids."""
    sizes: dict[int, int] = {}
    at = [0] * len(lists)
    live = [i for i, ids in enumerate(lists) if ids]
    while live:
        least, second, mask = None, None, 0
        for i in live:
            head = lists[i][at[i]]
            if least is None or head < least:
                least, second, mask, only = head, least, 1 << i, i
            elif head == least:
                mask |= 1 << i
            elif second is None or head < second:
                second = head
        if mask & (mask - 1):
            taken = 1
            for i in live:
                at[i] += mask >> i & 1
        else:
            ids = lists[only]
            end = len(ids) if second is None else gallop(ids, at[only], second)
            taken, at[only] = end - at[only], end
        sizes[mask] = sizes.get(mask, 0) + taken
        live = [i for i in live if at[i] < len(lists[i])]
    return sizes


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            sizes = cells([row[c] for c in LISTS])
            # ids in no list
            sizes[0] = row["n"] - sum(sizes.values())
            found += [(row["part"], mask, n) for mask, n in sizes.items() if n]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["part", "mask", "n"])


def part_cells(lists: DataFrame) -> DataFrame:
    """(part, cells): the sizes of all cells of a part, at most 2 ** 7 of them."""
    sizes = lists.select("part", "n", *LISTS).mapInArrow(_cell_batches, "part string, mask int, n long")
    sizes = sizes.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    return sizes.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("cells"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters, and step."""
    parts = part_cells(postings(judged(docs, labels)))
    good, toxic = 1 << LISTS.index("good"), 1 << LISTS.index("toxic")
    every = (1 << len(FILTERS)) - 1

    def total(test) -> Column:
        """Ids in the cells that pass ``test`` of the bit mask."""
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda sum_, cell: sum_ + F.when(test(cell["mask"]), cell["n"]).otherwise(0))

    def without(mask: Column, bits) -> Column:
        return mask.bitwiseAND(bits) == 0

    def removed(bit, before, more: int = 0) -> Column:
        return total(lambda m: ~without(m, bit) & without(m, before) & ((F.lit(more) == 0) | ~without(m, F.lit(more))))

    def share(f: int) -> Column:
        """What filter f removes, summed over all orders: |P|! (4 - |P|)! orders have just the filters P before it."""
        sets = [p for p in range(every + 1) if not p >> f & 1]
        times = [factorial(p.bit_count()) * factorial(len(FILTERS) - 1 - p.bit_count()) for p in sets]
        table = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in zip(sets, times)))

        def orders(mask: Column) -> Column:
            """Orders in which no filter of the cell comes before f."""
            return F.aggregate(table, F.lit(0), lambda sum_, x: sum_ + F.when(without(mask, x["p"]), x["t"]).otherwise(0))

        def add(sum_: Column, cell: Column) -> Column:
            return sum_ + F.when(~without(cell["mask"], F.lit(1 << f)), cell["n"] * orders(cell["mask"])).otherwise(0)

        return F.aggregate("cells", F.lit(0).cast("bigint"), add)

    def alone(f: int) -> Column:
        return total(lambda m: m.bitwiseAND(every) == 1 << f)

    filters = range(len(FILTERS))
    known = parts.select(
        "part", "cells", F.array(*map(share, filters)).alias("shares"), F.array(*map(alone, filters)).alias("alone")
    )
    fields = "filter_order string, step int, bit int, before int"
    table = F.array(*(F.struct(*map(F.lit, x)) for x in steps())).cast(f"array<struct<{fields}>>")
    rows = known.withColumn("s", F.explode(table)).select("part", "cells", "shares", "alone", "s.*")
    bit, before, number = F.col("bit"), F.col("before"), F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: without(m, bit.bitwiseOR(before))).alias("kept"),
        removed(bit, before).alias("removed"),
        total(lambda m: ~without(m, bit) & ~without(m, before)).alias("redundant"),
        F.element_at("alone", number).alias("unique_fails"),
        removed(bit, before, good).alias("good_lost"),
        removed(bit, before, toxic).alias("toxic_lost"),
        F.element_at("shares", number).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
      100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
n AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, x.i, e.i] AS o FROM n a, n b, n c, n x, n e WHERE len(list_distinct([a.i, b.i, c.i, x.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders),
r AS (
  SELECT part, filter_order, step, o[step] AS flt,
    sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda i: fails[i]))) AS kept,
    sum(n) FILTER (fails[o[step]] AND (step = 1 OR NOT list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])))) AS removed,
    sum(n) FILTER (fails[o[step]] AND step > 1 AND list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i]))) AS redundant,
    sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n) FILTER (good AND fails[o[step]] AND (step = 1 OR NOT list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])))) AS good_lost,
    sum(n) FILTER (toxic AND fails[o[step]] AND (step = 1 OR NOT list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])))) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, o)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, flt)::BIGINT AS shapley
FROM r
"""
