"""Helpers the operators of this subpackage share: written tables, checked broadcasts, byte hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmark.session import shared_folder

# A side of at most so many narrow rows (a few numbers each, some tens of MB) may be broadcast.
BROADCAST_ROWS = 400_000
# Texts are hashed in blocks of about so many bytes, so that the arrays of a task stay small.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = str(16 << 20)

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _bound_batches(spark: SparkSession, size: str) -> None:
    """Texts go to Python in batches of at most ``size`` bytes, whatever the session's bound was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) != size:
        spark.conf.set(name, size)


def written(df: DataFrame, batch_bytes: int | str = BATCH_BYTES) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share; lineage ends there.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    _bound_batches(spark, str(batch_bytes))
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# Rows of one sorted part; more rows make more parts.
PART_ROWS = 50_000


def sorted_runs(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a written table) sorted by ``group`` and ``order``, and where each part holds each group.

    The first table adds ``_part`` and ``_at`` (ascending along the order inside a part); the second has
    one row per part and group: ``_part``, the group, ``_first`` (its least ``_at``), ``_n`` and
    ``_before`` (rows of the group in earlier parts). Parts are ranges of the sort key, ending in
    the row's number in ``rows``, so neither a large group nor equal keys land in one part.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS + 1)
    keys = [*group, *order, "_tie"]
    at = written(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = at.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return at, written(runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))


def place(at: DataFrame, runs: DataFrame, group: list[str], name: str) -> DataFrame:
    """``at`` with its place in its group (from 0) and what else ``runs`` has."""
    joined = at.join(runs, same(at, runs, ["_part", *group]), "inner").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    for column in ("_part", *group):
        joined = joined.drop(runs[column])
    return joined.drop("_first", "_n", "_before", "_at")


def text_id(text: str = "text") -> Column:
    """A number that tells texts apart; only used beside the id or before an exact comparison."""
    return F.xxhash64(F.col(text))


def held_back(divisor: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text has this remainder; a null id counts as an empty text."""
    number = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return number % divisor == remainder


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on all of ``names``."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


# ---- memory of Python workers ----------------------------------------------------------------


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives back at its end what it took: the worker process goes on to the tasks of later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


# ---- hashing of bytes in numpy -------------------------------------------------------------


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < size:
        size = max(size, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def range_hasher(data: np.ndarray):
    """For bytes ``data``, a function (starts, ends) -> 64-bit hash of each byte range."""
    up, down = _powers(len(data) + 1)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * down[starts])

    return of


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Fixed value: white space that ends a word.
SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


class Words:
    """The white-space words of some texts: hash, text number, byte range in the joined texts."""

    def __init__(self, texts: list[bytes], fold: bool = True) -> None:
        joined = b"\n".join(texts) + b"\n"
        if fold:
            joined = joined.translate(LOWER)
        self.joined = joined
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends_of_texts = np.cumsum(lengths + 1)
        space = _IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.ends_of_texts, self.starts, side="right")
        self.hash = range_hasher(self.data)(self.starts, self.ends)
        self.count = np.bincount(self.text, minlength=len(texts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word number of each run of ``size`` words inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(_BASE) + self.hash[i : i + n]
        inside = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return mix(out[inside]), inside


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``size`` bytes together, with the number of the first."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


# ---- connected components ------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable, for every node of a link.

    Large-star and small-star rounds: each joins every neighbour (then every smaller neighbour) to
    the smallest one, until nothing changes. Minima are aggregated before they are exchanged and
    written before the join back, so that a node with very many links can be split by the join.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low")))
        wide = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        # here every link points from a to a smaller b
        low = written(wide.groupBy("a").agg(F.min("b").alias("low")))
        near = wide.join(low, "a")
        edges = written(
            near.select("a", F.col("low").alias("b"))
            .union(near.select(F.col("b").alias("a"), F.col("low").alias("b")))
            .where("a <> b").distinct()
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # a star's root is the smaller end of each of its links
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))
