"""Catalogue snapshots as Parquet tables, and the tables that answer requests beside them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.browse import MARK_STEP, SORTS, TITLE_KEY, Shelf, order_marks, title_key
from shelfmark.operators.postings import posting_blocks, postings_of
from shelfmark.operators.search import Indexes, author_index, direction, visible, with_search_columns
from shelfmark.schema import BOOK_COLUMNS, BOOKS


# A Bloom filter on the id picks the row group inside a file; 64 K rows are a row group of some 128 MB.
ID_FILTER = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "65536"}
# Consecutive ids of one folder of the key table.
KEY_SPAN = 1_000_000


def load_catalog(books: DataFrame) -> DataFrame:
    """The five columns that reconciliation needs."""
    return books.select("id", "file_path", "file_name", "content_hash", "is_missing")


def get_book(books: DataFrame, book_id: int, include_missing: bool = False) -> DataFrame:
    row = books.where(F.col("id") == book_id)
    return row if include_missing else row.where(~F.col("is_missing"))


def conform(books: DataFrame) -> DataFrame:
    """The catalogue columns in their fixed order and types."""
    return books.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BOOKS])


def write_catalog(books: DataFrame, root: str, version: int) -> str:
    """Write one snapshot: the books with their search columns, and the author index.

    Books are clustered by title order and the index by token, so that row-group statistics
    prune title ranges and token prefixes. A version is complete once both tables carry their
    success marker; readers pick the newest complete one. A complete version is never written again, as readers may
    hold it; what an attempt that failed left is.
    """
    target = f"{root}/v={version:08d}"
    if _exists(books.sparkSession, f"{target}/authors/_SUCCESS"):
        raise FileExistsError(f"version {version} below {root} is complete")
    # the search columns are worked out after the exchange: range sampling reads its input twice
    rows = conform(books).withColumn(TITLE_KEY, title_key())
    rows = rows.repartitionByRange(TITLE_KEY, "id").sortWithinPartitions(TITLE_KEY, "id")
    with_search_columns(rows).write.mode("overwrite").options(**ID_FILTER).parquet(f"{target}/books")
    written = books.sparkSession.read.parquet(f"{target}/books")
    index = author_index(written)
    index.repartitionByRange("token", "book_id").sortWithinPartitions("token", "book_id").write.mode(
        "overwrite"
    ).parquet(f"{target}/authors")
    return target


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest version whose last table is complete."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/authors/_SUCCESS")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getParent().getParent().getName() for s in system.globStatus(pattern) or []]
    return max((int(name.split("=")[1]) for name in done), default=None)


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(books with search columns, author index) of a version, the newest by default."""
    if version is None:
        version = latest_version(spark, root)
    target = f"{root}/v={version:08d}"
    return spark.read.parquet(f"{target}/books"), spark.read.parquet(f"{target}/authors")


def write_indexes(
    spark: SparkSession, root: str, version: int | None = None, sorts: tuple[str, ...] = SORTS, step: int = MARK_STEP
) -> str:
    """What requests need beside a written version: keys, word postings, and marks of some sorts in both directions.

    ``keys`` has the file of each id, in folders of ``KEY_SPAN`` ids; ``postings`` has blocks clustered by word;
    ``marks`` has every ``step``-th row of each order of the visible books.
    """
    version = latest_version(spark, root) if version is None else version
    target = f"{root}/v={version:08d}"
    books = spark.read.parquet(f"{target}/books")
    span = F.floor(F.col("id") / KEY_SPAN)
    keys = books.select("id", F.col("_metadata.file_name").alias("file"), span.alias("span"))
    keys.repartition("span").sortWithinPartitions("span", "id").write.mode("overwrite").partitionBy("span").parquet(f"{target}/keys")
    posting_blocks(books).write.mode("overwrite").parquet(f"{target}/postings")
    for sort in sorts:
        for way in ("asc", "desc"):
            marks = order_marks(visible(books), sort, way, step)
            marks.coalesce(1).sortWithinPartitions("position").write.mode("overwrite").parquet(f"{target}/marks/{sort}-{way}")
    return target


class Snapshot:
    """A stored version: its tables, and its rows by id."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark = spark
        self.version = latest_version(spark, root) if version is None else version
        self.folder = f"{root}/v={self.version:08d}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @cached_property
    def books(self) -> DataFrame:
        return self._table("books")

    @cached_property
    def authors(self) -> DataFrame:
        return self._table("authors")

    @cached_property
    def keys(self) -> DataFrame:
        return self.spark.read.schema("id long, file string, span long").parquet(f"{self.folder}/keys")

    @cached_property
    def postings(self) -> DataFrame:
        return postings_of(self._table("postings"))

    def rows_of(self, ids: list[int]) -> DataFrame:
        """The books with these ids, from the files that hold them."""
        if not ids:
            return self.books.limit(0)
        # one expression: a call for each id would take longer than the look-up
        asked = F.expr(f"id IN ({', '.join(str(int(i)) for i in ids)})")
        spans = sorted({i // KEY_SPAN for i in ids})
        held = self.keys.where(F.col("span").isin(*spans) & asked).select("file").distinct()
        files = [f"{self.folder}/books/{row.file}" for row in held.collect()]
        if not files:
            return self.books.limit(0)
        return self.spark.read.schema(self.books.schema).parquet(*files).where(asked)

    def marks(self, sort: str, sort_dir: str = "") -> DataFrame | None:
        """The marks of an order, None if they were not written."""
        path = f"{self.folder}/marks/{sort}-{direction(sort, sort_dir)}"
        return self.spark.read.parquet(path) if _exists(self.spark, f"{path}/_SUCCESS") else None

    @property
    def shelf(self) -> Shelf:
        return Shelf(Indexes(self.authors, self.postings, self.rows_of), self.marks)


def plain(books: DataFrame) -> DataFrame:
    """A stored snapshot without its derived columns."""
    return books.select(*BOOK_COLUMNS)
