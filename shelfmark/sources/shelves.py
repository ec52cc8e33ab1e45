"""A catalogue that grows by small changes: rows in buckets of their paths, a bucket in parts.

A version is a list of the parts of each bucket, each with the version that wrote its files: what a change
does not touch is the same files in both versions. New rows are a new part beside the others; a bucket
that loses or changes a row is rewritten as one part. A new part takes in the newest parts before it
that have no more rows than it has by then, so that a bucket has few parts and a row is rewritten few times.
Versions are written once and never changed; one is complete with the marker of its
last table, ``batches``, which also tells what of each stream it holds. Rows keep their search columns
when their part is rewritten. Per part, counts by language are kept, so that statistics add up what is stored.

    <root>/rows/v=<n>/bucket=<b>/     rows of the parts version n wrote
    <root>/counts/v=<n>/              bucket, language, visible rows, of the same parts
    <root>/versions/v=<n>/buckets     bucket, written (version), rows, top_id; one row a part
    <root>/versions/v=<n>/batches     stream, batch (the last one merged)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.operators.browse import TITLE_KEY, title_key
from shelfmark.operators.search import visible, with_search_columns
from shelfmark.operators.stats import stats_of_counts
from shelfmark.schema import BOOK_COLUMNS
from shelfmark.session import cut_lineage
from shelfmark.sources.catalog import ID_FILTER, conform

# Buckets of a new store; the new rows of a bucket are written in one task, so choose rows / BUCKETS to suit one.
BUCKETS = 64
# Tasks a core that write a new store, at most; each writes a file to each bucket.
STORE_TASKS = 16
# Ids that are broadcast to whole rows, at most; more are exchanged with them.
FEW_IDS = 1_000_000
# Texts take up most of a store.
_STORED = {**ID_FILTER, "compression": "zstd", "partitionOverwriteMode": "static"}

_LISTED = "bucket int, written long, rows long, top_id long"
_BATCHES = "stream string, batch long"


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Shelves:
    """One version of such a catalogue, the newest complete one by default."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.version = self._newest() if version is None else version

    # ---- reading -----------------------------------------------------------------------------

    def _newest(self) -> int | None:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/v=*/batches/_SUCCESS")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath().getParent().getParent().getName() for s in system.globStatus(pattern) or []]
        return max((int(name.split("=")[1]) for name in done), default=None)

    def _at(self, table: str, version: int | None = None) -> str:
        number = self.version if version is None else version
        return f"{self.root}/{table}/v={number:08d}"

    def _parts(self) -> list:
        """bucket, written (version), rows, top_id: one small row per part."""
        return self.spark.read.schema(_LISTED).parquet(f"{self._at('versions')}/buckets").collect()

    def parts(self) -> dict[int, dict[int, int]]:
        """bucket to its parts (version that wrote it to rows); an empty bucket has a part without rows."""
        found: dict[int, dict[int, int]] = {}
        for r in self._parts():
            found.setdefault(r.bucket, {})[r.written] = r.rows
        return found

    def listed(self) -> dict[int, tuple[int, int, int]]:
        """bucket to (version that wrote it last, rows, largest id)."""
        found: dict[int, tuple[int, int, int]] = {}
        for r in self._parts():
            written, rows, top = found.get(r.bucket, (r.written, 0, 0))
            found[r.bucket] = (max(written, r.written), rows + r.rows, max(top, r.top_id))
        return found

    def batches(self) -> dict[str, int]:
        """Stream to its last merged batch."""
        return {r.stream: r.batch for r in self.spark.read.schema(_BATCHES).parquet(f"{self._at('versions')}/batches").collect()}

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows with their derived columns and their bucket; of some buckets, only their files."""
        parts = self.parts()
        return self._rows_of(parts, {b: list(parts[b]) for b in (parts if buckets is None else parts.keys() & set(buckets))})

    def _rows_of(self, parts: dict[int, dict[int, int]], chosen: dict[int, list[int]]) -> DataFrame:
        """The rows of some parts (bucket to versions)."""
        folders = [f"{self._at('rows', w)}/bucket={b}" for b in sorted(chosen) for w in sorted(chosen[b]) if parts[b][w]]
        schema = self.spark.read.parquet(f"{self._at('versions')}/schema").schema
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumn("bucket", bucket_of(F.col("file_path"), len(parts)))

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows' ``file_path``: at most as many as the store has."""
        bucket = bucket_of(F.col("file_path"), len(self.listed())).alias("b")
        return sorted(row.b for row in rows.select(bucket).distinct().collect())

    def books(self) -> DataFrame:
        return self.stored().select(*BOOK_COLUMNS)

    def stats(self) -> DataFrame:
        """Total and languages of the visible books, added up from the buckets' counts: no row is read."""
        wanted: dict[int, list[int]] = {}
        for bucket, parts in self.parts().items():
            for written in parts:
                wanted.setdefault(written, []).append(bucket)
        stored = [
            self.spark.read.schema("bucket int, language string, n long").parquet(self._at("counts", written)).where(F.col("bucket").isin(*buckets))
            for written, buckets in sorted(wanted.items())
        ]
        counts = stored[0]
        for part in stored[1:]:
            counts = counts.unionByName(part)
        return stats_of_counts(counts)

    # ---- writing -----------------------------------------------------------------------------

    def _write(self, rows: list[DataFrame], parts: dict[int, dict[int, int]], tops: dict[int, int], batches: dict[str, int], version: int) -> Shelves:
        """Write ``rows`` (laid out) as new parts, and the list that puts them beside ``parts``, which stay."""
        target = self._at("rows", version)
        for number, some in enumerate(rows):
            some.write.mode("append" if number else "overwrite").options(**_STORED).partitionBy("bucket").parquet(target)
        own = rows[0].drop("bucket").schema
        schema = StructType([*own.fields, StructField("bucket", IntegerType())])
        written = self.spark.read.schema(schema).parquet(target)
        per_language = visible(written).groupBy("bucket", "language").agg(F.count(F.lit(1)).alias("n"))
        per_language.write.mode("overwrite").parquet(self._at("counts", version))
        sizes = {r.bucket: (r.rows, r.top_id) for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("top_id")).collect()}
        listed = []
        for bucket, kept in sorted(parts.items()):
            size, top = sizes.get(bucket, (0, 0))
            # the largest id ever given stays known when its row goes, so that no id is given twice
            top = max(top or 0, tops[bucket])
            now = {**kept, version: size} if size or not kept else kept
            listed += [(bucket, w, n, top) for w, n in sorted(now.items())]
        folder = self._at("versions", version)
        self.spark.createDataFrame(listed, _LISTED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")
        self.spark.createDataFrame([], own).write.mode("overwrite").parquet(f"{folder}/schema")
        self.spark.createDataFrame(sorted(batches.items()), _BATCHES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches")
        return Shelves(self.spark, self.root, version)

    def change(self, before: DataFrame, after: DataFrame, stream: str | None = None, batch: int | None = None) -> Shelves:
        """The next version: rows ``before`` (of this version) become rows ``after``, all others stay.

        Both are read once. Buckets that lose or change a row are rewritten, the other rows in them with the search
        columns they have; buckets that only get rows get them as a part of their own. A batch of a stream that is
        merged already changes nothing.
        """
        batches = self.batches()
        if stream is not None and batches.get(stream, -1) >= batch:
            return self
        if stream is not None:
            batches[stream] = batch
        c = F.col
        parts, tops = self.parts(), {b: entry[2] for b, entry in self.listed().items()}
        signed = conform(before).withColumn("_more", F.lit(-1)).unionByName(conform(after).withColumn("_more", F.lit(1)))
        both = cut_lineage(signed.groupBy(*BOOK_COLUMNS).agg(F.sum("_more").cast("int").alias("_more")).where(c("_more") != 0))
        bucket = bucket_of(c("file_path"), len(parts))
        tallies = both.groupBy(bucket.alias("b")).agg(F.sum(F.greatest("_more", F.lit(0))).alias("come"), F.count_if(c("_more") < 0).alias("gone")).collect()
        gone = both.where(c("_more") < 0).select("id").distinct()
        losing: set[int] = set()
        if any(row.gone for row in tallies):
            held = self.stored([row.b for row in tallies]).select("id", "bucket").join(gone, "id", "left_semi")
            losing = {row.bucket for row in held.select("bucket").distinct().collect()}
        replaced: dict[int, list[int]] = {}
        for row in tallies:
            rows_by_version, rows = parts[row.b], row.come
            replaced[row.b] = list(rows_by_version) if row.b in losing else []
            for written in sorted(rows_by_version, reverse=True) if row.come and row.b not in losing else ():
                if rows_by_version[written] > rows:
                    break
                replaced[row.b].append(written)
                rows += rows_by_version[written]
        come = both.where(c("_more") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), c("_more")))).select(*BOOK_COLUMNS)
        fresh = _fresh(come.repartition(bucket), len(parts))
        new = [fresh]
        if any(replaced.values()):
            rest = self._rows_of(parts, replaced)
            if losing:
                rest = rest.join(few_ids(gone), "id", "left_anti")
            # written by the tasks that read it, sorted again
            new.append(rest.select(*fresh.columns).sortWithinPartitions("bucket", TITLE_KEY, "id"))
        left = {b: {w: n for w, n in own.items() if w not in replaced.get(b, [])} for b, own in parts.items()}
        return self._write(new, left, tops, batches, self.version + 1)


def few_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table), to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def _fresh(books: DataFrame, buckets: int) -> DataFrame:
    """New rows with their bucket, in the order of a part; the search columns are worked out after the sort, which then is of fewer bytes."""
    rows = conform(books).withColumn(TITLE_KEY, title_key()).withColumn("bucket", bucket_of(F.col("file_path"), buckets))
    return with_search_columns(rows.sortWithinPartitions("bucket", TITLE_KEY, "id"))


def create(books: DataFrame, root: str, version: int = 0, buckets: int = BUCKETS) -> Shelves:
    """The first version, with all buckets. Rows are not exchanged: each task writes to all buckets."""
    spark = books.sparkSession
    rows = _fresh(books.coalesce(STORE_TASKS * spark.sparkContext.defaultParallelism), buckets)
    return Shelves(spark, root, version)._write([rows], {b: {} for b in range(buckets)}, dict.fromkeys(range(buckets), 0), {}, version)
