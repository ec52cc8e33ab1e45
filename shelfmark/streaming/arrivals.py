"""Files that land continuously, merged into a bucketed catalogue batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.plans.jobs import scan_part
from shelfmark.sources.shelves import Shelves

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the package files appearing below a folder.

    The file source knows a file by its path: rewritten and deleted files are left to the batch scan.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[eE][pP][uU][bB]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return files.select(
        F.regexp_replace("path", r"\Afile:/+", "/").alias("path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_mtime"),
        "content",
    )


def merge_arrivals(
    arrivals: DataFrame, root: str, checkpoint: str, now: str, validate: bool = True
) -> StreamingQuery:
    """Merge a stream of files (path, file_size, file_mtime, content) into the store below ``root``.

    Each batch makes the version after the newest one: a new part of each bucket that gets rows, and the buckets rewritten whose rows it changes. The
    stream's batch number is stored with the version, so a batch repeated after a failure changes nothing
    once it is merged, and every file counts once. The store must exist; it may be at any version.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        store = Shelves(batch.sparkSession, root)
        if store.batches().get(checkpoint, -1) >= number:
            return
        before, result = scan_part(store, batch, now, validate)
        store.change(before, result.books, checkpoint, number)

    return (
        arrivals.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
