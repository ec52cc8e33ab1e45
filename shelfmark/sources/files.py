"""File trees as DataFrames."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from shelfmark.functions.files import COVER_SUFFIXES, cover_book_id
from shelfmark.session import cut_lineage

BOOK_SUFFIXES = (".epub",)
_CHUNK = 1 << 20


def _any_case(suffix: str) -> str:
    return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in suffix)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/+", "/")


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _outermost(roots: list[str]) -> list[str]:
    """Roots not below another one, each once: no file is then listed twice."""
    clean = list(dict.fromkeys(root.rstrip("/") or "/" for root in roots))
    return [r for r in clean if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in clean)]


def inventory(
    spark: SparkSession,
    roots: list[str],
    suffixes: tuple[str, ...] = BOOK_SUFFIXES,
    content: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of several roots; a root may be one file, a missing root is an error row.

    A root below another root is read once. Without ``content`` the scan
    reads no file bytes.
    """
    present = [root for root in roots if _exists(spark, root)]
    absent = [(root, "path not found") for root in roots if root not in present]
    errors = spark.createDataFrame(absent, "path string, detail string")
    columns = [
        plain_path(F.col("path")).alias("path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_mtime"),
    ]
    if not present:
        empty = "path string, file_size long, file_mtime timestamp" + (", content binary" if content else "")
        return spark.createDataFrame([], empty), errors
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    globs = ",".join("*" + _any_case(s) for s in suffixes)
    reader = reader.option("pathGlobFilter", "{" + globs + "}" if len(suffixes) > 1 else globs)
    files = reader.load(_outermost(present)).select(*columns, *([F.col("content")] if content else []))
    return files, errors


def cover_inventory(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Cover images below a folder with the book id their name stands for."""
    return with_cover_ids(inventory(spark, [folder], COVER_SUFFIXES, content)[0])


def with_cover_ids(covers: DataFrame) -> DataFrame:
    return covers.withColumn("book_id", cover_book_id(F.col("path")))


def split_path(path: str) -> tuple[str, str, str]:
    """(scheme, authority, path) of a path as Spark names it; blanks and percent signs stay."""
    scheme, colon, rest = path.partition(":")
    if not colon or not scheme.isalnum() or not rest.startswith("/"):
        return "file", "", path
    if not rest.startswith("//"):
        return scheme, "", rest
    authority, _, inner = rest[2:].partition("/")
    return scheme, authority, "/" + inner


@lru_cache(maxsize=16)
def _file_system(scheme: str, authority: str):
    from pyarrow import fs

    host, _, port = authority.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem()
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem()
    if scheme == "gs":
        return fs.GcsFileSystem()
    if scheme in ("hdfs", "viewfs"):
        return fs.HadoopFileSystem(f"{scheme}://{host}" if host else "default", int(port or 0))
    raise ValueError(f"files of scheme {scheme!r} cannot be opened by path; read them with their content")


def open_file(path: str):
    """A stream of the bytes at a path on local or cluster storage; ``OSError`` if it is gone."""
    scheme, authority, inner = split_path(path)
    in_bucket = scheme in ("s3", "s3a", "s3n", "gs")
    return _file_system(scheme, authority).open_input_stream(authority + inner if in_bucket else inner)


@F.pandas_udf(StringType())
def _sha1_of_files(paths: pd.Series) -> pd.Series:
    def digest(path: str) -> str | None:
        total = hashlib.sha1()
        try:
            with open_file(path) as stream:
                while chunk := stream.read(_CHUNK):
                    total.update(chunk)
        except OSError:
            return None
        return total.hexdigest()

    return paths.map(digest, na_action="ignore")


# Bytes of one task that opens files by path, about; a larger file has a task of its own.
PACK_BYTES = 256 << 20
# Paths that are broadcast to an inventory that carries its bytes, at most.
FEW_PATHS = 100_000
_PACK_GROUPS = 4096


def packed(files: DataFrame, most: int = PACK_BYTES) -> DataFrame:
    """Files (path, file_size, ...) dealt to tasks of about ``most`` bytes, large files alone.

    The files are numbered by the bytes before them, along a hash of the path: sums of 4,096 even groups
    first, then inside each group. A small library is dealt to more tasks of fewer bytes, so that all cores read.
    """
    spark = files.sparkSession
    rows = cut_lineage(files.withColumn("_hash", F.xxhash64("path")).withColumn("_group", F.pmod("_hash", F.lit(_PACK_GROUPS))))
    total, largest = rows.agg(F.coalesce(F.sum("file_size"), F.lit(0)), F.coalesce(F.max("file_size"), F.lit(0))).first()
    if not total:
        return files
    most = max(1, min(most, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    # a large file counts as whole packs, so that the next file starts a new one
    weight = F.when(F.col("file_size") < most, F.col("file_size")).otherwise(F.lit(most) * (F.ceil(F.col("file_size") / most) + 1))
    rows = rows.withColumn("_weight", weight)
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("_group").agg(F.sum("_weight").alias("_sum")).select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_group").orderBy("_hash", "path").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_shift") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    # at most 4,096 sums; a large file is put where its second pack begins, which nothing else does
    pack = F.floor(start / most) + (F.col("file_size") >= most).cast("int")
    dealt = cut_lineage(rows.join(F.broadcast(shifts), "_group").withColumn("_pack", pack).select(*files.columns, "_pack"))
    # consecutive numbers of the packs that have files
    packs = dealt.select("_pack").distinct()
    along = Window.orderBy("_pack")
    numbered = packs.select("_pack", (F.row_number().over(along) - 1).alias("_task"))
    count = packs.count()
    return dealt.join(F.broadcast(numbered), "_pack").repartitionById(count, F.col("_task").cast("int")).select(*files.columns)


def contents(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """What is needed to open the files of ``paths`` (path, ...; unique): packed paths, or the inventory's bytes.

    An inventory that carries its bytes is not exchanged for it: the paths are broadcast to it if they are few.
    Beyond that the bytes are; a large library is listed without them.
    """
    wanted = paths.select("path")
    if "content" not in inventory.columns:
        return packed(inventory.select("path", "file_size").join(wanted, "path", "left_semi"))
    few = wanted.limit(FEW_PATHS + 1).count() <= FEW_PATHS
    return inventory.select("path", "content").join(F.broadcast(wanted) if few else wanted, "path", "left_semi")


def hashed(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """``paths`` (a written table: path, file_size, ...; unique) with the SHA-1 of their files in ``inventory``.

    Files are opened by path in tasks of even bytes. Bytes that an inventory carries are hashed where they
    are: only those of few paths (which are broadcast), else all, and hashes are joined.
    """
    if "content_hash" in inventory.columns:
        return paths.join(inventory.select("path", "content_hash"), "path")
    if "content" not in inventory.columns:
        return with_content_hash(packed(paths))
    own = inventory.select("path", "content")
    if paths.limit(FEW_PATHS + 1).count() <= FEW_PATHS:
        return with_content_hash(own.join(F.broadcast(paths), "path")).drop("content")
    return paths.join(with_content_hash(own).drop("content"), "path")


def with_content_hash(files: DataFrame) -> DataFrame:
    """SHA-1 of the bytes.

    A ``content`` column is hashed in place. Without one the files are opened by path and read in
    chunks, so that only the files still in the DataFrame are read and none has to fit in a row;
    an unreadable file gets NULL.
    """
    if "content_hash" in files.columns:
        return files
    value = F.sha1("content") if "content" in files.columns else _sha1_of_files("path")
    return files.withColumn("content_hash", value)
