"""Which datasets exist, and what is in them."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.blocks import blocked, previous_ts
from gridcast.functions.time import epoch, frequency_label
from gridcast.sources.readings import parse_timestamp

# Directories that hold tools, not data.
SKIPPED_DIRECTORIES = ("__pycache__", "node_modules", ".git", ".venv", "venv")
# What a path has below its dataset: files in key=value folders and part files of a writer; anything in a folder named like a file.
PART_FILE = r"(^|/)(([^/]+=[^/]*/)+[^/]+|part-\d[^/]*)$"
IN_NAMED_FOLDER = r"^(.*?\.(csv|parquet))/.*$"


def list_datasets(
    spark: SparkSession, directory: str, recursive: bool = True, limit: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """CSV and Parquet datasets under a directory, by path, with the full count.

    A dataset is a file, or a folder of part files (see :func:`dataset_path`) with the sum of their sizes and the latest of
    their times. ``recursive=False`` keeps the datasets directly in the directory. ``limit`` keeps the first datasets by
    path, ``max_depth`` those in at most so many nested folders; neither is set by default.

    Only file metadata is read: the content column never leaves the scan.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    depth = max_depth if recursive else 0
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,parquet}")
        .load(directory)
        .select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime")
    )
    kept = (
        placed(files, directory).where("listed")
        .where(F.size(F.split("relative_path", "/")) <= depth + 1 if depth is not None else F.lit(True))
        .groupBy("relative_path", F.lower(F.substring_index("path", ".", -1)).alias("format"))
        .agg(F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("modificationTime"))
    )
    total = kept.agg(F.count(F.lit(1)).alias("n_total"))
    top = kept.orderBy(F.lower("relative_path"), "relative_path", "format")
    top = top if limit is None else top.limit(limit)
    return top.select(
        "relative_path", "format", "size_bytes", "modificationTime", total.scalar().alias("n_total"),
    ).withColumn("truncated", F.lit(False) if limit is None else F.col("n_total") > limit)


def relative_path(path: Column, directory: str) -> Column:
    """The scan's ``_metadata.file_path`` below ``directory``, decoded; the whole path if it is elsewhere.

    An absolute directory is the first place in the path where it stands, so folders below may repeat its name. The scan
    names no ``.`` and ``..`` of the directory.
    """
    root = re.sub("/+", "/", re.sub("^[A-Za-z][A-Za-z0-9+.-]*:", "", directory) + "/")
    root = re.sub(r"^(\.\./)+", "", posixpath.normpath(root).rstrip("/") + "/")
    # a plus sign stands for itself in the URL form of a path
    plain = F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    if not root.startswith("/"):
        return F.substring_index(plain, "/" + root, -1)
    at = F.locate(root, plain)
    return F.when(at > 0, F.substr(plain, at + len(root))).otherwise(plain)


def dataset_path(path: Column) -> Column:
    """Path of the dataset that a file belongs to.

    A folder named ``*.csv`` or ``*.parquet`` is one dataset, whatever its files are called; so is a folder under which
    a writer left part files or ``key=value`` folders, ``.`` being the directory itself. Any other file is its own dataset.
    """
    folder = F.regexp_replace(F.regexp_replace(path, PART_FILE, ""), IN_NAMED_FOLDER, "$1")
    folder = F.coalesce(F.nullif(folder, F.lit("")), F.lit("."))
    # a profile asks for every row, so the usual paths take no regular expression
    csv, parquet = path.contains(".csv/"), path.contains(".parquet/")
    dataset = (
        F.when(path.contains("=") | (csv & parquet), folder)
        .when(parquet, F.concat(F.substring_index(path, ".parquet/", 1), F.lit(".parquet")))
        .when(csv, F.concat(F.substring_index(path, ".csv/", 1), F.lit(".csv")))
        .when(~path.contains("part-"), path)
        .otherwise(folder)
    )
    # never null, and known to be: a join's test for null would move below the sums and ask for every row
    return F.coalesce(dataset, F.lit("."))


def placed(files: DataFrame, directory: str | None) -> DataFrame:
    """Adds ``relative_path``, the dataset of the file at ``path`` below ``directory`` (else from the root), and ``listed``: false
    for hidden files and in folders that hold tools."""
    parts = F.split("_below", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    tools = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])) & (F.size(folders) > 0)
    return (
        files.withColumn("_below", relative_path(F.col("path"), directory or "/"))
        .withColumn("listed", ~F.exists(parts, lambda p: p.startswith(".")) & ~tools)
        .withColumn("relative_path", dataset_path(F.col("_below")))
        .drop("_below")
    )


def file_rows(spark: SparkSession, directory: str) -> DataFrame:
    """``relative_path, format, n_rows`` of every Parquet dataset under a directory, whatever its columns: the scan reads no column.

    Files are summed up before they are placed; as a filter, ``listed`` would be asked for every row. Files without rows
    yield none to a scan, so the file listing adds them with 0.
    """
    rows = spark.read.schema("none int").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(directory)
    files = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(directory)
    files = files.unionByName(there.select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("n")))
    return placed(files, directory).groupBy("relative_path", F.lit("parquet").alias("format")).agg(F.sum(F.when(F.col("listed"), F.col("n"))).alias("n_rows"))


def timed_rows(df: DataFrame, ts: str) -> DataFrame:
    """``path`` of the file, time as it is stored and as ``ts``, of every row of a scan."""
    parsed: Column = F.col(ts) if isinstance(df.schema[ts].dataType, (T.TimestampNTZType, T.TimestampType)) else parse_timestamp(ts)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col(ts).alias("_raw"), parsed.cast("timestamp_ntz").alias("ts"))


def time_ranges(df: DataFrame, ts: str, directory: str | None = None) -> DataFrame:
    """Per dataset of a scan: ``relative_path``, rows, time range and unreadable timestamps; files are summed up before they are placed."""
    files = timed_rows(df, ts).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.count_if(F.col("_raw").isNotNull() & F.col("ts").isNull()).alias("bad"),
    )
    return placed(files, directory).groupBy("relative_path").agg(
        F.sum("n").alias("n_rows"), F.min("first").alias("min_ts"), F.max("last").alias("max_ts"), F.sum("bad").alias("n_unparseable"),
    )


def profile_files(df: DataFrame, ts: str, directory: str | None = None) -> DataFrame:
    """Per dataset: rows, time range, unreadable timestamps and cadence. ``file`` is its path below ``directory``, else its name.

    ``df`` is a scan of one format with a common schema; the path comes from
    the scan's metadata, and files of one dataset are profiled together (see
    :func:`dataset_path`). Gaps are measured between distinct readable times;
    one row per distinct time leaves the first shuffle.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cadence = median_gap(placed(timed_rows(df, ts), directory), ["relative_path"])
    name = F.col("relative_path") if directory else F.element_at(F.split("relative_path", "/"), -1)
    return time_ranges(df, ts, directory).join(cadence, "relative_path", "left").select(
        name.alias("file"), "n_rows", "min_ts", "max_ts", "n_unparseable",
        frequency_label("median_gap_s").alias("frequency"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.concat_ws(",", *[F.lit(c) for c in numeric]).alias("numeric_columns"),
    )


def median_gap(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median seconds between consecutive distinct times, per key.

    Works on raw, unsorted, duplicated times: distinct times first, then gaps
    inside blocks of a day with the edge carried over. Equal gaps are counted before
    the median; k different whole-second gaps span at least k * (k + 1) / 2
    seconds, so a century holds fewer than 80,000 of them.
    """
    times = df.where(F.col("ts").isNotNull()).select(*keys, "ts").distinct()
    b = previous_ts(blocked(times, 86400, keys), keys=keys)
    gaps = b.where(F.col("prev_ts").isNotNull()).groupBy(
        *keys, (epoch("ts") - epoch("prev_ts")).alias("gap")
    ).agg(F.count(F.lit(1)).alias("n"))
    return gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap_s"))
