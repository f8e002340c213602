"""Reading tables: scans, wide-to-long, timestamps, duplicates, resampling, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.blocks import LOAD, SERIES, TS

CORRUPT = "_corrupt"


class DataLoadError(ValueError):
    """The input table cannot be used as asked."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """Scan CSV files with a header; an input without any row is an error.

    With ``keep_corrupt`` a line that does not fit the ``schema`` is kept as text in ``_corrupt``, else its cells that do not fit are NULL.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    if keep_corrupt:
        if not schema:
            raise DataLoadError("corrupt lines need a schema")
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.schema(schema) if schema else reader
    df = reader.csv(path)
    if not df.columns or df.isEmpty():
        raise DataLoadError(f"no rows in {path}")
    return nan_to_null(df)


def parse_csv_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Text lines to typed columns; a line that does not fit is kept in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    parsed = F.from_csv(F.col(column), ddl, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r")).select("r.*")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan Parquet; only the named columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def wide_to_long(
    df: DataFrame, ts: str, targets: Sequence[str], covariates: Sequence[str] = ()
) -> DataFrame:
    """One series per target column, sharing time and covariates."""
    missing = [c for c in [ts, *targets, *covariates] if c not in df.columns]
    if missing:
        raise DataLoadError(f"missing columns: {missing}")
    return df.unpivot([ts, *covariates], list(targets), SERIES, LOAD).select(
        SERIES, F.col(ts).alias(TS), LOAD, *covariates
    )


def parse_timestamp(text: str | Column) -> Column:
    """Text to wall clock time; offset-aware text becomes UTC, bad text NULL.

    The session runs in UTC, so a value with an offset is moved to UTC and a
    value without one keeps its clock.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def with_parsed_ts(df: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Replace a text column by ``ts``; strict mode fails the job on bad text."""
    parsed = parse_timestamp(text)
    if strict:
        bad = F.col(text).isNotNull() & parsed.isNull()
        parsed = F.when(
            bad, F.raise_error(F.concat(F.lit("unparseable timestamp: "), F.col(text))).cast("timestamp_ntz")
        ).otherwise(parsed)
    return df.withColumn(TS, parsed)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL from here on: Spark aggregates treat NaN as a value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def deduplicate(df: DataFrame, order: str, keys: Sequence[str] = (SERIES, TS)) -> DataFrame:
    """Keep the first row per key by ``order`` and report the group size.

    ``min_by`` combines before the shuffle, so a timestamp repeated a billion
    times leaves each task as one row.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in rest],
        F.min(order).alias(order),
        F.count(F.lit(1)).alias("n_copies"),
    )


def resample(
    df: DataFrame, unit: str, how: str = "sum", value: str = LOAD, series: str = SERIES, ts: str = TS
) -> DataFrame:
    """Readings per hour or day: ``sum``, ``avg`` or ``count`` per series."""
    agg = {"sum": F.sum, "avg": F.avg, "count": F.count}[how](value)
    return df.groupBy(F.col(series).alias(SERIES), F.date_trunc(unit, ts).cast("timestamp_ntz").alias(TS)).agg(
        agg.alias(LOAD)
    )


def write_results(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (SERIES,), mode: str = "overwrite") -> None:
    """Write result rows in one directory per key.

    Rows are hashed by the key; a partition above the session's advisory size is split, so
    one large series becomes several files written by several tasks and a small one a single file.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt).option("header", True).save(path)


# Folders that a bucketed result has, however many series there are.
RESULT_BUCKETS = 256


def result_bucket(series, buckets: int = RESULT_BUCKETS):
    return F.pmod(F.xxhash64(series), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int = RESULT_BUCKETS, mode: str = "overwrite") -> None:
    """Write result rows in one folder per hash bucket of the series; a large bucket becomes several files written by several tasks."""
    rows = df.withColumn("bucket", result_bucket(F.col(SERIES), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", SERIES).write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, series: Sequence[str] | None = None, buckets: int = RESULT_BUCKETS) -> DataFrame:
    """Rows of a bucketed result; of named series only their buckets are read."""
    df = spark.read.parquet(path)
    if series is not None:
        wanted = [r[0] for r in spark.createDataFrame([(s,) for s in series], f"{SERIES} string").select(result_bucket(F.col(SERIES), buckets)).distinct().collect()]
        df = df.where(F.col("bucket").isin(wanted) & F.col(SERIES).isin(list(series)))
    return df.drop("bucket")
