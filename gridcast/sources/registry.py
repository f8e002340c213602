"""Registry of fitted runs, kept as an append-only Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = """
    model_id string, series_id string, building string, model_type string, created_at timestamp_ntz,
    frequency string, lookback int, horizon int, validation_split double,
    target string, past_covariates array<string>, future_covariates array<string>,
    train_start timestamp_ntz, train_end timestamp_ntz, n_rows bigint,
    train_cv_rmse double, cv_rmse double, runtime_s double, energy_kwh double,
    params map<string,string>, deleted boolean, fit_id string, calendar_static boolean
"""


def model_id(building: Column, model_type: Column, created_at: Column, unique: Column) -> Column:
    """``{building}_{model}_{yyyymmdd_HHMMSS}_{suffix}``; the suffix keeps
    runs apart that a parallel fit creates in the same second."""
    clean = F.lower(F.regexp_replace(building, r"[^A-Za-z0-9]+", "_"))
    kind = F.lower(F.regexp_replace(model_type, r"[^A-Za-z0-9]+", "_"))
    return F.concat_ws("_", clean, kind, F.date_format(created_at, "yyyyMMdd_HHmmss"), unique)


def latest(runs: DataFrame) -> DataFrame:
    """The newest record of every model id, deletions applied."""
    w = Window.partitionBy("model_id").orderBy(F.col("created_at").desc(), F.col("deleted").desc())
    newest = runs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return newest.where(~F.coalesce(F.col("deleted"), F.lit(False)))


ORDERS = {
    "created": (F.desc, "created_at"),
    "cv_rmse": (F.asc_nulls_last, "cv_rmse"),
    "model_type": (F.asc, "model_type"),
}


def list_runs(
    runs: DataFrame,
    building: str | None = None,
    model_type: str | None = None,
    sort_by: str = "created",
    limit: int | None = None,
) -> DataFrame:
    """Runs of a building or type, sorted, with the total that matched."""
    kept = latest(runs)
    if building is not None:
        kept = kept.where(F.col("building") == building)
    if model_type is not None:
        kept = kept.where(F.col("model_type") == model_type)
    total = kept.agg(F.count(F.lit(1)).alias("n_total"))
    make, column = ORDERS[sort_by]
    top = kept.orderBy(make(column), F.asc("model_id"))
    top = top if limit is None else top.limit(limit)
    return top.withColumn("n_total", total.scalar())


class RunRegistry:
    """Runs stored under a path every executor can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, runs: DataFrame) -> None:
        """Append run records; missing columns become NULL."""
        empty = self.spark.createDataFrame([], RUN_SCHEMA)
        empty.unionByName(runs, allowMissingColumns=True).select(*empty.columns).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RUN_SCHEMA)

    def list(self, **kwargs) -> DataFrame:
        return list_runs(self.all(), **kwargs)

    def get(self, model: str) -> DataFrame:
        return latest(self.all().where(F.col("model_id") == model))

    def delete(self, model: str) -> None:
        """Append a deletion record; earlier files are never rewritten."""
        gone = self.get(model).withColumn("deleted", F.lit(True))
        self.save(gone)
