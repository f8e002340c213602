"""Stored models: runs, their coefficients or trees, and sketches of their validation residuals, under one path.

Every fit has a ``fit_id``, the partition of its tables, so later fits never rewrite earlier ones and reading some models reads their
fits only. Residual sketches are mergeable: sketches of later residuals are appended and merged when read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.blocks import SERIES
from gridcast.operators.intervals import level_column, validate_levels
from gridcast.operators.trees import TREES
from gridcast.sources.registry import RunRegistry, latest

COEFFICIENTS = f"fit_id string, {SERIES} string, h int, w array<double>"
SKETCHES = f"fit_id string, {SERIES} string, h int, sketch binary"
# Items a sketch keeps at least; a quantile of no more values than this is one of them exactly, else its rank errs by about 1.65 %.
SKETCH_ITEMS = 200


class ModelStore:
    """Runs of :func:`gridcast.operators.fleet.train_fleet` with what they learnt."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), RunRegistry(spark, f"{path.rstrip('/')}/runs")

    def _table(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").partitionBy("fit_id").parquet(f"{self.path}/{name}")

    def save(self, trained: dict) -> str:
        """Store a result of ``train_fleet``: runs, coefficients or trees, and the validation residuals' sketches. Returns the fit_id."""
        fit_id, fitted = trained["fit_id"], trained["fitted"]
        if fitted is not None:
            tree = "threshold" in fitted.columns
            rows = fitted if tree else fitted.select(SERIES, F.col("h").cast("int").alias("h"), "w")
            self._append(rows.withColumn("fit_id", F.lit(fit_id)), "trees" if tree else "coefficients")
        self.add_residuals(fit_id, trained["scored"].where("role = 'validation'"))
        self.registry.save(trained["runs"])  # last: a run that is listed can be loaded
        return fit_id

    def add_residuals(self, fit_id: str, scored: DataFrame) -> None:
        """Append sketches of the residuals of scored forecasts per series and step; call again when actual values arrive."""
        sketches = scored.groupBy(SERIES, F.col("h").cast("int").alias("h")).agg(
            F.kll_sketch_agg_double((F.col("actual") - F.col("yhat")).cast("double"), F.lit(SKETCH_ITEMS)).alias("sketch")
        )
        self._append(sketches.withColumn("fit_id", F.lit(fit_id)), "residuals")

    def runs(self, model_ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """The stored runs, or those of a list or table of ``model_id``; deleted ones are gone."""
        found = latest(self.registry.all())
        if model_ids is None:
            return found
        if isinstance(model_ids, DataFrame):
            return found.join(model_ids.select("model_id").distinct(), "model_id", "left_semi")
        return found.where(F.col("model_id").isin(list(model_ids)))

    def fitted(self, fit_id: str, model: str) -> DataFrame | None:
        """What a fit learnt, as :func:`gridcast.operators.fleet.forecast` takes it; None for models without a fit."""
        if model == "GradientBoosting":
            return self._table("trees", f"fit_id string, {TREES}").where(F.col("fit_id") == fit_id).drop("fit_id")
        found = self._table("coefficients", COEFFICIENTS).where(F.col("fit_id") == fit_id).drop("fit_id")
        return found if model in ("LinearRegression", "ARIMA") else None

    def residual_quantiles(self, fit_id: str, levels: Sequence[float] | None = None) -> DataFrame:
        """Quantiles of a fit's residuals per series and step, named as :func:`gridcast.operators.intervals.add_bands` takes them."""
        merged = self._table("residuals", SKETCHES).where(F.col("fit_id") == fit_id).groupBy(SERIES, "h").agg(F.kll_merge_agg_double("sketch").alias("_s"))
        return merged.select(SERIES, "h", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"_r{level_column(q)}") for q in validate_levels(levels)])
