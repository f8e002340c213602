"""What the corpus operators share: reading, ranking inside large groups, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.session import settle

# Words are runs of anything but ASCII white space; gaps are the white space between them.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def normalised(name: str = "text") -> Column:
    """The text with every run of white space as one space."""
    return F.regexp_replace(text_of(name), GAP, " ")


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("long")


def buckets_of(spark: SparkSession) -> int:
    """Parts into which every ranked group is dealt; grows with the cluster's setting."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def bucket_offsets(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows of each (group, _bucket) and the number of the group's rows in the buckets before it.

    Together with a row number inside (group, _bucket) this ranks a group of any size by tasks that
    each hold one bucket of it; the window runs over one row per bucket.
    """
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has an edge.

    Large-star and small-star steps replace the edges by edges to smaller nodes until they stand still;
    each step is settled in the shared folder, and only the change of the edge set's checksum reaches the driver.
    Neighbours of a hub are joined to one row of it, so Spark can split the hub's partition.
    """
    def stars(e: DataFrame, both: bool) -> DataFrame:
        around = e.union(e.select("v", "u")) if both else e
        least = around.groupBy("u").agg(F.min("v").alias("_m"))
        # A struct key differs from the grouping, so both sides are shuffled for the join and can be split.
        least = least.select(F.struct("u").alias("_k"), F.least("u", "_m").alias("_m"))
        met = around.withColumn("_k", F.struct("u")).join(least, "_k")
        if both:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        spread = met.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        return spread.union(met.select("u", F.col("_m").alias("v"))).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while (at := state(now)) != seen:
        seen = at
        now = settle(stars(stars(now, True), False)) if at[0] else now
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
