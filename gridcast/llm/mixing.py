"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import bucket, bucket_offsets, buckets_of, word_count
from gridcast.session import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
TOLERANCE = 1e-7
MOST_STEPS = 100


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target`` from ``source, size, n`` (documents of a size).

    Sources in code point order (null last) take the weights in turn and split ``share`` of all words by them; no
    target exceeds twice its source. The level at which targets stop is read off the sources ordered by the
    level at which each would stop. The windows run over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(MOST_COPIES)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = sources.withColumn("_w", weight).withColumn("_cap", limit).withColumn("_level", level)
    # While sources stop below the level it rises along the order, afterwards it falls.
    reached = F.max("_level").over(everything)
    return levels.withColumn("target", F.greatest(F.lit(0.0), F.least("_cap", F.col("_w") * reached))).select("source", "source_size", "target")


def _rate() -> F.Column:
    """Copies of a document of ``size``: two coins, tilted exponentially in its size."""
    return F.when(F.col("_full"), F.lit(float(MOST_COPIES))).otherwise(
        MOST_COPIES / (1 + F.exp(-F.col("_dual") * F.col("size") / F.col("_mean")))
    )


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, source_size, target, _mean, _full, _dual``: the dual variable of each source's word constraint.

    Of all rates between 0 and 2 whose expected words equal the target, those of greatest entropy are 2 / (1 +
    exp(-dual * size / mean)). Each Newton step is one aggregation over the histogram of sizes; started at 0 the steps
    approach the root from one side, because the expected words are concave above it and convex below.
    """
    means = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    state = settle(
        targets.join(means.withColumnRenamed("source", "_source"), same).select(
            "source", "source_size", "target", F.greatest("_mean", F.lit(1e-9)).alias("_mean"),
            (F.col("target") >= F.col("source_size") * MOST_COPIES * (1 - 1e-9)).alias("_full"), F.lit(0.0).alias("_dual"),
        )
    )
    rate, z = _rate(), F.col("size") / F.col("_mean")
    for _ in range(MOST_STEPS):
        sums = sizes.withColumnRenamed("source", "_source").join(state, same).groupBy("source").agg(
            *[F.max(c).alias(c) for c in ("source_size", "target", "_mean", "_full", "_dual")],
            F.sum(F.col("n") * F.col("size") * rate).alias("_words"),
            F.sum(F.col("n") * F.col("size") * z * rate * (1 - rate / MOST_COPIES)).alias("_slope"),
        )
        gap = F.col("target") - F.col("_words")
        still = F.col("_full") | (F.col("_slope") <= 0)
        state = settle(sums.select(
            "source", "source_size", "target", "_mean", "_full",
            (F.col("_dual") + F.when(still, 0.0).otherwise(gap / F.col("_slope"))).alias("_dual"),
            F.when(still, 0.0).otherwise(F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("_miss"),
        ))
        if (state.agg(F.max("_miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.drop("_miss")


def plan_copies(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """``source, source_size, target, size, n, copies``: copies that all documents of one size get together.

    Rates are added up from the longest size down and rounded where the sum passes a half, so a source misses its
    target by at most half its longest document. What is missing is made up by sizes that stand for their power of
    two, from long to short, at most one per power.
    """
    same = F.col("source").eqNullSafe(F.col("_source"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    total = F.sum(F.col("n") * _rate()).over(down.rowsBetween(Window.unboundedPreceding, 0))
    bins = sizes.withColumnRenamed("source", "_source").join(state, same).drop("_source").withColumn("_upto", F.floor(total + 0.5))
    copies = F.col("_upto") - F.coalesce(F.lag("_upto").over(down), F.lit(0))
    bins = bins.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n") * MOST_COPIES).cast("long"))
    bins = settle(bins.select("source", "source_size", "target", "size", "n", "copies"))

    spare = F.col("n") * MOST_COPIES - F.col("copies")
    powers = bins.where("size > 0").groupBy("source", "target", F.floor(F.log2("size")).alias("_power")).agg(
        F.sum(F.col("size") * F.col("copies")).alias("_words"),
        F.max_by(F.struct("size", spare.alias("room")), F.struct(spare, "size")).alias("_more"),
        F.max_by(F.struct("size", F.col("copies").alias("room")), F.struct("copies", "size")).alias("_less"),
    )
    # At most 63 powers per source.
    lists = powers.groupBy("source", "target").agg(
        F.sum("_words").alias("_words"), F.reverse(F.array_sort(F.collect_list(F.struct("_power", "_more", "_less")))).alias("_powers")
    )
    start = F.struct((F.col("target") - F.col("_words")).alias("gap"), F.array().cast("array<struct<size:bigint,by:bigint>>").alias("moves"))

    def step(acc, p):
        pick = F.when(acc["gap"] > 0, p["_more"]).otherwise(p["_less"])
        sign = F.when(acc["gap"] > 0, 1).otherwise(-1)
        by = (sign * F.least(F.round(F.abs(acc["gap"]) / pick["size"] - 0.001), pick["room"])).cast("bigint")
        return F.struct(
            (acc["gap"] - by * pick["size"]).alias("gap"),
            F.when(by == 0, acc["moves"]).otherwise(F.concat(acc["moves"], F.array(F.struct(pick["size"].alias("size"), by.alias("by"))))).alias("moves"),
        )

    moves = lists.select("source", F.explode(F.aggregate("_powers", start, step)["moves"]).alias("_m"))
    moves = moves.groupBy(F.col("source").alias("_source"), F.col("_m.size").alias("_size")).agg(F.sum("_m.by").alias("_by"))
    return bins.join(moves, same & (F.col("size") == F.col("_size")), "left").withColumn(
        "copies", F.least(F.greatest(F.col("copies") + F.coalesce("_by", F.lit(0)), F.lit(0)), F.col("n") * MOST_COPIES)
    ).drop("_source", "_size", "_by")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Every row of ``docs(doc_id, text, source, ...)`` as ``_row`` with ``_size, _source_size, _target, _copies`` (0 to 2).

    Documents of one source and size have one rate; their planned copies go to them in the order of a hash of
    doc_id, dealt over buckets, so a size that holds a third of all rows is ranked by many tasks and reruns agree.

    A null text has size 0; documents of size 0 get the rate's copies but add no words. A null source is a source
    of its own, last in order. Null doc_ids hash like a value. Rows that repeat a doc_id are separate documents. An empty table or one
    without words gives targets of 0. Columns of ``docs`` stay inside ``_row``, so their names clash with nothing.
    """
    rows = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), "source", word_count().alias("size")
    )
    sized = docs.select("doc_id", "source", word_count().alias("size")).withColumn("_bucket", bucket(["doc_id"], buckets_of(docs.sparkSession)))
    dealt = settle(bucket_offsets(sized, ["source", "size"]))
    sizes = settle(dealt.groupBy("source", "size").agg(F.sum("_n").alias("n")))
    planned = plan_copies(sizes, balance(sizes, source_targets(sizes, weights, share)))
    slots = dealt.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "_before").join(
        planned, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size"))
    ).select("_s", "_z", "_b", "_before", "source_size", "target", "n", "copies")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets_of(docs.sparkSession))).cast("int"))
    # Null sources are replaced in the key by a flag, so that rows and slots meet by plain equality of the same columns.
    key = ["_null", "_src", "_sz", "_bkt"]
    left = rows.select("_row", "_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src"), F.col("size").alias("_sz"), F.col("_bucket").alias("_bkt"))
    left = left.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_id", F.lit(1)), "_id")) - 1)
    right = slots.select(
        F.col("_s").isNull().alias("_null"), F.coalesce("_s", F.lit("")).alias("_src"), F.col("_z").alias("_sz"), F.col("_b").alias("_bkt"),
        "_before", "source_size", "target", "n", "copies",
    )
    place = F.col("_before") + F.col("_at")
    each = F.floor(F.col("copies") / F.col("n"))
    copies = each + F.when(place < F.col("copies") - each * F.col("n"), 1).otherwise(0)
    return left.join(right, key).select(
        "_row", F.col("_sz").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.cast("int").alias("_copies")
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it, columns as they were."""
    taken = mix(docs, weights, share).where("_copies > 0").select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row"))
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
