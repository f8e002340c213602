"""Time blocks: how ordered work is spread when one series is huge.

A window over ``PARTITION BY series_id`` puts a whole series into one task.
Here the time axis is cut into fixed-length blocks and rows are hashed by
``(series_id, block)``:

* what a row needs from *nearby* rows (lags, lookbacks, horizons) comes from a
  halo: rows close to an edge are copied into the neighbouring block;
* what it needs from *all earlier or later* rows (running totals, fills, row
  numbers, islands) comes from one summary row per block. The window over the
  series then runs over block summaries only, and the result is joined back on
  the partitioning the rows already have.

A block holds at most ``BLOCK_STEPS`` grid rows however long the series is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridcast.functions.time import epoch

SERIES = "series_id"
TS = "ts"
LOAD = "load"
BLK = "_blk"
BLOCK_STEPS = 1024
SALTS = 32


def present(*columns: str) -> Column:
    """All columns are non-null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def block_seconds(step_seconds: int, halo_steps: int = 0) -> int:
    """Length of a block; at least eight halos, so copies stay below 25 %."""
    return step_seconds * max(BLOCK_STEPS, 8 * halo_steps)


def block_of(seconds: Column, length: int) -> Column:
    return F.floor(seconds / F.lit(length)).cast("long")


def blocked(df: DataFrame, length: int, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Add the block column and hash rows by key and block (one shuffle)."""
    return df.withColumn(BLK, block_of(epoch(TS), length)).repartition(*keys, BLK)


def haloed(
    df: DataFrame, length: int, before: int = 0, after: int = 0, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Blocked rows plus copies: each block also sees ``before`` seconds of
    earlier and ``after`` seconds of later rows. Own rows have ``_own`` true."""
    e = epoch(TS)
    copies = F.sequence(block_of(e - after, length), block_of(e + before, length))
    return (
        df.withColumn("_home", block_of(e, length))
        .withColumn(BLK, F.explode(copies))
        .withColumn("_own", F.col(BLK) == F.col("_home"))
        .drop("_home")
        .repartition(*keys, BLK)
    )


def in_block(keys: Sequence[str] = (SERIES,)) -> WindowSpec:
    return Window.partitionBy(*keys, BLK).orderBy(TS)


def up_to_here(keys: Sequence[str] = (SERIES,)) -> WindowSpec:
    return in_block(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_here(keys: Sequence[str] = (SERIES,)) -> WindowSpec:
    """This row and all later ones, nearest last: use ``last`` for the nearest.

    Ordered backwards because a frame that ends at the end of the partition is
    evaluated anew for every row, while one that starts at its start grows.
    """
    backwards = Window.partitionBy(*keys, BLK).orderBy(F.col(TS).desc())
    return backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_summary(
    df: DataFrame,
    aggs: Sequence[Column],
    outs: Callable[[WindowSpec, WindowSpec, WindowSpec], Sequence[Column]],
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Attach to every row facts about the blocks around its own.

    ``aggs`` summarise one block; ``outs(before, after, whole)`` are window
    expressions over the block summaries of a series; ``before`` and ``after``
    both end with the nearest block, so ``last`` picks it.
    """
    # stated on the shared input, so that both branches read the same exchange
    df = df.where(present(*keys, BLK))
    order = Window.partitionBy(*keys).orderBy(BLK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(BLK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # every column is touched here, else Spark prunes this branch and shuffles a
    # narrower copy of the rows next to the full one
    touched = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_touched")
    summary = df.groupBy(*keys, BLK).agg(*aggs, touched).where("_touched IS NOT NULL")
    return df.join(summary.select(*keys, BLK, *outs(before, after, whole)), [*keys, BLK])


def row_index(
    df: DataFrame, name: str = "idx", total: str | None = None, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Position of each row in its series (0-based) and the series length."""
    out = with_summary(
        df,
        [F.count(F.lit(1)).alias("_c")],
        lambda before, after, whole: [
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"),
            F.sum("_c").over(whole).alias(total or "_total"),
        ],
        keys,
    )
    out = out.withColumn(name, F.col("_base") + F.row_number().over(in_block(keys)) - 1).drop("_base")
    return out if total else out.drop("_total")


def previous_ts(df: DataFrame, name: str = "prev_ts", keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Timestamp of the row before, across block edges."""
    out = with_summary(
        df,
        [F.max(TS).alias("_t")],
        lambda before, after, whole: [F.max("_t").over(before).alias("_carry")],
        keys,
    )
    lagged = F.lag(TS).over(in_block(keys))
    return out.withColumn(name, F.coalesce(lagged, F.col("_carry"))).drop("_carry")


def nearest_known(
    df: DataFrame, value: str, tag: str = "", keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Nearest non-null ``value`` at or before, and at or after, each row.

    Adds ``_pt/_pv`` (time and value behind) and ``_nt/_nv`` (ahead), each
    with ``tag`` appended.
    """
    known = F.when(F.col(value).isNotNull(), F.col(TS))
    out = with_summary(
        df,
        [
            F.max(known).alias("_lt"), F.max_by(value, known).alias("_lv"),
            F.min(known).alias("_ft"), F.min_by(value, known).alias("_fv"),
        ],
        lambda before, after, whole: [
            F.last("_lt", True).over(before).alias("_cpt"), F.last("_lv", True).over(before).alias("_cpv"),
            F.last("_ft", True).over(after).alias("_cnt"), F.last("_fv", True).over(after).alias("_cnv"),
        ],
        keys,
    )
    back, ahead = up_to_here(keys), from_here(keys)
    return out.select(
        *df.columns,
        F.coalesce(F.last(known, True).over(back), F.col("_cpt")).alias(f"_pt{tag}"),
        F.coalesce(F.last(value, True).over(back), F.col("_cpv")).alias(f"_pv{tag}"),
        F.coalesce(F.last(known, True).over(ahead), F.col("_cnt")).alias(f"_nt{tag}"),
        F.coalesce(F.last(value, True).over(ahead), F.col("_cnv")).alias(f"_nv{tag}"),
    )


def running_total(
    df: DataFrame, value: Column, name: str, include_current: bool = True, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Running sum of an expression over the series."""
    out = with_summary(
        df.withColumn("_x", value),
        [F.sum("_x").alias("_s")],
        lambda before, after, whole: [F.sum("_s").over(before).alias("_carry")],
        keys,
    )
    frame = in_block(keys).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1
    )
    inside = F.sum("_x").over(frame)
    return out.withColumn(
        name, F.coalesce(inside, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    ).drop("_x", "_carry")


def number_runs(
    df: DataFrame,
    columns: Sequence[str],
    breaks: Callable[[dict[str, Column], dict[str, Column]], Column],
    name: str,
    keys: Sequence[str] = (SERIES,),
) -> DataFrame:
    """Number the runs of a series: ``breaks(previous, current)`` starts one.

    Both callables' arguments map the named columns to their values in two
    consecutive rows. Breaks inside a block are counted in the block; a break
    at its first row is found by comparing block summaries.
    """
    w = in_block(keys)
    lagged = {c: F.lag(c).over(w) for c in columns}
    inner = F.when(F.row_number().over(w) == 1, False).otherwise(breaks(lagged, {c: F.col(c) for c in columns}))
    d = df.where(present(*keys, BLK, TS)).withColumn("_in", inner.cast("int"))
    edges = [e for c in columns for e in (F.min_by(c, TS).alias(f"_f_{c}"), F.max_by(c, TS).alias(f"_l_{c}"))]
    touched = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_touched")
    order = Window.partitionBy(*keys).orderBy(BLK)
    summary = d.groupBy(*keys, BLK).agg(F.sum("_in").alias("_n"), *edges, touched).where("_touched IS NOT NULL")
    edge = F.when(F.row_number().over(order) == 1, False).otherwise(
        breaks({c: F.lag(f"_l_{c}").over(order) for c in columns}, {c: F.col(f"_f_{c}") for c in columns})
    )
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.sum("_edge").over(here) + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    summary = summary.withColumn("_edge", edge.cast("int")).select(*keys, BLK, base.alias("_base"))
    return (
        d.join(summary, [*keys, BLK])
        .withColumn(name, F.col("_base") + F.sum("_in").over(up_to_here(keys)))
        .drop("_in", "_base")
    )


def attach(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join per-key facts to rows when one key may own a third of the rows.

    The per-key side is copied once per salt and the row side spreads each key
    over the salts; where the per-key side is small Spark broadcasts it. Wide
    facts whose keys already split a series take fewer salts.
    """
    return with_salt(rows, salts).join(per_salt(small, salts), [*keys, "_salt"], how).drop("_salt")


def with_salt(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """A salt from the row's content and the task that read it: copies of one
    row spread too, and a retried task gives the same salts."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.withColumn("_salt", F.pmod(content + F.spark_partition_id(), F.lit(salts)).cast("int"))


def per_salt(small: DataFrame, salts: int = SALTS) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """Linear-interpolated percentiles per key without gathering a key's values.

    A sketch per key, combined before its shuffle, brackets each wanted rank
    between two values; see :func:`around`. Only the values inside a bracket are
    ordered: about ``6 / accuracy`` of a key's rows for each level, whatever
    their distribution. The sketch only places the brackets: ranks are counted
    exactly, and a rank that no bracket holds fails the job.
    """
    picked = around(df, keys, value, list(probs.values()), accuracy)
    order = Window.partitionBy(*keys).orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("_start", F.coalesce(F.sum("_n").over(order), F.lit(0)))

    def at(rank: Column) -> Column:
        last = F.col("_start") + F.col("_n") - 1
        here = (rank >= F.col("_start")) & (rank <= last)
        found = F.when(rank == F.col("_start"), F.col("_least")).when((rank == last) | (F.col("_least") == F.col("_most")), F.col("_most"))
        return F.max(F.when(here, F.coalesce(found, F.raise_error(F.lit("rank outside its bracket")).cast("double"))))

    outs, finals = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        outs += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_z{i}")]
        frac = pos - F.floor(pos)
        finals.append((F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * frac).alias(name))
    return picked.groupBy(*keys).agg(F.max("_total").alias("_total"), *outs).select(*keys, *finals)


def around(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], accuracy: int) -> DataFrame:
    """``keys, _total, _least, _most, _n``: each distinct value near a level, and one row for each gap between brackets.

    A bracket reaches three errors of the sketch to either side of its level. Ranks
    next to a bracket are the ends of the gap beside it.
    """
    rows = df.where(present(value, *keys)).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, p + side * 3 / accuracy)) for p in levels for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_ends"), F.count(F.lit(1)).alias("_total"))
    v = F.col("_v")
    inside = reduce(or_, [v.between(F.get("_ends", F.lit(2 * i)), F.get("_ends", F.lit(2 * i + 1))) for i in range(len(levels))])
    gap = sum(F.when(F.get("_ends", F.lit(i)) < v, 1).otherwise(0) for i in range(len(ends)))
    near = attach(rows, sketch, keys)
    return near.groupBy(*keys, "_total", F.when(inside, v).alias("_in"), F.when(~inside, gap).alias("_gap")).agg(
        F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count(F.lit(1)).alias("_n")
    )
