"""Weighted rendezvous hashing of stable record keys to shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import text_of
from gridcast.session import settle

SHARDS, HEADER = 40, 16
# Hexadecimal digits of a record's hash that make its slot bucket: 4,096 buckets in each shard.
BUCKET_DIGITS = 3
# Copies of one record that one row stands for while slots are written out.
COPIES = 1 << 16


def key_text(column: str = "doc_id") -> Column:
    """The record key as text; a null key is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _draw(key: Column, shard: Column) -> Column:
    """A number strictly between 0 and 1 that the key and the shard alone decide: 52 bits of an MD5 and a half."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that a key goes to: the one of the least ``-ln(draw) / weight``, so each gets keys in proportion to its weight.

    A shard's draw depends on no other shard. Another shard can only take keys to itself, a lost one only gives its own
    away, and a changed weight moves keys to or from that shard alone. Shards of weight 0 get none.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one positive")
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in live])
    bids = F.transform(shards, lambda s: F.struct((-F.ln(_draw(key, s["shard"])) / s["weight"]).alias("bid"), s["shard"].alias("shard")))
    return F.array_min(bids)["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` as ``_row`` with ``size``, ``text_crc32``, ``shard`` and ``grown_shard``, the shard
    if one more of weight ``added`` were there. No shuffle: doc_id and the shards alone decide.

    A null text is empty. A null doc_id is a key like any other, so its rows share a shard, and so do rows that repeat a doc_id.
    Very long texts are only hashed. An empty table gives an empty result; columns of ``docs`` stay inside ``_row``.
    """
    data, key = text_of().cast("binary"), key_text()
    return docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"),
        (F.octet_length(data) + HEADER).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, added]).alias("grown_shard"),
    )


def shard_digest(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; ``slot`` numbers a shard's rows from 0 without gaps.

    Rows of a shard lie in the order of an MD5 of (doc_id, size, text_crc32). Equal rows are one record with a count while they are
    numbered: hash buckets of a shard are ranked by many tasks, and the copies written out at the end, so neither a shard nor
    a record that holds a third of all rows comes into one task. Reruns agree; equal rows have neighbouring slots. See
    :func:`assign_shards` for nulls, ties and empty tables.
    """
    rows = assign_shards(docs, weights, added).drop("_row")
    content = F.concat_ws(":", key_text("_id"), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    records = rows.groupBy("_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("_n"))
    records = settle(records.withColumn("_h", F.md5(content.cast("binary"))).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS)))
    counts = records.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_h", "_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(counts, ["shard", "_bucket"])
    placed = placed.withColumn("_first", F.col("_before") + F.col("_first"))
    columns = ["_id", "size", "text_crc32", "shard", "grown_shard"]
    once = placed.where("_n = 1").select(*columns, F.col("_first").alias("slot"))
    parts = placed.where("_n > 1").select(*columns, "_first", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES))).alias("_part"))
    parts = parts.repartition("_id", "size", "text_crc32", "_part")
    last = F.least(F.col("_n"), (F.col("_part") + 1) * COPIES) - 1
    copies = parts.select(*columns, F.explode(F.sequence(F.col("_first") + F.col("_part") * COPIES, F.col("_first") + last)).alias("slot"))
    return once.unionByName(copies).select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"),
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS) -> None:
    """The rows of ``docs`` as Parquet files below ``path/shard=N``; Spark deals a shard's rows evenly over its tasks."""
    rows = assign_shards(docs, weights).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias("shard"))
    rows.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def crc32_sql(name: str = "crc32_of") -> str:
    """A DuckDB common table expression with the CRC-32 table, read by :func:`crc32_call`."""
    return f"""{name} AS (SELECT list(v ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""


def crc32_call(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8 bytes, where ``crc_table`` is in reach."""
    pairs = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def oracle() -> str:
    bid = "-ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return f"""
WITH {crc32_sql()}, d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS text FROM documents),
z AS (SELECT doc_id, k, (octet_length(encode(text)) + {HEADER})::BIGINT AS size, {crc32_call('text')} AS text_crc32 FROM d, crc32_of),
b AS (SELECT k, s, {bid} AS bid FROM (SELECT DISTINCT k FROM d), range({SHARDS + 1}) t(s)),
w AS (SELECT k, (arg_min(s, bid) FILTER (WHERE s < {SHARDS}))::INTEGER AS shard, arg_min(s, bid)::INTEGER AS grown_shard FROM b GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || size || ':' || text_crc32), doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM z JOIN w USING (k)
"""
