"""Embedding near-deduplication by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridcast.llm.common import components
from gridcast.session import settle

LIKE, PASSES, WINDOW, BITS, SEED = 0.95, 8, 512, 63, 20
# Share of the pairs just at the threshold that some pass is expected to compare, whatever the size of the table.
RECALL = 0.99


def passes_for(total: int, window: int, like: float) -> int:
    """At least PASSES; as many as RECALL needs where a pair meets by agreeing in the leading signs that tell windows apart."""
    agree = 1 - math.acos(max(-1.0, min(1.0, like))) / math.pi
    meet = agree ** math.log2(max(total / window, 1))
    return PASSES if meet >= 1 else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))


def _coded(vectors: DataFrame, passes: int) -> DataFrame:
    """Adds ``codes``: per pass the signs of 63 random projections as one number, first projection highest."""
    schema_of = StructType([*vectors.schema.fields, StructField("codes", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = (np.int64(1) << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            codes = []
            for v in batch.column("v"):
                x = np.array(v.as_py())
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((passes * BITS, len(x)))
                codes.append((((planes[len(x)] @ x) > 0).reshape(passes, BITS) @ weight).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return vectors.mapInArrow(run, schema_of)


def _chunked(nodes: DataFrame, window: int, near_bits: int) -> tuple[DataFrame, DataFrame]:
    """Per node and pass its chunk of ``window`` neighbours in the order of codes; per chunk how far it is compared.

    All passes are sorted by one range partitioning; places come from the rows' numbers in their partition and the sizes of those
    before. A chunk is compared with the next one, and with all that begin with the same leading bits, so a dense
    place wider than the window is compared in full.
    """
    each = nodes.select("node", "dim", F.posexplode("codes").alias("pass", "code"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = each.repartitionByRange(n, "pass", "dim", "code", "node").sortWithinPartitions("pass", "dim", "code", "node")
    rows = settle(rows.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_part", part).withColumn("_at", at)
    parts = rows.groupBy("pass", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first"))
    placed = rows.join(parts.select(F.struct("pass", "_part").alias("_k"), "_off"), F.struct(rows["pass"], rows["_part"]) == F.col("_k"))
    placed = placed.select("node", "pass", "code", F.floor((F.col("_off") + F.col("_at")) / window).alias("chunk"))
    lead = lambda c: F.shiftright(c, BITS - near_bits)
    chunks = settle(placed.groupBy("pass", "chunk").agg(F.min("code").alias("lo"), F.max("code").alias("hi")))
    far = chunks.groupBy("pass", lead("lo").alias("lead")).agg(F.max("chunk").alias("far"))
    reach = chunks.select("pass", "chunk", lead("hi").alias("lead")).join(far, ["pass", "lead"], "left").select(
        "pass", "chunk", F.greatest(F.col("chunk") + 1, F.coalesce("far", F.lit(0))).alias("reach")
    )
    return placed.select("node", "pass", "chunk"), settle(reach)


def _compare(like: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        p, inner = int(block["pass"].iloc[0]), int(block["j"].iloc[0]) == int(block["i"].iloc[0]) + 1
        found = []
        for dim in np.unique(block["dim"]):
            a, b = left[left["dim"] == dim], right[right["dim"] == dim]
            if not len(a):
                continue
            both = pd.concat([a, b]) if inner else b
            if not len(both):
                continue
            x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(both["v"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            y /= np.linalg.norm(y, axis=1)[:, None]
            s, t = np.nonzero(x @ y.T >= like)
            if inner:
                keep = (t >= len(a)) | (s < t)
                s, t = s[keep], t[keep]
            if not len(s):
                continue
            # A pair counts in the first pass that compares it; the chunks of both tell which that is.
            ca, ra = np.stack(a["chunks"].to_numpy()), np.stack(a["reaches"].to_numpy())
            cb, rb = np.stack(both["chunks"].to_numpy()), np.stack(both["reaches"].to_numpy())
            new = np.ones(len(s), bool)
            for q in range(p):
                u, v = ca[s, q], cb[t, q]
                new &= ~np.where(u <= v, v <= ra[s, q], u <= rb[t, q])
            s, t = s[new], t[new]
            na, nb = a["node"].to_numpy(), both["node"].to_numpy()
            ma, mb = a["n"].to_numpy(), both["n"].to_numpy()
            nodes, index = np.unique(np.concatenate([na[s], nb[t]]), return_inverse=True)
            one, two = index[: len(s)], index[len(s) :]
            links = np.bincount(one, mb[t], len(nodes)) + np.bincount(two, ma[s], len(nodes))
            root = np.arange(len(nodes))
            while True:  # smallest node within the block, over the block's own pairs
                least = root.copy()
                np.minimum.at(least, one, root[two])
                np.minimum.at(least, two, root[one])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            found.append(pd.DataFrame({"node": nodes, "links": links.astype("int64"), "root": nodes[root]}))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

    return run


def near_vectors(table: DataFrame, like: float = LIKE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``table(vec_id, embedding, ...)``.

    Equal vectors are one node with a count. In each pass the nodes are ordered by the signs of random projections and each is compared,
    by cosine in double precision, with one to two windows of neighbours, and with all that share the order's leading
    bits. Blocks return counts of links and one edge per linked node, so the links of a large group are never written out.
    The passes grow with the table (``passes_for``) unless their number is given. Links are those found: each pair at or above ``like`` that some pass compares, counted once.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, and neither does a row without
    vec_id; each is its own component (null without vec_id, and then not kept). Vectors of different lengths are not compared. Rows that
    repeat a vec_id with other vectors are separate nodes; their component takes the smallest vec_id it reaches. An empty table gives an empty result.
    """
    spark = table.sparkSession
    v = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select("vec_id", v.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    distinct = rows.where("fit").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = settle(distinct.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    coded = settle(_coded(nodes.select("node", "dim", "v"), passes or passes_for(total, window, like)).select("node", "dim", "codes"))
    near_bits = min(BITS, max(1, math.ceil(math.log2(max(total / window, 1)))) + 3)
    placed, reach = _chunked(coded, window, near_bits)
    lists = placed.join(reach, ["pass", "chunk"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "chunk", "reach"))).alias("_l"))
    ready = nodes.select("node", "v", "n", "dim").join(lists, "node").select(
        "node", "v", "n", "dim", F.col("_l.chunk").alias("chunks"), F.col("_l.reach").alias("reaches"), F.posexplode("_l").alias("_p", "_at")
    )
    ready = ready.select("node", "v", "n", "dim", "chunks", "reaches", F.col("_at.pass").alias("pass"), F.col("_at.chunk").alias("chunk"), F.col("_at.reach").alias("reach"))
    blocks = reach.select("pass", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk") + 1, F.col("reach"))).alias("j"))
    carried = ["node", "v", "n", "dim", "chunks", "reaches", "pass"]
    left = ready.select(*carried, F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk") + 1, F.col("reach"))).alias("j"), F.lit(0).alias("side"))
    first = blocks.groupBy("pass", F.col("j").alias("chunk")).agg(F.min("i").alias("first"))
    right = ready.join(first, ["pass", "chunk"]).select(*carried, F.explode(F.sequence("first", F.col("chunk") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"))
    found = left.union(right).groupBy("pass", "i", "j").applyInPandas(_compare(like), "node bigint, links bigint, root bigint")
    found = settle(found.where("links > 0"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select("node", "root"), "node", "root").withColumnRenamed("node", "_n")
    own = nodes.select("node", "v", "n", "least").join(linked, F.col("node") == F.col("_n"), "left").join(counts, "node", "left").select(
        "v", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    own = settle(own)
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(ids, "component").select(F.struct("v").alias("_k"), "n_links", "component_id")
    good = rows.where("fit").select("vec_id", F.struct("v").alias("_k")).join(own, "_k").select("vec_id", "n_links", "component_id")
    bad = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
