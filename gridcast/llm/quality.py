"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import buckets_of, text_of
from gridcast.session import settle, shared_dir

# N-grams are of four UTF-16 units of lower-case text, 16 bits each in one long; a text begins after three start marks.
ORDER, START = 4, 1
BLOCK_CHARS = 16 << 20
QUANTILE, MARGIN = 0.99, 1.1
_CUT = 1 << 20


def _grams(text: str) -> Iterator[np.ndarray]:
    """The 4-gram that ends at each unit, in parts of at most a million."""
    u = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    u = np.concatenate([np.full(ORDER - 1, START), np.maximum(u, START)])
    for lo in range(0, len(u) - ORDER + 1, _CUT):
        v = u[lo : lo + _CUT + ORDER - 1]
        yield v[:-3] << 48 | v[1:-2] << 32 | v[2:-1] << 16 | v[3:]


def gram_counts(texts: DataFrame) -> DataFrame:
    """``g, c``: 4-grams of all rows' texts with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

        for batch in batches:
            for text in batch.column("text"):
                for part in _grams(text.as_py()):
                    held.append(part)
                    if sum(map(len, held)) > 4 * _CUT:
                        yield flush()
        if held:
            yield flush()

    return texts.select(text_of().alias("text")).mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _tail(g: str | Column, units: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << 16 * units) - 1)) if isinstance(g, str) else g.bitwiseAND(F.lit((1 << 16 * units) - 1))


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """Per order k the tables ``g, p`` of seen k-grams and ``h, back`` of seen contexts, and the probability of an unseen unit.

    The highest order has true counts, each lower one counts of different left neighbours. Each order has its own three
    discounts from its counts of counts. All tables are joined by n-gram and by context, so they are sharded by Spark.
    """
    tables = {ORDER: settle(counts)}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = settle(tables[k + 1].groupBy(_tail("g", k).alias("g")).agg(F.count("*").alias("c")))
    unseen = 1.0 / (tables[1].count() + 1)
    probs, backs = {}, {}
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("h", F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long"))
        n1, n2, n3, n4 = (v or 0 for v in t.agg(*[F.sum((F.col("c") == i).cast("int")) for i in (1, 2, 3, 4)]).first())
        y = n1 / max(n1 + 2 * n2, 1)
        d = [min(max(i - (i + 1) * y * (b / a if a else 0.0), 0.1), i - 0.1) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        ctx = t.groupBy("h").agg(F.sum("c").alias("s"), F.sum(cut).alias("cut"))
        ctx = ctx.select("h", F.col("s").cast("double").alias("s"), (F.col("cut") / F.col("s")).alias("back"))
        own = t.join(ctx, "h").select("g", ((F.col("c") - cut) / F.col("s")).alias("first"), "back")
        if k == 1:
            probs[k] = own.select("g", (F.col("first") + F.col("back") * unseen).alias("p"))
        else:
            low = probs[k - 1].select(F.col("g").alias("_t"), F.col("p").alias("low"))
            probs[k] = own.withColumn("_t", _tail("g", k - 1)).join(low, "_t").select("g", (F.col("first") + F.col("back") * F.col("low")).alias("p"))
        probs[k], backs[k] = settle(probs[k]), settle(ctx.select("h", "back"))
    return probs, backs, unseen


def log_probabilities(grams: DataFrame, model) -> DataFrame:
    """``g, lp`` of the distinct 4-grams ``g``: the seen probability of the longest seen tail, times the weights of the seen contexts above it."""
    probs, backs, unseen = model
    out = grams.select("g", F.lit(0.0).alias("lp"), F.lit(False).alias("done"))
    for k in range(ORDER, 0, -1):
        p = probs[k].select(F.col("g").alias("_g"), "p")
        b = backs[k].select(F.col("h").alias("_h"), "back")
        out = out.withColumn("_g0", _tail("g", k) if k < ORDER else F.col("g")).join(p, F.col("_g0") == F.col("_g"), "left")
        if k > 1:
            out = out.join(b, F.shiftrightunsigned(F.col("_g0"), 16) == F.col("_h"), "left")
        else:  # the empty context has one weight
            out = out.withColumn("back", F.lit((b.select("back").first() or [1.0])[0]))
        out = out.select(
            "g",
            F.when(F.col("done"), F.col("lp")).when(F.col("p").isNotNull(), F.col("lp") + F.log("p")).otherwise(F.col("lp") + F.log(F.coalesce("back", F.lit(1.0)))).alias("lp"),
            (F.col("done") | F.col("p").isNotNull()).alias("done"),
        )
    return out.select("g", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") + math.log(unseen)).alias("lp"))


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, ids, body``: documents of a task put together by 16 million characters, their texts compressed.

    They are a table in the shared folder, bucketed by block, so joins by block leave the texts where they are. The
    buckets grow with the corpus: each holds about four blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush():
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            mark = xxhash.xxh64()
            for i, t in zip(ids, raw, strict=True):
                mark.update(f"{i}:{len(t)};".encode())
            body = zstandard.compress(b"".join(len(t).to_bytes(8, "little") + t for t in raw), 12)
            row = pa.RecordBatch.from_arrays([pa.array([mark.intdigest() >> 1], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([body], pa.binary())], names=["block", "ids", "body"])
            ids.clear(), texts.clear()
            return row

        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(i.as_py()), texts.append(t.as_py())
                size += len(texts[-1])
                if size > BLOCK_CHARS:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    name, buckets = f"text_blocks_{uuid.uuid4().hex}", max(buckets_of(spark), math.ceil(size / (4 * BLOCK_CHARS)))
    made = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"block bigint, ids array<{kind}>, body binary")
    made.write.format("parquet").bucketBy(buckets, "block").option("path", shared_dir(spark, name)).saveAsTable(name)
    return spark.table(name)


def _texts(body: bytes) -> Iterator[str]:
    raw, at = zstandard.decompress(body), 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        yield raw[at + 8 : at + 8 + n].decode("utf-8", "surrogatepass")
        at += 8 + n


def _texts_of(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``text`` of all rows in the blocks whose id ``rows(doc_id)`` has; texts move in their blocks' compressed form at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, places in zip(batch.column("body"), batch.column("places"), strict=True):
                wanted, held, size = set(places.as_py()), [], 0
                for at, text in enumerate(_texts(body.as_py())):
                    if at in wanted:
                        held.append(text)
                        size += len(text)
                    if size > _CUT:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["text"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["text"])

    ids = blocks.select(F.col("block").alias("_b"), F.posexplode("ids").alias("place", "doc_id"))
    places = ids.join(rows, "doc_id").groupBy("_b").agg(F.collect_list("place").alias("places"))
    return blocks.join(places.hint("shuffle_hash"), F.col("block") == F.col("_b")).select("body", "places").mapInArrow(run, "text string")


def perplexities(docs: DataFrame, model, blocks: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_units, perplexity``. The different n-grams of each block of documents are joined to the model's shards and come back to the block."""
    blocks = _blocks(docs) if blocks is None else blocks

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block"), batch.column("body"), strict=True):
                seen, held = np.zeros(0, np.int64), []
                for text in _texts(body.as_py()):
                    held += list(_grams(text))
                    if sum(map(len, held)) > 2 * _CUT:
                        seen, held = np.unique(np.concatenate([seen, *held])), []
                seen = np.unique(np.concatenate([seen, *held]))
                for lo in range(0, len(seen), 1 << 16):
                    g = seen[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block.as_py())), pa.array(g)], names=["block", "g"])

    pairs = blocks.select("block", "body").mapInArrow(grams, "block bigint, g bigint")
    found = log_probabilities(pairs.select("g").distinct(), model).select(F.col("g").alias("_g"), F.col("lp").cast("float").alias("lp"))
    back = pairs.join(found.select(F.struct(F.col("_g")).alias("_k"), "lp"), F.struct(F.col("g")) == F.col("_k")).select(F.col("block").alias("_b"), "g", "lp")
    tables = back.groupBy("_b").agg(F.collect_list("g").alias("g"), F.collect_list("lp").alias("lp"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body, g, lp in zip(batch.column("ids"), batch.column("body"), batch.column("g"), batch.column("lp"), strict=True):
                keys, values = (g.values.to_numpy(), lp.values.to_numpy().astype(float)) if g.is_valid else (np.zeros(0, np.int64), np.zeros(0))
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                n, total = [], []
                for text in _texts(body.as_py()):
                    parts = list(_grams(text))
                    n.append(sum(map(len, parts)))
                    total.append(float(sum(values[np.searchsorted(keys, p)].sum() for p in parts if len(p))))
                ppl = np.exp(-np.array(total) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n, pa.int64()), pa.array(ppl)], names=["doc_id", "n_units", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = blocks.join(tables.hint("shuffle_hash"), F.col("block") == F.col("_b"), "left").select("ids", "body", "g", "lp")
    return joined.mapInArrow(score, f"doc_id {kind}, n_units bigint, perplexity double")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_units, perplexity, threshold, kept`` of every row of ``docs(doc_id, text, lang, ...)``.

    The model counts the texts that ``labels(doc_id, quality)`` trusts (quality 1), all of them: no cap, none held out.
    A document is kept if its perplexity is at most 1.1 times the 0.99 quantile of the trusted documents of its language, or, where the language has
    none, of all its documents.

    A null or empty text has perplexity 1 and is kept. Null lang is a language of its own. Rows that repeat a doc_id are scored each, and take the
    threshold of the smallest of their languages; a null doc_id is scored and judged by the null language. Without trusted text every unit is
    equally likely. An empty table gives an empty result; other columns are ignored.
    """
    rows = settle(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    blocks = _blocks(docs)
    scored = settle(perplexities(docs, kneser_ney(gram_counts(_texts_of(blocks, rows))), blocks))
    langs = docs.groupBy(F.col("doc_id").alias("_d")).agg(F.min("lang").alias("lang")).where("_d is not null")
    with_lang = settle(scored.join(langs, F.col("doc_id") == F.col("_d"), "left").join(rows.select(F.col("doc_id").alias("_r")), F.col("doc_id") == F.col("_r"), "left").select(
        "doc_id", "n_units", "perplexity", "lang", F.col("_r").isNotNull().alias("_trusted")
    ))
    filled = F.col("n_units") > 0
    limits = with_lang.groupBy(F.struct("lang").alias("_l")).agg(F.coalesce(
        F.percentile_approx(F.when(F.col("_trusted") & filled, F.col("perplexity")), QUANTILE, 10000),
        F.percentile_approx(F.when(filled, F.col("perplexity")), QUANTILE, 10000), F.lit(1.0),
    ).alias("_q"))
    judged = with_lang.join(F.broadcast(limits), F.struct("lang") == F.col("_l"))  # one row per language
    limit = F.col("_q") * MARGIN
    return judged.select("doc_id", "n_units", "perplexity", limit.alias("threshold"), (F.col("perplexity") <= limit).alias("kept"))
