"""SimHash near-deduplication with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import GAP, components, text_of
from gridcast.session import settle

SHINGLE, MOST_BITS, SEED = 3, 3, 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), dtype="<u8", count=n)
    places = hashes.view(np.uint8).reshape(n, 8).astype(np.int64) + 256 * np.arange(8)
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(ones.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def codewords() -> np.ndarray:
    """The 4,096 words of the binary Golay code of length 23."""
    generator = 0b101011100011
    data = np.arange(4096, dtype=np.uint32)
    code = data << 11
    for k in range(22, 10, -1):  # remainder of the division by the generator polynomial
        code ^= np.where(code >> k & 1, np.uint32(generator << (k - 11)), np.uint32(0))
    return code | data << 11


@lru_cache(1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word, padded to 23 bits: the index of its nearest codeword, and of all within four bits (-1: none).

    The perfect (23, 12) Golay code has one codeword within three bits of any word. If two words differ in one
    bit, the codeword nearest to the first is within four bits of the second; at most six are.
    """
    code = codewords()
    words = np.arange(1 << 16, dtype=np.uint32)
    nearest, near, count = np.full(1 << 16, -1, np.int32), np.full((1 << 16, 6), -1, np.int32), np.zeros(1 << 16, np.int64)
    for index, c in enumerate(code):
        distance = np.bitwise_count(words ^ c)
        nearest[distance <= 3] = index
        at = np.flatnonzero(distance <= 4)
        near[at, count[at]] = index
        count[at] += 1
    return nearest, near


def _keys(fps: np.ndarray, fuzzy: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit words: segment i exactly, with a codeword index of segment i+1 or i+2. Returns rows and keys."""
    nearest, near = golay_keys()
    segments = np.ascontiguousarray(fps).view("<u2").reshape(-1, 4).astype(np.int64)
    rows, keys = [], []
    for i in range(4):
        for j in (1, 2):
            other = segments[:, (i + j) % 4]
            codes = near[other] if fuzzy else nearest[other][:, None]
            key = ((i * 2 + j - 1) << 28 | segments[:, i] << 12)[:, None] | codes
            at, column = np.nonzero(codes >= 0)
            rows.append(at)
            keys.append(key[at, column])
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: all pairs a < b of the distinct values ``fp`` that differ in at most three bits.

    Of four 16-bit segments one carries no error, and of any two others one carries at most one. So the pair agrees
    exactly in a segment, and in one of the next two the codeword nearest to the first lies among those near the second:
    8 keys of 28 bits on one side, up to 48 on the other, met by one join that verifies each pair as it is found.
    """
    def spread(fuzzy: bool, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("fp").to_numpy(zero_copy_only=False)
                for lo in range(0, len(own), 4096):
                    rows, keys = _keys(own[lo : lo + 4096], fuzzy)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[lo : lo + 4096][rows])], names=["key", name])

        return fps.mapInArrow(run, f"key bigint, {name} bigint")

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    return spread(False, "a").join(spread(True, "b"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id, group_size`` of every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at three or fewer differing bits.
    Documents with one fingerprint are one node, so copies never make pairs.

    A null or empty text has fingerprint zero and links like any other. A text with fewer words than a shingle is one shingle. Null
    doc_ids link their neighbours but are no smallest id (a component of null ids only has a null one). Rows that repeat a doc_id get a row
    each. An empty table gives an empty result; other columns are ignored.
    """
    own = settle(fingerprints(docs, shingle))
    nodes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp")), "a", "b")
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    labelled = settle(labelled)
    sums = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    of_fp = labelled.select("fp", "component").join(sums, "component").select(F.struct("fp").alias("_key"), "component_id", "group_size")
    # The struct key has both sides shuffled, so a fingerprint that many documents share can be split.
    joined = own.select("doc_id", "fp", F.struct("fp").alias("_key")).join(of_fp, "_key")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


# --- near copies by five-word similarity ------------------------------------------------------------------------------

# Whole-text fingerprints of texts at similarity 0.8 differ in about ten bits, beyond any fuzzy key. So a text gets
# several fingerprints, each of the few shingles that one ordering puts first; texts at 0.8 share one of them with 0.985.
LIKE, WORDS, ORDERINGS, FIRST, PIVOTS, BLOCK = 0.8, 5, 8, 4, 32, 256
_MIX = np.random.default_rng(23).integers(1, 1 << 62, ORDERINGS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_key():
    """A text's lower-cased words as one hash: texts that share it have the same shingles."""
    folded = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(folded, GAP, " ")).cast("binary"))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle, none are none."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def sample_fingerprints(hashes: np.ndarray) -> list[int]:
    """For each ordering the SimHash of the first shingles: a bit is set if it is set in over half of them."""
    if not len(hashes):
        return [0] * ORDERINGS
    out = []
    for k in range(ORDERINGS):
        order = hashes * _MIX[k]
        order ^= order >> np.uint64(29)
        first = hashes[np.argpartition(order, FIRST)[:FIRST]] if len(hashes) > FIRST else hashes
        ones = np.unpackbits(first.view(np.uint8).reshape(len(first), 8), axis=1, bitorder="little").sum(0)
        out.append(int(np.packbits(ones * 2 > len(first), bitorder="little").view("<i8")[0]))
    return out


def _segment_codes(fps: np.ndarray) -> np.ndarray:
    """Index of the nearest Golay codeword of bits 0-22, 23-45 and 46-63 (padded): rows by three."""
    nearest = golay_nearest()
    fps = fps.view(np.uint64)
    parts = [fps & np.uint64(0x7FFFFF), fps >> np.uint64(23) & np.uint64(0x7FFFFF), fps >> np.uint64(46)]
    return np.stack([nearest[p.astype(np.int64)] for p in parts], 1).astype(np.int64)


@lru_cache(1)
def golay_nearest() -> np.ndarray:
    """The index of the one codeword within three bits of each 23-bit word."""
    code, data = codewords(), np.arange(4096)
    out = np.zeros(1 << 23, np.int16)
    places = [1 << i for i in range(23)]
    errors = [0, *(sum(c) for n in (1, 2, 3) for c in combinations(places, n))]
    for e in errors:
        out[code ^ np.uint32(e)] = data
    return out


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three keys of each fingerprint: codeword indices of two of its segments."""
    for batch in batches:
        fps, order = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("ordering").to_numpy(zero_copy_only=False)
        code = _segment_codes(np.ascontiguousarray(fps))
        for i, (a, b) in enumerate(((0, 1), (1, 2), (0, 2))):
            key = (order.astype(np.int64) * 3 + i) << 24 | code[:, a] << 12 | code[:, b]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(order, pa.int32()), pa.array(fps)], names=["key", "ordering", "fp"])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fps`` of every row: the hash of its words and its sample fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sample_fingerprints(shingles(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "node", "fps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("node"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, node string, fps array<bigint>")


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, node`` of ``nodes(node, fps)``: texts that share a sample fingerprint, or whose fingerprints differ in one bit, under one ordering.

    Of three segments two carry no error then, so the indices of their nearest codewords agree in one of three
    pairs; the join that meets them verifies the fingerprints. Only buckets with several texts are returned.
    """
    each = nodes.select("node", F.posexplode("fps").alias("ordering", "fp"))
    prints = each.select("ordering", "fp").distinct()
    keyed = prints.mapInArrow(_sample_keys, "key bigint, ordering int, fp bigint")
    other = keyed.select("key", F.col("ordering").alias("_o"), F.col("fp").alias("other"))
    one = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) == 1
    near = keyed.join(other, "key").where((F.col("ordering") == F.col("_o")) & (F.col("fp") < F.col("other")) & one).select("ordering", "fp", "other").distinct()
    moved = each.join(near.select("ordering", F.col("other").alias("fp"), F.col("fp").alias("_to")), ["ordering", "fp"]).select("node", "ordering", F.col("_to").alias("fp"))
    rows = settle(each.unionByName(moved).select(F.xxhash64("ordering", "fp").alias("bucket"), "node"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    key = F.struct("bucket").alias("_k")  # a key of its own, so a large bucket can be split
    return rows.select("node", "bucket", key).join(several.select(key), "_k").select("bucket", "node")


def similar_texts(docs: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """:func:`sketches` of every row, and ``node, component`` of the texts that have a candidate.

    Texts are linked at a Jaccard similarity of their five-word shingle sets of ``like`` or more, verified exactly; candidates share a
    bucket. A bucket is not compared pair by pair. First each text is compared with one anchor; the Jaccard distance is a metric, so
    texts whose distances to the anchor differ by more than ``1 - like`` cannot be similar. Then some pivots with the bucket's
    commonest label, and some without, are compared with its texts of other labels, and at last all with those that still have
    other labels. So no link between components is lost, and a large group of near copies is compared with few of its texts.
    """
    own = settle(sketches(docs))
    texts = settle(own.groupBy("node").agg(F.first("fps").alias("fps")).withColumn("id", F.monotonically_increasing_id()))
    members = settle(candidate_buckets(texts.select(F.col("id").alias("node"), "fps")).withColumn("_u", F.shiftrightunsigned(F.xxhash64("node", F.lit(3)), 1) / float(1 << 63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    labels = settle(members.select("node").distinct().withColumn("label", F.col("node")))
    wanted = texts.join(labels, F.col("id") == labels["node"], "left_semi").select(F.col("node").alias("_key"), "id")
    bodies = docs.select(text_key().alias("_key"), text_of().alias("text")).join(wanted, "_key").select(F.col("id").alias("node"), "text")
    sets = settle(bodies.mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"]))
    key = F.struct("bucket").alias("_k")  # a key of its own, so a large bucket can be split
    anchors = members.groupBy("bucket").agg(F.min_by("node", "_u").alias("a")).select(key, "a")
    against = members.select(key, "bucket", "node", "_u").join(anchors, "_k").drop("_k")
    met = settle(similarities(against.where("a <> node").select("a", F.col("node").alias("b")).distinct(), sets))
    near = F.struct("a", F.col("node").alias("b"))
    far = against.withColumn("_p", near).join(met.select(F.struct("a", "b").alias("_q"), "like"), F.col("_p") == F.col("_q"), "left")
    members = settle(far.select("bucket", "node", "_u", (1 - F.coalesce("like", F.lit(1.0))).alias("_d")))
    links = met.where(F.col("like") >= like - 1e-9).select(F.col("a").alias("la"), F.col("b").alias("lb"))
    labels = settle(_one_hop(labels, links))
    for pivots in (PIVOTS, 1 << 62):  # the second time every text is a pivot
        labelled = members.join(labels, "node")
        per = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        main = per.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("size"), F.count("*").alias("labels")).where("labels > 1")
        main = main.select(key, F.col("m.label").alias("main"), F.col("m.n").alias("inside"), (F.col("size") - F.col("m.n")).alias("outside"))
        rows = settle(labelled.select(key, "node", "_u", "_d", "label").join(main, "_k"))
        within = F.when(F.col("label") == F.col("main"), F.col("inside")).otherwise(F.col("outside"))
        new = settle(_links_outside(rows.withColumn("pivot", F.col("_u") < float(pivots) / within), sets, like, pivots))
        links = links.unionByName(new)
        labels = settle(_one_hop(labels, new))
    every = links.unionByName(labels.select(F.col("node").alias("la"), F.col("label").alias("lb")))
    joined = components(settle(every), "la", "lb").withColumnRenamed("node", "_n")
    labels = labels.join(joined, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("component", "node").alias("label"))
    found = texts.select("node", "id").join(labels.withColumnRenamed("node", "id"), "id").select("node", F.col("label").alias("component"))
    return own, found


def _one_hop(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Every label replaced by the smallest one linked to it: equal labels mean one component, though not the other way round."""
    both = links.select("la", "lb").unionByName(links.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
    least = both.groupBy("la").agg(F.min("lb").alias("_least"))
    return labels.join(least, F.col("label") == F.col("la"), "left").select("node", F.least("label", F.coalesce("_least", "label")).alias("label"))


def _links_outside(rows: DataFrame, sets: DataFrame, like: float, pivots: int) -> DataFrame:
    """``la, lb``: labels that a bucket's pivots and its texts outside the largest component link.

    Pivots and outside texts are dealt into blocks of about ``BLOCK``; each block of the one meets each of the other in a task that
    holds both, so a text's shingles move once for each block it meets, not for each pair. A block returns linked labels, never pairs.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.least(F.lit(2.0 * pivots), F.col("inside") + F.col("outside")) / BLOCK)).cast("int")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("outside") / BLOCK)).cast("int")
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    wanted = rows.where(F.col("pivot") | (F.col("label") != F.col("main"))).join(sets, "node")
    columns = [F.col("_k.bucket").alias("bucket"), "node", "label", "_d", "hashes"]
    left = wanted.where("pivot").select(*columns, F.lit(True).alias("side"), deal(parts, 5).alias("p"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"))
    right = wanted.where("label <> main").select(*columns, F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), deal(chunks, 6).alias("c"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["side"]], block[~block["side"]]
        found = set()
        others = [(lb, db, set(y.tolist())) for lb, db, y in zip(b["label"].tolist(), b["_d"].tolist(), b["hashes"], strict=True)]
        for la, da, x in zip(a["label"].tolist(), a["_d"].tolist(), (set(x.tolist()) for x in a["hashes"]), strict=True):
            for lb, db, y in others:
                if la == lb or abs(da - db) > 1 - like + 1e-9 or (la, lb) in found or min(len(x), len(y)) < like * max(len(x), len(y)) - 1e-9:
                    continue
                both = len(x & y)
                if both >= like * (len(x) + len(y) - both) - 1e-9:
                    found.add((la, lb))
        return pd.DataFrame(list(found), columns=["la", "lb"]).astype("int64")

    return left.unionByName(right).groupBy("bucket", "p", "c").applyInPandas(compare, "la bigint, lb bigint").distinct()


def similarities(pairs: DataFrame, sets: DataFrame, least: float = 0.0) -> DataFrame:
    """``pairs(a, b, ...)`` with ``like``, the Jaccard similarity of their shingle sets, where it is ``least`` or more."""
    left = sets.select(F.struct("node").alias("_a"), F.col("hashes").alias("_x"))
    right = sets.select(F.struct("node").alias("_b"), F.col("hashes").alias("_y"))
    near = pairs.withColumn("_a", F.struct(F.col("a").alias("node"))).join(left, "_a").withColumn("_b", F.struct(F.col("b").alias("node"))).join(right, "_b")
    m, n = F.size("_x"), F.size("_y")
    near = near.where(F.least(m, n) >= least * F.greatest(m, n) - 1e-9)
    both = F.size(F.array_intersect("_x", "_y"))
    return near.select(*pairs.columns, F.coalesce(both / (m + n - both), F.lit(1.0)).alias("like")).where(F.col("like") >= least - 1e-9)


def drop_near_copies(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` of which one of each group of near copies stays, that with the smallest doc_id; columns as they were.

    Near copies have five-word shingle sets with a Jaccard similarity of ``like`` or more, or are linked by such; see :func:`similar_texts`. Each
    row is judged by its own doc_id and text: rows without doc_id, or that repeat one, stay or go by their own text, and
    are later in order than rows with one. Of rows that repeat doc_id and words one stays. Texts with fewer than five words
    are one shingle, so only equal ones meet; empty and null texts are copies of each other. An empty table gives an empty result.
    """
    own, found = similar_texts(docs, like)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    grouped = own.join(found, "node", "left").select("doc_id", "node", F.coalesce(F.col("component").cast("string"), "node").alias("component"))
    least = settle(grouped.groupBy("component").agg(F.min(rank).alias("_r")).select(F.col("_r.doc_id").alias("_keep"), F.col("_r.node").alias("_node")))
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    stay = rows.join(least, (F.col("_key") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    repeated = not own.join(least, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_keep"))).groupBy("doc_id", "node").count().where("count > 1").isEmpty()
    return (stay.dropDuplicates(["_id", "_key"]) if repeated else stay).select(*columns)
