"""Ranked lexical search: an item's documents are grouped by the mask of its terms that they hold, best masks first."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridcast.llm.common import buckets_of
from gridcast.session import settle

TOP = 50
# Item text that one pass over the documents takes along; more items take more passes.
PASS_BYTES = 32 << 20
# Documents and postings of a block at most, and the stretch of a long text that is split at once.
BLOCK_DOCS, BLOCK_POSTINGS, STRETCH = 1 << 14, 1 << 21, 1 << 20
# Everything but ASCII letters, digits and non-ASCII bytes parts terms; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, as one list for each stretch of a long one."""
    at, length = 0, STRETCH
    while at < len(text):
        piece = text[at : at + length].translate(_FOLD)
        if at + length < len(text):
            cut = piece.rfind(b" ")
            if cut < 0:  # inside one long term
                length *= 2
                continue
            piece = piece[:cut]
        yield piece.split()
        at, length = at + len(piece) + 1, STRETCH


def _pack(values: list | np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.asarray(values, kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind).astype(np.int64)


def index_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per block of documents: ``ids, sizes`` of those that hold a known term, how many documents have terms at all
    (``n_docs``) and how many terms they have (``n_terms``), the known ``terms`` with their ``counts`` of documents, and their
    postings, packed term by term.
    """
    schema_of = StructType([StructField("ids", ArrayType(docs.schema["doc_id"].dataType))])
    for name, kind in (("sizes", ArrayType(LongType())), ("n_docs", LongType()), ("n_terms", LongType()), ("terms", ArrayType(LongType())), ("counts", ArrayType(LongType()))):
        schema_of.add(name, kind)
    schema_of = schema_of.add("docs", "binary").add("tfs", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()

        def block(ids, sizes, n_docs, n_terms, held):
            term, doc, tf = (np.array(x, np.int64) for x in held)
            order = np.argsort(term, kind="stable")
            found, counts = np.unique(term, return_counts=True)
            columns = [[ids], [sizes], [n_docs], [n_terms], [found.tolist()], [counts.tolist()], [_pack(doc[order], "<u2")], [_pack(tf[order], "<u4")]]
            types = [pa.list_(ids.type), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            first = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([first, *[pa.array(c, t) for c, t in zip(columns[1:], types[1:], strict=True)]], names=schema_of.names)

        for batch in batches:
            rows, sizes, n_docs, n_terms, held = [], [], 0, 0, ([], [], [])
            for row, text in enumerate(batch.column("text")):
                counts, n = Counter(), 0
                for words in terms(text.as_py() or b""):
                    counts.update(words)
                    n += len(words)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                hit = counts.keys() & known
                if hit:
                    held[0].extend([vocabulary[w] for w in hit])
                    held[1].extend([len(rows)] * len(hit))
                    held[2].extend([counts[w] for w in hit])
                    rows.append(row)
                    sizes.append(n)
                if len(rows) >= BLOCK_DOCS or len(held[0]) >= BLOCK_POSTINGS:
                    yield block(batch.column("doc_id").take(pa.array(rows)), sizes, n_docs, n_terms, held)
                    rows, sizes, n_docs, n_terms, held = [], [], 0, 0, ([], [], [])
            if n_docs:
                yield block(batch.column("doc_id").take(pa.array(rows, pa.int64())), sizes, n_docs, n_terms, held)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema_of)


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _norms(sizes: np.ndarray, total: int, length: int) -> np.ndarray:
    if len(sizes) and 50 * int(sizes.max()) * total >= 1 << 63:
        return np.array([50 + 50 * int(n) * total // length for n in sizes], np.int64)
    return 50 + 50 * sizes * total // max(length, 1)


def best_of_block(ids: pa.Array, postings: dict[int, tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a block's ``top`` documents for the terms ``wanted``, equal scores by ascending id.

    ``postings`` has the documents of each term and what the term adds to the score of each. The bitmaps of the item's terms are
    turned into a mask for each document. Documents of one mask share the bound that the sum of their terms' largest
    additions gives; masks are evaluated by descending bound until ``top`` documents score above what is left.
    """
    own = [t for t in wanted.tolist() if t in postings]
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    masks = np.zeros((len(ids), (len(own) + 63) // 64), np.uint64)
    for j, t in enumerate(own):
        masks[postings[t][0], j // 64] |= np.uint64(1 << j % 64)
    if masks.shape[1] == 1:
        distinct, group = np.unique(masks[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(masks, axis=0, return_inverse=True)
    bits = (distinct[:, np.arange(len(own)) // 64] >> (np.arange(len(own)) % 64).astype(np.uint64)) & np.uint64(1)
    bound = bits.astype(np.int64) @ np.array([postings[t][1].max() for t in own], np.int64)
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(group.ravel(), minlength=len(distinct)))
    starts = np.concatenate([[0], ends[:-1]])
    id_rank = None
    place, score = np.empty(0, np.int64), np.empty(0, np.int64)
    at, size = 0, 2 * top
    while at < len(order) and bound[order[at]] > 0 and (len(score) < top or score[-1] <= bound[order[at]]):
        taken = []
        while at < len(order) and bound[order[at]] > 0 and sum(map(len, taken)) < size:
            taken.append(members[starts[order[at]] : ends[order[at]]])
            at += 1
        docs = np.sort(np.concatenate(taken))
        sums = np.zeros(len(docs), np.int64)
        for t in own:
            holds, adds = postings[t]
            i = np.minimum(np.searchsorted(holds, docs), len(holds) - 1)
            sums += np.where(holds[i] == docs, adds[i], 0)
        place, score, size = np.concatenate([place, docs]), np.concatenate([score, sums]), 2 * size
        if id_rank is None:
            id_rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        keep = np.lexsort((id_rank[place], -score))[:top]
        place, score = place[keep], score[keep]
    return place[score > 0], score[score > 0]


def _rank_blocks(blocks: DataFrame, items: list[np.ndarray], item_ids: pa.Array, weights: dict[int, int], total: int, length: int, top: int, kinds: StructType) -> DataFrame:
    """``item_id, doc_id, score``: the best documents of each block for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                norm = _norms(batch.column("sizes")[row].values.to_numpy(), total, length)
                found = batch.column("terms")[row].values.to_numpy()
                counts = batch.column("counts")[row].values.to_numpy()
                docs, tf = _unpack(batch.column("docs")[row].as_py(), "<u2"), _unpack(batch.column("tfs")[row].as_py(), "<u4")
                w = np.repeat(np.array([weights[t] for t in found.tolist()], np.int64), counts)
                adds = w * (1_000_000_000 * tf // (1000 * tf + 20 * norm[docs]))
                ends = np.cumsum(counts)
                postings = {int(t): (docs[e - c : e], adds[e - c : e]) for t, c, e in zip(found, counts, ends, strict=True) if weights[int(t)] > 0}
                out = [best_of_block(ids, postings, wanted, top) for wanted in items]
                which = np.repeat(np.arange(len(items)), [len(p) for p, _ in out])
                places = np.concatenate([p for p, _ in out]) if out else np.empty(0, np.int64)
                scores = np.concatenate([s for _, s in out]) if out else np.empty(0, np.int64)
                for lo in range(0, len(which), 10_000):
                    at = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(which[at])), ids.take(pa.array(places[at])), pa.array(scores[at])], names=kinds.names)

    return blocks.select("ids", "sizes", "terms", "counts", "docs", "tfs").mapInArrow(run, kinds)


def _item_terms(text) -> set[bytes]:
    return {w for words in terms(bytes(text or b"")) for w in words}


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs(doc_id, text, ...)`` for each item of ``items(item_id, text, ...)``.

    Terms are runs of ASCII letters and digits and of other than ASCII characters, with A-Z lower-cased; the score
    is a BM25 in integers: a term's weight times its damped frequency, which length norms divide. Documents are indexed in blocks that keep
    the postings of the items' terms only; blocks are ranked apart (:func:`best_of_block`) and their best documents merged.
    Items travel to the tasks ``pass_bytes`` of text at a time; each such part of the items is a pass of its own over all documents.

    Documents without a term (null and empty texts) neither rank nor count. Very long texts are split a stretch at a time. Equal scores rank by
    ascending doc_id, null first; rows that repeat a doc_id are documents of their own and rank each. Rows that share an item_id, a null one
    too, are one item with all their terms. Items without a term, and empty tables, give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    kinds = StructType([items.schema["item_id"], docs.schema["doc_id"], StructField("score", LongType())])
    for f in kinds.fields:
        f.nullable = True
    found = None
    for part in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part).collect()  # about pass_bytes of text
        of_item: dict = {}
        for r in rows:
            of_item.setdefault(r["item_id"], set()).update(_item_terms(r["text"]))
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*of_item.values())))}
        blocks = settle(index_blocks(docs, vocabulary))
        total, length = (int(v or 0) for v in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        dfs = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).collect()  # one row per term of the items
        weights = {r["terms"]: weight(total, r["df"]) for r in dfs}
        id_type = pa.RecordBatch.from_pylist([{"item_id": None}], schema=_arrow_schema(spark, items)).schema.field("item_id").type
        ids = pa.array(list(of_item), id_type)
        lists = [np.array(sorted(vocabulary[w] for w in ws), np.int64) for ws in of_item.values()]
        best = _rank_blocks(blocks, lists, ids, weights, total, length, top, kinds)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Many blocks' candidates for one item are cut down in parts before they meet.
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(buckets_of(spark))))
    parts = parts.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_r") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _arrow_schema(spark, items: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(items.select("item_id").schema)


# The same result in DuckDB.
_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


def oracle() -> str:
    return f"""
WITH d AS (SELECT r, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
z AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
s AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM z),
q AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, total),
m AS (SELECT r, 50 + (50 * n * total) // length AS m FROM z, s),
p AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= {TOP}
"""
