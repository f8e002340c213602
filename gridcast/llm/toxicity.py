"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import text_of
from gridcast.session import settle

# The classifier is fitted on at most this many labelled rows, chosen by a hash of doc_id. Nothing else is bounded by it.
MOST_LABELLED = 200_000
# Word beginnings that lend their statistics to the words below them.
PREFIXES = (4, 5, 6)
# Strength of the Dirichlet prior, in documents; evidence and documents a key must show against its parent.
PRIOR, LEAST_Z, LEAST_DOCS = 8.0, 4.0, 3
LOW, HIGH = -3, 12
_WORD = re.compile(r"[^\W\d_]+")


def training_rows(labels: DataFrame, column: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, label`` of labelled rows to learn from: not held out, one per doc_id, at most about ``most``."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    n = rows.count()
    share = min(1.0, 0.98 * most / max(n, 1))
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))


def held_out(n: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest, F.lit(False))


def _one_per_passage(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Training rows of which no other shares the smallest hash of three words: copies count once, near copies seldom."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column("text"):
                words = text.as_py().encode().lower().split()
                keys.append(min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(keys, pa.int64())], names=["doc_id", "label", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text")
    keyed = chosen.mapInArrow(run, f"doc_id {kind}, label int, key bigint")
    return settle(keyed.groupBy("key").agg(F.min_by(F.struct("doc_id", "label"), "doc_id").alias("r")).select("r.doc_id", "r.label").distinct())


def log_odds(docs: DataFrame, rows: DataFrame) -> dict[str, int]:
    """Scores of the word beginnings (``4:..``, ``5:..``, ``6:..``) and words (``w:..``) that differ from what they inherit.

    A key's share of toxic documents is shrunk towards its parent's by a Dirichlet prior: word to six letters, to five, to four, to all.
    A score is twice the log-odds against all tokens, less one, as an integer.
    """
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(rows), "doc_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    vocabulary = settle(chosen.select("label", F.explode(words).alias("w")).groupBy("w").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("y")))
    n, y = vocabulary.agg(F.sum("n"), F.sum("y")).first()
    if not n:
        return {}
    base = (y + 0.5) / (n + 1)
    parent = None
    found = None
    for depth in [*PREFIXES, None]:
        key = F.col("w") if depth is None else F.substring("w", 1, depth)
        level = vocabulary.groupBy(key.alias("k")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        if parent is None:
            level = level.withColumn("up", F.lit(base))
        else:
            level = level.withColumn("_p", F.substring("k", 1, above)).join(parent, "_p")
        level = level.withColumn("r", (F.col("y") + PRIOR * F.col("up")) / (F.col("n") + PRIOR))
        z = (F.col("y") - F.col("n") * F.col("up")) / F.sqrt(F.col("n") * F.col("up") * (1 - F.col("up")))
        odds = F.log(F.col("r") / (1 - F.col("r"))) - math.log(base / (1 - base))
        kept = level.where(F.col("n") >= LEAST_DOCS).select(
            F.concat(F.lit(f"{depth or 'w'}:"), "k").alias("key"), F.abs(z).alias("z"), odds.alias("odds"),
            F.log(F.col("up") / (1 - F.col("up"))).alias("_up"),
        ).where((F.col("z") >= LEAST_Z) & (F.abs(F.col("odds") + math.log(base / (1 - base)) - F.col("_up")) >= 0.7)).select("key", "z", "odds")
        found = kept if found is None else found.union(kept)
        parent, above = level.select(F.col("k").alias("_p"), F.col("r").alias("up")), depth
    rows_of = found.collect()  # keys that several of at most MOST_LABELLED documents support
    return {r["key"]: max(LOW, min(HIGH, round(2 * r["odds"]) - 1)) for r in rows_of}


def segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time (Ruzzo and Tompa).

    Only positive entries are visited; what lies between comes from running totals. ``before[k]`` is the last segment that
    starts from a lower total than segment k, so that the search backwards skips what earlier searches skipped.
    """
    total = np.concatenate([[0], np.cumsum(scores)])
    start, end, low, high, before = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        s, lo, hi = i, int(total[i]), int(total[i + 1])
        while True:
            k = len(low) - 1
            while k >= 0 and low[k] >= lo:
                k = before[k]
            if k < 0 or high[k] >= hi:
                break
            s, lo = start[k], low[k]
            del start[k:], end[k:], low[k:], high[k:], before[k:]
        start.append(s), end.append(i + 1), low.append(lo), high.append(hi), before.append(k)
    return [(s, e, h - lo) for s, e, lo, h in zip(start, end, low, high, strict=True)]


def scan(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """``doc_id, text_md5, n, counts, passages``: words, how many had each score, and all maximal segments as code point spans with scores."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = shared.value, {}

        def score(word: str) -> int:
            for key in (f"w:{word}", *(f"{d}:{word[:d]}" for d in reversed(PREFIXES))):
                if key in table:
                    return table[key]
            return -1

        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                words = _WORD.findall(text.lower())
                if len(memo) > 200_000:
                    memo.clear()
                values = np.empty(len(words), np.int64)
                for i, w in enumerate(words):
                    v = memo.get(w)
                    if v is None:
                        v = memo[w] = score(w)
                    values[i] = v
                found = segments(values)
                if found:
                    at = [m.span() for m in _WORD.finditer(text)]
                    if len(at) != len(words):  # lower case of a letter may hold a mark that ends a word
                        at = [m.span() for m in _WORD.finditer(text.lower())]
                    found = [{"start": at[s][0], "end": at[e - 1][1], "score": v} for s, e, v in found]
                out.append((len(words), np.bincount(values - LOW, minlength=HIGH - LOW + 1).tolist(), found))
            n, counts, found = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(n, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(found, spans)], names=["doc_id", "text_md5", "n", "counts", "passages"])

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_md5(), text_of().alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_md5 string, n bigint, counts array<bigint>, passages array<struct<start:bigint,end:bigint,score:bigint>>"
    )


def decay(counts: list[float]) -> float:
    """The positive root of sum(p * exp(x * score)) = 1 for the score counts of clean tokens (Karlin and Altschul)."""
    scores = np.arange(LOW, HIGH + 1)
    p = np.array(counts, float) + np.where((scores == HIGH) | (scores == -1), 0.5, 0.0)
    p /= p.sum()
    if (p * scores).sum() >= 0:
        return 0.05
    lo, hi = 1e-6, 20.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * scores)).sum() < 1 else (lo, mid)
    return lo


def logistic(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Intercept and slope of label shares over binned evidence ``(x, n, positives)``, with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        g, h = np.array([-0.02 * a, -0.02 * b]), np.diag([0.02, 0.02])
        for x, n, y in bins:
            p = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            v = np.array([1, x])
            g += (y - n * p) * v
            h += n * p * (1 - p) * np.outer(v, v)
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    return a, b


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages, passages, text_md5`` of every row of ``docs(doc_id, text, ...)``.

    Token log-odds are learnt from ``labels(doc_id, toxic)`` rows that are not held out. A segment of score S in a text of n
    words has about K n exp(-decay S) equals by chance in clean text; ``passages`` holds those expected less
    than once, and the document's evidence is the sum of the negative logarithms, turned into a probability of the label
    by a logistic curve over the training rows.

    A null or empty text has no passage and gets the score of no evidence. A null doc_id is not held out. Rows that repeat a doc_id are
    scored each; of contradicting labels the toxic one counts. Without labels every score is next to 0. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = settle(training_rows(labels))
    weights = log_odds(docs, _one_per_passage(docs, rows))
    scanned = settle(scan(docs, weights))
    trained = scanned.join(rows, "doc_id")
    clean = trained.where("label = 0")
    seen = clean.agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(HIGH - LOW + 1)]).first()
    rate = decay([v or 0 for v in seen])
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0))
    hits, reach = clean.agg(F.sum((best >= 4).cast("int")), F.sum(F.col("n") * math.exp(-rate * 4))).first()
    scale = math.log(((hits or 0) + 0.5) / max(reach or 0.0, 1e-9))
    chance = F.log(F.greatest("n", F.lit(1)).cast("double")) + scale
    passages = F.filter("passages", lambda p: p["score"] * rate > chance)
    evidence = F.aggregate(passages, F.lit(0.0), lambda s, p: s + p["score"] * rate - chance)
    judged = scanned.select("doc_id", "text_md5", passages.alias("passages"), F.least(evidence, F.lit(40.0)).alias("_x"))
    bins = judged.join(rows, "doc_id").groupBy(F.round("_x", 1).alias("x")).agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()  # 401 bins
    a, b = logistic([(r["x"], r["n"], r["y"]) for r in bins]) if bins else (-40.0, 0.0)
    score = 1 / (1 + F.exp(-(F.lit(float(a)) + float(b) * F.col("_x"))))
    return judged.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"), "passages", "text_md5",
    )


def text_md5() -> Column:
    return F.md5(text_of().cast("binary")).alias("text_md5")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; columns as they were.

    Each row is judged by its own doc_id and text, so clean rows without doc_id, or that repeat a toxic row's, stay. Null and empty texts stay.
    """
    bad = score_toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_bad"), F.col("text_md5").alias("_md5")).distinct()
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text_md5())
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("text_md5") == F.col("_md5")), "left_anti").select(*columns)
