"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import text_of
from gridcast.session import settle

FEATURES, SMOOTHING, SEED = 8192, 0.5, 5
AMBIGUOUS = 0.75
# Bytes as features: ASCII letters lower, bytes of other letters as they are, all else a space.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def held_out(n: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest, F.lit(False))


def _grams(text: str) -> np.ndarray:
    """Hashed frequencies of a text's byte bigrams and trigrams; they add up to 1, or to 0 for a text without letters."""
    raw = _BYTES[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    total = np.zeros(FEATURES)
    for lo in range(0, len(raw), 1 << 20):  # a very long text in parts, each with the next two bytes
        a = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        if len(a) < 3:
            continue
        two = a[:-2] << 8 | a[1:-1]
        for code in (two, (two << 8 | a[2:]) + (1 << 25)):
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=FEATURES)
    blank = ((32 << 8 | 32) * 2654435761 % 2**32) >> 19
    total[blank] = 0
    return total / max(total.sum(), 1)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, far apart: the best of seeded random matrices whose columns all split the classes."""
    bits = max(7, 4 * max(1, (max(n, 2) - 1).bit_length()) + 3)
    rng, best, far = np.random.default_rng(SEED), np.ones((n, bits)), -1
    if n < 2:
        return best
    for _ in range(400):
        m = rng.choice([-1.0, 1.0], (n, bits))
        flat = np.abs(m.sum(axis=0)) == n
        m[0, flat] *= -1
        gap = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if gap > far:
            best, far = m, gap
    return best


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, f, total``: summed frequencies per language; each task sums its own documents first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                sums[lang] = sums.get(lang, 0) + _grams(text.as_py())
        for lang, total in sums.items():
            f = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f), pa.array(total[f])], names=["lang", "f", "total"])

    parts = docs.select("lang", text_of().alias("text")).mapInArrow(run, "lang string, f bigint, total double")
    return parts.groupBy("lang", "f").agg(F.sum("total").alias("total"))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row of ``docs(doc_id, text, lang, ...)``.

    Each bit of the languages' codewords has a naive Bayes classifier over byte n-grams: languages with the bit against those without. Its
    output is the mean log-odds of a text's n-grams, divided by its spread over the training rows. A text gets the language whose codeword has the least
    sum of logistic losses, each weighted by how often that bit's classifier is right on that language; ``score`` is the
    softmax over these losses, and a score below 0.75 is flagged as ambiguous. lang is read of training rows only.

    A null text, or one without a letter, is ``und`` with score 0 and ambiguous, as is every text if nothing can be learnt. Null lang and
    held-out rows teach nothing; a null doc_id is not held out. Rows that repeat a doc_id are judged each. An empty table gives
    an empty result; other columns are ignored.
    """
    train = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = settle(gram_counts(train))  # at most FEATURES rows per language
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not langs:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    table = np.zeros((len(langs), FEATURES))
    for r in counts.toLocalIterator():
        table[langs.index(r["lang"]), r["f"]] = r["total"]
    code = codewords(len(langs))
    plus, minus = (code > 0).astype(float).T @ table, (code < 0).astype(float).T @ table
    # Sums of frequencies count documents; the prior is a hundredth of a document over all features.
    share = lambda c: np.log((c + SMOOTHING / 100 / FEATURES) / (c.sum(axis=1, keepdims=True) + SMOOTHING / 100))
    weights = docs.sparkSession.sparkContext.broadcast(share(plus) - share(minus))  # bits x FEATURES numbers
    bits = code.shape[1]

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 128):
                x = [_grams(t) for t in batch.column("text").slice(lo, 128).to_pylist()]
                out.extend((np.stack(x) @ weights.value.T).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "truth", "letters")), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "truth", "letters", "margins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    truth = F.when(held_out(), F.lit(None)).otherwise(F.col("lang"))
    scored = settle(docs.select("doc_id", truth.alias("truth"), letters.alias("letters"), text_of().alias("text")).mapInArrow(
        margins, f"doc_id {kind}, truth string, letters boolean, margins array<double>"
    ))
    seen = scored.where("truth is not null and letters").groupBy("truth").agg(
        F.count("*").alias("n"), *[F.avg((F.col("margins")[b] > 0).cast("double")).alias(f"p{b}") for b in range(bits)],
        *[F.avg(F.abs(F.col("margins")[b])).alias(f"s{b}") for b in range(bits)],
    ).collect()  # one row per language
    right, spread = np.full((len(langs), bits), 0.5), np.ones(bits)
    for r in seen:
        p = np.array([r[f"p{b}"] for b in range(bits)])
        right[langs.index(r["truth"])] = np.where(code[langs.index(r["truth"])] > 0, p, 1 - p)
    if seen:
        spread = np.maximum(np.mean([[r[f"s{b}"] for b in range(bits)] for r in seen], axis=0), 1e-6)
    trust = np.maximum(right - 0.5, 0.01)
    trust /= trust.sum(axis=1, keepdims=True)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array(batch.column("margins").to_pylist(), float).reshape(batch.num_rows, bits) / spread
            loss = np.stack([np.logaddexp(0, -3 * m * c) @ t for c, t in zip(code, trust, strict=True)], axis=1)
            soft = np.exp(2 * (loss.min(axis=1, keepdims=True) - loss))
            best, ok = loss.argmin(axis=1), np.array(batch.column("letters").to_pylist(), bool)
            score = np.where(ok, 1 / soft.sum(axis=1), 0.0)
            named = [langs[k] if yes else "und" for k, yes in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    judged = scored.select("doc_id", "letters", "margins").mapInArrow(decode, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
