"""op8 beyond one block: long texts, thresholds against brute force, ties at the threshold."""

from __future__ import annotations

import collections
import math

from gridcast.llm import quality
from tests.llm.test_operators import LONG, brute_kneser_ney, frame, labels_of


def brute_kept(docs, trusted, ppl):
    """Threshold of each language: 1.1 times the 0.99 quantile (the value at rank ceil(0.99 n)) of its trusted texts, else of all."""
    of = {k: ppl(t or "") for k, (_, t, *_) in enumerate(docs)}
    groups = collections.defaultdict(lambda: ([], []))
    for k, (i, t, lang, _) in enumerate(docs):
        if t:
            groups[lang][0].append(of[k])
            if i in trusted:
                groups[lang][1].append(of[k])
    out = {}
    for k, (i, _, lang, _) in enumerate(docs):
        values = sorted(groups[lang][1] or groups[lang][0])
        limit = 1.1 * (values[math.ceil(0.99 * len(values)) - 1] if values else 1.0)
        out[i] = (of[k], limit, of[k] <= limit * (1 + 1e-9))
    return out


def test_thresholds_and_ties_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 60)  # many blocks
    texts = ["the cat sat on the mat", "a cat and a dog", "dogs eat the mat", "zq xj kv wq", "", None, "the mat sat on a cat", "zq xj kv wq", "mats and hats and cats"]
    docs = [(i, t, ("en", "de", None)[i % 3] if i < 20 else "fr", "a") for i, t in enumerate(texts * 3)]
    trusted = {i for i in range(20) if texts[i % 9] not in ("zq xj kv wq",) and i % 3 != 2}
    got = quality.judge_quality(frame(spark, docs), labels_of(spark, [(i, 1, None) for i in trusted])).collect()
    want = brute_kept(docs, trusted, brute_kneser_ney([t or "" for i, t, *_ in docs if i in trusted]))
    assert len(got) == len(docs) and len({r.threshold for r in got}) >= 3
    for r in got:
        ppl, limit, kept = want[r.doc_id]
        assert math.isclose(r.perplexity, ppl, rel_tol=1e-4) and math.isclose(r.threshold, limit, rel_tol=1e-4) and r.kept == kept
    # Of equal texts all have the same perplexity, and one that lies on the threshold is kept.
    tied = quality.judge_quality(frame(spark, docs), labels_of(spark, [(0, 1, None)])).where("doc_id in (0, 9, 18)").collect()
    assert len({r.perplexity for r in tied}) == 1 and all(r.kept for r in tied)


def test_texts_longer_than_every_split(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 1 << 20)
    long = LONG * 3
    assert len(long) > (1 << 20)
    docs = [(1, long, "en", "a"), (2, long[: 1 << 20], "en", "a"), (3, "w1x1 w2x2", "en", "a"), (4, "ÄÖ ß 日本語", "en", "a")]
    got = {r.doc_id: r for r in quality.judge_quality(frame(spark, docs), labels_of(spark, [(1, 1, None)])).collect()}
    assert all(got[i].n_units == len(t.lower().encode("utf-16-le")) // 2 for i, t, *_ in docs)
    assert got[1].kept and got[2].kept and not got[4].kept
    # Whole texts count: the long text's perplexity is the mean over all its units, those of the second part too.
    other = {r.doc_id: r for r in quality.judge_quality(frame(spark, [(1, long, "en", "a"), (5, long + "日本語" * 9, "en", "a")]), labels_of(spark, [(1, 1, None)])).collect()}
    assert math.isclose(other[1].perplexity, got[1].perplexity, rel_tol=1e-6) and other[5].perplexity > other[1].perplexity
