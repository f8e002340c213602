"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
from gridcast.llm import simhash, toxicity
from tests.llm.test_operators import SF_BIG, brute_components, documents, norm


def brute_shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_like(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if abs(len(a) - len(b)) <= 0.25 * max(len(a), len(b)) else False


def test_stages(spark):
    docs = documents(spark, SF_BIG)
    columns = docs.columns
    steps = [docs.collect()]
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, SF_BIG).collect(), stage(spark, at, SF_BIG).schema)
        steps.append(at.collect())
        if stage is not corpus_pipeline.packed_sequences:
            assert at.columns == columns
    start, clean, unique, apart, mixed, packed = steps
    assert 0.8 * len(start) < len(clean) < len(start)
    least = {}
    for r in clean:
        least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(least.values())
    sets = [brute_shingles(r.text) for r in sorted(unique)]
    root = brute_components(len(sets), lambda i, j: brute_like(sets[i], sets[j]))
    assert sorted(r.doc_id for r in apart) == [r.doc_id for i, r in enumerate(sorted(unique)) if root[i] == i]
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in apart} and max(copies.values()) <= 2
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert corpus_pipeline.run(spark, SF_BIG).count() == len(packed)


def test_stages_take_odd_rows(spark):
    from tests.llm.test_operators import BASE, frame

    at = frame(spark, BASE)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF_BIG)
        at = spark.createDataFrame(out.collect(), out.schema)
        assert at.count() > 0
    kept = simhash.drop_near_copies(frame(spark, BASE))
    assert kept.columns == frame(spark, BASE).columns


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_near_copies_of_a_large_group_and_of_small_ones(spark):
    """A group of a third of all rows, pairs, chains, and documents that share a passage only."""
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, shared = word(200), word(60)
    texts = [changed(rng, base, 2) for _ in range(150)]
    for _ in range(40):
        one = word(rng.randrange(30, 300))
        texts += [" ".join(one), changed(rng, one, max(1, len(one) // 60)), changed(rng, one, len(one) // 4)]
    texts += [" ".join(shared + word(90)) for _ in range(120)]
    texts += ["one two", "One  two", "one two three", "", None, " "]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").repartition(5)
    sets = [brute_shingles(t) for t in texts]
    root = brute_components(len(texts), lambda i, j: sets[i] == sets[j] or brute_like(sets[i], sets[j]))
    want = {i for i in range(len(texts)) if root[i] == i}
    got = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(texts) - len(want))  # links are verified; few are missed


def test_rows_are_judged_one_by_one(spark):
    toxic = spark.read.parquet(f"{SF_BIG}/labels.parquet").where("toxic = 1").select("doc_id")
    docs = documents(spark, SF_BIG)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF_BIG}/labels.parquet"))
    bad = docs.join(scored.where("predicted = 1").join(toxic, "doc_id").select("doc_id"), "doc_id").first()
    clean = "a plain note about the garden and the weather of the week"
    extra = [(None, clean), (None, clean + " again"), (bad.doc_id, clean + " too"), (None, bad.text), (None, None)]
    at = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    kept = [tuple(r) for r in toxicity.drop_toxic(at, spark.read.parquet(f"{SF_BIG}/labels.parquet")).where("doc_id is null or doc_id = " + str(bad.doc_id)).collect()]
    assert sorted(kept, key=str) == sorted([extra[0], extra[1], extra[2], extra[4]], key=str)
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (3, "x y"), (3, "z"), (3, "z"), (None, "z")], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.drop_near_copies(rows).collect()), key=str) in (
        sorted([(None, "a b c d e f"), (3, "x y"), (3, "z")], key=str), sorted([(None, "A b c d e f"), (3, "x y"), (3, "z")], key=str),
    )
