"""Ranked search, sharding and conversation repair against brute force."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridcast.llm import repair, search, sharding
from tests.llm.test_operators import BASE, LONG, empty, frame

# --- ranked search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, top):
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(words(text))
    for item, ws in wanted.items():
        scored = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if w in c)
            if s > 0:
                scored.append((-s, doc is not None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id bigint, text string, doc_id string")


ITEMS = [(1, "one two SIX"), (2, ""), (3, None), (None, "w3x3 same"), (None, "row"), (4, "日本語 ünïcode Ünïcode 5"), (4, "nobody"), (5, "absent words only"), (6, LONG[:20000])]


@pytest.mark.parametrize("top", [1, 2, 50])
def test_search_edges(spark, top):
    docs = [(r[0], r[1]) for r in BASE]
    got = [tuple(r) for r in search.ranked_search(frame(spark), items_of(spark, ITEMS), top).collect()]
    assert sorted(got, key=str) == brute_search(docs, ITEMS, top)
    assert search.ranked_search(empty(spark), items_of(spark, ITEMS)).collect() == []
    assert search.ranked_search(frame(spark), items_of(spark, [])).collect() == []


def test_search_over_blocks_masks_and_passes(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(200)]
    docs = [(rng.randrange(400), " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(200)], k=rng.randrange(1, 60)))) for _ in range(700)]
    docs += [(1000 + i, "t0 t1 t2") for i in range(300)]  # one mask and one score for many
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([3, 20, 150])))) for i in range(12)]
    monkeypatch.setattr(search, "BLOCK_DOCS", 37)
    frame_of = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    size = sum(len(t) for _, t in items)
    for pass_bytes in (1 << 20, size // 3):
        got = [tuple(r) for r in search.ranked_search(frame_of, items_of(spark, items), 50, pass_bytes).collect()]
        assert sorted(got, key=str) == brute_search(docs, items, 50)


def test_terms_of_a_long_text(monkeypatch):
    text = ("Ab c1-x " * 50 + "y" * 300 + " Ünï").encode()
    whole = [w for ws in search.terms(text) for w in ws]
    for stretch in (1, 7, 64):
        monkeypatch.setattr(search, "STRETCH", stretch)
        assert [w for ws in search.terms(text) for w in ws] == whole == [w.encode() for w in words(text.decode())]


def test_norms_beyond_64_bits():
    import numpy as np

    n = np.array([3, 10**9])
    assert search._norms(n, 10**12, 10**13).tolist() == [50 + 50 * 3 * 10**12 // 10**13, 50 + 50 * 10**9 * 10**12 // 10**13]


# --- sharding --------------------------------------------------------------------------------------------------------


def brute_shard(key, weights):
    def bid(s, w):
        return -math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w

    return min((bid(s, w), s) for s, w in enumerate(weights) if w)[1]


def brute_digest(rows, weights):
    shards = collections.defaultdict(list)
    for doc, text in rows:
        key, data = "" if doc is None else str(doc), (text or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data)
        order = hashlib.md5(f"{key}:{size}:{crc}".encode()).hexdigest()
        shards[brute_shard(key, weights)].append((order, doc, size, crc, brute_shard(key, [*weights, 1.0])))
    return sorted(((d, z, c, "key", s, i, g) for s, own in shards.items() for i, (_, d, z, c, g) in enumerate(sorted(own, key=str))), key=str)


@pytest.mark.parametrize("weights", [(1.0,) * 40, (1.0, 3.0, 0.0, 2.0)])
def test_shards_and_slots(spark, monkeypatch, weights):
    monkeypatch.setattr(sharding, "COPIES", 2)  # copies of a record over several rows
    rows = [(r[0], r[1]) for r in BASE] + [(77, "hot")] * 7
    got = [tuple(r) for r in sharding.shard_digest(frame(spark, [*BASE, *[(77, "hot", None, None)] * 7]), weights).collect()]
    assert sorted(got, key=str) == brute_digest(rows, weights)
    assert sharding.shard_digest(empty(spark), weights).collect() == []


def test_shards_follow_weights_and_move_little(spark):
    weights = (1.0, 2.0, 5.0)
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.assign_shards(docs, weights, 2.0).select("shard", "grown_shard").collect()
    counts = collections.Counter(r.shard for r in rows)
    for s, w in enumerate(weights):
        assert abs(counts[s] / len(rows) - w / 8) < 0.01
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / len(rows) - 0.2) < 0.01
    digest = sharding.shard_digest(docs, weights)
    shards = digest.groupBy("shard").agg(F.min("slot").alias("low"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots"), F.count("*").alias("n"))
    assert all(r.low == 0 and r.n == r.slots == r.top + 1 for r in shards.collect())
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, (0.0, 0.0))


def test_written_shards_hold_the_rows(spark, tmp_path):
    sharding.write_shards(frame(spark), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in BASE)
    want = {r[0]: brute_shard("" if r[0] is None else r[0], (1.0,) * 40) for r in BASE}
    assert all(r.shard == want[r.doc_id] for r in back.collect())


# --- conversation repair ---------------------------------------------------------------------------------------------

TALK = "conv_id bigint, turn bigint, role string, text string, conv string, n int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TALK)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = fill(role), fill(text)
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(own):
    """Cheapest edits of one conversation by exhaustive best-first search over (cost, audit)."""
    own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in own:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, known = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in known:
            continue
        known.add((at, last))
        if at == len(own) and last in ("", "a"):
            break
        for role in ("user", "assistant"):
            if role[0] in legal[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*lines, f"{role}:")))
        if at < len(own):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, lines))
            if faults[at] not in ("blank", "duplicate"):
                role, text = own[at][2:]
                more = faults[at] == "truncated"
                if role and role[0] in legal[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if to[0] in legal[last]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, to[0], (*lines, f"{to}:{text}")))
    turns = [r[1] for r in own if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check_repair(spark, rows, ids, size):
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(talk(spark, rows), talk(spark, ids), size).collect()}
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: brute_repair(convs[c]) for c in {r[0] for r in ids}}


ODD = [
    (1, 0, "system", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "assistant", "No."), (2, None, "user", "null turn."), (2, None, "user", "null turn."), (2, 1, None, None),
    (3, 0, "tool", "x."), (3, 0, "tool", "x."), (3, 5, "", "no role."), (None, 1, "assistant", "nobody"), (None, None, "user", "nobody's."), (4, 0, "user", " \n"),
    (5, 9, "user", LONG), (5, 9, "assistant", LONG + "!"), (6, 1, "user", "same."), (6, 2, "user", "same."), (6, 3, "assistant", "same."), (6, 3, "assistant", "Ünï 日本."), (7, 2, "assistant", "a."),
]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_repair_edges(spark, size):
    check_repair(spark, ODD, [*ODD, (99, 0, "user", "all rows dropped")], size)
    assert repair.repair_report(talk(spark, []), talk(spark, [])).collect() == []
    assert [tuple(r)[1:7] for r in repair.repair_report(talk(spark, []), talk(spark, ODD[:1])).collect()] == [(0,) * 6]


@pytest.mark.parametrize("size", [2, 5])
def test_repair_across_chunks(spark, size):
    """Runs of one role never forget what follows them, so fix-up passes must carry two vectors through all chunks."""
    rng = random.Random(8)
    rows = [(1, t, "user", f"u{t}.") for t in range(41)] + [(2, t, "user", "copy.") for t in range(30)]
    rows += [(3, t, "user" if t < 30 else "assistant", f"{t}") for t in range(60)]
    for conv in range(4, 16):
        rows += [(conv, rng.randrange(40), rng.choice(["system", "user", "assistant", "tool", "user"]), rng.choice(["", "a.", "b", f"{rng.random()}!"])) for _ in range(rng.randrange(1, 50))]
    check_repair(spark, rows, rows, size)


def test_repair_of_random_damage(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2], rng.choice(["Fine.", "So what?", "end", "Ok! ", "..."])))
    damaged = [tuple(r) for r in repair.damage(talk(spark, [*rows, *ODD])).collect()]
    assert sorted(damaged, key=str) == sorted(brute_damage([*rows, *ODD]), key=str)
    check_repair(spark, damaged, [*rows, *ODD], 4096)


def test_repaired_rows_have_the_roles(spark):
    rows = [r for r in ODD if r[0] is not None]
    found = sorted((tuple(r) for r in repair.repaired_rows(talk(spark, rows)).collect()), key=lambda r: r[:6])
    told = {r.conv_id: r.repaired_sha256 for r in repair.repair_report(talk(spark, rows), talk(spark, rows)).collect()}
    lines = collections.defaultdict(list)
    for r in found:
        lines[int(r[0][1:])].append(f"{r[6]}:{r[7]}")
    for conv, sha in told.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[conv]))
