"""The corpus operators against brute force on small fixtures and on the small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from gridcast.llm import embeddings, exact, langid, licenses, mixing, packing, quality, queries, secretscan, simhash, toxicity
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SF_BIG = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, _row int, component_id int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
BASE = [
    (1, "one two three four five six", "en", "a"), (2, "one  two\tthree four five six", "en", "a"), (3, "one two three four five six", "en", None),
    (4, "", None, "b"), (5, None, "en", "b"), (6, "  \n ", "en", "c"), (7, LONG, "en", "a"), (8, LONG, "fr", "b"), (9, LONG + " tail", "fr", "b"),
    (10, "x", None, None), (None, "nobody owns this text here", "en", "c"), (11, "same row", "en", "a"), (11, "same row", "en", "a"), (12, "Ünïcode ½ ² don't 3.5 a..b é. 日本語", "de", "c"),
]


def frame(spark, rows=BASE):
    return spark.createDataFrame([(*r, None, "clash", 1, 2) for r in rows], SCHEMA)


def empty(spark):
    return frame(spark, []).limit(0)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_sql(spark, name):
    assert compare(spark, connect(SF_BIG), queries.QUERIES[name], queries.ORACLES[name], SF_BIG) is None


# --- exact dedup -----------------------------------------------------------------------------------------------------


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        own = groups[norm(r[1])]
        keep = min((i for i in own if i is not None), default=None)
        out.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_edges(spark):
    got = [tuple(r) for r in exact.exact_groups(frame(spark)).collect()]
    assert sorted(got, key=str) == brute_exact(BASE)
    kept = exact.drop_exact_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "9", "10", "None", "11", "12"])


def test_exact_tries_another_seed_when_identifiers_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    whole = exact.chunk_id
    weak = lambda c, seed: F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed == 0 else whole(c, seed)
    monkeypatch.setattr(exact, "chunk_id", weak)
    assert exact.verified_seed(frame(spark)) == 1
    assert sorted((tuple(r) for r in exact.exact_groups(frame(spark)).collect()), key=str) == brute_exact(BASE)


def test_chunks_give_the_text_back(spark):
    from pyspark.sql import functions as F

    df = documents(spark).select(exact.normalised().alias("t"))
    assert df.where(F.concat_ws("", exact.chunks_of(F.col("t"))) != F.col("t")).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check_simhash(rows, got):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = brute_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, root, strict=True)), key=str)


def test_simhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    check_simhash(rows, simhash.near_groups(documents(spark)).collect())
    check_simhash(BASE, simhash.near_groups(frame(spark)).collect())


def test_golay_keys_meet_at_three_bits(spark):
    nearest, near = simhash.golay_keys()
    assert (nearest >= 0).all() and (near[:, 0] >= 0).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * 2 + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b[k * 800 :] ^= np.uint64(1) << rng.integers(0, 64, 3000 - k * 800).astype(np.uint64)
    left, right = collections.defaultdict(set), collections.defaultdict(set)
    for table, (rows, keys) in ((left, simhash._keys(a, False)), (right, simhash._keys(b, True))):
        for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
            table[r].add(k)
    assert all(left[i] & right[i] for i in range(3000))
    fps = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([a, b])).view(np.int64)], "fp bigint")
    found = {(r.a, r.b) for r in simhash.links(fps).collect()}
    want = {tuple(sorted((int(x), int(y)))) for x, y in zip(a.view(np.int64), b.view(np.int64), strict=True) if x != y}
    assert want <= found and all(((x ^ y) & (2**64 - 1)).bit_count() <= 3 for x, y in found)


# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("which", ["edges", "table"])
def test_mixing(spark, which):
    docs = frame(spark) if which == "edges" else documents(spark, SF_BIG)
    got = mixing.mix(docs).select("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "_copies").collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(((r.doc_id, r.source, size(r.text)) for r in rows), key=str)
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r._size
        taken[r.source] += r._size * r._copies
        longest[r.source] = max(longest[r.source], r._size)
        assert 0 <= r._copies <= 2
    targets = brute_targets(dict(sizes))
    for r in got:
        assert r._source_size == sizes[r.source] and math.isclose(r._target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= (0.01 * targets[s] if which == "table" else longest[s] / 2 + 1)
    again = mixing.mix(docs.repartition(5)).select("_row.doc_id", "_copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs).select("_row.doc_id", "_copies").collect())
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed_rows(docs).count() == sum(r._copies for r in got)


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = frame(spark).union(documents(spark).selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "'x'", "1", "2"))
    packed = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = sorted(([r.doc_id, *tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()), key=str)
    parts = collections.defaultdict(list)
    for r in packed:
        parts[r.doc_id].append(r)
    found = []
    for doc_id, own in parts.items():
        repeats = sum(r.piece == 0 for r in own)
        ids = b"".join(r.ids for r in sorted(own, key=lambda r: r.piece)[:: repeats])
        found += [[doc_id, *np.frombuffer(ids, "<u4").tolist()]] * repeats
    assert sorted(found, key=str) == want
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.start == 2048 * r.piece
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    digest = packing.pack_digest(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in digest) == sorted((str(r.doc_id), r.piece, zlib.crc32(r.ids)) for r in packed)
    whole = packing.sequences(packing.pack(docs)).collect()
    assert len(whole) == len(bins) and sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in packed)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    tokenizer, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = [
        "Plain words. More, words.", "H\u0331 h\u0331 T\u0308 J\u030c E\u0301", "<|endoftext|> <|ENDOFTEXT|> <|EndOfText|>. x<|startoftext|>y", "It's DON'T we'LL 's. 't,",
        "\u212a \u0130 \u03a3\u03a3 \u01c4", "a\u00a0b\u3000c\u0085d\x1ce", "\u65e5\u672c\u8a9e\u3002\u30cf\u309a", "x.y. 3.14. a1, \u00e9. \u00d7. \u00f7,", "",
    ]
    for t in [*texts, " ".join(texts[:2]), *texts]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_plan_equals_best_fit_one_by_one():
    rng = np.random.default_rng(1)
    for trial in range(30):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 300))).tolist()
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(cap - n)
        used = collections.defaultdict(list)
        for length, first, last, seq, per, offset in packing.plan(dict(collections.Counter(lengths)), cap):
            for t in range(last - first):
                used[seq + t // per].append((offset + t % per * length, length))
        assert sorted(x for v in used.values() for _, x in v) == sorted(lengths)
        for v in used.values():
            assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(v))) and sum(x for _, x in v) <= cap
        assert sorted(cap - sum(x for _, x in v) for v in used.values()) == sorted(rooms), trial


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_segments_against_recursive_definition():
    def recursive(s, lo):
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, n = -best[2], -best[1]
        return [*recursive(s[:i], lo), (lo + i, lo + i + n, best[0]), *recursive(s[i + n :], lo + i + n)]

    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(-4, 5, int(rng.integers(0, 14)))
        assert sorted(x[2] for x in toxicity.segments(s)) == sorted(int(x[2]) for x in recursive(s.tolist(), 0))


def test_toxicity_held_out(spark):
    docs, labels = documents(spark, SF_BIG), spark.read.parquet(f"{SF_BIG}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    shuffled = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(map(str, toxicity.score_toxicity(docs, shuffled).collect())) == sorted(map(str, got))
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()) == sorted(r.doc_id for r in got if not r.predicted)


def test_toxicity_edges(spark):
    bad = [(100 + i, f"fine words {i} then vileword vileword again {i}", "en", "a") for i in range(40)]
    good = [(200 + i, f"fine words {i} then nice again {i} and {i * 7}", "en", "a") for i in range(60)]
    docs = frame(spark, [*BASE, *bad, *good])
    labels = labels_of(spark, [*((r[0], 1, 1) for r in bad), *((r[0], 1, 0) for r in good), (None, 1, 1), (1, None, None)])
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[r[0]].predicted == 1 and got[r[0]].n_passages == 1 for r in bad) and all(got[r[0]].predicted == 0 for r in [*good, *BASE])
    p = got[100].passages[0]
    assert bad[0][1][p.start : p.end] == "vileword vileword"
    assert all(r.score < 1e-9 and r.predicted == 0 for r in toxicity.score_toxicity(docs, labels_of(spark)).collect())


# --- secrets ---------------------------------------------------------------------------------------------------------


def brute_secrets(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(secretscan.RULES):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets_against_regex(spark):
    texts = [
        "password=abcdef token: 'short' token=ab SECRET = \"long_enough\" é api-key: x api_key:y1234567", "AKIA" + "A1" * 8 + " AKIAX " + "0123456789abcdef" * 2 + "\n" + "f" * 23,
        "token: token: abcdefgh passwd:=x", "日本 apikey='ZZZZZZ' " * 500, "eyJhbGci.eyJzdWIi.sig-_ ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "pass word KIA tok ken", "aKIA" + "0" * 30,
    ]
    rows = [*BASE, *((100 + i, t, "en", "a") for i, t in enumerate(texts)), (100, texts[0], "en", "a"), (None, texts[1], "en", "a")]
    got = secretscan.find_secrets(frame(spark, rows)).collect()
    want = sorted(str((r[0], brute_secrets(r[1]))) for r in rows)
    assert sorted(str((r.doc_id, [tuple(s) for s in r.secrets])) for r in got) == want


def test_trigram_queries():
    rules = {k: secretscan.trigram_query(p) for k, p, _, _ in secretscan.RULES}
    assert rules["hex"] == [] and rules["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in rules["assign"][0] and frozenset({"api", "pik", "ike", "key"}) in rules["assign"][0]
    assert secretscan.trigram_query("ab?c.*xyz+") == [[frozenset({"xyz"})]]


# --- the rest --------------------------------------------------------------------------------------------------------


def test_language_held_out_and_edges(spark):
    docs = documents(spark, SF_BIG)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    both = docs.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars", "'x'", "1", "2").union(frame(spark, [*BASE, (20, "12 !! 3", "en", "a")]))
    found = {r.doc_id: r for r in langid.identify(both).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {4, 5, 6, 20}
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 4, 9, 40):
        m = langid.codewords(n)
        assert min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= 2 and (np.abs(m.sum(axis=0)) < n).all()


def test_notice_lines_end_at_line_feeds(spark):
    texts = ["Kept line\nfoo\rCOPYRIGHT (C) 2020 A", "Kept line", "kept \u2028 line", "Licensed under CC BY 4.0.\r\n(c) 2021 B\r\n", "copyright law is prose"]
    got = {r.doc_id: r for r in licenses.find_licenses(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got[0].digest == got[1].digest != got[2].digest and got[3].license == "CC-BY-4.0" and got[4].digest != got[1].digest


def test_license_forms(spark):
    mit = dict(reversed(licenses.KNOWN[:3]))["MIT"]
    texts = [licenses.KNOWN[2][1].upper().replace(",", " , ") + "\nCopyright (c) 2020 A. Person\n", "prose\n  licenced under the APACHE Licence - version 2.0\nmore", mit, "Licensed under the Apache License, Version 2.0. and more"]
    got = {r.doc_id: r for r in licenses.find_licenses(frame(spark, [*BASE, *((100 + i, t, "en", "a") for i, t in enumerate(texts)), (101, texts[1], "en", "a")])).collect()}
    assert [got[100 + i].license for i in range(4)] == ["MIT", None, "MIT", None] and got[101].line_licenses == ["Apache-2.0"]
    assert all(got[r[0]].license is None and got[r[0]].line_licenses == [] for r in BASE)


def test_whole_license_files(spark):
    mit = "MIT License\n\nCopyright (c) 2021 A. Person\n\n" + re.sub("(.{60}[^ ]*) ", r"\1\n", licenses.KNOWN[2][1])
    whole = {n: max((t for m, t in licenses.KNOWN if m == n), key=len) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0")}
    files = {"MIT": mit, **{n: re.sub(r"[ ]+", "  ", t).upper() for n, t in whole.items()}}
    files["Apache-2.0"] = whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 A. Person")
    got = {r.doc_id: r.license for r in licenses.find_licenses(frame(spark, [(i, t, "en", "a") for i, t in enumerate(files.values())])).collect()}
    assert [got[i] for i in range(len(files))] == list(files)


def brute_kneser_ney(texts):
    counts = collections.Counter(g for t in texts for t in ["\x01\x01\x01" + t.lower()] for g in (t[i : i + 4] for i in range(len(t) - 3)))
    tables = {4: counts}
    for k in (3, 2, 1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])

    def prob(k, g):
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        t = tables[k]
        n = [0, *(sum(c == i for c in t.values()) for i in (1, 2, 3, 4))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0, *(min(max(i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 0), 0.1), i - 0.1) for i in (1, 2, 3))]
        heirs = {x: c for x, c in t.items() if x[:-1] == g[:-1]}
        if not heirs:
            return prob(k - 1, g[1:])
        s = sum(heirs.values())
        c = heirs.get(g, 0)
        return max(c - d[min(c, 3)], 0) / s + sum(d[min(x, 3)] for x in heirs.values()) / s * prob(k - 1, g[1:])

    return lambda t: math.exp(-sum(math.log(prob(4, x[i : i + 4])) for x in ["\x01\x01\x01" + t.lower()] for i in range(len(t))) / max(len(t), 1))


def test_kneser_ney_against_brute_force(spark):
    train = ["the cat sat on the mat", "a cat and a dog", "dogs eat the mat", ""]
    ask = ["the dog sat", "zzz qqq", "", "The cat é", "a"]
    ppl = brute_kneser_ney(train)
    model = quality.kneser_ney(quality.gram_counts(spark.createDataFrame([(t,) for t in train], "text string")))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string"), model).collect()}
    for i, t in enumerate(ask):
        assert math.isclose(got[i], ppl(t), rel_tol=1e-5)


def test_quality_keeps_trusted_and_drops_junk(spark):
    docs, labels = documents(spark, SF_BIG), spark.read.parquet(f"{SF_BIG}/labels.parquet")
    junk = [(10**6 + i, "".join(chr(33 + (i * 31 + j * j * 7) % 90) for j in range(400)), "en", "a") for i in range(5)]
    both = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x'", "1", "2").union(frame(spark, [(None, "abc def", "en", "a"), *junk]))
    got = {r.doc_id: r for r in quality.judge_quality(both, labels).collect()}
    assert not any(got[r[0]].kept for r in junk) and len(got) == docs.count() + 6
    trusted = [got[r.doc_id].kept for r in labels.where("quality = 1").collect() if r.doc_id in got]
    assert sum(trusted) / len(trusted) >= 0.97


def test_quality_learns_from_every_trusted_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity.training_rows, "__defaults__", ("toxic", 2))  # a cap on labelled rows is no matter of op8's
    texts = ["the cat sat on the mat", "a cat and a dog", "dogs eat the mat", "mats and hats", "", "the hat", "zzz qqq", None] * 3
    docs = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(3, "a repeated id", "en", "a"), (None, "cats", "en", "a")]
    labels = [(i, 0 if i % 8 == 6 else 1, None) for i in range(len(texts))] + [(6, 1, None), (0, 0, None), (None, 1, None)]
    assert any(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts)) if i % 8 != 6)
    trusted = [t or "" for i, t, *_ in docs if i is not None and (i % 8 != 6 or i == 6)]
    ppl = brute_kneser_ney(trusted)
    got = quality.judge_quality(frame(spark, docs), labels_of(spark, labels)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.perplexity, 3)) for r in got) == sorted((i is None, i or 0, round(ppl(t or ""), 3)) for i, t, *_ in docs)


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for centre in rng.standard_normal((40, 16)):
        rows += [(centre + rng.standard_normal(16) * 0.05).tolist() for _ in range(int(rng.integers(1, 40)))]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]]] + rng.standard_normal((300, 16)).tolist()
    odd = [None, [0.0] * 16, [1.0, None, *[0.0] * 14], [float("nan")] * 16, [float("inf"), *[1.0] * 15], [], [1.0, 2.0]]
    table = [(i, v, 0) for i, v in enumerate([*rows, *odd])] + [(None, rows[0], 0)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, links int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, window=16).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    n = (s >= 0.95).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    root = brute_components(len(rows), lambda i, j: s[i, j] >= 0.95)
    assert np.mean([got[i].component_id == root[i] for i in range(len(rows))]) >= 0.97
    for i in range(len(rows), len(rows) + len(odd)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def test_embedding_passes_grow_with_the_table(spark, monkeypatch):
    assert embeddings.passes_for(2000, 512, 0.95) == embeddings.PASSES == embeddings.passes_for(0, 512, 0.95)
    agree = 1 - math.acos(0.95) / math.pi
    for total in (10**6, 10**7, 10**8):
        passes, meet = embeddings.passes_for(total, 512, 0.95), agree ** math.log2(total / 512)
        assert 1 - (1 - meet) ** passes >= 0.99 and 1 - (1 - meet) ** embeddings.PASSES < 0.97
    used, coded = [], embeddings._coded
    monkeypatch.setattr(embeddings, "_coded", lambda nodes, passes: used.append(passes) or coded(nodes, passes))
    x = np.random.default_rng(4).standard_normal((1200, 16))
    embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), window=2).count()
    assert used == [embeddings.passes_for(1200, 2, 0.95)] and used[0] > embeddings.PASSES


def test_empty_tables(spark):
    docs, none = empty(spark), labels_of(spark)
    for out in (
        exact.exact_groups(docs), exact.drop_exact_copies(docs), simhash.near_groups(docs), simhash.drop_near_copies(docs), mixing.mix(docs), mixing.mixed_rows(docs), packing.pack(docs),
        packing.pack_digest(docs), toxicity.score_toxicity(docs, none), toxicity.drop_toxic(docs, none), secretscan.find_secrets(docs), langid.identify(docs), licenses.find_licenses(docs),
        quality.judge_quality(docs, none), embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
    ):
        assert out.count() == 0
