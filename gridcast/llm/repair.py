"""Conversation structure repair: cheapest edits by a Viterbi search that runs over chunks of a conversation in parallel.

Roles must read ``(s?(ua)+)?``. A conversation's rows are cut into chunks. Each chunk runs backwards from a speculative vector of the
costs that remain after it; fix-up passes rerun chunks until the vectors that meet at every edge differ only by a constant.
The stitched costs then lead a forward trace that takes the ASCII-least of the cheapest edits at each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.sharding import crc32_call, crc32_sql
from gridcast.session import settle

SPACES = " \t\n\x0b\x0c\r"
# Records of one chunk at most; a record is a row with its exact copies.
CHUNK = 4096
RANK = ["conv", "dated", "turn", "role", "digest"]
RECORD = "conv string, dated boolean, turn bigint, role string, digest string"
# Rows of one task whose texts are remembered, so that copies of them do not move.
REMEMBERED = 50_000

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
FINAL = (0, 4, 2, 0)  # cost of the inserts that end a conversation
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = (2, 2, 3, 2)  # state after a row of the role that may follow
ROLE_OF = {2: "user", 3: "assistant"}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 2, 3, 2, 1
FORCED = 8  # code of a record without a row that may stay; else the initial's place, plus 4 if its text is truncated


# --- one row ---------------------------------------------------------------------------------------------------------


def _options(after: tuple, code: int, state: int) -> tuple[int, int, int]:
    """Costs to delete, keep and rerole a row that may stay, with the costs ``after`` it."""
    end = OPEN if code & 4 else 0
    kept = NEXT.get((state, (INITIALS + "x")[code & 3]))
    return DELETE + after[state], 99 if kept is None else KEEP + end + after[kept], REROLE + end + after[WANTED[state]]


@lru_cache(None)
def step_back(after: tuple, code: int) -> tuple[tuple, int]:
    """The vector before a row that may stay, lowered so that its least cost is 0, and by how much it was lowered."""
    v = [min(_options(after, code, s)) for s in range(4)]
    for _ in range(2):  # at most two inserts in a row help
        v = [min(c, INSERT + v[WANTED[s]]) for s, c in enumerate(v)]
    least = min(v)
    return tuple(c - least for c in v), least


@lru_cache(None)
def step_on(after: tuple, code: int, state: int) -> tuple[int, str, int]:
    """Number of inserts, then the edit of a row that may stay, and the state after it: of the cheapest the ASCII-least."""
    before, least = step_back(after, code)
    inserts = 0
    while True:
        delete, keep, rerole = _options(after, code, state)
        left = before[state] + least
        if delete == left:
            return inserts, "D", state
        if INSERT + before[WANTED[state]] + least == left:
            inserts, state = inserts + 1, WANTED[state]
        elif keep == left:
            return inserts, "K", NEXT[state, INITIALS[code & 3]]
        else:
            return inserts, "R", WANTED[state]


# --- one chunk -------------------------------------------------------------------------------------------------------


def run_back(after: tuple, codes: bytes) -> tuple:
    """The vector before a chunk, less a constant: rows that must go add the same to all four costs."""
    for code in reversed(codes):
        if code != FORCED:
            after = step_back(after, code)[0]
    return after


def trace(after: tuple, codes: bytes, state: int) -> tuple[list[tuple[int, str, int]], int]:
    """The edit of each record from a start state, and the state after the chunk."""
    vectors = []
    for code in reversed(codes):
        vectors.append(after)
        if code != FORCED:
            after = step_back(after, code)[0]
    found = []
    for code, after in zip(codes, reversed(vectors), strict=True):
        edit = (0, "", state) if code == FORCED else step_on(after, code, state)
        found.append(edit)
        state = edit[2]
    return found, state


def _key(vector: tuple) -> str:
    return ",".join(map(str, vector))


def _vector(key: str) -> tuple:
    return tuple(map(int, key.split(",")))


# --- rows and records ------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage: rows of ``(conv_id, turn, role, text)`` dropped, emptied, stripped of sentence ends, repeated or given the role user.

    A CRC-32 of ``conv_id:turn`` decides, so rows that share both share their fate. Null values, in the key too, become one space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind"))
    rows = rows.where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).drop("_copy")


def conv_key() -> Column:
    """The conversation's id as text; the null id is the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def keyed(rows: DataFrame) -> DataFrame:
    """``conv, dated, turn, role, digest, text``: a row's key and place, nulls first, without a null."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        conv_key().alias("conv"), F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        role.alias("role"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"),
    )


def records(rows: DataFrame) -> DataFrame:
    """Distinct rows of :func:`keyed` with how many there are (``n``), ``blank``, ``open`` (truncated) and ``first``, whether the
    role and text were not seen earlier. Copies meet inside tasks before they move, and texts do not move at all.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    flagged = rows.select(*RANK, (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"))
    own = settle(flagged.groupBy(*RANK).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open")))
    same = F.struct("conv", "role", "digest").alias("_same")  # a key of its own: both sides are shuffled for the join and can be split
    seen = own.groupBy("conv", "role", "digest").agg(F.min(F.struct("dated", "turn")).alias("_seen")).select(same, "_seen")
    joined = own.select("*", same).join(seen, "_same")
    return joined.select(*RANK, "n", "blank", "open", (F.struct("dated", "turn") == F.col("_seen")).alias("first"))


CHUNKS = (
    "conv string, seq bigint, dated array<boolean>, turn array<bigint>, role array<string>, digest array<string>, n array<bigint>, "
    "codes binary, illegal bigint, head string, tail string, before string"
)


def chunks(own: DataFrame, size: int = CHUNK) -> DataFrame:
    """Consecutive records (settled) of a conversation, at most ``size`` to a row, and the vector before them if the conversation ended after them.

    ``seq`` orders the chunks; ``illegal`` counts neighbouring rows inside whose roles may not follow each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pack() -> pa.RecordBatch:
            codes, illegal, last = bytearray(), 0, None
            for r in held:
                initial = r["role"][:1] if r["role"].startswith(tuple(INITIALS)) else "x"
                codes.append((INITIALS + "x").index(initial) + 4 * r["open"] if r["first"] and not r["blank"] else FORCED)
                illegal += r["n"] - 1 + (last is not None and last + initial not in LEGAL)
                last = initial
            row = {k: [r[k] for r in held] for k in ("dated", "turn", "role", "digest", "n")}
            row |= {"conv": held[0]["conv"], "seq": held[0]["_id"], "codes": bytes(codes), "illegal": illegal, "before": _key(run_back(FINAL, codes))}
            row |= {"head": held[0]["role"][:1], "tail": last}
            return row

        ready = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["conv"] != r["conv"] or len(held) == size):
                    ready.append(pack())
                    held.clear()
                held.append(r)
            if sum(len(x["n"]) for x in ready) >= 1 << 14:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready.clear()
        if held:
            ready.append(pack())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    arrow = pa.schema([
        ("conv", pa.string()), ("seq", pa.int64()), ("dated", pa.list_(pa.bool_())), ("turn", longs), ("role", texts), ("digest", texts), ("n", longs),
        ("codes", pa.binary()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("before", pa.string()),
    ])
    ordered = own.repartitionByRange(*RANK).sortWithinPartitions(*RANK)
    return ordered.withColumn("_id", F.monotonically_increasing_id()).mapInArrow(run, CHUNKS)


# --- edges between chunks --------------------------------------------------------------------------------------------


def _walk_back(summaries: pd.DataFrame) -> pd.DataFrame:
    """From a conversation's last chunk to its first: the vector after each, and vectors that no chunk has run from yet.

    Where a chunk's run from the true vector is not known, the walk goes on with what its latest run gave.
    """
    conv, after, out, missing = summaries["conv"].iloc[0], _key(FINAL), [], []
    for seq, runs in sorted(summaries.groupby("seq"), key=lambda x: -x[0]):
        known = dict(zip(runs["after"], runs["before"], strict=True))
        out.append((conv, seq, after, False))
        if after not in known:
            missing.append((conv, -1, after, True))
        after = known.get(after, runs["before"].iloc[-1])
    return pd.DataFrame(list(dict.fromkeys(missing)) or out, columns=["conv", "seq", "after", "missing"])


def stitched(parts: DataFrame) -> DataFrame:
    """``conv, seq, after``: the true vector after each chunk of the conversations that have several.

    A vector that some edge lacks is run through all of the conversation's chunks, so the passes number no more than the distinct vectors,
    a few dozen, however many chunks never converge by themselves.
    """
    several = parts.groupBy("conv").agg(F.count("*").alias("_n")).where("_n > 1").select("conv")
    slim = settle(parts.join(several, "conv", "left_semi").select("conv", "seq", "codes", "before"))
    runs = slim.select("conv", "seq", F.lit(_key(FINAL)).alias("after"), "before")

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, codes = batch.column("after").to_pylist(), batch.column("codes").to_pylist()
            before = [_key(run_back(_vector(a), c)) for a, c in zip(after, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seq"), batch.column("after"), pa.array(before, pa.string())], names=["conv", "seq", "after", "before"])

    while True:
        walked = settle(runs.groupBy("conv").applyInPandas(_walk_back, "conv string, seq bigint, after string, missing boolean"))
        missing = walked.where("missing").select("conv", "after")
        if missing.isEmpty():
            return walked.where("not missing").select("conv", "seq", "after")
        more = slim.join(missing, "conv").select("conv", "seq", "after", "codes").mapInArrow(rerun, "conv string, seq bigint, after string, before string")
        runs = settle(runs.unionByName(more).dropDuplicates(["conv", "seq", "after"]))


def _walk_on(summaries: pd.DataFrame) -> pd.DataFrame:
    """From a conversation's first chunk to its last: the state before each."""
    state, out = 0, []
    for r in summaries.sort_values("seq").itertuples():
        out.append((r.conv, r.seq, r.after, state, False))
        state = r.ends[state]
    out[-1] = (*out[-1][:4], True)
    return pd.DataFrame(out, columns=["conv", "seq", "after", "state", "last"])


def located(parts: DataFrame) -> DataFrame:
    """``conv, seq, after, state, last`` of chunks of conversations that have several: what the trace of a chunk needs of the others."""
    edges = settle(stitched(parts))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, codes = batch.column("after").to_pylist(), batch.column("codes").to_pylist()
            found = [[trace(_vector(a), c, s)[1] for s in range(4)] for a, c in zip(after, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seq"), batch.column("after"), pa.array(found, pa.list_(pa.int32()))], names=["conv", "seq", "after", "ends"])

    met = parts.select("conv", "seq", "codes").join(edges, ["conv", "seq"]).select("conv", "seq", "after", "codes")
    traced = met.mapInArrow(ends, "conv string, seq bigint, after string, ends array<int>")
    return traced.groupBy("conv").applyInPandas(_walk_on, "conv string, seq bigint, after string, state int, last boolean")


EDITS = f"{RECORD}, inserts array<string>, edit string, new_role string, drops bigint, closing array<string>, cost bigint"


def edits(parts: DataFrame) -> DataFrame:
    """One row per record: roles of the empty rows inserted before it, the edit of its first row (``K``, ``R``, ``D``, or none if that must go too)
    with the role it leaves with, ``drops`` further rows deleted, roles inserted at the end of the conversation, and the cost.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                start = 0 if part["state"] is None else part["state"]
                after = _vector(part["after"]) if part["after"] else FINAL
                found, end = trace(after, part["codes"], start)
                rows, state = [], start
                for i, (code, (inserts, edit, to)) in enumerate(zip(part["codes"], found, strict=True)):
                    added = []
                    for _ in range(inserts):
                        state = WANTED[state]
                        added.append(ROLE_OF[state])
                    role = {"K": part["role"][i], "R": ROLE_OF.get(WANTED[state])}.get(edit)
                    drops = part["n"][i] - (code != FORCED)
                    cost = INSERT * inserts + {"K": KEEP, "R": REROLE, "D": DELETE, "": 0}[edit] + (OPEN if edit in ("K", "R") and code & 4 else 0) + DELETE * drops
                    rows.append([part["conv"], part["dated"][i], part["turn"][i], part["role"][i], part["digest"][i], added, edit, role, drops, [], cost])
                    state = to
                if part["last"] is not False:
                    closing = {1: ["user", "assistant"], 2: ["assistant"]}.get(end, [])
                    rows[-1][-2], rows[-1][-1] = closing, rows[-1][-1] + INSERT * len(closing)
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    texts = pa.list_(pa.string())
    arrow = pa.schema([
        ("conv", pa.string()), ("dated", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("inserts", texts), ("edit", pa.string()),
        ("new_role", pa.string()), ("drops", pa.int64()), ("closing", texts), ("cost", pa.int64()),
    ])
    placed = parts.drop("illegal", "head", "tail", "before").join(located(parts), ["conv", "seq"], "left")
    return placed.mapInArrow(run, EDITS)


def repair(rows: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cheapest repair of the conversations in ``rows(conv_id, turn, role, text, ...)``: settled ``records``, ``chunks`` and ``edits``.

    Rows of a conversation are taken by turn, null turns first; rows of one turn by role, then by the MD5 of the text, so copies are neighbours. A null
    role or text is one space, and rows with a null conv_id are a conversation. Blank texts and repeated rows must go; a truncated row
    that stays costs one more; a role that begins with none of s, u, a (an empty one too) cannot stay as it is. A conversation of any length is searched by
    many tasks; copies of a row are one record with a count. Very long texts are only hashed. An empty table gives empty results; other columns are ignored.
    """
    own = settle(records(keyed(rows)))
    parts = settle(chunks(own, size))
    return own, parts, settle(edits(parts))


def repaired_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``conv, dated, turn, role, digest, part, new_role, text``: the rows that the repair leaves, in the order of all columns up to ``part``."""
    done = repair(rows, size)[2]
    lines = F.concat(
        F.transform("inserts", lambda r: F.struct(r.alias("new_role"), F.lit(False).alias("own"))),
        F.when(F.col("new_role").isNotNull(), F.array(F.struct("new_role", F.lit(True).alias("own")))).otherwise(F.array()),
        F.transform("closing", lambda r: F.struct(r.alias("new_role"), F.lit(False).alias("own"))),
    )
    lines = done.select(*RANK, F.posexplode(lines).alias("part", "_l")).select(*RANK, "part", "_l.new_role", "_l.own")
    texts = keyed(rows).groupBy(*RANK).agg(F.min("text").alias("text"))
    return lines.join(texts, RANK).select(*RANK, "part", "new_role", F.when(F.col("own"), F.col("text")).otherwise("").alias("text"))


# --- report ----------------------------------------------------------------------------------------------------------


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without copies of the rows just before them; what slips through is ignored later."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in RANK], strict=True))
        keep = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its edits and texts, sorted by record, edits first. One row is held at a time."""
    conv, audit, digest, first, open_edit = None, [], None, True, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=names)

    def line(role: str, text: str) -> None:
        nonlocal first
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False

    def close() -> None:
        nonlocal open_edit
        if open_edit is None:
            return
        audit.append("D" * open_edit["drops"] + "I" * len(open_edit["closing"]))
        for role in open_edit["closing"]:
            line(role, "")
        open_edit = None

    for batch in batches:
        done: list[tuple] = []
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        close()
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, first = r["conv"], [], hashlib.sha256(), True
                if r["text"] is None:
                    close()
                    audit.append("I" * len(r["inserts"]) + r["edit"])
                    for role in r["inserts"]:
                        line(role, "")
                    open_edit = r
                elif open_edit and open_edit["new_role"] is not None:
                    line(open_edit["new_role"], r["text"])
                    open_edit["new_role"] = None  # further texts of the record are copies
        yield batch_of(done)
    if conv is not None:
        close()
        yield batch_of([(conv, "".join(audit), digest.hexdigest())])


def written_out(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``. A SHA-256 is one chain of blocks, so one task streams a conversation's rows in order; it holds one batch of them."""
    texts = keyed(rows).where(F.rtrim("text", F.lit(SPACES)) != "").mapInArrow(_once_per_task, f"{RECORD}, text string")
    columns = [*RANK, "inserts", "edit", "new_role", "drops", "closing"]
    both = done.select(*columns).unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv").sortWithinPartitions(*RANK, F.asc_nulls_first("text"))
    return ordered.mapInArrow(_write_out, "conv string, audit string, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per distinct ``conv_id`` of ``ids``: faults and gaps of its ``rows``, cost and audit of its repair, and the SHA-256 of the repaired text.

    See :func:`repair` for ties and nulls. A conversation of ``ids`` without rows has zeros, an empty audit and the hash of the empty text.
    """
    own, parts, done = repair(rows, size)
    kept = F.col("first") & ~F.col("blank")
    turn = F.when(F.col("dated"), F.col("turn"))
    faults = own.groupBy("conv").agg(
        (F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n"))).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int"))).alias("duplicate"), F.sum((kept & F.col("open")).cast("long")).alias("truncated"),
    )
    edge = F.lag("tail").over(Window.partitionBy("conv").orderBy("seq"))
    crossing = (edge.isNotNull() & ~F.concat(edge, F.col("head")).isin(*sorted(LEGAL))).cast("long")
    roles = parts.select("conv", "illegal", crossing.alias("_edge")).groupBy("conv").agg(F.sum(F.col("illegal") + F.col("_edge")).alias("illegal"))
    costs = done.groupBy("conv").agg(F.sum("cost").alias("cost"))
    told = written_out(rows, done)
    every = ids.select("conv_id", conv_key().alias("conv")).distinct()
    joined = every.join(faults, "conv", "left").join(roles, "conv", "left").join(costs, "conv", "left").join(told, "conv", "left")
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


# The same report in DuckDB, for damaged conversations.
def oracle() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep = {s: " ".join(f"WHEN ini = '{r}' THEN {to}" for (state, r), to in NEXT.items() if state == s) for s in range(4)}
    wanted = "CASE s WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE " + " ".join(f"WHEN s = {s} THEN CASE {k} END" for s, k in keep.items()) + " END"

    def least(s: int) -> str:
        stay = " ".join(f"WHEN ini = '{r}' THEN t + v[{to + 1}]" for (state, r), to in NEXT.items() if state == s)
        return f"CASE WHEN forced THEN 3 + v[{s + 1}] ELSE least(3 + v[{s + 1}], CASE {stay} ELSE 9999999999 END, t + 2 + v[{WANTED[s] + 1}]) END AS a{s}"

    return f"""
WITH RECURSIVE {crc32_sql()},
raw AS (SELECT coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_call("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc32_of),
dam AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE k <> 0),
pos AS (SELECT *, row_number() OVER o AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER o AS prev, rtrim(text, {space}) AS body,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM dam
  WINDOW o AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS MATERIALIZED (SELECT conv, i, turn, role, text, ini, body = '' AS blank, body <> '' AND seen > 1 AS dup, body = '' OR seen > 1 AS forced,
  (body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?'))::BIGINT AS t, (prev || ini NOT IN ('su', 'ua', 'au')) AS bad FROM pos),
sums AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
  sum(t)::BIGINT AS truncated, count(*) FILTER (WHERE bad) AS illegal, max(i) AS n FROM f GROUP BY conv),
b AS (SELECT conv, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS v FROM sums
  UNION ALL SELECT conv, i, [least(a0, 2 + c2), least(a1, 2 + c2), c2, least(a3, 2 + a2)] FROM (SELECT *, least(a2, 2 + a3) AS c2 FROM (
    SELECT f.conv, f.i, {least(0)}, {least(1)}, {least(2)}, {least(3)} FROM b JOIN f ON f.conv = b.conv AND f.i = b.i - 1))),
w AS MATERIALIZED (SELECT * FROM b),
g AS (SELECT conv, 1::BIGINT AS i, 0::BIGINT AS s, '' AS audit, []::VARCHAR[] AS lines FROM sums
  UNION ALL SELECT conv, CASE act WHEN 'I' THEN i ELSE i + 1 END, CASE act WHEN 'D' THEN s WHEN 'K' THEN kept ELSE wanted END, audit || act,
    CASE act WHEN 'D' THEN lines ELSE list_append(lines, CASE act WHEN 'K' THEN role WHEN 'R' THEN name ELSE name END || ':' || CASE act WHEN 'I' THEN '' ELSE text END) END
  FROM (SELECT *, CASE WHEN forced OR 3 + nv[s + 1] = hv[s + 1] THEN 'D' WHEN 2 + hv[wanted + 1] = hv[s + 1] THEN 'I' WHEN t + nv[kept + 1] = hv[s + 1] THEN 'K' ELSE 'R' END AS act
    FROM (SELECT g.*, f.role, f.text, f.forced, f.t, {kept} AS kept, {wanted} AS wanted, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END AS name, h.v AS hv, x.v AS nv
      FROM g JOIN w h ON h.conv = g.conv AND h.i = g.i LEFT JOIN f ON f.conv = g.conv AND f.i = g.i LEFT JOIN w x ON x.conv = g.conv AND x.i = g.i + 1
      WHERE f.i IS NOT NULL OR s IN (1, 2)))),
told AS (SELECT g.conv, audit, array_to_string(lines, chr(10)) AS body FROM g JOIN sums USING (conv) WHERE g.i = n + 1 AND s IN (0, 3)),
cost AS (SELECT conv, v[1] AS cost FROM w WHERE i = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM conversations) LEFT JOIN sums USING (conv) LEFT JOIN cost USING (conv) LEFT JOIN told USING (conv)
"""
