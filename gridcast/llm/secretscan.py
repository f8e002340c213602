"""Secret scan over a trigram inverted index."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import text_of
from gridcast.session import settle

# Kind, pattern, the group whose length counts, its least length. The first three are the base rules, in their order.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
BASE = ("assign", "access", "hex")
_MOST = 64


def _strings(nodes) -> set[str] | None:
    """All strings that a piece of a pattern matches, lower case, if they are few."""
    out = {""}
    for op, arg in nodes:
        if op is C.LITERAL:
            each = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            each = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            each = _strings(arg[3])
        elif op is C.BRANCH:
            each = set()
            for branch in arg[1]:
                some = _strings(branch)
                each = None if some is None or each is None else each | some
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            each = _strings(arg[2])
            each = each if each is None or arg[0] else each | {""}
        elif op is C.AT:
            each = {""}
        else:
            each = None
        if each is None or len(out) * len(each) > _MOST:
            return None
        out = {a + b for a in out for b in each}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What a text must hold to match: an AND of clauses, each an OR of sets of trigrams; empty if nothing is mandatory.

    The pattern is read left to right; pieces with few strings are multiplied out, and each run of them between other pieces
    gives one clause. Of alternatives that include another's trigrams only the smaller stays.
    """
    runs, run = [], {""}

    def visit(nodes) -> None:
        nonlocal run
        for node in nodes:
            few = _strings([node])
            if few is not None and len(run) * len(few) <= _MOST:
                run = {a + b for a in run for b in few}
                continue
            op, arg = node
            if op is C.SUBPATTERN:  # what it begins with follows on the run
                visit(arg[3])
                continue
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:  # and so does the first of its repeats
                visit(arg[2])
            runs.append(run)
            run = {""}

    visit(_parser.parse(pattern))
    runs.append(run)
    clauses = []
    for strings in runs:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """``key, trigram``: the inverted index of the trigrams that some rule asks for, over all rows and whole lower-case texts."""
    wanted = sorted({t for _, p, _, _ in rules for clause in trigram_query(p) for s in clause for t in s})
    low = docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("key"), F.lower(text_of()).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``key, kinds``: the rules whose trigram query a row's postings satisfy. At most one entry per asked trigram meets in a group."""
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("_t"))
    kinds = []
    for kind, pattern, _, _ in rules:
        clauses = trigram_query(pattern)
        if clauses:
            good = F.lit(True)
            for clause in clauses:
                some = F.lit(False)
                for s in clause:
                    every = F.lit(True)
                    for t in sorted(s):
                        every = every & F.array_contains("_t", t)
                    some = some | every
                good = good & some
            kinds.append(F.when(good, F.lit(kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _matches(rows: DataFrame, rule, order: int) -> DataFrame:
    """``key, kind, order, at`` and the lengths of what lies before, the match and the counted group, in code points."""
    kind, pattern, group, _ = rule
    lengths = lambda found: F.transform(found, lambda m: F.length(m).cast("long"))
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(lengths(F.split("text", pattern, -1)).alias("gap"), lengths(whole).alias("whole"), lengths(value).alias("value"))
    return rows.where(F.col("text").rlike(pattern)).select(
        "key", F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.posexplode(parts).alias("at", "m")
    ).select("key", "kind", "order", "at", F.col("m.gap").alias("gap"), F.col("m.whole").alias("whole"), F.col("m.value").alias("value"))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, n_<base kind> ..., secrets`` of every row of ``docs(doc_id, text, ...)``.

    ``secrets`` lists ``start, order, kind, end`` in code points, end exclusive: per rule the leftmost non-overlapping matches, of which
    those with too short a value are dropped. Rules with mandatory trigrams are verified on the rows that the index yields; the
    others scan every text.

    A null text is empty and has none. Rows with equal doc_id (or both null) and text are found once and reported each. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("key"), text_of().alias("text"))
    found = candidates(postings(docs, rules), rules)
    checked = rows.join(found, "key")
    matches = None
    for order, rule in enumerate(rules):
        kind, pattern = rule[:2]
        own = _matches(checked.where(F.array_contains("kinds", kind)) if trigram_query(pattern) else rows, rule, order)
        matches = own if matches is None else matches.union(own)
    # Equal rows, and rows that several rules yield, are found more than once.
    matches = settle(matches.dropDuplicates(["key", "order", "at"]))
    along = Window.partitionBy("key", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("gap").over(along) + F.sum(F.coalesce("whole", F.lit(0))).over(along) - F.coalesce("whole", F.lit(0))
    least = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r[3]))])
    spans = matches.withColumn("start", start).where(F.col("whole").isNotNull() & (F.col("value") >= least[F.col("order")]))
    spans = spans.select("key", F.struct("start", "order", "kind", (F.col("start") + F.col("whole")).alias("end")).alias("s"))
    lists = spans.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    # Keys go through a struct so that the join shuffles both sides.
    own = docs.select("doc_id", F.struct(F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("key")).alias("_k"))
    joined = own.join(lists.select(F.struct("key").alias("_k"), "secrets"), "_k", "left")
    secrets = F.coalesce("secrets", F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>"))
    out = joined.select("doc_id", secrets.alias("secrets"))
    def of_kind(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[of_kind(k) for k in BASE], "secrets")


def span_list(secrets):
    """``kind:start:end`` of each, comma-joined in their order."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle(rules=RULES) -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS s,
  length(whole[i]) AS n FROM (SELECT doc_id, whole, vals, gaps, unnest(range(1, len(whole) + 1)) AS i FROM
  (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d)) WHERE length(vals[i]) >= {least}""")
    base = "', '".join(BASE)
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(parts) + f"""),
f AS (SELECT doc_id, ord, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS one FROM m),
g AS (SELECT doc_id, sum((kind = 'assign')::INT)::BIGINT AS a, sum((kind = 'access')::INT)::BIGINT AS b, sum((kind = 'hex')::INT)::BIGINT AS c,
  string_agg(one, ',' ORDER BY s, ord) FILTER (kind IN ('{base}')) AS base, string_agg(one, ',' ORDER BY s, ord) AS every FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
