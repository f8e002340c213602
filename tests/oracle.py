"""Run queries and their SQL side by side: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
    "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(set(df.columns) ^ set(cols))}"
    kinds = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {k[0]: k[1] for k in kinds}
    bad = {c: (t, theirs[c]) for c, t in df.dtypes if SAME.get(t) != theirs[c]}
    if bad:
        return f"types {bad}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}"
    if not a:
        return "empty on both sides"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from gridcast import get_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf, argv = argv[0], argv[1:]
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad, slow = oracle_sql(), 0, []
    for name, q in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, q, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001 - a report line per query
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - t
        slow.append((took, name))
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {name}{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(slow)} queries, {bad} differ, slowest {sorted(slow)[-5:]}, total {sum(s[0] for s in slow):.0f}s")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
