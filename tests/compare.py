"""Run a registered query and its SQL oracle on the same tables and compare values."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)) or type(value).__name__ == "Row":
        return tuple(_plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _kind(value) -> str:
    return type(value).__name__


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir: str, run, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want_cols, want = rows(names, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            bad = sum(1 for x, y in zip(got, want) if x != y)
            return f"{bad} of {len(got)} rows differ, first {a!r:.300} != {b!r:.300}"
    return None


def main(argv: list[str]) -> int:
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from motionlake import catalog
    from motionlake.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failures = 0
    for name, entry in catalog.entries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            if entry.sql:
                problem = compare(spark, sf_dir, entry.run, entry.sql)
                n = ""
            else:
                problem, n = None, f" rows-only {entry.run(spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the next query
            text = str(exc)
            problem = "ERROR " + text[:600]
            n = ""
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{n} {problem or ''}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    import sys

    raise SystemExit(min(1, main(sys.argv[1:])))
