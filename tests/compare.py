"""Compare a Spark result with DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float" if isinstance(v, float) else "decimal"
    return type(v).__name__


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple(str(x) for x in r))
    return [columns[i] for i in order], out


def differences(df, con, sql: str):
    """Return (problem or None, number of rows)."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    a_cols, a = rows_of(df.columns, got)
    b_cols, b = rows_of(names, want)
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}", len(got)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}: {a[:2]} vs {b[:2]}", len(got)
    for i, name in enumerate(df.columns):
        ours = {kind(r[i]) for r in got} - {"null"}
        j = names.index(name)
        theirs = {kind(r[j]) for r in want} - {"null"}
        if ours != theirs:
            return f"type of {name}: {ours} vs {theirs}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]} ({a_cols})", len(got)
    return None, len(got)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from statewise.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = differences(df, con, oracles[name])
            else:
                problem, n = None, len(df.collect())
                name += " (rows only)"
            if n == 0 and problem is None:
                problem = "no rows"
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
