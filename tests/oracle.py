"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e-12 else repr(round(v, 6) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, name: str, query, sql: str | None, con) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, {took:.1f}s, no SQL {got[0] if got else ''}"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {df.columns} != {names}"
    a, b = normal(df.columns, got), normal(names, want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows, {took:.1f}s (duckdb {duck_took:.1f}s)"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{len(a)} vs {len(b)} rows; first differences {diff}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from traitweave.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        try:
            ok, note = compare(spark, sf, name, queries[name], sqls.get(name), con)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note[:1200], flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
