"""Run registered queries next to their SQL twins and report differences.

    python -m ocuspark.plans.compare /root/testdata/sf0.01 [name or prefix* ...]
"""

from __future__ import annotations

import math
import sys
import time
from fnmatch import fnmatch

from ocuspark.plans.catalog import CHECKS, QUERIES
from ocuspark.session import local_session
from ocuspark.sources.adapters import BASE


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(_cell(x) for x in v.values())
    return v


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    import duckdb

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if name not in CHECKS:
        return len(rows) > 0, f"rows only: {len(rows)} rows {took:.1f}s"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{sf_dir}/{b}.parquet'")
    start = time.time()
    cur = con.execute(CHECKS[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    check_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = _sorted_rows(rows, df.columns), _sorted_rows(want, columns)
    if len(a) != len(b):
        return False, f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    detail = f"{len(a)} rows {took:.1f}s (check {check_took:.1f}s)"
    if bad:
        detail += f" {len(bad)} differ, columns {sorted(columns)}; first {bad[:2]}"
    return not bad, detail


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    failed = []
    wanted = [q for q in QUERIES if not names or any(fnmatch(q, n) for n in names)]
    for name in wanted:
        try:
            ok, detail = compare(spark, sf_dir, name)
        except Exception as exc:  # report and go on to the next query
            ok, detail = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print("ok  " if ok else "FAIL", name, detail, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
