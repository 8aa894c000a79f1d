"""Run registered queries beside their oracle text and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

from latticework.plans import QUERIES, ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    if hasattr(value, "is_integer") or isinstance(value, int):
        return float(value)
    return str(value)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    took = time.time() - started
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(row[c]) for c in cols) for row in rows)
    if name not in ORACLES:
        return True, f"{name}: rows {len(rows)} (no oracle) {took:.1f}s"
    started = time.time()
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    o_took = time.time() - started
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(_norm(row[i]) for i in order) for row in want_rows)
    if got == want:
        return True, f"{name}: ok {len(rows)} rows {took:.1f}s (oracle {o_took:.1f}s)"
    extra, missing = got - want, want - got
    return False, (
        f"{name}: spark {len(rows)} oracle {len(want_rows)}; "
        f"only spark {sum(extra.values())} {sorted(extra, key=str)[:3]}; "
        f"only oracle {sum(missing.values())} {sorted(missing, key=str)[:3]}; cols {cols} {took:.1f}s"
    )


def main(argv: list[str]) -> int:
    from latticework.session import local_session

    folder = argv[0]
    wanted = argv[1:] or list(QUERIES)
    spark = local_session("8")
    bad = 0
    for name in wanted:
        con = oracle_connection(folder)
        try:
            ok, text = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print(("  " if ok else "X ") + text, flush=True)
    print(f"{len(wanted)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
