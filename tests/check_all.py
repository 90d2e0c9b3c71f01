"""CLI: compare registered queries with their DuckDB oracles.

python tests/check_all.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck_connection  # noqa: E402

from pitloom.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = local_session(8, 8)
    from pitloom.plans.catalog import ORACLE, QUERIES

    con = duck_connection(sf_dir)
    bad = 0
    for name in QUERIES:
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        if name not in ORACLE:
            try:
                n = QUERIES[name](spark, sf_dir).count()
                print(f"ROWS-ONLY {name}: {n} rows ({time.time() - t:.1f}s)")
            except Exception:
                bad += 1
                print(f"ERROR {name}\n{traceback.format_exc()}")
            continue
        try:
            r = compare(spark, name, sf_dir, con)
        except Exception:
            bad += 1
            print(f"ERROR {name}\n{traceback.format_exc()}")
            continue
        ok = r["rows_match"] and r["schema_match"] and r["hash_match"]
        bad += not ok
        print(
            f"{'OK ' if ok else 'BAD'} {name}: rows={r['rows']} schema={r['schema_match']} "
            f"hash={r['hash_match']} ({time.time() - t:.1f}s)"
        )
        if r["dtype_diff"]:
            print("  dtype differences (spark, oracle):", r["dtype_diff"])
        if not ok:
            s, o = r["spark"], r["oracle"]
            print("  spark cols:", list(s.columns), s.dtypes.tolist())
            print("  oracle cols:", list(o.columns), o.dtypes.tolist())
            print(s.sort_values(list(s.columns)).head(5).to_string())
            print(o.sort_values(list(o.columns)).head(5).to_string())
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
