"""CLI: compare every registered query with its DuckDB SQL.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from vitrina.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        if name not in sqls:
            try:
                n = build(spark, sf_dir).count()
                print(f"ROWS {name}: {n} rows ({time.time()-t0:.1f}s)")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"FAIL {name}: {type(e).__name__}: {str(e)[:400]}")
            continue
        try:
            r = compare(spark, con, name, build, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:600]}")
            continue
        status = "OK  " if r["ok"] else "DIFF"
        bad += not r["ok"]
        print(f"{status} {name}: spark={r['spark_rows']} duck={r['duck_rows']} "
              f"({time.time()-t0:.1f}s) {r.get('why', '')[:600]}")
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
