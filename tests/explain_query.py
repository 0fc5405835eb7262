"""CLI: print the formatted physical plan of registered queries.

    python tests/explain_query.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from vitrina.session import get_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.1"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = get_session(shuffle_partitions=16)
    qs = E.queries()
    for name in args:
        df = qs[name](spark, sf)
        df.collect()  # run on this frame's own plan, so AQE's final plan can be shown
        print(f"===== {name}")
        print(df._jdf.queryExecution().executedPlan().toString())


if __name__ == "__main__":
    main()
