"""CLI: run every registered query and summarise its final (AQE) physical
plan: shuffles, broadcasts, sort-merge joins, windows, Python operators,
scans with pushed filters. Writes a markdown table to stdout.

    python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from plan_text import final_plan  # noqa: E402
from vitrina.session import get_session  # noqa: E402


def count(pattern, text):
    return len(re.findall(pattern, text))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(shuffle_partitions=16)
    print("| query | s | shuffles | broadcasts | SMJ | windows | python ops | scans (pushed filters) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, build in E.queries().items():
        t0 = time.perf_counter()
        plan = final_plan(build(spark, sf))
        dt = time.perf_counter() - t0
        shuffles = count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
                         r"Exchange RoundRobin", plan)
        reused = count(r"ReusedExchange", plan)
        bcast = count(r"BroadcastExchange", plan)
        smj = count(r"SortMergeJoin", plan)
        win = count(r"\bWindow ", plan)
        py = count(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|PythonMapInArrow", plan)
        scans = count(r"FileScan parquet", plan)
        pushed = count(r"PushedFilters: \[[^\]]+\]", plan)
        single = " (single)" if "SinglePartition" in plan else ""
        print(f"| {name} | {dt:.1f} | {shuffles}{' +%d reused' % reused if reused else ''}{single} | {bcast} | "
              f"{smj} | {win} | {py} | {scans} ({pushed}) |")


if __name__ == "__main__":
    main()
