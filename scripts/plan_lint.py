"""Lint the physical plans of every registered query.

Usage: python scripts/plan_lint.py [sf_dir] [name-substring ...]
Flags plan nodes that do not scale (cartesian products, nested-loop joins,
Python UDF evaluation), notes sort-based aggregation, and prints per query the
number of shuffles (Exchange) and scans so a change in plan shape is visible.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FLAGS = {
    "CartesianProduct": "cross join",
    "BroadcastNestedLoopJoin": "nested-loop join",
    "BatchEvalPython": "row-at-a-time Python UDF",
    "ArrowEvalPython": "pandas UDF",
}
# informational: spill-safe but slower than a hash aggregate (max_by/min over a struct order)
INFO = {"SortAggregate": "sort-based aggregate"}


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    pats = [a for a in args if not a.startswith("/")]
    from vitrine.plans import catalog
    from vitrine.session import build_session
    spark = build_session("local[4]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in catalog.REGISTRY:
        if pats and not any(p in name for p in pats):
            continue
        plan = catalog.run(spark, sf_dir, name)._jdf.queryExecution().executedPlan().toString()
        found = sorted({v for k, v in FLAGS.items() if re.search(rf"\b{k}\b", plan)})
        info = sorted({v for k, v in INFO.items() if re.search(rf"\b{k}\b", plan)})
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
        scans = len(re.findall(r"FileScan parquet|Scan parquet", plan))
        bad += bool(found)
        note = ("FLAG: " + ", ".join(found) if found else "") + ("  info: " + ", ".join(info) if info else "")
        print(f"{name:40s} shuffles={shuffles:3d} scans={scans:3d} {note}")
    print(f"flagged: {bad}")


if __name__ == "__main__":
    main()
