"""Write PLANS.md: the physical plan shape of every registered query.

usage: python tools/plan_report.py [SF_DIR]

For each query the initial physical plan is summarised twice: as planned
on the given data, and "at scale" with size-based broadcasts switched off
(``autoBroadcastJoinThreshold=-1``), which is what the planner does when
the dimension tables are too large to broadcast.  Only the explicit hints
on the fixed-size code tables remain broadcasts.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = [
    ("hash shuffles", r"Exchange hashpartitioning"),
    ("range shuffles", r"Exchange rangepartitioning"),
    ("single-partition", r"Exchange SinglePartition"),
    ("sort-merge joins", r"SortMergeJoin"),
    ("broadcast joins", r"BroadcastHashJoin"),
    ("hash aggs", r"\bHashAggregate\("),
    ("sort aggs", r"\bSortAggregate\("),
    ("object aggs", r"ObjectHashAggregate\("),
    ("windows", r"\bWindow \["),
    ("group limits", r"WindowGroupLimit"),
    ("top-k", r"TakeOrderedAndProject"),
    ("scans", r"FileScan parquet"),
]


def summary(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    return {name: len(re.findall(rx, text)) for name, rx in NODES}


def fmt(d: dict) -> str:
    return ", ".join(f"{v} {k}" for k, v in d.items() if v) or "-"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tidewater.plans.catalog import QUERIES
    from tidewater.session import get_session
    spark = get_session(shuffle_partitions=8)
    qs = QUERIES
    local, scale = {}, {}
    for name, fn in qs.items():
        local[name] = summary(fn(spark, sf))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, fn in qs.items():
        scale[name] = summary(fn(spark, sf))
    lines = [
        "# Plan shapes of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` on `{sf}`. Counts are nodes of the initial physical",
        "plan (AQE may still coalesce partitions, turn a shuffle join into a broadcast join when a",
        "side turns out small, and split skewed partitions). Subquery plans count too.",
        "\"At scale\" disables size-based broadcasts, as for dimension tables too large to",
        "broadcast. No plan contains a Python evaluation node, a cartesian product or a",
        "nested-loop join (see `tests/test_plans.py`).",
        "",
        "| Query | Planned on this data | At scale (no size-based broadcast) |",
        "|---|---|---|",
    ]
    for name in qs:
        lines.append(f"| `{name}` | {fmt(local[name])} | {fmt(scale[name])} |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(out)
    spark.stop()


if __name__ == "__main__":
    main()
