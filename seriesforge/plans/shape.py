"""Shape of an executed plan: scans per table, shuffles, reused exchanges, joins, pushed filters.

Reads the final adaptive plan (``executedPlan`` after the query ran), so it reflects AQE's runtime
decisions. Used by the plan tests and ``tools/plan_report.py``.
"""

from __future__ import annotations

import collections
import re

from pyspark.sql import DataFrame


def final_part(plan: str) -> str:
    """Drop every '== Initial Plan ==' block (main plan and subqueries), keep the final ones."""
    out, skip_col = [], None
    for line in plan.splitlines():
        m = re.search(r"[A-Za-z=*(]", line)
        col = m.start() if m else 0
        if skip_col is not None:
            if col >= skip_col:
                continue
            skip_col = None
        if "== Initial Plan ==" in line:
            skip_col = col
            continue
        out.append(line)
    return "\n".join(out)


def summarise(plan: str) -> dict:
    scans = collections.Counter()
    for path in re.findall(r"FileScan \w+ .*?Location: \w+\([^)]*\)\[([^\],]*)", plan):
        name = path.rstrip("/").split("/")[-1]
        scans[name[:-8] if name.endswith(".parquet") else "written:" + re.sub(r"-\d{14}-\w+$", "", name)] += 1
    if "Scan ExistingRDD" in plan or "ExistingRDD" in plan:
        scans["checkpoint"] += plan.count("ExistingRDD")
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
                     if p and any(w in p for w in ("LessThan", "GreaterThan", "EqualTo", "In("))})
    joins = collections.Counter()
    for line in plan.splitlines():
        m = re.search(r"(SortMergeJoin(?:\(skew=true\))?|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", line)
        if m:
            kind = re.search(r"\b(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti|Cross)\b", line)
            joins[f"{m.group(1)} {kind.group(1) if kind else ''}".strip()] += 1
    return {
        "scans": dict(scans),
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|\bExchange RoundRobinPartitioning", plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": dict(joins),
        "pushed": pushed,
    }



def executed_shape(df: DataFrame) -> dict:
    """Run ``df`` (collect) and summarise its final plan."""
    df.collect()
    return summarise(final_part(df._jdf.queryExecution().executedPlan().toString()))
