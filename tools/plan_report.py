"""Write PLANS.md: physical-plan facts of the headline queries.

For each query: shuffles (Exchange), join strategies, window group limits,
Python stages, and for every Parquet scan its pushed filters and read schema.
Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def facts(plan: str) -> dict:
    ops = re.findall(r"^\(\d+\) (\w+)", plan, re.M)
    count = lambda name: sum(1 for o in ops if o == name)
    scans = []
    for block in re.split(r"\n(?=\(\d+\) )", plan):
        if block.startswith("(") and " Scan parquet" in block.splitlines()[0]:
            loc = re.search(r"Location: \w+ \[(.*?)\]", block)
            pf = re.search(r"PushedFilters: \[(.*?)\]\n", block)
            rs = re.search(r"ReadSchema: (struct<.*?>)", block)
            name = os.path.basename(loc.group(1)) if loc else "?"
            if not name.endswith(".parquet"):
                name = f"written table {name[:8]}"
            scans.append((name, pf.group(1) if pf else "", rs.group(1) if rs else ""))
    return {
        "exchanges": count("Exchange"),
        "broadcast_joins": count("BroadcastHashJoin"),
        "sort_merge_joins": count("SortMergeJoin"),
        "shuffled_hash_joins": count("ShuffledHashJoin"),
        "window_group_limits": count("WindowGroupLimit"),
        "python_stages": sum(1 for o in ops if "InPandas" in o or o.startswith("ArrowEvalPython")),
        "checkpoint_reads": plan.count("Scan ExistingRDD"),
        "scans": scans,
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from recoflow.plans.registry import QUERIES, load_all
    from recoflow.session import get_spark
    load_all()
    spark = get_spark()
    out = ["# PLANS", "", f"Generated by `python tools/plan_report.py {sf}`: physical-plan facts of the",
           "headline queries (`explain('formatted')`, before AQE re-planning). A \"written table\" is",
           "one the query materialized under spark.checkpoint.dir and reads several times.", ""]
    for key in HEADLINE:
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[key](spark, sf).explain("formatted")
        f = facts(buf.getvalue())
        out.append(f"## {key}")
        out.append("")
        out.append(f"exchanges {f['exchanges']}, broadcast joins {f['broadcast_joins']}, sort-merge joins "
                   f"{f['sort_merge_joins']}, window group limits {f['window_group_limits']}, python stages "
                   f"{f['python_stages']}, checkpoint reads {f['checkpoint_reads']}")
        out.append("")
        if f["scans"]:
            out.append("| scan | pushed filters | read schema |")
            out.append("|---|---|---|")
            for name, pf, rs in f["scans"]:
                out.append(f"| {name} | {pf.replace('|', '/') or '-'} | `{rs}` |")
            out.append("")
    open(os.path.join(ROOT, "PLANS.md"), "w").write("\n".join(out) + "\n")
    print("PLANS.md written")


if __name__ == "__main__":
    main()
