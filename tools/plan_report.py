"""Write docs/PLANS.md: the plans that every registered solar query really ran.

usage: python tools/plan_report.py [sf_dir]

Each query is executed in full with Spark's event log on. The report reads
the final (adaptive) plan of every SQL execution the query started, those
that ran while its frame was being built included: size checks, sorted
tables, written layouts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pvtide.plans.queries import QUERIES  # noqa: E402
from pvtide.session import build_session  # noqa: E402

KINDS = {
    "shuffles": re.compile(r"^Exchange$"), "broadcasts": re.compile(r"^BroadcastExchange$"),
    "joins": re.compile(r"Join$|^CartesianProduct$"), "aggregates": re.compile(r"Aggregate$"),
    "sorts": re.compile(r"^Sort$|^TakeOrderedAndProject$"), "windows": re.compile(r"^Window$"),
    "python": re.compile(r"Python|Pandas|Arrow"), "scans": re.compile(r"^Scan parquet|^Scan csv"),
    "writes": re.compile(r"^Execute InsertIntoHadoopFs|^WriteFiles$"),
}


def nodes(plan: dict) -> list[tuple[str, str]]:
    own = [(plan["nodeName"].strip(), plan["simpleString"])]
    return own + [x for child in plan["children"] for x in nodes(child)]


def executions(log_dir: str) -> list[tuple[float, list]]:
    """``(start time, nodes of the final plan)`` of every SQL execution."""
    plans, began = {}, {}
    for path in Path(log_dir).rglob("*"):
        if not path.is_file():
            continue
        for line in path.open(errors="replace"):
            if "sparkPlanInfo" not in line:
                continue
            event = json.loads(line)
            plans[event["executionId"]] = nodes(event["sparkPlanInfo"])  # the last one is the one that ran
            began.setdefault(event["executionId"], event.get("time", 0))
    return [(began[k] / 1000, plan) for k, plan in plans.items() if began[k]]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                                 "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    spans = {}
    for name, query in QUERIES.items():
        t0 = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spans[name] = (t0, time.time())
    spark.stop()
    ran = executions(log_dir)
    out = ["# Plans of the registered queries", "",
           f"Generated by `tools/plan_report.py` on `{sf_dir}` from the event log: final plans of all SQL executions "
           "of each query, those that run while its frame is built included (counts are sums over them).", "",
           "| query | executions | shuffles | broadcasts | joins | aggregates | sorts, windows | scans | Python |",
           "| --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    filters = ["", "## Scans", "", "Pushed filters and columns read by each scan.", ""]
    for name, (start, end) in spans.items():
        own = [plan for at, plan in ran if start <= at <= end]
        found = {kind: Counter(n for plan in own for n, _ in plan if pattern.search(n)) for kind, pattern in KINDS.items()}
        names = lambda kind: ", ".join(f"{n} {c}" for n, c in sorted(found[kind].items())) or "-"
        total = lambda *kinds: sum(sum(found[k].values()) for k in kinds)
        out.append(f"| {name} | {len(own)} | {total('shuffles')} | {total('broadcasts')} | {names('joins')} | "
                   f"{names('aggregates')} | {total('sorts')}, {total('windows')} | {total('scans')} | "
                   f"{'yes' if total('python') else 'no'} |")
        scans = {re.sub(r"^.*?PartitionFilters", "PartitionFilters", text) for plan in own for n, text in plan
                 if KINDS["scans"].search(n)}
        filters += [f"* {name}: " + "; ".join(f"`{s}`" for s in sorted(scans))]
    path = Path(__file__).resolve().parent.parent / "docs" / "PLANS.md"
    path.write_text("\n".join(out + filters) + "\n")
    print(path)


if __name__ == "__main__":
    main()
