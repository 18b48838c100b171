"""Write PLANS.md: the physical plans of the headline queries.

Usage: python tools/explain_plans.py [sf_dir]

Materialises the star schema of ``sf_dir`` below the shared checkpoint folder
(facts range-clustered by date, snapshots partitioned by report date), then
records for each query the operator tree of ``explain("formatted")`` and the
scan lines that show pushdown and pruning.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.operators import gauges as G  # noqa: E402
from ledgerlens.operators import snapshots as SN  # noqa: E402
from ledgerlens.operators import utilization as U  # noqa: E402
from ledgerlens.plans import all_firms as AF  # noqa: E402
from ledgerlens.plans import report as R  # noqa: E402
from ledgerlens.plans import rollup as RU  # noqa: E402
from ledgerlens.session import local_session, shared_path  # noqa: E402
from ledgerlens.sources.star import from_test_tables  # noqa: E402

AS_OF = "2000-06-16"
KEEP = ("PushedFilters", "PartitionFilters", "ReadSchema")


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def condense(text: str) -> str:
    lines = text.splitlines()
    tree, details = [], []
    in_tree = True
    for line in lines:
        if in_tree and line.startswith("(") and ")" in line:
            in_tree = False
        if in_tree:
            if line.strip() and not line.startswith("=="):
                tree.append(line)
        elif line.startswith(("(", "Subquery:")) and ("Scan" in line or "Subquery:" in line):
            details.append(line)
        elif line.startswith(KEEP):
            details.append("  " + (line if len(line) < 240 else line[:237] + "..."))
        elif line.startswith("===== Subqueries"):
            details.append(line)
    return "\n".join(tree + [""] + details)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    star = from_test_tables(spark, sf_dir).materialize(
        shared_path(spark, f"plans-{uuid.uuid4().hex[:8]}"))
    rollup = RU.with_time_rollup(star)
    queries = {
        "time_gauges (span-pruned by the date profile)": G.time_gauges(star, AS_OF, "NATION_3"),
        "time_gauges, prune=False": G.time_gauges(star, AS_OF, prune=False),
        "service_lines": G.service_lines(star, AS_OF),
        "service_lines, prune=True (key columns of the history in the same aggregate)":
            G.service_lines(star, AS_OF, prune=True),
        "utilization": U.utilization(star, AS_OF),
        "ar_aging": SN.ar_aging(star, AS_OF),
        "ar_risk": SN.ar_risk(star, AS_OF),
        "perf_table": R.perf_table(R.scorecard_measures(star, AS_OF)),
        "perf_table_all_firms": AF.perf_table(star, AS_OF),
        "ar_risk_all_firms": AF.ar_risk(star, AS_OF),
        "time_gauges over the daily rollup": G.time_gauges(rollup, AS_OF),
        "time_gauges_series (many as-of dates)": RU.time_gauges_series(
            rollup, ["2000-06-16", "2000-12-31", "2001-03-01"]),
    }
    out = ["# PLANS", "",
           f"Physical plans (`explain(\"formatted\")`, condensed) of the headline queries over the "
           f"star schema materialised from `{sf_dir}`. Generated by `tools/explain_plans.py`.", ""]
    for title, df in queries.items():
        out += [f"## {title}", "", "```", condense(formatted(df)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main(sys.argv)
