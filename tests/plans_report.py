"""Write PLANS.md: the physical plan tree of headline queries (sf0.1), with their scans.

python tests/plans_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitloom.session import local_session  # noqa: E402

QUERIES = [
    ("s2_bounded_feature_read", "Bounded read: the cutoff reaches the Parquet scan, only four columns are read."),
    ("j1_asof_tolerance", "As-of join: both sides folded to one row per (key, instant); windows over (key, slice) and over slice summaries; the labels join the instants last."),
    ("j4_reconcile_counts", "Reconciliation: both sides stacked, one grouped shuffle, no join."),
    ("s13_upsert_predictions", "Upsert scoped to the staged batches: semi/anti joins on the batch column, one full-outer join on the id."),
    ("a15_snapshot_digest", "Digest: map-side hashing, partial sums, one final aggregate (on top of the spine)."),
    ("w2_stratified_split", "Stratified split over its written spine: per-(class, 16-bit bucket) counts, a window over the rows of the cut's buckets only, a union with the rest."),
    ("a8_js_distance", "Jensen-Shannon: broadcast of one min/max row per feature, then aggregates."),
    ("p10_data_decision", "Data decision: one aggregate per population, one grouped pass per uniqueness rule, one spine."),
]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16, app="pitloom-plans")
    from pitloom.plans.catalog import QUERIES as Q

    out = ["# Physical plans of headline queries", "",
           f"Generated by `tests/plans_report.py` on `{sf_dir}`, `local[8]`, 16 shuffle partitions, AQE on",
           "(the plans are the ones planned before execution; AQE may still coalesce partitions or",
           "switch a join to broadcast at run time). Fixture subtrees (the `fx_*` aggregates over",
           "lineitem and orders) appear below the operators.", ""]
    for name, note in QUERIES:
        buf = io.StringIO()
        with redirect_stdout(buf):
            Q[name](spark, sf_dir).explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        tree = re.sub(r"#\d+", "", tree)
        exchanges = len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange \(", tree))
        scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]*\n){0,6}?PushedFilters: ([^\n]*)\n(?:[^\n]*\n){0,2}?ReadSchema: ([^\n]*)", text)
        out += [f"## {name}", "", note, "", f"Shuffle exchanges in the plan, fixture subtrees included: {exchanges}.", "", "```", tree.strip(), "```", ""]
        if scans:
            out += ["| Pushed filters | Read schema |", "| --- | --- |"]
            out += [f"| `{f}` | `{r}` |" for f, r in scans]
            out.append("")
    print("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
