"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (the whole plan executes,
nothing is collected). The JVM is warmed first by running the headline queries on the
sf0.001 tables; each headline query is then timed on its best of ``BENCH_REPEAT`` runs
(default 1). Spark's event log goes to a fresh
scratch folder; shuffle bytes written and input bytes read per query are summed
from it after the session stops (no UI, no server).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "j1_asof_backward",
    "j1_asof_tolerance",
    "j3_point_in_time_delay",
    "p10_data_decision",
    "j4_reconcile_counts",
    "s13_upsert_predictions",
    "f2_prediction_id",
    "a15_snapshot_digest",
    "w2_stratified_split",
    "a5_macro_f1",
    "a6_log_loss",
    "a8_js_distance",
    "a9_chi_squared",
    "a12_gate_outcome",
    "t3_dedupe_events",
    "m1_train_metrics",
    "l1_lifecycle",
]


def _lines(path: str):
    """Lines of one (rolling, possibly zstd-compressed) event log file."""
    import io

    with open(path, "rb") as raw:
        if path.endswith(".zstd"):
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            yield from io.TextIOWrapper(raw, encoding="utf-8")


def _io_per_group(log_dir: str) -> tuple[dict[str, int], dict[str, int]]:
    """Shuffle bytes written and input bytes read, per job group, from the event log."""
    stage_group: dict[int, str] = {}
    shuffle: dict[str, int] = defaultdict(int)
    read: dict[str, int] = defaultdict(int)
    for path in sorted(glob.glob(f"{log_dir}/**/events_*", recursive=True)):
        for line in _lines(path):
            if not line.strip():
                continue
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                if group:
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
            elif kind == "SparkListenerTaskEnd":
                group = stage_group.get(ev.get("Stage ID"))
                metrics = ev.get("Task Metrics") or {}
                if group:
                    shuffle[group] += (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    read[group] += (metrics.get("Input Metrics") or {}).get("Bytes Read", 0)
    return dict(shuffle), dict(read)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    log_dir = tempfile.mkdtemp(prefix="pitloom-eventlog-")

    from pitloom.session import local_session

    spark = local_session(
        cpus,
        int(os.environ.get("BENCH_PARTITIONS", str(max(8, int(cpus) * 2)))),
        app="pitloom-bench",
        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}"},
    )
    from pitloom.plans.catalog import QUERIES

    sc = spark.sparkContext
    # Warm-up: compile and JIT the code paths on the tiny tables (another folder, so no
    # result or file cache carries over); the training-heavy queries are left out.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in only or HEADLINE:
        if name not in ("m1_train_metrics", "l1_lifecycle") and os.path.isdir(warm_dir):
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in only or HEADLINE:
        best = None
        for _ in range(repeat):
            sc.setJobGroup(name, name)
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    spark.stop()
    shuffle, read = _io_per_group(log_dir)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
                "repeat": repeat,
                "shuffle_write_bytes": {q: int(shuffle.get(q, 0) / repeat) for q in times},
                "input_read_bytes": {q: int(read.get(q, 0) / repeat) for q in times},
            }
        )
    )


if __name__ == "__main__":
    main()
