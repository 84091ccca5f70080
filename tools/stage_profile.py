"""Per-stage task statistics from Spark's event log (no UI, no server).

``profile(phases)`` starts a local session with the event log written to a new
scratch folder, runs each phase under its own job group, stops the session and
reads the log back: for every stage, the number of tasks, the shuffle records
read in total and by the busiest task, and task times.  Used to check that a
hot key does not end up in one task.

``python tools/stage_profile.py`` runs the skew check below and prints JSON:
the order-lines relation with one route, one user and one day forced to hold
a third of all rows, then the route, user and bucket measure tables, the
distributed median, the first-seen table, the source/destination report, and
-- as a control -- a per-route window, which must put that third into a
single task.
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
from collections import defaultdict
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from routeboard.plans.catalog import PAGE  # noqa: E402
from routeboard.plans.session import local_session  # noqa: E402


def profile(phases, cores: int = 8, partitions: int = 16) -> dict[str, list[dict]]:
    """Run ``phases`` (label -> fn(spark)) and return per-stage stats for each label."""
    log_dir = tempfile.mkdtemp(prefix="routeboard-events-", dir="/tmp")
    spark = local_session(cores, partitions, app="stage-profile", extra={
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false",
        # keep the raw hash distribution visible: no coalescing of small partitions
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    for label, fn in phases.items():
        spark.sparkContext.setJobGroup(label, label)
        fn(spark)
    spark.stop()
    return read_log(log_dir)


def read_log(log_dir: str) -> dict[str, list[dict]]:
    stage_group: dict[int, str] = {}
    stage_name: dict[int, str] = {}
    records: dict[int, list[int]] = defaultdict(list)
    times: dict[int, list[int]] = defaultdict(list)
    # Spark 4 writes a rolling log: a folder of event files per application
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if Path(path).is_dir():
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev.get("Stage Info") or {}
                    stage_name[info.get("Stage ID")] = info.get("Stage Name", "")
                elif kind == "SparkListenerTaskEnd":
                    sid = ev["Stage ID"]
                    m = ev.get("Task Metrics") or {}
                    records[sid].append((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
                    info = ev.get("Task Info") or {}
                    times[sid].append(info.get("Finish Time", 0) - info.get("Launch Time", 0))
    out: dict[str, list[dict]] = defaultdict(list)
    for sid, recs in sorted(records.items()):
        total = sum(recs)
        out[stage_group.get(sid, "?")].append({
            "stage": sid,
            "name": stage_name.get(sid, ""),
            "tasks": len(recs),
            "shuffle_records": total,
            "max_task_records": max(recs),
            "max_task_share": (max(recs) / total) if total else 0.0,
            "median_task_ms": median(times[sid]),
            "max_task_ms": max(times[sid]),
        })
    return dict(out)


def skewed_routes(spark, data_dir: str):
    """Order lines where every third transfer moves onto one route, one user and one day."""
    from routeboard.sources.order_lines import order_lines_base
    base = order_lines_base(spark, data_dir)
    hot = F.col("id") % 3 == 0
    hot_day = F.lit("2024-01-15").cast("date")
    moved = ("source_chain", "destination_chain", "user_address", "created_date", "created_at")
    return base.select(
        *[c for c in base.columns if c not in moved],
        F.when(hot, F.lit("HOT_SRC")).otherwise(F.col("source_chain")).alias("source_chain"),
        F.when(hot, F.lit("HOT_DST")).otherwise(F.col("destination_chain")).alias("destination_chain"),
        F.when(hot, F.lit("HOT_USER")).otherwise(F.col("user_address")).alias("user_address"),
        F.when(hot, hot_day).otherwise(F.col("created_date")).alias("created_date"),
        F.when(hot, hot_day.cast("timestamp_ntz")).otherwise(F.col("created_at")).alias("created_at"),
    )


def skew_check(data_dir: str = "/root/testdata/sf0.01") -> dict[str, list[dict]]:
    from routeboard.operators import reports as R

    def rows(spark):
        return R.in_range(skewed_routes(spark, data_dir), PAGE)

    def measures(spark):
        R.route_measures(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def ranked_median(spark):
        R.route_medians(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def route_profile(spark):
        R.route_profile(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def user_measures(spark):
        R.user_measures(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def first_seen(spark):
        R.daily_new_users(skewed_routes(spark, data_dir), PAGE).write.format("noop").mode("overwrite").save()

    def bucket_measures(spark):
        R.bucket_measures(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def source_destination(spark):
        R.source_destination(rows(spark), PAGE).write.format("noop").mode("overwrite").save()

    def per_route_window(spark):
        r = rows(spark).select(R._route(False).alias("path"), "amount_usd")
        ranked = r.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("amount_usd")))
        ranked.write.format("noop").mode("overwrite").save()

    return profile({"route_measures": measures, "ranked_median": ranked_median, "route_profile": route_profile,
                    "user_measures": user_measures, "first_seen": first_seen,
                    "bucket_measures": bucket_measures, "source_destination": source_destination,
                    "control_per_route_window": per_route_window})


if __name__ == "__main__":
    print(json.dumps(skew_check(*sys.argv[1:]), indent=1))
