"""Task balance of the member detail when one member holds a third of the rows.

Usage: python tools/skew_check.py [balanced|window|summary_flat|summary_keyed|detail_flat|detail_keyed]
       [sf_dir] [copies]

Builds a ledger from the driver's orders and customers, repeated ``copies``
times (array explode, no join), and hands a third of all rows to one member.
Then numbers every member's payments either with ``positions`` (balanced)
or with ``row_number() over (partition by miembro ...)`` (window), writes
through the ``noop`` sink, and reads task metrics from Spark's event log in
a fresh scratch folder. Prints one JSON line: wall time and, for the stage
whose largest task read the most shuffle records, that task's share of all
records it read and its run time against the stage median.

The ``summary_*`` and ``detail_*`` modes compare the member summary and the
numbered detail over the row-level join (flat) and over the keyed ledger,
with broadcast joins switched off as they would be at full scale and one
customer holding a third of the orders; they also report all shuffle
records written.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pozo.operators.ranking import positions  # noqa: E402
from pozo.plans import member_detail, member_summary  # noqa: E402
from pozo.sources.keyed import KeyedLedger  # noqa: E402
from pozo.session import build_session  # noqa: E402
from pozo.sources import adapter  # noqa: E402


def main() -> None:
    mode = sys.argv[1] if len(sys.argv) > 1 else "balanced"
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    copies = int(sys.argv[3]) if len(sys.argv) > 3 else 20
    logs = tempfile.mkdtemp(prefix="run-evlog-", dir="/tmp")
    spark = build_session("local[8]", 16, app_name=f"skew-{mode}",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logs}", "spark.eventLog.compress": "false",
                                 "spark.driver.memory": "8g"})
    if mode.startswith(("summary", "detail")):
        run_summary(spark, mode, sf_dir, copies, logs)
        return
    led = adapter.aportes(spark, sf_dir)
    rep = led.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = F.pmod(F.xxhash64("miembro", "fecha", "aporte", "copy"), F.lit(3)) == 0
    rep = rep.withColumn("miembro", F.when(hot, F.lit("Hot member")).otherwise(F.col("miembro")))
    order = [F.col("fecha").desc(), F.col("aporte").desc(), F.col("concepto").desc(), F.col("copy")]
    if mode == "window":
        out = rep.withColumn("pos", F.row_number().over(Window.partitionBy("miembro").orderBy(*order)))
    else:
        out = positions(rep, order, keys=["miembro"])
    t0 = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark.stop()

    report(logs, {"mode": mode, "copies": copies, "wall_sec": round(wall, 2)})


def run_summary(spark, mode: str, sf_dir: str, copies: int, logs: str) -> None:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    keyed = adapter.aportes_keyed(spark, sf_dir)
    pay = keyed.payments.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = F.pmod(F.xxhash64("id_pagador", "fecha", "aporte", "copy"), F.lit(3)) == 0
    pay = pay.withColumn("id_pagador", F.when(hot, F.lit(1)).otherwise(F.col("id_pagador"))).drop("copy")
    ledger = KeyedLedger(pay, keyed.payers, keyed.key, unique_names=True)
    report_fn = member_summary if mode.startswith("summary") else member_detail
    out = report_fn(ledger if mode.endswith("_keyed") else ledger.flat())
    t0 = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark.stop()
    report(logs, {"mode": mode, "copies": copies, "wall_sec": round(wall, 2)})


def report(logs: str, head: dict) -> None:
    stages: dict[int, list[tuple[int, int]]] = {}
    written = 0
    for path in glob.glob(os.path.join(logs, "**", "*"), recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                written += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Records Written", 0)
                stages.setdefault(ev["Stage ID"], []).append((recs, m.get("Executor Run Time", 0)))
    sid, tasks = max(stages.items(), key=lambda kv: max(r for r, _ in kv[1]))
    total = sum(r for r, _ in tasks)
    top_recs, top_time = max(tasks)
    print(json.dumps({
        **head, "shuffle_records_written": written,
        "stage": sid, "tasks": len(tasks),
        "largest_task_share_of_records": round(top_recs / total, 3) if total else None,
        "largest_task_ms": top_time,
        "median_task_ms": statistics.median(t for _, t in tasks),
    }))


if __name__ == "__main__":
    main()
