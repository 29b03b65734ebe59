"""Run the four baseline/tuned job pairs at full size and compare their event logs.

    python measure_pairs.py <scratch folder> [scale]

Writes the generated tables, the logs and the comparison below the folder, and
prints the comparison.
"""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import jobs  # noqa: E402
from bench import session  # noqa: E402

from plumbline import schemas  # noqa: E402
from plumbline.plans import fleet  # noqa: E402
from plumbline.sources import generate  # noqa: E402


def main(folder: str, scale: str = "1.0") -> None:
    tables, logs = os.path.join(folder, "tables"), os.path.join(folder, "logs")
    os.makedirs(logs, exist_ok=True)
    spark = session("8")
    generate.write_tables(spark, tables, float(scale))
    for job in jobs.SETTINGS:
        for mode in ("baseline", "tuned"):
            command = [sys.executable, jobs.__file__, job, mode, tables, logs]
            subprocess.run(command, check=True, timeout=600, stderr=subprocess.DEVNULL)
    found = fleet.diagnose(spark, logs, os.path.join(folder, "fleet"))
    pairs = spark.createDataFrame(jobs.PAIRS, schemas.PAIRS)
    fleet.compare_pairs(found, pairs)
    fleet.write_pair_reports(found, pairs)
    shown = found.table("comparison").orderBy("label", "metric_ord")
    for row in shown.toLocalIterator():
        print(f"| {row.label} | {row.metric} | {row.baseline_disp} | {row.tuned_disp} | {row.change} |")
    listed = found.table("findings").orderBy("app_name", "detector_ord", "stage_id")
    for row in listed.toLocalIterator():
        print(f"{row.app_name}: [{row.severity}] {row.category}: {row.message}")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
