"""Baseline runs against tuned runs, for any number of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.formatting import fmt_bytes, fmt_fixed, fmt_pct_change
from plumbline.operators.advice import recommendations_per_run
from plumbline.sources.eventlog import latest_runs

COMPARED = "compared"
SKIPPED = "skipped"

# The compared metrics in report order, and whether they are bytes.
METRICS = [
    ("tasks", False),
    ("shuffle_read_bytes", True),
    ("shuffle_write_bytes", True),
    ("spill_bytes", True),
    ("executor_run_time_ms", False),
    ("longest_task_ms", False),
]
SKEW_METRIC = "worst_skew_ratio"


def paired_runs(pairs: DataFrame, apps: DataFrame) -> DataFrame:
    """Pairs with the newest run of each side; a missing side makes a pair skipped."""
    newest = latest_runs(apps).select("app_name", "run_key")
    side = {
        name: newest.select(
            F.col("app_name").alias(f"{name}_app"), F.col("run_key").alias(f"{name}_run")
        )
        for name in ("baseline", "tuned")
    }
    both = F.col("baseline_run").isNotNull() & F.col("tuned_run").isNotNull()
    missing = F.when(F.col("baseline_run").isNull(), F.col("baseline_app")).when(
        F.col("tuned_run").isNull(), F.col("tuned_app")
    )
    return (
        pairs.join(side["baseline"], "baseline_app", "left")
        .join(side["tuned"], "tuned_app", "left")
        .select(
            "label",
            "baseline_app",
            "tuned_app",
            "baseline_run",
            "tuned_run",
            F.when(both, COMPARED).otherwise(SKIPPED).alias("status"),
            missing.alias("missing_app"),
            F.regexp_replace("baseline_app", "_baseline", "").alias("report_name"),
        )
    )


def _metrics_of(side: str, metrics: DataFrame) -> DataFrame:
    spill = F.col("total_memory_spilled") + F.col("total_disk_spilled")
    values = [
        F.col("total_tasks"),
        F.col("total_shuffle_read_bytes"),
        F.col("total_shuffle_write_bytes"),
        spill,
        F.col("total_executor_run_time_ms"),
        F.col("max_task_run_time_ms"),
        F.col("worst_skew_ratio"),
    ]
    return metrics.select(
        F.col("run_key").alias(f"{side}_run"),
        F.array(*[v.cast("double") for v in values]).alias(f"{side}_values"),
    )


def compare_metrics(pairs: DataFrame, apps: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per compared pair and metric.

    The skew row is there only if either side has a ratio.  A tuned side without
    one counts as zero for the change, and without a baseline ratio there is none.
    """
    paired = (
        paired_runs(pairs, apps)
        .where(F.col("status") == COMPARED)
        .join(_metrics_of("baseline", metrics), "baseline_run")
        .join(_metrics_of("tuned", metrics), "tuned_run")
    )
    before, after = F.col("baseline_values"), F.col("tuned_values")
    rows = []
    for position, (name, is_bytes) in enumerate(METRICS):
        b, t = before[position], after[position]
        shown = fmt_bytes if is_bytes else (lambda value: value.cast("bigint").cast("string"))
        rows.append(_row(position + 1, name, b, t, shown(b), shown(t), fmt_pct_change(b, t)))
    b, t = before[len(METRICS)], after[len(METRICS)]
    change = F.when(b.isNull(), "n/a").otherwise(fmt_pct_change(b, F.coalesce(t, F.lit(0.0))))
    skew = _row(len(METRICS) + 1, SKEW_METRIC, b, t, _ratio_text(b), _ratio_text(t), change)
    rows.append(F.when(b.isNotNull() | t.isNotNull(), skew))

    kept = F.filter(F.array(*rows), lambda row: row.isNotNull())
    return paired.select("label", "report_name", F.inline(kept))


def _row(position: int, name: str, b: Column, t: Column, b_text: Column, t_text: Column, change: Column) -> Column:
    return F.struct(
        F.lit(position).alias("metric_ord"),
        F.lit(name).alias("metric"),
        b.alias("baseline"),
        t.alias("tuned"),
        b_text.alias("baseline_disp"),
        t_text.alias("tuned_disp"),
        change.alias("change"),
    )


def _ratio_text(ratio: Column) -> Column:
    return F.coalesce(F.concat(fmt_fixed(ratio, 1), F.lit("x")), F.lit("n/a"))


def compare_findings(pairs: DataFrame, apps: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of both runs of each compared pair, marked by ``phase``."""
    paired = paired_runs(pairs, apps).where(F.col("status") == COMPARED)
    phases = F.array(
        F.struct(F.lit("before").alias("phase"), F.col("baseline_run").alias("run_key")),
        F.struct(F.lit("after").alias("phase"), F.col("tuned_run").alias("run_key")),
    )
    return findings.join(paired.select("label", "report_name", F.inline(phases)), "run_key")


def compare_recommendations(pairs: DataFrame, apps: DataFrame, findings: DataFrame) -> DataFrame:
    """What fixed each pair: the advice for the findings of its baseline run."""
    before = compare_findings(pairs, apps, findings).where(F.col("phase") == "before")
    return recommendations_per_run(before, ["label", "report_name"])


def compare_suite(
    pairs: DataFrame, apps: DataFrame, metrics: DataFrame, findings: DataFrame
) -> DataFrame:
    """One row per pair: what became of it, how many findings, and skew before and after."""
    paired = paired_runs(pairs, apps)
    counts = findings.groupBy("run_key").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("category") == "skew").alias("skew_findings"),
    )
    per_run = metrics.select("run_key", "worst_skew_ratio", "max_task_run_time_ms").join(
        counts, "run_key", "left"
    )
    both = F.col("status") == COMPARED
    for side in ("baseline", "tuned"):
        paired = paired.join(
            per_run.select(*[F.col(c).alias(f"{side}_{c}") for c in per_run.columns])
            .withColumnRenamed(f"{side}_run_key", f"{side}_run"),
            f"{side}_run",
            "left",
        )
    shown = {
        f"{side}_{c}": F.when(both, F.coalesce(F.col(f"{side}_{c}"), F.lit(0)))
        for side in ("baseline", "tuned")
        for c in ("findings",)
    }
    return paired.select(
        "label",
        "status",
        "missing_app",
        "report_name",
        *[value.alias(name) for name, value in shown.items()],
        (both & (F.coalesce("baseline_skew_findings", F.lit(0)) > 0)).alias("has_skew_note"),
        F.when(both, F.col("baseline_worst_skew_ratio")).alias("baseline_skew_ratio"),
        F.when(both, F.col("tuned_worst_skew_ratio")).alias("tuned_skew_ratio"),
        F.when(both, F.col("baseline_max_task_run_time_ms")).alias("baseline_longest_task_ms"),
        F.when(both, F.col("tuned_max_task_run_time_ms")).alias("tuned_longest_task_ms"),
    )
