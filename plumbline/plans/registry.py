"""Query names, what they run, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import diagnosis, fixes
from plumbline.plans.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    # event logs
    "evt_type_counts": diagnosis.evt_type_counts,
    "evt_task_extract": diagnosis.evt_task_extract,
    "evt_stage_rollup": diagnosis.evt_stage_rollup,
    "evt_apps": diagnosis.evt_apps,
    "sql_durations": diagnosis.sql_durations,
    "plan_signals": diagnosis.plan_signals,
    "latest_runs": diagnosis.latest_runs,
    "find_run": diagnosis.find_run,
    "latest_run": diagnosis.latest_run,
    # roll-ups
    "stage_rollup": diagnosis.stage_rollup,
    "stage_rollup_succeeded": diagnosis.stage_rollup_succeeded,
    "stage_shuffle_skew": diagnosis.stage_shuffle_skew,
    "stage_duration_skew": diagnosis.stage_duration_skew,
    "app_rollup": diagnosis.app_rollup,
    "combined_plans": diagnosis.combined_plans,
    "run_summary": diagnosis.run_summary,
    # rules and advice
    "detect_skew": diagnosis.detect_skew,
    "detect_small_files": diagnosis.detect_small_files,
    "detect_missing_broadcast": diagnosis.detect_missing_broadcast,
    "detect_missing_broadcast_final": diagnosis.detect_missing_broadcast_final,
    "detect_missing_broadcast_sized": diagnosis.detect_missing_broadcast_sized,
    "detect_missing_cache": diagnosis.detect_missing_cache,
    "detect_spill": diagnosis.detect_spill,
    "detect_serialization": diagnosis.detect_serialization,
    "all_findings": diagnosis.all_findings,
    "findings_listing": diagnosis.findings_listing,
    "finding_recommendations": diagnosis.finding_recommendations,
    "recommendations": diagnosis.recommendations,
    # comparison and reports
    "compare_metrics": diagnosis.compare_metrics,
    "compare_findings": diagnosis.compare_findings,
    "compare_recommendations": diagnosis.compare_recommendations,
    "compare_suite": diagnosis.compare_suite,
    "pct_change": diagnosis.pct_change_query,
    "fmt_bytes_cases": diagnosis.fmt_bytes_cases,
    "single_run_report": diagnosis.single_run_report,
    "single_run_report_files": diagnosis.single_run_report_files,
    "comparison_report": diagnosis.comparison_report,
    "suite_report": diagnosis.suite_report,
    # joins
    "shuffle_join_hot_key": fixes.shuffle_join_hot_key,
    "salted_join_hot_key": fixes.salted_join_hot_key,
    "salted_join_rows": fixes.salted_join_rows,
    "salted_join_grid": fixes.salted_join_grid,
    "skew_aware_join": fixes.skew_aware_join,
    "dim_join_shuffle": fixes.dim_join_shuffle,
    "dim_join_broadcast": fixes.dim_join_broadcast,
    "key_skew_profile": fixes.key_skew_profile,
    "key_skew_profile_hot": fixes.key_skew_profile_hot,
    "hot_keys": fixes.hot_keys,
    # layout
    "small_files_region_total": fixes.small_files_region_total,
    "small_files_compacted": fixes.small_files_compacted,
    "rebalanced_write": fixes.rebalanced_write,
    "small_files_write": fixes.small_files_write,
    # reuse
    "enrich_orders": fixes.enrich_orders,
    "enrich_orders_limited": fixes.enrich_orders_limited,
    "enriched_hashes": fixes.enriched_hashes,
    "reuse_by_region": fixes.reuse_by_region,
    "reuse_by_bucket": fixes.reuse_by_bucket,
    "reuse_by_signup": fixes.reuse_by_signup,
    "reuse_uncached": fixes.reuse_uncached,
    "reuse_cached": fixes.reuse_cached,
    "reuse_grouping_sets": fixes.reuse_grouping_sets,
    # generators
    "gen_skewed_orders": fixes.gen_skewed_orders,
    "gen_customers": fixes.gen_customers,
    "gen_orders_join_fact": fixes.gen_orders_join_fact,
    "gen_events_join_fact": fixes.gen_events_join_fact,
    "row_range": fixes.row_range,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
