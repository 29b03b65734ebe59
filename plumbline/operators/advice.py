"""What to do about each category of finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas

# The categories, and the one setting each recommends.
SETTINGS = {
    "skew": {"spark.sql.adaptive.skewJoin.enabled": "true"},
    "small_files": {"spark.sql.files.maxPartitionBytes": "134217728"},
    "missing_broadcast": {"spark.sql.autoBroadcastJoinThreshold": "104857600"},
    "missing_cache": None,
    "spill": {"spark.sql.shuffle.partitions": "<increase from current value>"},
    "serialization_overhead": {"spark.serializer": "org.apache.spark.serializer.KryoSerializer"},
}

# Per category: the operator that measures it, what its figures decide, and the operator to use.
_MEASURED_BY = {
    "skew": (
        "key_skew_profile",
        "Every key above `rows_per_salt` rows, on either side, gets rows / rows_per_salt salts",
        "skew_aware_join(left, right, on='key', rows_per_salt=5_000_000)",
    ),
    "small_files": (
        "small_file_profile",
        "`target_partitions` is what the listed bytes fill; the scan packs files up to that size",
        "compact_scan(spark, path)  # and write_compacted(df, path, files) at the writer",
    ),
    "missing_broadcast": (
        "measured_bytes",
        "Up to `max_bytes` of the smaller side the join broadcasts it, beyond that it shuffles",
        "broadcast_join(fact, dim, on='key', max_bytes=100 * 1024**2)",
    ),
    "missing_cache": (
        "sql_signals",
        "Results of one derived frame fit one pass with grouping sets; persist it where they do not",
        "reuse_grouping_sets(enriched)  # or: with shared(enriched) as frame: ...",
    ),
    "spill": (
        "stage_rollup",
        "Shuffle bytes of the stage / 128 MB is a number of partitions that should not spill",
        None,
    ),
    "serialization_overhead": (
        "stage_rollup",
        "`serde_time_ms` against run time, again after columns are dropped ahead of the shuffle",
        None,
    ),
}

RECOMMENDATIONS = [
    (category, f"{category}: measure with {measure}", f"{decides}.", SETTINGS[category], use)
    for category, (measure, decides, use) in _MEASURED_BY.items()
]


def recommendations(spark: SparkSession) -> DataFrame:
    """The recommendation of each category: six rows, so safe to broadcast."""
    return spark.createDataFrame(RECOMMENDATIONS, schemas.RECOMMENDATIONS)


def recommend(findings: DataFrame) -> DataFrame:
    """Every finding with the recommendation for its category."""
    advice = recommendations(findings.sparkSession)
    return findings.join(F.broadcast(advice), "category")


def recommendations_per_run(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each category once per run, in the order in which its rule reports."""
    keys = keys or ["run_key"]
    seen = findings.groupBy(*keys, "category").agg(
        F.min("detector_ord").alias("first_seen"), F.count(F.lit(1)).alias("n_findings")
    )
    return recommend(seen)
