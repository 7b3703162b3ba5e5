"""The run log: writing it, and the comparisons made over it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.fixed_values import (
    ACCURACY_THRESHOLD,
    DRIFT_ADVICE,
    DRIFT_LIMIT,
    DRIFT_WINDOW,
    DRIFT_WINDOW_RANGE,
    ENVIRONMENT_TAG,
    STABLE_ADVICE,
    WARNINGS_IN_TAG,
)
from quire.functions.ranking import first_per_group
from quire.functions.text import exact_mean, np_round
from quire.operators.score import completeness


def log_runs(extractions: DataFrame, pipeline: str = "document-extraction") -> DataFrame:
    """Add ``field_completeness`` and ``tags`` to extraction rows."""
    has_warnings = F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0
    joined = F.array_join(F.slice("warnings", 1, WARNINGS_IN_TAG), "; ")
    always = F.create_map(F.lit("pipeline"), F.lit(pipeline), F.lit("environment"), F.lit(ENVIRONMENT_TAG))
    warned = F.create_map(F.lit("has_warnings"), F.lit("true"), F.lit("warnings"), joined)
    return extractions.withColumns(
        {
            "field_completeness": completeness("fields_extracted", "total_fields"),
            "tags": F.when(has_warnings, F.map_concat(always, warned)).otherwise(always),
        }
    )


def append_runs(runs: DataFrame, path: str) -> None:
    """Append to the run log, one folder per document type so that a type filter prunes files.

    Rebalancing gives files of even size: small types are merged, a dominant one is split.
    """
    even = runs.hint("rebalance", F.col("document_type"))
    even.write.mode("append").partitionBy("document_type").parquet(path)


def latest_runs(runs: DataFrame, document_type: str, n: int) -> DataFrame:
    """The newest ``n`` runs of a type. Equal start times: the higher ``run_id`` is newer."""
    chosen = runs.where(F.col("document_type") == document_type)
    return chosen.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(n)


def latest_runs_per_type(runs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` runs of every type, numbered from 1 in ``recency``."""
    newest = [F.col("start_time").desc(), F.col("run_id").desc()]
    return first_per_group(runs, ["document_type"], newest, n, spread_by="run_id", rank="recency")


def _recent(runs: DataFrame, document_type: str | None, n: int) -> DataFrame:
    chosen = runs if document_type is None else runs.where(F.col("document_type") == document_type)
    return latest_runs_per_type(chosen, n)


def compare_prompts(runs: DataFrame, document_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Per type and prompt version, over all runs or the newest ``limit`` of the type: runs and rounded means.

    Runs without a version count towards the limit (COMPARE_LIMIT is the usual page) but form no group.
    """
    columns = ["document_type", "prompt_version", "start_time", "run_id"]
    metrics = ["extraction_confidence", "processing_time_ms", "field_completeness"]
    chosen = runs.select(*columns, *metrics)
    if limit is not None:
        recent = _recent(chosen, document_type, limit)
    else:
        recent = chosen if document_type is None else chosen.where(F.col("document_type") == document_type)
    return (
        recent.where(F.col("prompt_version").isNotNull())
        .groupBy("document_type", "prompt_version")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            np_round(exact_mean(F.col("extraction_confidence")), 4).alias("avg_extraction_confidence"),
            np_round(exact_mean(F.col("processing_time_ms")), 2).alias("avg_processing_time_ms"),
            np_round(exact_mean(F.col("field_completeness")), 4).alias("avg_field_completeness"),
        )
    )


def check_drift(runs: DataFrame, document_type: str | None = None, window: int = DRIFT_WINDOW) -> DataFrame:
    """Mean confidence of the newest ``window`` runs against the oldest ``window`` of the newest 2 x that.

    The two overlap while a type has fewer than 2 x ``window`` runs. Only a fall counts as drift. One row
    per type; for a given type always one row.
    """
    low, high = DRIFT_WINDOW_RANGE
    if not low <= window <= high:
        raise ValueError(f"window must be between {low} and {high}")
    narrow = runs.select("document_type", "start_time", "run_id", "extraction_confidence")
    recent = _recent(narrow, document_type, 2 * window)
    # counted only now: a count beside the rank would keep Spark from limiting rows before the shuffle
    counted = recent.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("document_type")))
    confidence = F.col("extraction_confidence")
    means = [
        F.count(F.lit(1)).alias("runs"),
        exact_mean(F.when(F.col("recency") <= window, confidence)).alias("_recent"),
        exact_mean(F.when(F.col("recency") > F.col("_n") - window, confidence)).alias("_baseline"),
    ]
    if document_type is None:
        grouped = counted.groupBy("document_type").agg(*means)
    else:
        grouped = counted.agg(*means).withColumn("document_type", F.lit(document_type))
    enough = F.col("runs") >= window
    drift = F.col("_baseline") - F.col("_recent")
    drifted = F.coalesce(drift > DRIFT_LIMIT, F.lit(False))
    return grouped.select(
        "document_type",
        "runs",
        F.when(~enough, "insufficient_data").when(drifted, "drift_detected").otherwise("stable").alias("status"),
        F.when(enough, np_round(F.col("_recent"), 4)).alias("recent_avg_confidence"),
        F.when(enough, np_round(F.col("_baseline"), 4)).alias("baseline_avg_confidence"),
        F.when(enough, np_round(drift, 4)).alias("drift_magnitude"),
        F.when(enough, F.lit(ACCURACY_THRESHOLD)).alias("threshold"),
        F.when(enough, F.when(drifted, DRIFT_ADVICE).otherwise(STABLE_ADVICE)).alias("recommendation"),
    )


def metrics_summary(runs: DataFrame) -> DataFrame:
    """One row: documents, mean confidence and time, documents by type, success rate.

    Counts and sums combine by type first; only one row per type reaches the last step. NaN counts as null.
    """

    def known(column: str):
        return F.when(~F.isnan(column), F.col(column))

    by_type = runs.groupBy(F.coalesce("document_type", F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.sum(known("extraction_confidence")).alias("confidence"),
        F.count(known("extraction_confidence")).alias("with_confidence"),
        F.sum(known("processing_time_ms")).alias("time"),
        F.count(known("processing_time_ms")).alias("with_time"),
    )

    def ratio(top: str, bottom: str):
        return F.coalesce(F.try_divide(F.sum(top).cast("double"), F.sum(bottom)), F.lit(0.0))

    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"),
        np_round(ratio("confidence", "with_confidence"), 4).alias("avg_confidence"),
        np_round(ratio("time", "with_time"), 2).alias("avg_processing_time_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("documents_by_type"),
        np_round(ratio("completed", "n"), 4).alias("extraction_success_rate"),
    )
