"""From uploads, recognised text and model answers to result rows, index rows and run-log rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import MAX_FILE_SIZE_MB, OCR_CONFIDENCE_THRESHOLD
from quire.operators.classify import classify_keywords, resolve_type
from quire.operators.extract import parse_model_json
from quire.operators.ingest import route_uploads
from quire.operators.ocr import choose_engine, engine_result, flag_ocr
from quire.operators.prompts import select_prompt
from quire.operators.runs import log_runs
from quire.operators.score import score_and_count
from quire.operators.store import build_index_rows


def gather(uploads: DataFrame, primary: DataFrame, alternate: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per upload with both engines' results, the model's answer, and the class of its error if it failed.

    All sides have one row per ``doc_id`` and join on it, so each is shuffled once (not at all when the
    tables are bucketed by it).
    """
    failed = F.col("error") if "error" in responses.columns else F.lit(None)
    return (
        uploads.join(engine_result(primary, "primary"), "doc_id", "left")
        .join(engine_result(alternate, "alternate"), "doc_id", "left")
        .join(responses.select("doc_id", "raw", failed.cast("string").alias("error_type")), "doc_id", "left")
    )


def process_documents(
    gathered: DataFrame,
    prompts: DataFrame,
    max_mb: int = MAX_FILE_SIZE_MB,
    threshold: float = OCR_CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """One result row per row of ``gather``; row by row, so it also runs on a stream.

    Rejected rows keep their ``status_code`` and ``reason`` and have no further values. A failed model
    call or an unusable answer is still a completed row, with an empty object or the raw answer.
    """
    routed = route_uploads(gathered, max_mb).withColumnsRenamed(
        {"status_code": "_upload_code", "reason": "_upload_reason"}
    )
    read = flag_ocr(routed.withColumns(choose_engine("primary", "alternate", threshold)), threshold)
    turned_away = F.col("_upload_code") != 200
    decided = read.withColumns(
        {
            "status_code": F.when(turned_away, F.col("_upload_code")).otherwise(F.col("status_code")),
            "reason": F.when(turned_away, F.col("_upload_reason")).otherwise(F.col("reason")),
        }
    )
    accepted = F.col("status_code") == 200
    untyped = F.coalesce("requested_type", F.lit("unknown")) == "unknown"
    opened = decided.withColumns(
        {
            "status": F.when(accepted, "completed").otherwise("failed"),
            "warnings": F.when(accepted, F.col("warnings")).otherwise(F.array().cast("array<string>")),
            # only these texts are searched for type words, and only these answers are parsed
            "_unclassified": F.when(accepted & untyped, F.col("raw_text")),
            "raw": F.when(accepted, F.col("raw")),
        }
    )
    typed = resolve_type(classify_keywords(opened, "_unclassified"))
    prompted = select_prompt(typed, prompts)
    scored = score_and_count(parse_model_json(prompted))
    blanked = {
        name: F.when(accepted, F.col(name))
        for name in (
            "document_type",
            "raw_text",
            "engine_used",
            "page_count",
            "ocr_time_ms",
            "error_type",
            "data",
            "parse_path",
            "confidence_score",
            "prompt_key",
            "version_used",
            "fields_extracted",
            "total_fields",
            "field_completeness",
        )
    }
    return (
        scored.withColumns(blanked)
        .withColumn("ocr_confidence", F.when(accepted, F.col("confidence")))
        .drop(
            "_upload_code", "_upload_reason", "_unclassified", "classified_type", "primary", "alternate",
            "confidence", "raw", "prompt_version", "extension",
        )
        .withColumnRenamed("version_used", "prompt_version")
    )


def extract_documents(
    uploads: DataFrame,
    primary: DataFrame,
    alternate: DataFrame,
    responses: DataFrame,
    prompts: DataFrame,
    max_mb: int = MAX_FILE_SIZE_MB,
    threshold: float = OCR_CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """The whole run over tables: one lazy plan, one result row per upload."""
    return process_documents(gather(uploads, primary, alternate, responses), prompts, max_mb, threshold)


def index_rows(results: DataFrame, extracted_at: str = "created_at") -> DataFrame:
    """Rows for the document index from completed results (where ``store_in_index`` is not false)."""
    done = results.where(F.col("status") == "completed")
    if "store_in_index" in results.columns:
        done = done.where(F.coalesce("store_in_index", F.lit(True)))
    named = done.withColumn("confidence", F.col("confidence_score"))
    return build_index_rows(named, extracted_at=extracted_at)


def run_rows(results: DataFrame, model: str, start_time: str = "created_at") -> DataFrame:
    """Rows for the run log from completed results; rejected uploads leave no run."""
    done = results.where(F.col("status") == "completed")
    return log_runs(
        done.select(
            F.col("doc_id").alias("run_id"),
            F.col(start_time).alias("start_time"),
            F.col("doc_id").cast("string").alias("document_id"),
            "document_type",
            "prompt_version",
            F.col("engine_used").alias("ocr_engine"),
            F.lit(model).alias("llm_model"),
            "status",
            "error_type",
            "ocr_confidence",
            "ocr_time_ms",
            F.col("confidence_score").alias("extraction_confidence"),
            "fields_extracted",
            "total_fields",
            "processing_time_ms",
            "warnings",
        )
    )
