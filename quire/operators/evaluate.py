"""Extracted fields against ground truth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import NUMERIC_TOLERANCE
from quire.functions.json import as_field_map
from quire.functions.text import py_float, py_round, py_strip

_ZERO = r"^-?0(\.0*)?([eE][+-]?\d+)?$"
_QUOTE = '"'


def _plain(json: Column) -> Column:
    """The text of a JSON value: strings without quotes, null as null, all else as written."""
    inner = F.substring(json, F.lit(2), F.length(json) - 2)
    escaped = F.try_parse_json(json).try_cast("string")
    text = F.when(json.contains("\\"), escaped).otherwise(inner)
    return F.when(json.startswith(_QUOTE), text).otherwise(F.nullif(json, F.lit("null")))


def _matches() -> Column:
    """Whether the extracted value agrees with the expected one; by the kind of the expected value.

    Null, false, zero and empty values count as an empty text and as the number 0, so that a missing
    field agrees with an expected 0.
    """
    shown = F.col("_value")
    empty = shown.isNull() | shown.isin("null", "false", '""', "[]", "{}") | shown.rlike(_ZERO)
    text = F.when(empty, "").otherwise(F.coalesce("extracted", F.lit("")))
    number = F.when(empty, 0.0).when(shown == "true", 1.0).otherwise(py_float(F.col("extracted")))
    same_text = F.lower(py_strip(text)) == F.lower(py_strip(F.col("expected_text")))
    same_number = F.abs(number - F.col("expected_number")) < NUMERIC_TOLERANCE
    same_count = F.col("_items") == F.col("expected_number")
    kind = F.col("kind")
    chosen = F.when(kind == "count", same_count).when(kind == "number", same_number).otherwise(same_text)
    return F.coalesce(chosen, F.lit(False))


def field_matches(extracted: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """One row per expected field: what was extracted and whether it agrees; missing fields are kept.

    ``extracted``: sample_id, data (VARIANT) and optionally prompt_version. ``ground_truth``: sample_id,
    document_type, field, kind (text, number, count), expected_text, expected_number. A ``count`` field
    compares the length of ``line_items``.
    """
    items = F.size(F.try_variant_get("data", "$.line_items", "array<variant>"))
    carried = [c for c in ("prompt_version",) if c in extracted.columns]
    # JSON texts are smaller in the shuffle than VARIANT values, each of which carries its own key table
    values = F.transform_values(as_field_map(F.col("data")), lambda _, value: F.to_json(value))
    side = extracted.select("sample_id", *carried, values.alias("_values"), F.coalesce(items, F.lit(0)).alias("_items"))
    joined = ground_truth.join(side, "sample_id", "left").fillna(0, ["_items"])
    valued = joined.withColumn("_value", F.try_element_at("_values", F.col("field")))
    return valued.withColumn("extracted", _plain(F.col("_value"))).withColumn("match", _matches()).drop(
        "_values", "_items", "_value"
    )


def _accuracy() -> list[Column]:
    correct, total = F.count_if("match"), F.count(F.lit(1))
    share = py_round(correct / F.greatest(total, F.lit(1)), 4)
    return [correct.alias("correct"), total.alias("total"), share.alias("accuracy")]


def sample_accuracy(matches: DataFrame) -> DataFrame:
    """Correct and expected fields of each sample."""
    return matches.groupBy("sample_id").agg(*_accuracy())


def overall_accuracy(matches: DataFrame, document_type: str | None = None) -> DataFrame:
    """Correct over expected fields of each type (not the mean of samples).

    For a given type there is always one row; without ground truth it carries an ``error``.
    """
    samples = F.count_distinct("sample_id").alias("total_samples")
    if document_type is None:
        totals = matches.groupBy("document_type").agg(*_accuracy(), samples)
    else:
        chosen = matches.where(F.col("document_type") == document_type)
        totals = chosen.agg(*_accuracy(), samples).withColumn("document_type", F.lit(document_type))
    missing = F.concat(F.lit("No ground truth for type: "), F.col("document_type"))
    return totals.select(
        "document_type",
        "total_samples",
        "correct",
        "total",
        F.when(F.col("total") > 0, F.col("accuracy")).alias("accuracy"),
        F.when(F.col("total") == 0, missing).alias("error"),
    )


def field_accuracy(matches: DataFrame) -> DataFrame:
    """Share of samples in which each field agrees."""
    return matches.groupBy("field").agg(*_accuracy())


def prompt_accuracy(matches: DataFrame) -> DataFrame:
    """Accuracy per prompt version."""
    return matches.groupBy("prompt_version").agg(*_accuracy())
