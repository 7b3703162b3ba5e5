"""Confidence score, field counts, bands, and declared constraints."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import (
    CONFIDENCE_BANDS,
    CRITICAL_WEIGHT,
    DOCUMENT_TYPES,
    EXTRACTION_STATUSES,
    IMPORTANT_WEIGHT,
    LENGTH_BANDS,
    LIST_FIELDS,
    SCORE_FIELDS,
)
from quire.functions.json import as_field_map, is_filled
from quire.functions.text import py_round, py_strip


def _with_fields(df: DataFrame) -> DataFrame:
    return df.withColumn("_fields", as_field_map(F.col("data")))


def _field_filled(name: str) -> Column:
    """1 where a top-level field is filled. Lists are recognised without turning them into text."""
    text = F.coalesce(F.try_variant_get("data", f"$.{name}", "string") != "", F.lit(False))
    if name in LIST_FIELDS:
        text = F.try_variant_get("data", f"$.{name}", "array<variant>").isNotNull() | text
    return text.cast("int")


def _score(df: DataFrame, out: str) -> DataFrame:
    def share(names: list[str]) -> Column:
        return reduce(add, [_field_filled(n) for n in names]) / F.lit(float(len(names)))

    score = F.when(F.lit(False), F.lit(None).cast("double"))
    for kind, fields in SCORE_FIELDS.items():
        weighted = share(fields["critical"]) * CRITICAL_WEIGHT + share(fields["important"]) * IMPORTANT_WEIGHT
        score = score.when(F.col("document_type") == kind, py_round(weighted, 4))
    filled = F.size(F.filter(F.map_values("_fields"), is_filled))
    generic = filled / F.greatest(F.size(F.map_keys("_fields")), F.lit(1))
    return df.withColumn(out, F.coalesce(score.otherwise(generic), F.lit(0.0)))


def _count(df: DataFrame) -> DataFrame:
    not_null = F.filter(F.map_values("_fields"), lambda value: ~F.is_variant_null(value))
    return df.withColumns(
        {
            "fields_extracted": F.coalesce(F.size(not_null), F.lit(0)).cast("bigint"),
            "total_fields": F.coalesce(F.size(F.map_keys("_fields")), F.lit(0)).cast("bigint"),
        }
    ).withColumn("field_completeness", completeness("fields_extracted", "total_fields"))


def score_confidence(df: DataFrame, out: str = "confidence_score") -> DataFrame:
    """Add the share of expected fields that are filled.

    Invoices and contracts weigh critical against important fields and round to four digits; other
    types use filled keys over all keys, unrounded. An empty object scores 0.
    """
    untyped = ~F.col("document_type").isin(list(SCORE_FIELDS))
    opened = df.withColumn("_fields", F.when(untyped, as_field_map(F.col("data"))))
    return _score(opened, out).drop("_fields")


def count_fields(df: DataFrame) -> DataFrame:
    """Add ``fields_extracted`` (not null; empty text counts), ``total_fields`` and ``field_completeness``."""
    return _count(_with_fields(df)).drop("_fields")


def score_and_count(df: DataFrame, out: str = "confidence_score") -> DataFrame:
    """Both ``score_confidence`` and ``count_fields``, opening each object once."""
    return _count(_score(_with_fields(df), out)).drop("_fields")


def completeness(fields: str, total: str) -> Column:
    """Extracted over total fields, with at least one field in total."""
    return F.col(fields) / F.greatest(F.col(total), F.lit(1))


def length_band(df: DataFrame, text_col: str = "raw_text", out: str = "length_band") -> DataFrame:
    """Add the band of the stripped text's length and the band's confidence range."""
    length = F.length(py_strip(F.coalesce(text_col, F.lit(""))))
    band = F.when(F.lit(False), F.lit(None).cast("struct<name:string,low:double,high:double>"))
    for name, limit, low, high in LENGTH_BANDS:
        value = F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        band = band.when(length > limit, value) if limit is not None else band.otherwise(value)
    return (
        df.withColumn("_band", band)
        .withColumns({out: F.col("_band.name"), "expected_low": F.col("_band.low"), "expected_high": F.col("_band.high")})
        .drop("_band")
    )


def confidence_band(df: DataFrame, value_col: str = "confidence_score", out: str = "confidence_band") -> DataFrame:
    """Add the display band of a confidence."""
    band = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, limit in CONFIDENCE_BANDS:
        band = band.when(F.col(value_col) > limit, name) if limit is not None else band.otherwise(name)
    return df.withColumn(out, band)


def band_counts(df: DataFrame, *bands: str) -> DataFrame:
    """Rows per band."""
    return df.groupBy(*bands).agg(F.count(F.lit(1)).alias("documents"))


def check_constraints(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows that break each declared rule, one row per rule, in one pass over the table.

    ``rules`` maps a name to a condition that is true for a broken row; the default rules are the
    declared bounds on the columns ``df`` has.
    """
    rules = declared_rules(df.columns) if rules is None else rules
    broken = [F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *broken)
    pairs = [v for name in rules for v in (F.lit(name), F.col(name), F.col("_rows"))]
    return counts.select(F.stack(F.lit(len(rules)), *pairs).alias("rule", "violations", "checked"))


def declared_rules(columns: list[str]) -> dict[str, Column]:
    """Rules for whichever of the known columns are present."""
    rules: dict[str, Column] = {}
    for name in ("ocr_confidence", "confidence", "confidence_score", "extraction_confidence"):
        if name in columns:
            value = F.col(name)
            rules[f"{name}_in_0_1"] = value.isNotNull() & (F.isnan(value) | ~value.between(0.0, 1.0))
    for name in ("document_id", "description", "raw_text"):
        if name in columns:
            rules[f"{name}_present"] = F.col(name).isNull()
    for name, known in (("document_type", DOCUMENT_TYPES), ("status", EXTRACTION_STATUSES)):
        if name in columns:
            rules[f"{name}_known"] = F.col(name).isNull() | ~F.col(name).isin(known)
    return rules
