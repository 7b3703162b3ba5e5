"""Document type from words, from a model's answer, or from the caller."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import CLASSIFY_DEFAULT, CLASSIFY_KEYWORDS, DOCUMENT_TYPES
from quire.functions.text import py_strip


def _first_label(text: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first group with a word contained in ``text``."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in groups:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        label = label.when(hit, name)
    return label.otherwise(default)


def classify_keywords(df: DataFrame, text_col: str = "raw_text", out: str = "classified_type") -> DataFrame:
    """Add the type of the first word group found in the text."""
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(text_col, F.lit(""))))
    return lowered.withColumn(out, _first_label(F.col("_lowered"), CLASSIFY_KEYWORDS, CLASSIFY_DEFAULT)).drop(
        "_lowered"
    )


def classify_from_response(df: DataFrame, answer_col: str = "answer", out: str = "classified_type") -> DataFrame:
    """Add the first known type, in declaration order, named in a model's answer; else ``unknown``."""
    answer = F.lower(py_strip(F.coalesce(answer_col, F.lit(""))))
    return df.withColumn(out, _first_label(answer, [(t, [t]) for t in DOCUMENT_TYPES], "unknown"))


def resolve_type(
    df: DataFrame, requested: str = "requested_type", classified: str = "classified_type", out: str = "document_type"
) -> DataFrame:
    """Add the caller's type, or the classifier's where the caller left it ``unknown``; null for an undeclared type.

    ``route_uploads`` refuses rows with an undeclared type.
    """
    asked = F.coalesce(requested, F.lit("unknown"))
    return df.withColumn(out, F.when(asked == "unknown", F.col(classified)).when(asked.isin(DOCUMENT_TYPES), asked))
