"""Recognised words to text, confidence per document, and choice between two engines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import BLANK_TEXT, LOW_CONFIDENCE_WARNING, OCR_CONFIDENCE_THRESHOLD
from quire.functions.text import py_round, py_strip, two_decimals

_DOC = ["doc_id", "engine"]
_PAGE = [*_DOC, "page"]
_LINE = [*_PAGE, "block", "line"]


def _joined(order: list[str], value: str, separator: str) -> Column:
    """Values of a group joined in the order of ``order``."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, value)))
    return F.array_join(ordered[value], separator)


def assemble_text(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document and engine: words to lines, lines to pages, pages to ``raw_text``.

    Grouping goes up level by level, so a document with very many words is spread over its pages and
    only finished page texts meet. One shuffle by document and page serves both the line and the page level.
    With ``pages`` given, pages without words count as empty pages.
    """
    lines = words.repartition("doc_id", "page").groupBy(_LINE).agg(_joined(["word"], "value", " ").alias("line_text"))
    texts = lines.groupBy(_PAGE).agg(_joined(["block", "line"], "line_text", "\n").alias("page_text"))
    if pages is not None:
        texts = pages.select(_PAGE).join(texts, _PAGE, "left").fillna("", ["page_text"])
    return texts.groupBy(_DOC).agg(
        py_strip(_joined(["page"], "page_text", "\n\n")).alias("raw_text"),
        F.count(F.lit(1)).alias("page_count"),
    )


def confidence_by_page(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean over all pages of each page's mean word confidence (0..100 scale), at most 1.

    Only whole-numbered positive confidences count; a page without any counts as 0.
    """
    valid = F.col("conf").isNotNull() & (F.col("conf") > 0) & (F.col("conf") == F.floor("conf"))
    by_page = words.where(valid).groupBy(_PAGE).agg((F.avg("conf") / 100.0).alias("page_confidence"))
    return (
        pages.select(_PAGE)
        .join(by_page, _PAGE, "left")
        .groupBy(_DOC)
        .agg(
            F.least(F.avg(F.coalesce("page_confidence", F.lit(0.0))), F.lit(1.0)).alias("confidence"),
            F.count(F.lit(1)).alias("page_count"),
        )
    )


def confidence_by_word(words: DataFrame) -> DataFrame:
    """Plain mean of all word confidences (0..1 scale) of a document; 0 without any."""
    return words.groupBy(_DOC).agg(
        F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"),
        F.count("conf").alias("word_count"),
    )


def choose_engine(primary: str, alternate: str, threshold: float = OCR_CONFIDENCE_THRESHOLD) -> dict[str, Column]:
    """Columns of the winning engine, for a row that holds a struct of each engine's result (or null).

    The alternate replaces a failed primary, or a weak one if it is strictly more confident.
    """
    p, a = F.col(primary), F.col(alternate)
    failed = p["raw_text"].isNull()
    weak = p["confidence"] < threshold
    better = weak & a["raw_text"].isNotNull() & (F.coalesce(a["confidence"], F.lit(0.0)) > p["confidence"])
    chosen = F.when(failed | better, a).otherwise(p)
    return {
        "raw_text": py_strip(F.coalesce(chosen["raw_text"], F.lit(""))),
        "confidence": py_round(F.coalesce(chosen["confidence"], F.lit(0.0)), 4),
        "engine_used": F.coalesce(F.when(chosen["raw_text"].isNotNull(), chosen["engine"]), F.lit("none")),
        "page_count": F.coalesce(p["page_count"], a["page_count"], F.lit(0).cast("bigint")),
        "ocr_time_ms": F.when(chosen["raw_text"].isNotNull(), chosen["time_ms"]),
    }


def result_struct(df: DataFrame) -> Column:
    """An engine's result as one column; its ``time_ms`` is null if not measured."""
    time = (F.col("time_ms") if "time_ms" in df.columns else F.lit(None)).cast("double").alias("time_ms")
    return F.struct("engine", "raw_text", "confidence", "page_count", time)


def engine_result(df: DataFrame, name: str) -> DataFrame:
    """``doc_id`` plus one struct column ``name`` with an engine's result."""
    return df.select("doc_id", result_struct(df).alias(name))


def reconcile_ocr(
    primary: DataFrame, alternate: DataFrame, threshold: float = OCR_CONFIDENCE_THRESHOLD
) -> DataFrame:
    """One row per document known to either engine. Inputs have one row per document."""
    both = engine_result(primary, "p").join(engine_result(alternate, "a"), "doc_id", "full_outer")
    chosen = choose_engine("p", "a", threshold)
    return both.select("doc_id", *[c.alias(n) for n, c in chosen.items()])


def flag_ocr(df: DataFrame, threshold: float = OCR_CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add ``status_code``/``reason`` (422 for blank text) and ``warnings`` (low confidence)."""
    blank = py_strip(F.coalesce("raw_text", F.lit(""))) == ""
    prefix, suffix = LOW_CONFIDENCE_WARNING.split("%.2f")
    warning = F.concat(F.lit(prefix), two_decimals(F.col("confidence")), F.lit(suffix))
    weak = ~blank & (F.col("confidence") < threshold)
    return df.withColumns(
        {
            "status_code": F.when(blank, 422).otherwise(200),
            "reason": F.when(blank, BLANK_TEXT),
            "warnings": F.array_compact(F.array(F.when(weak, warning))),
        }
    )
