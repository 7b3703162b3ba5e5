"""Upload routing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import ALLOWED_EXTENSIONS, DOCUMENT_TYPES, MAX_FILE_SIZE_MB, NO_FILENAME
from quire.functions.text import content_id


def route_uploads(df: DataFrame, max_mb: int = MAX_FILE_SIZE_MB) -> DataFrame:
    """Add ``extension``, ``status_code`` and ``reason``: 200 accepted, 400 name or type, 413 size, 422 request.

    Needs ``filename`` and ``size``. The first failing rule decides; an unknown or zero size passes. Where there is a
    ``requested_type``, one that is not declared is refused before all else; null asks for none.
    """
    name = F.coalesce(F.col("filename"), F.lit(""))
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    unnamed = name == ""
    unsupported = ~F.col("extension").isin(ALLOWED_EXTENSIONS)
    oversized = F.coalesce(F.col("size") > max_mb * 1024 * 1024, F.lit(False))
    undeclared = F.lit(False)
    if "requested_type" in df.columns:
        undeclared = F.coalesce(~F.col("requested_type").isin(DOCUMENT_TYPES), F.lit(False))
    dotted = F.when(name.contains("."), F.concat(F.lit("."), F.col("extension"))).otherwise("")
    allowed = ", ".join(f"'.{e}'" for e in sorted(ALLOWED_EXTENSIONS))
    return df.withColumn("extension", extension).withColumns(
        {
            "status_code": F.when(undeclared, 422).when(unnamed | unsupported, 400).when(oversized, 413).otherwise(200),
            "reason": F.when(undeclared, F.lit(f"Unknown document type. Declared: {', '.join(DOCUMENT_TYPES)}"))
            .when(unnamed, NO_FILENAME)
            .when(unsupported, F.concat(F.lit("Unsupported file type: "), dotted, F.lit(f". Allowed: {{{allowed}}}")))
            .when(oversized, f"File too large. Max size: {max_mb}MB"),
        }
    )


def with_document_ids(df: DataFrame, content: list[str], out: str = "document_id") -> DataFrame:
    """Fill in ``document_id`` where it is null or absent: an id made from the columns ``content``.

    The same content gets the same id whenever and wherever it is made, so a repeated upload stays one document.
    """
    made = content_id(*content)
    return df.withColumn(out, F.coalesce(F.col(out), made) if out in df.columns else made)
