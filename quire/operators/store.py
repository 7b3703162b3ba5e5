"""The document index: building rows, last-write-wins upserts, statistics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.sizing import hinted, is_small
from quire.functions.text import decimal_text


def as_text(value: Column, kind: str) -> Column:
    """Text of a metadata value."""
    return decimal_text(value) if kind in ("double", "float") else value.cast("string")


def build_index_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "raw_text",
    extracted_at: str = "created_at",
    extra: tuple[str, ...] = ("filename", "confidence", "prompt_version"),
) -> DataFrame:
    """``id``, ``text`` and ``metadata`` (text to text) for each document.

    ``extra`` columns are turned into text and win over the standard entries of the same name; the
    overridden names are known here, so they are left out and the map never has a key twice.
    """
    kinds = dict(df.dtypes)
    if kinds[extracted_at].startswith("timestamp"):
        stamp = F.date_format(extracted_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        stamp = F.col(extracted_at).cast("string")
    standard = {
        "document_type": F.col("document_type"),
        "extracted_at": stamp,
        "field_count": F.col("fields_extracted").cast("string"),
    }
    entries = {k: v for k, v in standard.items() if k not in extra}
    entries |= {name: as_text(F.col(name), kinds[name]) for name in extra}
    flat = [part for name, value in entries.items() for part in (F.lit(name), value)]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.create_map(*flat).alias("metadata"))


def latest_per_id(
    df: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("seq",), within: tuple[str, ...] = ()
) -> DataFrame:
    """The row of each id that comes last in ``order``.

    The rank filter is applied before the shuffle as well, so an id written very often sends one row per
    task. Rows already partitioned by ``within``, which the id decides, are not shuffled again.
    """
    newest = Window.partitionBy(*within, id_col).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def newest_of(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: the highest ``seq``; of equal ones an update (``_update`` = 1), then the text's hash decides."""
    tie = rows.withColumn("_tie", F.xxhash64("text"))
    return latest_per_id(tie, order=("seq", "_update", "_tie"), within=within).drop("_update", "_tie")


def upsert_documents(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per id, the highest ``seq`` wins; on equal ``seq`` an update replaces the current row.

    ``current`` has one row per id; ``updates`` may have many. Null is an id like any other. Rows of ids
    without an update pass through as they are: without a shuffle while the updated ids fit a broadcast, and
    through a shuffle join beyond that, with the same result. Returns the new table; write it to a new folder,
    never over the one being read.
    """
    ids = updates.select(F.col("id").alias("_updated")).distinct()
    ids = hinted(ids, is_small(ids))
    same = F.col("id").eqNullSafe(F.col("_updated"))
    untouched = current.join(ids, same, "left_anti")
    touched = current.join(ids, same, "left_semi")
    rows = touched.withColumn("_update", F.lit(0)).unionByName(updates.withColumn("_update", F.lit(1)))
    newest = newest_of(rows)
    return untouched.select(newest.columns).unionByName(newest)


def collection_stats(docs: DataFrame) -> DataFrame:
    """Documents per type and in all (``document_type`` = ``*``), in one pass."""
    by_type = docs.groupBy(F.col("metadata")["document_type"].alias("document_type")).agg(
        F.count(F.lit(1)).alias("total_documents")
    )
    # only one row per type is left; the total is always present, also for an empty collection
    total = by_type.agg(
        F.lit("*").alias("document_type"), F.coalesce(F.sum("total_documents"), F.lit(0)).alias("total_documents")
    )
    return by_type.unionByName(total)
