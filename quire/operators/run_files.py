"""A long run log in time-clustered files, read from the newest back until every type has its rows.

An append writes rows sorted by type, start time and run id, so that a file holds a stretch of time of one type or
of a few, and beside them an index: first and last time and rows of every (file, type). The log's snapshots list both.
The newest rows are found from the index alone; files that cannot hold one are not opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.ranking import first_per_group
from quire.streaming import snapshots

ROWS_PER_FILE = 1_000_000
_ORDER = ("document_type", "start_time", "run_id")


def _index_folder(path: str, run: str, batch: int) -> str:
    return f"{path}/index/run={run}/batch_id={batch}"


def append_clustered(runs: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> snapshots.Snapshot:
    """Add rows to the log at ``path``; readers see all of them or none. No row, no new snapshot.

    The range partitioning samples the order columns, so a type with most of the rows is split by time into as many
    files as any others. A null type is a type, a null time is older than any other.
    """
    spark, name = runs.sparkSession, uuid.uuid4().hex
    data = snapshots.folder(path, name, 0)
    clustered = runs.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    clustered.write.option("maxRecordsPerFile", rows_per_file).parquet(data)
    written = spark.read.schema(runs.schema).parquet(data)
    time = F.col("start_time")
    index = written.groupBy(F.col("_metadata.file_path").alias("file"), "document_type").agg(
        F.when(F.count_if(time.isNull()) == 0, F.min(time)).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count(F.lit(1)).alias("rows"),
    )
    index.write.parquet(_index_folder(path, name, 0))
    if spark.read.schema(index.schema).parquet(_index_folder(path, name, 0)).isEmpty():
        return snapshots.read_snapshot(spark, path)
    return snapshots.append(spark, path, name, 0)


def _of_type(document_type: str | None) -> Column:
    return F.lit(True) if document_type is None else F.col("document_type") == document_type


def needed_files(index: DataFrame, n: int) -> DataFrame:
    """document_type, file: the files that can hold one of the newest ``n`` rows of a type.

    Files are counted from the latest first time back. Once they hold ``n`` rows, no row older than the first time
    reached can be among the newest; a file is needed if its last time is not older than that. As every file holds a
    row, the ``n`` files of latest first time decide, and the count never sees more than that of a type.
    """
    back = [F.col("first_time").desc_nulls_last(), F.col("file")]
    latest = first_per_group(index, ["document_type"], back, n, spread_by="file", rank="_place")
    so_far = Window.partitionBy("document_type").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    counted = latest.withColumn("_rows", F.sum("rows").over(so_far))
    reached = counted.where(F.col("_rows") >= n).groupBy(F.col("document_type").alias("_type"))
    reached = reached.agg(F.max("first_time").alias("_bound"))
    same = F.col("document_type").eqNullSafe(F.col("_type"))
    bounded = index.join(reached, same, "left")
    return bounded.where(F.col("_bound").isNull() | (F.col("last_time") >= F.col("_bound"))).select("document_type", "file")


def read_newest(
    spark: SparkSession, path: str, n: int, document_type: str | None = None, version: int | None = None
) -> DataFrame:
    """Rows of the log that include the newest ``n`` of every type, or of one; older ones may be among them.

    Give them to ``latest_runs``, ``check_drift`` (n = 2 x window) or ``compare_prompts`` (n = limit): the result is
    that of the whole log. The driver gets the names of the files to open, as with any read. Appends whose times
    overlap make more files needed, never a different result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    snapshot = snapshots.read_snapshot(spark, path, version)
    if not snapshot.folders:
        raise ValueError(f"nothing was committed to {path} yet")
    index = spark.read.parquet(*[_index_folder(path, *f) for f in snapshot.folders]).where(_of_type(document_type))
    files = sorted({row["file"] for row in needed_files(index, n).select("file").distinct().toLocalIterator()})
    if not files:
        schema = spark.read.parquet(snapshots.folder(path, *snapshot.folders[-1])).schema
        return spark.createDataFrame([], schema)
    return spark.read.schema(spark.read.parquet(files[-1]).schema).parquet(*files).where(_of_type(document_type))
