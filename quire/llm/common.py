"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.paths import work_dir

# bytes that separate words: blank and the five ASCII control characters for white space (a fixed value)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixed(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read again.

    Cuts the lineage: what is read later is the same whatever executors are lost, and is computed once.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``fixed`` wrote and that no later plan reads."""
    for stored in tables:
        path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
        path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it holds at most ``max_rows`` (narrow) rows, else as it is.

    Counts at most ``max_rows + 1`` rows. Without the hint Spark joins by shuffle; the rows are the same.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python tasks get at most ``rows`` texts at a time; texts can be long, and every batch is held twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def task_number() -> int:
    """Number of the running task's partition; the same when the task is tried again."""
    return TaskContext.get().partitionId()


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once per worker process and key.

    The package's functions travel to the executors by value, each job with globals of its own, so what
    should outlive a task hangs on a module of its own.
    """
    kept = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
