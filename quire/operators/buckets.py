"""A document table in hash buckets: an upsert rewrites the buckets it touches and leaves all other files alone.

A bucket is a folder that is written once. A snapshot names the folder of every bucket; an upsert writes new folders
for its buckets and publishes a snapshot that names them, so readers see all of it or nothing, and writers of other
buckets do not disturb each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.sizing import hinted, is_small
from quire.operators.store import latest_per_id, newest_of
from quire.streaming import snapshots

BUCKETS = 256
_TRIES = 20


def bucket_of(buckets: int) -> Column:
    """The bucket of ``id``; null is an id like any other."""
    return F.pmod(F.xxhash64("id"), F.lit(buckets))


def _folders(path: str, found: list[tuple[str, int]]) -> list[str]:
    return [snapshots.folder(path, *f) for f in found]


def _merged(spark: SparkSession, path: str, old: list[tuple[str, int]], updates: DataFrame, buckets: int) -> DataFrame:
    rows = updates.withColumn("_update", F.lit(1))
    if old:
        current = spark.read.schema(updates.schema).parquet(*_folders(path, old))
        rows = rows.unionByName(current.withColumn("_update", F.lit(0)))
    # one shuffle by bucket serves the ranking and the write
    return newest_of(rows.withColumn("bucket", bucket_of(buckets)).repartition("bucket"), within=("bucket",))


def upsert_buckets(updates: DataFrame, path: str, buckets: int = BUCKETS) -> snapshots.Snapshot:
    """Merge ``updates`` (id, seq, text, ...) into the table at ``path`` by the rule of ``upsert_documents``.

    The first upsert makes the table and fixes its number of ``buckets``; choose it so that a bucket's rows fit a
    task (about 1 GB: 100,000 for 100 TB). An id written very often is cut to its newest row before it is sent
    anywhere. If another writer changed one of the same buckets meanwhile, the merge is done again on its result.
    Only the numbers of the touched buckets reach the driver. No update, no new snapshot.
    """
    spark = updates.sparkSession
    for _ in range(_TRIES):
        before = snapshots.read_snapshot(spark, path)
        count = before.buckets or buckets
        ranked = latest_per_id(updates.withColumn("_tie", F.xxhash64("text")), order=("seq", "_tie")).drop("_tie")
        touched = {row[0] for row in updates.select(bucket_of(count)).distinct().collect()}
        if not touched:
            return before
        old = [f for f in before.folders if f[1] in touched]
        name = uuid.uuid4().hex
        merged = _merged(spark, path, old, ranked, count).withColumnRenamed("bucket", "batch_id")
        merged.write.partitionBy("batch_id").parquet(f"{path}/data/run={name}")
        new = [(name, b) for b in sorted(touched)]

        def change(now: snapshots.Snapshot, count=count, touched=touched, old=old, new=new) -> snapshots.Snapshot | None:
            if now.buckets not in (0, count) or [f for f in now.folders if f[1] in touched] != old:
                return None  # another writer was first
            others = [f for f in now.folders if f[1] not in touched]
            return snapshots.Snapshot(0, True, [*others, *new], now.committed, count)

        after = snapshots.commit(spark, path, change)
        if new[0] in after.folders:
            return after
    raise RuntimeError(f"{_TRIES} other upserts to {path} came first")


def read_buckets(spark: SparkSession, path: str, ids: list[str | int] | None = None, version: int | None = None) -> DataFrame:
    """The table's rows, one per id; with ``ids`` those rows, from the buckets of these ids alone."""
    snapshot = snapshots.read_snapshot(spark, path, version)
    if not snapshot.folders:
        raise ValueError(f"nothing was committed to {path} yet")
    schema = spark.read.parquet(_folders(path, snapshot.folders[:1])[0]).schema
    if ids is None:
        return spark.read.schema(schema).parquet(*_folders(path, snapshot.folders))
    asked = spark.createDataFrame([(i,) for i in ids], f"id {schema['id'].dataType.simpleString()}")
    wanted = {row[0] for row in asked.select(bucket_of(snapshot.buckets)).distinct().collect()}
    found = [f for f in snapshot.folders if f[1] in wanted]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*_folders(path, found))
    asked = asked.distinct().withColumnRenamed("id", "_id")
    return rows.join(hinted(asked, is_small(asked)), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
