"""Two-pass external shuffle into shards, with DataFrame functions only.

First pass: records are scattered uniformly over buckets that fit in memory, by a seeded hash. Second pass:
each bucket gets a seeded Fisher-Yates shuffle (Spark's ``shuffle`` of its record numbers) and is laid out.
The buckets one after the other are the shuffled corpus; shards are slices of it, so that their row counts
differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fixed, free_name, text_or_empty

BUCKET_BYTES = 32 * 1024 * 1024
RECORD_BYTES = 16  # counted for each record besides its text
SHARDS = 40


def shuffle_into_shards(
    records: DataFrame,
    keys: list[Column],
    size: Column,
    shards: int = SHARDS,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``records`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``keys`` tell records apart: they seed the scatter and number the records of a bucket before the
    shuffle. Records equal in all keys are interchangeable. ``size`` (bytes, not null) sets the number of
    buckets. Every record is placed, with nulls and repeats; an empty table gives an empty result. A column
    named ``shard`` or ``slot`` is kept; the new one then gets an underscore. Other columns are carried along.
    """
    total = records.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    buckets = int(total // bucket_bytes) + 1
    keys = [key.alias(f"key{i}") for i, key in enumerate(keys)]
    scattered = records.select(F.struct("*").alias("record"), *keys)
    by = scattered.columns[1:]
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(buckets)))
    numbered = scattered.withColumn("number", F.row_number().over(Window.partitionBy("bucket").orderBy(*by)))

    # written, so that a lost executor cannot make a bucket be shuffled in another way
    held = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("bucket")
    numbers = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    perms = fixed(held.select("bucket", "n", F.shuffle(numbers, F.lit(seed)).alias("places")), "places")
    rows = perms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per bucket
    starts = perms.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    perms = perms.join(starts, "bucket").select("bucket", "start", "places")

    placed = numbered.join(perms, "bucket")
    placed = placed.select("record", (F.col("start") + F.element_at("places", F.col("number"))).alias("index"))
    placed = placed.withColumn("shard", F.expr(f"(index * {shards}L) div {max(rows, 1)}L"))
    # the first index of shard s is ceil(s * rows / shards)
    slot = F.col("index") - F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    shard_name, slot_name = free_name(records, "shard"), free_name(records, "slot")
    return placed.select("record.*", F.col("shard").cast("int").alias(shard_name), slot.alias(slot_name))


def record_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + RECORD_BYTES


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Documents with their shard and slot; documents are told apart by id and text."""
    keys = [F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")]
    return shuffle_into_shards(docs, keys, record_size(), shards, seed)


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed records to one folder per shard, in slot order within files.

    A bucket is a run of the shuffled corpus, so its task writes its slices of the shards without another shuffle.
    """
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
