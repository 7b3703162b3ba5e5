"""Streams of documents and runs.

Rows later than the watermark are dropped by Spark and counted in the query's progress
(``numRowsDroppedByWatermark``).
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.fixed_values import DRIFT_WINDOW, SCRAPE_WINDOW
from quire.operators.embed import EmbeddingModel, embed_text
from quire.operators.metrics import bucket_counts, bucket_rows
from quire.operators.ocr import result_struct
from quire.operators.runs import check_drift, latest_runs_per_type
from quire.operators.store import latest_per_id
from quire.plans.documents import process_documents
from quire.streaming import snapshots


def read_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """One of the given tables as a stream, whether it is a single file or a folder of files."""
    # a pattern: the stream source takes a plain path for a folder
    return read_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


# state of whole documents outgrows an executor's heap: RocksDB keeps it on local disk, in bounded memory, one store
# per join and partition. Texts are packed in large blocks; large batches have a snapshot written with every commit, beside
# which a log of changes would be a second copy
_DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "64",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state on disk; the session's own settings come back after that.

    A query takes its settings when it starts; one that goes on from a checkpoint keeps those it began with.
    """
    before = {name: spark.conf.get(name, None) for name in _DISK_STATE}
    for name, value in _DISK_STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, taking all input that is there and then stopping."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def stream_extract(gathered: DataFrame, prompts: DataFrame, **limits) -> DataFrame:
    """Result rows for a stream of gathered documents; ``prompts`` is a plain table."""
    return process_documents(gathered, prompts, **limits)


def stream_gather(
    uploads: DataFrame,
    primary: DataFrame,
    alternate: DataFrame,
    responses: DataFrame,
    within: str = "1 hour",
    watermark: str = "10 minutes",
    time_col: str = "event_time",
) -> DataFrame:
    """Rows as ``documents.gather`` makes them, from four streams that each have ``doc_id`` and a time.

    An engine's result or an answer belongs to an upload if it comes at the upload's time or up to ``within`` after it.
    A row is ready once all watermarks have passed that span; what has not come by then is null, as for an engine that
    failed. Results later than that, or than their own watermark, join nothing: the row went out without them. Each
    side has at most one row per document. State holds ``within`` and ``watermark`` of each stream, no more; these are
    whole texts, so start the query under ``state_on_disk``.
    """
    failed = F.col("error") if "error" in responses.columns else F.lit(None)
    answers = responses.select("doc_id", "raw", failed.cast("string").alias("error_type"), F.col(time_col).alias("_at"))
    sides = []
    for side, name in ((primary, "primary"), (alternate, "alternate")):
        sides.append(side.select("doc_id", result_struct(side).alias(name), F.col(time_col).alias("_at")))
    gathered = uploads.withWatermark(time_col, watermark)
    for side in (*sides, answers):
        right = side.withColumnRenamed("doc_id", "_id").withWatermark("_at", watermark)
        at, limit = F.col("_at"), F.col(time_col) + F.expr(f"INTERVAL {within}")
        met = (F.col("doc_id") == F.col("_id")) & (at >= F.col(time_col)) & (at <= limit)
        gathered = gathered.join(right, met, "left").drop("_id", "_at")
    return gathered.drop(time_col)


def _windowed(runs: DataFrame, labels: list[str], window: str, watermark: str, slide: str | None, time_col: str):
    spans = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return runs.withWatermark(time_col, watermark).groupBy(spans.alias("window"), *labels)


def _span() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def stream_counts(
    runs: DataFrame,
    labels: list[str],
    window: str = SCRAPE_WINDOW,
    watermark: str = "1 minute",
    slide: str | None = None,
    time_col: str = "start_time",
) -> DataFrame:
    """Rows per time window and label set; a window is emitted once it is closed. Also runs on tables."""
    grouped = _windowed(runs, labels, window, watermark, slide, time_col)
    return grouped.agg(F.count(F.lit(1)).alias("total")).select(*_span(), *labels, "total")


def stream_histogram(
    runs: DataFrame,
    value: str,
    bounds: list[float],
    labels: list[str],
    window: str = SCRAPE_WINDOW,
    watermark: str = "1 minute",
    slide: str | None = None,
    time_col: str = "start_time",
) -> DataFrame:
    """Cumulative histogram per time window and label set, as ``histogram``. Also runs on tables."""
    grouped = _windowed(runs, labels, window, watermark, slide, time_col)
    counted = grouped.agg(*bucket_counts(F.expr(value).cast("double"), bounds))
    return bucket_rows(counted, bounds, [*_span(), *labels])


def stream_dedup(
    stream: DataFrame, id_cols: list[str], time_col: str = "start_time", watermark: str = "1 hour"
) -> DataFrame:
    """Drop rows whose ids were seen within the watermark; the first one stays. For exact re-sends."""
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(id_cols)


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, model: EmbeddingModel | None = None) -> StreamingQuery:
    """Keep a document table up to date from a stream of index rows (id, seq, text, ...).

    Each batch writes its own folder, reduced to one row per id, and commits it as a new snapshot, so the cost follows
    the batch and not the table; a batch that was committed before is not written again. With ``model`` the texts are
    embedded on the way. ``read_documents`` gives the current rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Spark names every checkpoint in its metadata: a renewed one starts at batch 0 in folders of its own
        run = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        if snapshots.read_snapshot(spark, path).committed.get(run, -1) >= batch_id:
            return
        newest = latest_per_id(batch.withColumn("_tie", F.xxhash64("text")), order=("seq", "_tie")).drop("_tie")
        newest = newest if model is None else embed_text(newest, model)
        newest.write.mode("overwrite").parquet(snapshots.folder(path, run, batch_id))
        snapshots.append(spark, path, run, batch_id)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_documents(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Current rows of a table kept by ``stream_upsert``, or those of a snapshot: highest ``seq``, then latest commit."""
    return snapshots.read_rows(spark, path, snapshots.read_snapshot(spark, path, version))


def stream_drift(runs: DataFrame, path: str, checkpoint: str, window: int = DRIFT_WINDOW) -> StreamingQuery:
    """Drift status of every type after each batch, in ``{path}/status``.

    The state is the newest 2 x ``window`` runs per type, ordered by start time, so late rows find their
    place. It is kept in two folders used in turn: a batch reads the one its predecessor wrote and
    overwrites the other, so a repeated batch finds its input intact. Each batch is cut to the newest
    rows per type before its shuffle, however many rows one type has.
    """

    columns = ["document_type", "start_time", "run_id", "extraction_confidence"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = batch.select(*columns)
        if batch_id > 0:
            known = known.unionByName(spark.read.parquet(f"{path}/state_{(batch_id - 1) % 2}"))
        newest = latest_runs_per_type(known, 2 * window).drop("recency")
        state = f"{path}/state_{batch_id % 2}"
        newest.write.mode("overwrite").parquet(state)
        status = check_drift(spark.read.schema(newest.schema).parquet(state), window=window)
        status.coalesce(1).write.mode("overwrite").parquet(f"{path}/status/batch_id={batch_id}")

    writer = runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest_drift(spark: SparkSession, path: str) -> DataFrame:
    """Status rows of the newest batch written by ``stream_drift``."""
    status = spark.read.parquet(f"{path}/status")
    last = status.agg(F.max("batch_id").alias("_last"))
    return status.join(F.broadcast(last), F.col("batch_id") == F.col("_last")).drop("_last", "batch_id")


DRIFT_STATE = "document_type string, part int, runs array<struct<start_time: timestamp, run_id: bigint, confidence: double>>, idle boolean"
_PARTS = 8


def _newest_runs(window: int, idle_after_ms: int):
    """Keeps the newest 2 x ``window`` runs of a key and passes them on; after a while without any, says so once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        idle = state.hasTimedOut
        if not idle:
            for batch in batches:
                kept += zip(batch["_micros"].tolist(), batch["run_id"].tolist(), batch["extraction_confidence"].astype(float).tolist())
                kept = sorted(kept, key=lambda r: r[:2], reverse=True)[: 2 * window]
            state.update(tuple(list(c) for c in zip(*kept)))
            if idle_after_ms:
                newest = max(r[0] for r in kept) // 1000
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_after_ms)
        runs = [{"start_time": pd.Timestamp(t, unit="us"), "run_id": i, "confidence": None if c != c else c} for t, i, c in kept]
        yield pd.DataFrame({"document_type": [key[0]], "part": [key[1]], "runs": [runs], "idle": [idle]})

    return step


def stream_drift_keyed(
    runs: DataFrame,
    path: str,
    checkpoint: str,
    window: int = DRIFT_WINDOW,
    parts: int = _PARTS,
    idle_after_ms: int = 0,
    watermark: str = "1 day",
) -> StreamingQuery:
    """Drift status with keyed state: as ``stream_drift``, but a batch touches only the types it has runs of.

    A key is a type and one of ``parts`` parts of it, so that a type with most of the runs is kept by several tasks; a
    key's state is its newest 2 x ``window`` runs, in the checkpoint. Each batch writes the lists of its keys to
    {path}/parts; ``latest_keyed_drift`` merges the last list of every key. With ``idle_after_ms`` a key whose newest
    run lies so long before the watermark comes out once more, marked idle; runs later than the watermark are then
    dropped.
    """
    part = F.pmod(F.xxhash64("run_id"), F.lit(parts)).cast("int")
    runs = runs.withColumn("start_time", F.col("start_time").cast("timestamp"))
    runs = runs.withWatermark("start_time", watermark) if idle_after_ms else runs
    known = runs.select("document_type", part.alias("part"), "run_id", "start_time", F.unix_micros("start_time").alias("_micros"), "extraction_confidence")
    timeout = GroupStateTimeout.EventTimeTimeout if idle_after_ms else GroupStateTimeout.NoTimeout
    lists = known.groupBy("document_type", "part").applyInPandasWithState(
        _newest_runs(window, idle_after_ms), DRIFT_STATE, "micros array<bigint>, ids array<bigint>, confidences array<double>", "update", timeout
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/parts/batch_id={batch_id}")

    return lists.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_keyed_drift(spark: SparkSession, path: str, window: int = DRIFT_WINDOW) -> DataFrame:
    """Status rows of ``stream_drift_keyed`` as of its last batch, with ``idle``: whether all of a type's parts are."""
    lists = spark.read.parquet(f"{path}/parts")
    last = lists.groupBy("document_type", "part").agg(F.max_by(F.struct("runs", "idle"), "batch_id").alias("last"))
    kept = last.select("document_type", F.explode("last.runs").alias("run")).select(
        "document_type", "run.start_time", "run.run_id", F.col("run.confidence").alias("extraction_confidence")
    )
    idle = last.groupBy("document_type").agg(F.bool_and("last.idle").alias("idle"))
    return check_drift(kept, window=window).join(F.broadcast(idle), "document_type")


class LateRows(StreamingQueryListener):
    """Writes, per batch of every query, how many rows came later than the watermark, to a table ({path}, Parquet).

    Add it with ``spark.streams.addListener``. Batches without late rows leave none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = [(i, s.operatorName, s.numRowsDroppedByWatermark) for i, s in enumerate(progress.stateOperators) if s.numRowsDroppedByWatermark]
        rows = [(str(progress.id), str(progress.runId), progress.name, progress.batchId, progress.timestamp, *d) for d in dropped]
        if rows:
            kind = "query_id string, run_id string, name string, batch_id long, at string, operator int, operator_name string, rows_dropped long"
            self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
