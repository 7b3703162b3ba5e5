"""Streams equal their batch forms; late rows, repeated batches and restarts."""

import datetime as dt
import glob
import time

import pytest
from pyspark.sql import functions as F

from quire.fixed_values import CONFIDENCE_BOUNDS
from quire.operators import metrics, runs, store
from quire.operators.prompts import prompt_registry
from quire.plans import documents
from quire.plans.registry import QUERIES
from quire.sources import derived
from quire.sources.uploads import scan_uploads
from quire.streaming import snapshots, streams


def write_by_day(log, path, days):
    """One file per range of days, in the order given."""
    for i, (first, last) in enumerate(days):
        part = log.where(F.dayofmonth("start_time").between(first, last))
        part.coalesce(1).write.mode("append").parquet(f"{path}/part-{i}")


DAYS = [(1, 6), (7, 12), (13, 18), (19, 24), (25, 31)]


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    df = derived.runs(spark, sf_dir).cache()
    yield df
    df.unpersist()


def files(spark, path, schema, per_batch=1):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true")
        .parquet(path)
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(spark, stream, folder, name="out"):
    query = streams.write_stream(stream, f"{folder}/{name}", f"{folder}/{name}-checkpoint")
    query.awaitTermination()
    return query, spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def test_closed_windows_equal_batch(spark, log, folder):
    write_by_day(log, folder + "/in", DAYS)
    stream = files(spark, folder + "/in", log.schema)
    for name, make in {
        "counts": lambda df: streams.stream_counts(df, ["document_type", "status"], "6 hours", "30 minutes"),
        "buckets": lambda df: streams.stream_histogram(
            df, "ocr_confidence", CONFIDENCE_BOUNDS, ["ocr_engine"], "1 day", "30 minutes"
        ),
    }.items():
        _, got = run(spark, make(stream), folder, name)
        latest = log.agg(F.max("start_time")).first()[0] - dt.timedelta(minutes=30)
        closed = make(log).where(F.col("window_end") <= F.lit(latest))
        drop = ["total_sum"] if name == "buckets" else []
        assert rows(got.drop(*drop)) == rows(closed.drop(*drop)) and got.count() > 0


def test_late_rows_are_dropped_and_counted(spark, log, folder):
    first = log.where("dayofmonth(start_time) > 1")
    late = log.where("dayofmonth(start_time) = 1")
    make = lambda df: streams.stream_counts(df, ["document_type"], "1 day", "1 hour")
    first.coalesce(1).write.parquet(folder + "/in")
    run(spark, make(files(spark, folder + "/in", log.schema)), folder)
    late.coalesce(1).write.mode("append").parquet(folder + "/in")
    query, got = run(spark, make(files(spark, folder + "/in", log.schema)), folder)
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped > 0
    assert got.where("dayofmonth(window_start) = 1").count() == 0


def test_dedup_keeps_one_of_each(spark, log, folder):
    log.coalesce(1).write.parquet(folder + "/in")
    log.coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = streams.stream_dedup(files(spark, folder + "/in", log.schema, 2), ["run_id"])
    _, got = run(spark, stream.select("run_id"), folder)
    assert got.count() == log.count() == got.distinct().count()


def test_upserts_over_batches_restarts_and_repeats(spark, folder):
    kind = "id long, seq long, text string, metadata map<string,string>"
    batches = [
        [(1, 0, "a", {}), (2, 0, "b", {}), (1, 1, "a1", {})],
        [(2, 2, "b2", {}), (3, 0, "c", {}), (1, 0, "late", {})],
        [(3, 1, "c1", {}), (2, 1, "late", {})],
    ]
    table, checkpoint = folder + "/table", folder + "/checkpoint"
    everything = None
    for part in batches:
        df = spark.createDataFrame(part, kind)
        df.coalesce(1).write.mode("append").parquet(folder + "/in")
        everything = df if everything is None else everything.unionByName(df)
        stream = files(spark, folder + "/in", df.schema)
        streams.stream_upsert(stream, table, checkpoint).awaitTermination()
    want = {r["id"]: r["text"] for r in store.upsert_documents(everything.limit(0), everything).collect()}
    assert want == {1: "a1", 2: "b2", 3: "c1"}
    assert {r["id"]: r["text"] for r in streams.read_documents(spark, table).collect()} == want
    # the same input once more from the start: a new checkpoint writes folders of its own, with the same rows
    again = streams.stream_upsert(files(spark, folder + "/in", df.schema), table, folder + "/other")
    again.awaitTermination()
    assert {r["id"]: r["text"] for r in streams.read_documents(spark, table).collect()} == want


def texts_of(df):
    return {r["id"]: r["text"] for r in df.collect()}


def test_snapshots_with_concurrent_compaction_and_restart(spark, folder, monkeypatch):
    kind = "id long, seq long, text string, metadata map<string,string>"
    table, checkpoint = folder + "/table", folder + "/checkpoint"

    def arrive(*part):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = files(spark, folder + "/in", spark.createDataFrame([], kind).schema)
        streams.stream_upsert(stream, table, checkpoint).awaitTermination()

    assert snapshots.read_snapshot(spark, table).version == 0
    with pytest.raises(ValueError, match="nothing was committed"):
        streams.read_documents(spark, table)
    arrive((1, 0, "a", {}), (2, 0, "b", {}))
    arrive((1, 1, "a1", {}))
    assert snapshots.read_snapshot(spark, table).version == 2
    pinned = streams.read_documents(spark, table, version=1)

    # a batch commits between what the compaction reads and what it publishes; so does another writer's manifest
    publish = snapshots._published
    calls = []

    def interrupted(spark_, path, snapshot):
        calls.append(snapshot)
        if len(calls) == 1:
            monkeypatch.setattr(snapshots, "_published", publish)
            arrive((2, 1, "b1", {}), (3, 0, "c", {}))
        return publish(spark_, path, snapshot)

    monkeypatch.setattr(snapshots, "_published", interrupted)
    done = snapshots.compact(spark, table)
    assert done.version == 4 and done.base and len(done.folders) == 2
    want = {1: "a1", 2: "b1", 3: "c"}
    assert texts_of(streams.read_documents(spark, table)) == want
    assert texts_of(pinned) == {1: "a", 2: "b"}

    # restart: nothing new arrives, and a batch that is tried again is not committed twice
    arrive()
    run = next(iter(done.committed))
    assert snapshots.append(spark, table, run, 0).version == snapshots.read_snapshot(spark, table).version
    assert texts_of(streams.read_documents(spark, table)) == want

    # two compactions of the same snapshot: the second finds it gone and leaves the table alone
    snapshots.compact(spark, table)
    newest = snapshots.read_snapshot(spark, table)
    assert newest.base and len(newest.folders) == 1 and texts_of(streams.read_documents(spark, table)) == want
    old = snapshots.expire(spark, table, keep=1)
    assert old == list(range(1, newest.version)) and texts_of(streams.read_documents(spark, table)) == want
    with pytest.raises(ValueError, match="no snapshot 1"):
        streams.read_documents(spark, table, version=1)
    arrive((1, 1, "a2 of the same seq", {}), (4, 0, "d", {}))
    assert texts_of(streams.read_documents(spark, table)) == want | {1: "a2 of the same seq", 4: "d"}


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [1, 2, 4, 3, 0]])
def test_drift_equals_batch_at_the_end(spark, log, folder, order):
    seen = None
    for i in order:
        part = log.where(F.dayofmonth("start_time").between(*DAYS[i]))
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        seen = part if seen is None else seen.unionByName(part)
        stream = files(spark, folder + "/in", log.schema)
        streams.stream_drift(stream, folder + "/drift", folder + "/checkpoint", window=20).awaitTermination()
        assert rows(streams.latest_drift(spark, folder + "/drift")) == rows(runs.check_drift(seen, window=20))


def test_stream_of_documents_equals_batch(spark, sf_dir, folder):
    inputs = derived.document_run_inputs(spark, sf_dir)
    documents.gather(**inputs).repartition(3).write.parquet(folder + "/in")
    schema = spark.read.parquet(folder + "/in").schema
    registry = prompt_registry(spark)
    columns = ["doc_id", "status_code", "document_type", "prompt_key", "parse_path", "confidence_score", "warnings"]
    stream = streams.stream_extract(files(spark, folder + "/in", schema), registry).select(columns)
    _, got = run(spark, stream, folder)
    batch = documents.process_documents(spark.read.parquet(folder + "/in"), registry).select(columns)
    assert rows(got) == rows(batch)


def test_four_streams_equal_batch_with_an_answer_that_never_comes(spark, sf_dir, folder):
    inputs = {name: df.where("doc_id <= 300") for name, df in derived.document_run_inputs(spark, sf_dir).items()}
    inputs["responses"] = inputs["responses"].where("doc_id % 10 <> 1")  # never come
    minutes = {"uploads": 0, "primary": 5, "alternate": 10, "responses": 30}
    streamed = {}
    for name, df in inputs.items():
        late = (F.col("doc_id") % 10 == 2) & F.lit(name == "responses")  # come after the hour is over
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") + 60 * minutes[name] + F.when(late, 7200).otherwise(0))
        rows_ = df.withColumn("event_time", at)
        parts = [rows_.where("doc_id <= 150"), rows_.where("doc_id > 150")]
        parts.append(rows_.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "event_time": F.timestamp_seconds(F.lit(1_800_000_000))}))
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streamed[name] = files(spark, f"{folder}/{name}", rows_.schema)
    registry = prompt_registry(spark)
    columns = ["doc_id", "status_code", "document_type", "parse_path", "confidence_score", "ocr_time_ms", "error_type"]
    # restarted after every file of each stream
    make = lambda: streams.stream_extract(streams.stream_gather(**streamed), registry).select(columns)
    _, got = run(spark, make(), folder)
    kept = inputs | {"responses": inputs["responses"].where("doc_id % 10 <> 2")}
    want = documents.extract_documents(**kept, prompts=registry).select(columns)
    assert rows(got.where("doc_id >= 0")) == rows(want)
    _, again = run(spark, make(), folder)  # nothing new, nothing twice
    assert rows(again.where("doc_id >= 0")) == rows(want)


def test_four_streams_keep_their_state_on_disk(spark, sf_dir):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    done = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/quire/extracted-from-four-checkpoint-*"))
    assert QUERIES["stream_extracted_from_four"](spark, sf_dir).count() > 0
    (new,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/quire/extracted-from-four-checkpoint-*")) - done
    with open(f"{new}/offsets/0", encoding="utf-8") as file:
        assert "RocksDBStateStoreProvider" in file.read()
    assert spark.conf.get(setting, None) == before


def test_four_streams_store_their_rows_once(spark, sf_dir):
    """No copy of each stream beside the invoices they are derived from, and no log of changes beside the state's files."""
    shared = f"{spark.conf.get('spark.checkpoint.dir')}/quire"
    done = set(glob.glob(f"{shared}/*"))
    assert QUERIES["stream_extracted_from_four"](spark, sf_dir).count() > 0
    new = set(glob.glob(f"{shared}/*")) - done
    assert sorted(path.split("/")[-1].rsplit("-", 1)[0] for path in new) == ["extracted-from-four", "extracted-from-four-checkpoint", "invoices"]
    (checkpoint,) = [path for path in new if "checkpoint" in path]
    assert glob.glob(f"{checkpoint}/state/*/*/*.zip") and not glob.glob(f"{checkpoint}/state/*/*/*.changelog")


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [1, 2, 4, 3, 0]])
def test_keyed_drift_equals_batch_after_restarts_with_a_hot_type(spark, log, folder, order):
    hot = log.withColumn("document_type", F.when(F.col("run_id") % 10 < 8, "invoice").otherwise(F.col("document_type")))
    seen = None
    for i in order:
        part = hot.where(F.dayofmonth("start_time").between(*DAYS[i]))
        if i == 3:
            part = part.where("document_type = 'invoice'")  # the other types are not touched by this batch
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        seen = part if seen is None else seen.unionByName(part)
        stream = files(spark, folder + "/in", log.schema)
        streams.stream_drift_keyed(stream, folder + "/drift", folder + "/checkpoint", window=20).awaitTermination()
        got = streams.latest_keyed_drift(spark, folder + "/drift", window=20)
        assert rows(got.drop("idle")) == rows(runs.check_drift(seen, window=20))
        assert [r["idle"] for r in got.collect()] == [False] * got.count()
    held = spark.read.parquet(folder + "/drift/parts").agg(F.max(F.size("runs"))).first()[0]
    assert held == 40  # however many runs the hot type has


def test_idle_types_are_marked(spark, log, folder):
    log.where("dayofmonth(start_time) = 1").coalesce(1).write.parquet(folder + "/in")
    later = log.where("dayofmonth(start_time) >= 20 AND document_type = 'invoice'")
    for part in (later, later.limit(1).withColumn("run_id", F.lit(10**9).cast("long"))):  # the second moves the watermark
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = files(spark, folder + "/in", log.schema)
        query = streams.stream_drift_keyed(stream, folder + "/drift", folder + "/checkpoint", 10, idle_after_ms=3_600_000, watermark="1 hour")
        assert query.awaitTermination(60)
    got = {r["document_type"]: r["idle"] for r in streams.latest_keyed_drift(spark, folder + "/drift", window=10).collect()}
    assert len(got) > 1 and got.pop("invoice") is False and all(got.values())


def test_late_rows_are_kept_as_data(spark, log, folder):
    make = lambda df: streams.stream_counts(df, ["document_type"], "1 day", "1 hour")
    listener = streams.LateRows(spark, folder + "/late")
    spark.streams.addListener(listener)
    try:
        log.where("dayofmonth(start_time) > 1").coalesce(1).write.parquet(folder + "/in")
        run(spark, make(files(spark, folder + "/in", log.schema)), folder)
        late = log.where("dayofmonth(start_time) = 1")
        late.coalesce(1).write.mode("append").parquet(folder + "/in")
        query, _ = run(spark, make(files(spark, folder + "/in", log.schema)), folder)
        dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
        for _ in range(50):  # the listener is told after the query has ended
            try:
                table = spark.read.parquet(folder + "/late")
                if table.count():
                    break
            except Exception:
                time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert table.agg(F.sum("rows_dropped")).first()[0] == dropped > 0
    assert {r["query_id"] for r in table.collect()} == {str(query.id)}


def test_scan_uploads_batch_and_stream(spark, folder, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PDF").write_bytes(b"12345")
    (tmp_path / "in" / "deep" / "noext").write_bytes(b"12")
    (tmp_path / "in" / "b.tar.png").write_bytes(b"1")
    want = [("a.PDF", "pdf", 5), ("b.tar.png", "png", 1), ("noext", "", 2)]
    columns = ["filename", "extension", "size"]
    batch = scan_uploads(spark, folder + "/in")
    assert rows(batch.select(columns)) == want
    _, got = run(spark, scan_uploads(spark, folder + "/in", stream=True).select(columns), folder)
    assert rows(got) == want
    assert scan_uploads(spark, folder + "/in", with_content=True).where("size = 5").first()["content"] == b"12345"


def test_histogram_of_a_table_equals_its_windows(log):
    whole = metrics.histogram(log, "ocr_confidence", CONFIDENCE_BOUNDS, ["ocr_engine"])
    windows = streams.stream_histogram(log, "ocr_confidence", CONFIDENCE_BOUNDS, ["ocr_engine"], "1 day")
    summed = windows.groupBy("ocr_engine", "le").agg(F.sum("cumulative_count").alias("cumulative_count"))
    assert rows(whole.select("ocr_engine", "le", "cumulative_count")) == rows(summed)


def test_tables_of_many_files_are_streamed(spark, sf_dir, folder):
    counts = {}
    for place, files_of in ((f"{folder}/single", 1), (f"{folder}/many", 3)):
        for name in ("documents", "labels", "events"):
            derived.table(spark, sf_dir, name).repartition(files_of).write.parquet(f"{place}/{name}.parquet")
        counts[place] = [rows(QUERIES[q](spark, place)) for q in ("stream_upserted", "stream_counts")]
    plain = [rows(QUERIES[q](spark, sf_dir)) for q in ("stream_upserted", "stream_counts")]  # a file each
    assert all(plain) and all(found == plain for found in counts.values())


def test_streamed_updates_come_in_many_files_each_id_in_one(spark, sf_dir, monkeypatch):
    read, arriving = streams.read_stream, []
    monkeypatch.setattr(streams, "read_stream", lambda s, path, *more, **named: arriving.append(path) or read(s, path, *more, **named))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["stream_similar_texts"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    updates = spark.read.parquet(arriving[0]).where("seq > 0").select("id", F.input_file_name().alias("file"))
    assert updates.select("file").distinct().count() > 1
    assert updates.groupBy("id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
