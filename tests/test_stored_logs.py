"""The run log in time-clustered files and the document table in hash buckets."""

import os
from datetime import datetime, timedelta
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from quire.operators import buckets, run_files, runs, store
from quire.streaming import snapshots

START = datetime(2024, 1, 1)
LOG = "run_id long, document_type string, start_time timestamp, extraction_confidence double, prompt_version string"
LOG += ", processing_time_ms double, field_completeness double"


def log_rows(ids, kind=lambda i: "invoice" if i % 10 else "contract", time=lambda i: START + timedelta(minutes=i)):
    return [(i, kind(i), time(i), i % 97 / 100, f"v{i % 3}", float(i % 50), 0.5) for i in ids]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def local(files):
    return {unquote(urlparse(f).path) for f in files}


def all_files(path, end=".parquet"):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(end)}


def test_newest_runs_open_no_old_file(spark, folder):
    parts = [spark.createDataFrame(log_rows(range(k * 1000, k * 1000 + 1000)), LOG) for k in range(3)]
    for part in parts:
        run_files.append_clustered(part, folder, rows_per_file=100)
    whole = parts[0].union(parts[1]).union(parts[2])
    newest = run_files.read_newest(spark, folder, 40)
    opened = local(newest.inputFiles())
    assert len(opened) <= 4 < 30 <= len(all_files(folder))
    for old in all_files(folder) - opened:  # unreadable now: whoever opens one fails
        with open(old, "wb") as broken:
            broken.write(b"not parquet")
    assert rows_of(runs.latest_runs_per_type(newest, 40)) == rows_of(runs.latest_runs_per_type(whole, 40))
    assert rows_of(runs.check_drift(newest, window=20)) == rows_of(runs.check_drift(whole, window=20))
    assert rows_of(runs.compare_prompts(newest, limit=40)) == rows_of(runs.compare_prompts(whole, limit=40))
    one = run_files.read_newest(spark, folder, 40, "contract")
    assert local(one.inputFiles()) < opened
    assert rows_of(runs.latest_runs(one, "contract", 40)) == rows_of(runs.latest_runs(whole, "contract", 40))


@pytest.mark.parametrize("n", [1, 7, 60, 5000])
def test_newest_runs_with_overlaps_ties_and_nulls(spark, folder, n):
    """Late rows, equal times, a null type, null times, a type with few rows: as from the whole log."""
    kinds = [None, "invoice", "invoice", "rare"]
    times = {0: None, 1: START, 2: START + timedelta(days=3)}
    parts = []
    for k in range(3):
        ids = range(k * 200, k * 200 + 200)
        rows = log_rows(
            ids,
            kind=lambda i: kinds[3 if i % 100 == 1 else i % 3],
            time=lambda i: times.get(i % 11, START + timedelta(minutes=(i * 7919) % 500)),
        )
        parts.append(spark.createDataFrame(rows, LOG))
        run_files.append_clustered(parts[-1], folder, rows_per_file=30)
    whole = parts[0].union(parts[1]).union(parts[2])
    newest = run_files.read_newest(spark, folder, n)
    assert rows_of(runs.latest_runs_per_type(newest, n)) == rows_of(runs.latest_runs_per_type(whole, n))
    for kind in ("invoice", "rare", "unknown"):
        one = run_files.read_newest(spark, folder, n, kind)
        assert rows_of(runs.latest_runs(one, kind, n)) == rows_of(runs.latest_runs(whole, kind, n))


def test_log_versions_and_empty_appends(spark, folder):
    with pytest.raises(ValueError, match="nothing was committed"):
        run_files.read_newest(spark, folder, 1)
    part = spark.createDataFrame(log_rows(range(20)), LOG)
    assert run_files.append_clustered(part.limit(0), folder).version == 0
    first = run_files.append_clustered(part, folder)
    assert run_files.append_clustered(part.limit(0), folder).version == first.version
    run_files.append_clustered(spark.createDataFrame(log_rows(range(20, 40)), LOG), folder)
    assert run_files.read_newest(spark, folder, 1000).count() == 40
    assert run_files.read_newest(spark, folder, 1000, version=first.version).count() == 20
    with pytest.raises(ValueError, match="at least 1"):
        run_files.read_newest(spark, folder, 0)


DOCS = "id long, seq long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_upsert_rewrites_touched_buckets_only(spark, folder):
    current = docs(spark, [(i, 1, f"text {i}") for i in range(2000)] + [(None, 1, "no id")])
    first = buckets.upsert_buckets(current, folder, buckets=16)
    before = all_files(folder)
    updates = docs(spark, [(5, 2, "newer"), (5, 1, "as old"), (7, 0, "older"), (9, 1, "equal"), (None, 1, "z"), (9000, 0, "new")])
    second = buckets.upsert_buckets(updates, folder)
    touched = {r[0] for r in updates.select(buckets.bucket_of(16)).distinct().collect()}
    assert 0 < len(touched) < 8
    assert before <= all_files(folder)  # nothing was overwritten
    kept = [f for f in first.folders if f[1] not in touched]
    assert [f for f in second.folders if f[1] not in touched] == kept
    assert {f[1] for f in second.folders if f not in first.folders} == touched
    read = buckets.read_buckets(spark, folder)
    assert rows_of(read) == rows_of(store.upsert_documents(current, updates))
    assert rows_of(buckets.read_buckets(spark, folder, version=first.version)) == rows_of(current)
    names = local(read.inputFiles())
    assert {f for f in before if any(f"run={r}/batch_id={b}/" in f for r, b in kept)} <= names
    some = buckets.read_buckets(spark, folder, ids=[5, 9000, 12345])
    assert rows_of(some) == [(5, 2, "newer"), (9000, 0, "new")]
    snapshots.expire(spark, folder, keep=1)
    assert rows_of(buckets.read_buckets(spark, folder)) == rows_of(store.upsert_documents(current, updates))


def test_no_update_is_no_version(spark, folder):
    with pytest.raises(ValueError, match="nothing was committed"):
        buckets.read_buckets(spark, folder)
    assert buckets.upsert_buckets(docs(spark, []), folder).version == 0
    one = buckets.upsert_buckets(docs(spark, [(1, 1, None), (1, 1, "a")]), folder, buckets=4)
    assert buckets.upsert_buckets(docs(spark, []), folder).version == one.version
    assert buckets.read_buckets(spark, folder).count() == 1


def test_writer_that_comes_second_merges_again(spark, folder, monkeypatch):
    """Another upsert of the same id, and one of another bucket, are published between the merge and its commit."""
    buckets.upsert_buckets(docs(spark, [(i, 1, "old") for i in range(50)]), folder, buckets=8)
    publish, done = snapshots.commit, []

    def late(*arguments):
        if not done:
            done.append(True)
            buckets.upsert_buckets(docs(spark, [(3, 5, "other writer")]), folder)
            buckets.upsert_buckets(docs(spark, [(4, 5, "third writer")]), folder)
        return publish(*arguments)

    monkeypatch.setattr(snapshots, "commit", late)
    buckets.upsert_buckets(docs(spark, [(3, 4, "late"), (11, 2, "late")]), folder)
    found = {r["id"]: r["text"] for r in buckets.read_buckets(spark, folder).collect()}
    assert (found[3], found[4], found[11], len(found)) == ("other writer", "third writer", "late", 50)


def test_hot_id_is_cut_before_the_shuffle(spark, folder):
    many = spark.range(20000).select(F.expr("id DIV 100000 + 1").alias("id"), F.col("id").alias("seq"), F.lit("t").alias("text"))
    ranked = store.latest_per_id(many)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    buckets.upsert_buckets(many, folder, buckets=4)
    assert rows_of(buckets.read_buckets(spark, folder)) == [(1, 19999, "t")]
