"""Run-log analytics against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import metrics, runs

KIND = (
    "run_id long, start_time timestamp, document_type string, prompt_version string, status string, "
    "extraction_confidence double, processing_time_ms double, field_completeness double, fields_extracted long, "
    "total_fields long, warnings array<string>"
)
START = dt.datetime(2024, 1, 1)


def make(seed, per_type):
    rng = random.Random(seed)
    rows, run_id = [], 0
    for name, count in per_type.items():
        for _ in range(count):
            run_id += 1
            rows.append((
                run_id, START + dt.timedelta(seconds=rng.randrange(40) * 60 + rng.randrange(3)), name,
                rng.choice(["v1", "v2", None]), rng.choice(["completed", "failed"]), rng.randrange(100) / 100,
                float(rng.randrange(200000)) / 4, rng.randrange(14) / 13, 3, 0, ["w"] * rng.randrange(8),
            ))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def log(spark):
    rows = make(1, {"invoice": 120, "contract": 17, "report": 10, "receipt": 9})
    return rows, spark.createDataFrame(rows, KIND).repartition(5).cache()


def newest(rows, name, n):
    return sorted((r for r in rows if r[2] == name), key=lambda r: (r[1], r[0]), reverse=True)[:n]


def expected_drift(rows, name, w):
    got = newest(rows, name, 2 * w)
    if len(got) < w:
        return ("insufficient_data", len(got), None, None, None)
    recent, base = np.mean([r[5] for r in got[:w]]), np.mean([r[5] for r in got[-w:]])
    status = "drift_detected" if base - recent > 0.05 else "stable"
    return (status, len(got), round(recent, 4), round(base, 4), round(base - recent, 4))


def drift_row(r):
    return (r["status"], r["runs"], r["recent_avg_confidence"], r["baseline_avg_confidence"], r["drift_magnitude"])


@pytest.mark.parametrize("window", [10, 12, 50])
def test_drift(log, window):
    rows, df = log
    got = {r["document_type"]: drift_row(r) for r in runs.check_drift(df, window=window).collect()}
    assert got == {n: expected_drift(rows, n, window) for n in ("invoice", "contract", "report", "receipt")}
    for name in ("invoice", "contract", "memo"):
        one = runs.check_drift(df, name, window).collect()
        assert [drift_row(r) for r in one] == [expected_drift(rows, name, window)]


def test_drift_is_one_sided(spark):
    def rows(recent, older):
        return [(i, START + dt.timedelta(minutes=i), "invoice", c) for i, c in enumerate([older] * 10 + [recent] * 10)]

    for recent, older, status in ((0.5, 0.9, "drift_detected"), (0.9, 0.5, "stable"), (0.86, 0.9, "stable")):
        df = spark.createDataFrame(rows(recent, older), "run_id long, start_time timestamp, document_type string, extraction_confidence double")
        row = runs.check_drift(df, window=10).first()
        assert (row["status"], row["threshold"]) == (status, 0.85)


@pytest.mark.parametrize("window", [9, 501])
def test_drift_bounds(log, window):
    with pytest.raises(ValueError):
        runs.check_drift(log[1], window=window)


@pytest.mark.parametrize("limit", [30, 500])
def test_comparison(log, limit):
    rows, df = log
    got = {(r["document_type"], r["prompt_version"]): tuple(r)[2:] for r in runs.compare_prompts(df, limit=limit).collect()}
    want = {}
    for name in {r[2] for r in rows}:
        chosen = newest(rows, name, limit)
        for version in {r[3] for r in chosen if r[3]}:
            group = [r for r in chosen if r[3] == version]
            means = [np.float64(np.mean([r[c] for r in group])) for c in (5, 6, 7)]
            want[(name, version)] = (len(group), round(means[0], 4), round(means[1], 2), round(means[2], 4))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-4)


def test_nan_metrics_are_left_out(spark):
    rows = [(1, START, "invoice", "v1", 0.5, float("nan"), 1.0), (2, START, "invoice", "v1", float("nan"), 3.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, start_time timestamp, document_type string, prompt_version string, extraction_confidence double, processing_time_ms double, field_completeness double")
    row = runs.compare_prompts(df).first()
    assert (row["run_count"], row["avg_extraction_confidence"], row["avg_processing_time_ms"]) == (2, 0.5, 3.0)


@pytest.mark.parametrize("n", [1, 7, 1001])
def test_latest(log, n):
    rows, df = log
    got = runs.latest_runs_per_type(df, n).collect()
    for name in ("invoice", "contract"):
        want = [r[0] for r in newest(rows, name, n)]
        assert [r["run_id"] for r in sorted(got, key=lambda r: r["recency"]) if r["document_type"] == name] == want
        assert [r["run_id"] for r in runs.latest_runs(df, name, n).collect()] == want


def test_log_rows(log):
    for r in runs.log_runs(log[1]).collect():
        assert r["field_completeness"] == 3.0 and r["tags"]["environment"] == "production"
        assert r["tags"].get("has_warnings") == ("true" if r["warnings"] else None)
        assert r["tags"].get("warnings") == ("; ".join(r["warnings"][:5]) if r["warnings"] else None)


def test_append_partitions_by_type(log, folder, spark):
    runs.append_runs(log[1], folder + "/runs")
    runs.append_runs(log[1], folder + "/runs")
    back = spark.read.parquet(folder + "/runs").where("document_type = 'report'")
    assert back.count() == 20 and "PartitionFilters: [isnotnull(document_type" in plan(back)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_of_an_empty_log(spark):
    row = runs.metrics_summary(spark.createDataFrame([], KIND)).first()
    assert tuple(row) == (0, 0.0, 0.0, {}, 0.0)


def test_histogram_counts(log):
    rows, df = log
    got = metrics.histogram(df, "extraction_confidence", [0.1, 0.5, 1.0], ["document_type"]).collect()
    for r in got:
        values = [x[5] for x in rows if x[2] == r["document_type"]]
        bound = float("inf") if r["le"] == "+Inf" else float(r["le"])
        assert r["cumulative_count"] == sum(v <= bound for v in values) and r["total_count"] == len(values)
        assert r["total_sum"] == pytest.approx(sum(values))
    assert len(got) == 16


def test_in_flight_and_peaks(log):
    rows, df = log
    changes = {}
    for r in rows:
        end = r[1] + dt.timedelta(microseconds=int(r[6] * 1000))
        changes[r[1]] = changes.get(r[1], 0) + 1
        changes[end] = changes.get(end, 0) - 1
    level, want, peaks, left = 0, [], {}, {}
    for at in sorted(changes):
        before, level = level, level + changes[at]
        want.append((at, changes[at], level))
        bucket = at.replace(second=0, microsecond=0)
        peaks[bucket] = max(peaks.get(bucket, before), level)
        left[bucket] = level
    minute, carried = min(peaks), 0
    while minute <= max(peaks):  # quiet minutes go on with what the last one left
        peaks.setdefault(minute, carried)
        carried = left.get(minute, carried)
        minute += dt.timedelta(minutes=1)
    got = metrics.in_flight(df).orderBy("at").collect()
    assert [tuple(r) for r in got] == want and want[-1][2] == 0
    assert {r["bucket_start"]: r["peak"] for r in metrics.peak_in_flight(df).collect()} == peaks


def test_quiet_buckets_over_several_spans(log, monkeypatch):
    rows, df = log
    far = df.limit(1).withColumn("start_time", F.expr("start_time + INTERVAL 3 DAYS")).withColumn("processing_time_ms", F.lit(9e7))
    both = df.unionByName(far)
    for bucket, width in (("7 minutes", 420), ("90 seconds", 90)):
        changes = metrics.in_flight(both).orderBy("at").collect()
        want = {}
        first, last = (int(changes[i]["at"].timestamp()) // width for i in (0, -1))
        at, level = 0, 0
        for n in range(first, last + 1):
            opening = peak = level
            while at < len(changes) and int(changes[at]["at"].timestamp()) // width == n:
                level = changes[at]["in_flight"]
                peak = max(peak, level)
                at += 1
            want[n * width] = (opening, peak)
        for span in (1440, 100):
            monkeypatch.setattr(metrics, "SPAN_BUCKETS", span)
            got = metrics.peak_in_flight(both, bucket).collect()
            assert {int(r["bucket_start"].timestamp()): (r["opening"], r["peak"]) for r in got} == want
    assert metrics.peak_in_flight(df.limit(0)).count() == 0


def test_running_total(log):
    rows, df = log
    spread = df.withColumn("start_time", F.expr("start_time + make_dt_interval(cast(run_id % 3 as int))"))
    got = [(r["documents"], r["total_documents"]) for r in metrics.running_total(spread).orderBy("day").collect()]
    sizes = [sum(r[0] % 3 == d for r in rows) for d in range(3)]
    assert got == [(sizes[0], sizes[0]), (sizes[1], sum(sizes[:2])), (sizes[2], sum(sizes))]
