"""The physical plans are the intended ones."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import metrics, ocr, prompts, runs, search, store
from quire.plans import documents
from quire.plans.registry import QUERIES
from quire.sources import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def index_and_queries(spark, sf_dir):
    docs = derived.index_documents(spark, sf_dir)
    return docs, docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return derived.runs(spark, sf_dir)


def test_newest_rows_are_cut_before_the_shuffle(log, spark, sf_dir):
    for df in (
        runs.check_drift(log),
        runs.check_drift(log, window=500),
        runs.compare_prompts(log, limit=500),
        runs.latest_runs_per_type(log, 1000),
        store.upsert_documents(derived.stored_documents(spark, sf_dir), derived.document_updates(spark, sf_dir)),
    ):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_comparison_of_all_runs_combines_before_its_shuffle(log):
    text = plan(runs.compare_prompts(log))
    assert "partial_count" in text and "Window" not in text and text.count("Exchange hashpartitioning") == 1


def test_drift_shuffles_only_cut_rows(log):
    text = plan(runs.check_drift(log))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Partial") == 2


def test_one_type_takes_the_newest_without_a_full_sort(log):
    assert "TakeOrderedAndProject" in plan(runs.latest_runs(log, "invoice", 25))


def test_only_needed_columns_are_read(log):
    assert "ReadSchema: struct<event_type:string>" in plan(metrics.count_by(log, "document_type"))


def test_filters_reach_the_scan(spark, sf_dir):
    hot = derived.table(spark, sf_dir, "events").where("event_id > 10")
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in plan(hot)


def test_page_and_line_texts_share_a_shuffle(spark, sf_dir):
    assert exchanges(ocr.assemble_text(derived.words(spark, sf_dir))) == 2


def test_search_builds_no_pairs(spark, sf_dir, monkeypatch):
    docs, queries = index_and_queries(spark, sf_dir)
    copies = docs.withColumn("id", F.explode(F.array([F.col("id") * 10 + i for i in range(5)])))
    stored = []
    monkeypatch.setattr(search, "_stored", lambda df, purpose: stored.append(plan(df)) or df)
    whole = plan(search.search_similar(copies, queries, block=3))
    (text,) = stored
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text and node not in whole
    # several blocks of queries, one scan of the vectors for them and one for the documents; each slot's best are cut again
    # before their shuffle, and no text or metadata goes with them
    assert text.count("MapInArrow") == 1 and text.count("FileScan parquet [vec_id") == 2
    assert text.count("WindowGroupLimit") == 4 and text.count("Partial") == 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"model_applied", "uploads_scanned"}))
def test_no_row_by_row_python(spark, sf_dir, name):
    if name.startswith("stream_") or name.startswith("similar_"):
        pytest.skip("runs jobs to build its plan; covered by the other tests")
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_document_run_joins_on_one_placement(spark, sf_dir):
    inputs = derived.document_run_inputs(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(documents.extract_documents(**inputs, prompts=prompts.prompt_registry(spark)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # each of the four tables is placed by doc_id once; nothing is shuffled after that
    assert text.count("SortMergeJoin") == 3
    assert text.count("Exchange hashpartitioning(doc_id") == 4


def test_model_failures_stay_with_their_rows(spark):
    def model(batch: pd.DataFrame):
        if (batch["prompt"] == "bad").any():
            raise RuntimeError("refused")
        return batch["prompt"].str.upper()

    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "bad"), (3, "s", "c")], "doc_id long, system string, prompt string")
    got = {r["doc_id"]: r["raw"] for r in prompts.apply_model(df.coalesce(1), model).collect()}
    assert got == {1: "A", 2: None, 3: "C"}


def test_an_id_written_very_often_is_reduced_early(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("id"),
        F.col("id").alias("seq"),
        F.lit("t").alias("text"),
        F.expr("map('document_type', 'x')").alias("metadata"),
    )
    result = store.upsert_documents(hot.limit(0), hot)
    assert result.where("id = 7").first()["seq"] == 29997 and result.count() == 20000


def test_documents_without_updates_are_not_shuffled(spark, sf_dir, monkeypatch):
    current, updates = derived.stored_documents(spark, sf_dir), derived.document_updates(spark, sf_dir)
    small = store.upsert_documents(current, updates)
    assert "BroadcastHashJoin" in plan(small) and "LeftAnti" in plan(small)
    monkeypatch.setattr(store, "is_small", lambda ids: False)
    large = store.upsert_documents(current, updates)
    columns = ["id", "seq", "text"]
    assert sorted(map(tuple, small.select(columns).collect())) == sorted(map(tuple, large.select(columns).collect()))


@pytest.mark.parametrize("small", [True, False])
def test_upserts_do_not_depend_on_their_size(spark, monkeypatch, small):
    monkeypatch.setattr(store, "is_small", lambda ids: small)
    schema = "id long, seq long, text string"
    current = spark.createDataFrame([(1, 1, "a"), (1, 2, "a2"), (2, 1, "b"), (None, 1, "n")], schema)
    updates = spark.createDataFrame([(2, 1, "b1"), (None, 2, "n1"), (None, 1, "n0")], schema)
    rows = sorted(map(tuple, store.upsert_documents(current, updates).select("text", "id").collect()))
    assert rows == [("a", 1), ("a2", 1), ("b1", 2), ("n1", None)]


def test_invoice_texts_are_not_shuffled(spark, sf_dir):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        gathered = documents.gather(**derived.document_run_inputs(spark, sf_dir, bucketed=True))
        assert "Exchange" not in plan(gathered) and gathered.count() > 0
        texts = [line for line in plan(derived.invoice_texts(spark, sf_dir)).splitlines() if "Exchange" in line]
        assert texts and not any("items" in line or "item#" in line for line in texts)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
