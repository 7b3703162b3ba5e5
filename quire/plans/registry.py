"""The registered queries: every operator over whole tables, as flat columns."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixed_values import COMPARE_LIMIT, CONFIDENCE_BOUNDS
from quire.functions.paths import work_dir
from quire.functions.text import py_round
from quire.operators import buckets, classify, embed, evaluate, extract, ingest, metrics, ocr, prompts, run_files, runs, score, search, store
from quire.plans import documents
from quire.session import configure
from quire.sources import derived
from quire.sources.uploads import scan_uploads
from quire.streaming import snapshots, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def _micros(name: str) -> Column:
    return F.unix_micros(name)


# --- sources and sinks ---


@query
def uploads_scanned(spark, sf_dir):
    return scan_uploads(spark, sf_dir, pattern="*.parquet").select("filename", "extension", "size")


@query
def runs_logged(spark, sf_dir):
    logged = runs.log_runs(derived.runs(spark, sf_dir).drop("field_completeness"))
    return logged.select(
        "run_id",
        "document_type",
        "field_completeness",
        F.col("tags")["environment"].alias("environment"),
        F.col("tags")["has_warnings"].alias("has_warnings"),
        F.col("tags")["warnings"].alias("warnings"),
    )


def _index_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "seq", "text", F.col("metadata")["document_type"].alias("document_type"))


@query
def documents_upserted(spark, sf_dir):
    current = derived.stored_documents(spark, sf_dir)
    return _index_columns(store.upsert_documents(current, derived.document_updates(spark, sf_dir)))


@query
def documents_upserted_in_buckets(spark, sf_dir):
    """The same upsert in a stored table, the re-sent documents in two steps."""
    path = work_dir(spark, "document-buckets")
    updates = derived.document_updates(spark, sf_dir)
    buckets.upsert_buckets(derived.stored_documents(spark, sf_dir), path, buckets=64)
    buckets.upsert_buckets(updates.where("seq = 0"), path)
    buckets.upsert_buckets(updates.where("seq > 0"), path)
    return _index_columns(buckets.read_buckets(spark, path))


# --- routing and recognised text ---


@query
def uploads_routed(spark, sf_dir):
    routed = ingest.route_uploads(derived.page_uploads(spark, sf_dir))
    return routed.select("doc_id", "extension", _long("status_code").alias("status_code"), "reason")


@query
def documents_identified(spark, sf_dir):
    """Pages as uploads; two of three come without an id."""
    pages = derived.table(spark, sf_dir, "pages").withColumn("document_id", F.expr("CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS STRING) END"))
    return ingest.with_document_ids(pages, ["url", "html"]).select("page_id", "document_id")


@query
def ocr_flagged(spark, sf_dir):
    read = derived.engine_results(spark, sf_dir, alternate=False).withColumn(
        "raw_text", F.expr("CASE WHEN doc_id % 10 = 0 THEN concat(' \n\t', char(160)) ELSE raw_text END")
    )
    return ocr.flag_ocr(read).select(
        "doc_id",
        _long("status_code").alias("status_code"),
        "reason",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query
def text_assembled(spark, sf_dir):
    return ocr.assemble_text(derived.words(spark, sf_dir)).select("doc_id", "engine", "raw_text", "page_count")


@query
def text_assembled_with_blank_pages(spark, sf_dir):
    whole = ocr.assemble_text(derived.words(spark, sf_dir), derived.pages_of_words(spark, sf_dir))
    return whole.select("doc_id", "engine", F.length("raw_text").cast("bigint").alias("chars"), "page_count")


@query
def confidence_by_page(spark, sf_dir):
    result = ocr.confidence_by_page(derived.words(spark, sf_dir), derived.pages_of_words(spark, sf_dir))
    return result.select("doc_id", "engine", py_round(F.col("confidence"), 4).alias("confidence"), "page_count")


@query
def confidence_by_word(spark, sf_dir):
    scaled = derived.words(spark, sf_dir, 37, "doctr").withColumn("conf", F.greatest("conf", F.lit(0.0)) / 128)
    result = ocr.confidence_by_word(scaled)
    return result.select("doc_id", "engine", py_round(F.col("confidence"), 4).alias("confidence"), "word_count")


@query
def ocr_reconciled(spark, sf_dir):
    primary = derived.engine_results(spark, sf_dir, alternate=False)
    return ocr.reconcile_ocr(primary, derived.engine_results(spark, sf_dir, alternate=True))


# --- classification and prompts ---


@query
def classified_by_keywords(spark, sf_dir):
    return classify.classify_keywords(derived.typed_texts(spark, sf_dir)).select("doc_id", "classified_type")


@query
def classified_from_answers(spark, sf_dir):
    return classify.classify_from_response(derived.typed_texts(spark, sf_dir)).select("doc_id", "classified_type")


def _resolved(spark, sf_dir) -> DataFrame:
    return classify.resolve_type(classify.classify_keywords(derived.typed_texts(spark, sf_dir)))


@query
def types_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "document_type")


@query
def prompts_selected(spark, sf_dir):
    chosen = prompts.select_prompt(_resolved(spark, sf_dir), prompts.prompt_registry(spark))
    return chosen.select("doc_id", "prompt_key", "version_used")


@query
def prompts_rendered(spark, sf_dir):
    rendered = prompts.render_prompts(_resolved(spark, sf_dir), prompts.prompt_registry(spark))
    return rendered.select("doc_id", "version_used", "system", "prompt")


def _answer_length(requests: pd.DataFrame) -> list[str]:
    if any(len(text) % 7 == 0 for text in requests["prompt"]):
        raise LookupError("refused")
    return ['{"chars":%d}' % len(text) for text in requests["prompt"]]


@query
def model_applied(spark, sf_dir):
    rendered = prompts.render_prompts(_resolved(spark, sf_dir), prompts.prompt_registry(spark))
    return prompts.apply_model(rendered, _answer_length)


@query
def classification_prompts_rendered(spark, sf_dir):
    texts = derived.typed_texts(spark, sf_dir)
    return prompts.render_classification(texts, prompts.prompt_registry(spark)).select("doc_id", "prompt")


# --- model output ---


def _parsed(spark, sf_dir) -> DataFrame:
    return extract.parse_model_json(derived.invoice_answers(spark, sf_dir))


@query
def answers_parsed(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id",
        "parse_path",
        F.try_variant_get("data", "$.invoice_number", "string").alias("invoice_number"),
        F.try_variant_get("data", "$.vendor_name", "string").alias("vendor_name"),
        F.try_variant_get("data", "$.raw_output", "string").alias("raw_output"),
    )


@query
def invoices_typed(spark, sf_dir):
    invoices = extract.as_invoices(_parsed(spark, sf_dir))
    return invoices.withColumn("line_items", _long(F.size("line_items")))


@query
def contracts_typed(spark, sf_dir):
    contracts = extract.as_contracts(extract.parse_model_json(derived.contract_answers(spark, sf_dir)))
    return contracts.withColumns(
        {"parties": F.array_join("parties", "|"), "key_terms": F.array_join("key_terms", "|")}
    )


@query
def line_items_exploded(spark, sf_dir):
    items = extract.explode_line_items(extract.as_invoices(_parsed(spark, sf_dir)))
    return items.withColumn("item_no", _long("item_no"))


@query
def invoices_totalled(spark, sf_dir):
    return extract.invoice_totals(extract.explode_line_items(extract.as_invoices(_parsed(spark, sf_dir))))


@query
def totals_verified(spark, sf_dir):
    checked = extract.verify_totals(extract.as_invoices(_parsed(spark, sf_dir)))
    return checked.select("doc_id", "subtotal", "tax", "total", "subtotal_ok", "tax_ok", "total_ok")


@query
def invoice_numbers(spark, sf_dir):
    return extract.invoice_number(derived.invoice_texts(spark, sf_dir)).select("doc_id", "invoice_number")


@query
def invoice_fields(spark, sf_dir):
    return extract.extract_invoice_fields(derived.invoice_layouts(spark, sf_dir)).drop("line_items")


@query
def invoice_lines_read(spark, sf_dir):
    """The items that the layout reader finds on the page, one row each."""
    read = extract.extract_invoice_fields(derived.invoice_layouts(spark, sf_dir))
    items = extract.explode_line_items(read)
    return items.withColumn("item_no", _long("item_no"))


def _scored(spark, sf_dir) -> DataFrame:
    columns = ["doc_id", "raw", "document_type"]
    answers = derived.invoice_answers(spark, sf_dir).select(columns)
    answers = answers.unionByName(derived.contract_answers(spark, sf_dir).select(columns))
    return score.score_confidence(extract.parse_model_json(answers))


@query
def confidence_scored(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "document_type", "confidence_score")


@query
def fields_counted(spark, sf_dir):
    counted = score.count_fields(_scored(spark, sf_dir))
    return counted.select("doc_id", "document_type", "fields_extracted", "total_fields", "field_completeness")


@query
def length_bands(spark, sf_dir):
    banded = score.length_band(derived.typed_texts(spark, sf_dir))
    return score.band_counts(banded, "length_band", "expected_low", "expected_high")


@query
def confidence_bands(spark, sf_dir):
    return score.band_counts(score.confidence_band(_scored(spark, sf_dir)), "document_type", "confidence_band")


# --- the document index ---


@query
def index_rows_built(spark, sf_dir):
    texts = derived.typed_texts(spark, sf_dir).selectExpr(
        "doc_id",
        "raw_text",
        "requested_type AS document_type",
        "doc_id % 14 AS fields_extracted",
        "CAST(doc_id % 1000 AS DOUBLE) / 1000 AS confidence",
        "concat('f', doc_id, '.pdf') AS filename",
        "prompt_version",
        "'2024-01-01T00:00:00' AS created_at",
    )
    names = ["document_type", "extracted_at", "field_count", "filename", "confidence", "prompt_version"]
    return store.build_index_rows(texts).select(
        "id", _long(F.length("text")).alias("chars"), *[F.col("metadata")[n].alias(n) for n in names]
    )


def _found(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        _long("rank").alias("rank"),
        "id",
        "text_preview",
        F.col("metadata")["document_type"].alias("document_type"),
        py_round(F.col("distance"), 6).alias("distance"),
    )


def _index_and_queries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All indexed documents, and every one whose id is divisible by 50 as a query."""
    docs = derived.index_documents(spark, sf_dir)
    return docs, docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query
def similar_documents(spark, sf_dir):
    return _found(search.search_similar(*_index_and_queries(spark, sf_dir)))


@query
def similar_invoices(spark, sf_dir):
    """Of one type, with several blocks of queries."""
    return _found(search.search_similar(*_index_and_queries(spark, sf_dir), k=20, document_type="invoice", block=4))


def _written_index(spark, docs) -> str:
    path = work_dir(spark, "index")
    search.write_search_index(docs, path)
    return path


@query
def similar_documents_approximate(spark, sf_dir):
    docs, queries = _index_and_queries(spark, sf_dir)
    return _found(search.search_index(spark, _written_index(spark, docs), queries))


@query
def similar_documents_indexed(spark, sf_dir):
    """Through the index, looking on until no other cell can hold a nearer document."""
    docs, queries = _index_and_queries(spark, sf_dir)
    return _found(search.search_index(spark, _written_index(spark, docs), queries, probes=2, exact=True))


@query
def similar_invoices_indexed(spark, sf_dir):
    docs, queries = _index_and_queries(spark, sf_dir)
    return _found(search.search_index(spark, _written_index(spark, docs), queries, k=20, document_type="invoice"))


def _stored_texts(spark, sf_dir) -> tuple[embed.EmbeddingModel, DataFrame, DataFrame, DataFrame]:
    """A model of all texts, the index rows, their updates, and the benchmark passages as questions."""
    current, updates = derived.stored_documents(spark, sf_dir), derived.document_updates(spark, sf_dir)
    asked = derived.table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text")
    return embed.fit_model(current), current, updates, asked


@query
def similar_texts(spark, sf_dir):
    """Texts in, text questions out: a store that embeds what it is given, updated once."""
    model, current, updates, asked = _stored_texts(spark, sf_dir)
    path = work_dir(spark, "texts")
    embed.store_texts(embed.embed_text(current, model), updates, model).write.parquet(path)
    return _found(embed.search_texts(spark.read.parquet(path), asked, model))


@query
def similar_texts_of_a_newer_model(spark, sf_dir):
    """Half of the store was embedded by an older model of other weights; the search embeds it anew."""
    model, current, updates, asked = _stored_texts(spark, sf_dir)
    old = embed.EmbeddingModel(0, tuple(1.0 for _ in model.weights))
    known = embed.embed_text(current.where("id % 2 = 0"), model).unionByName(embed.embed_text(current.where("id % 2 <> 0"), old))
    path = work_dir(spark, "texts")
    embed.store_texts(known, updates, model).write.parquet(path)
    return _found(embed.search_texts(spark.read.parquet(path), asked, model))


@query
def collection_counted(spark, sf_dir):
    return store.collection_stats(derived.index_documents(spark, sf_dir))


# --- the run log ---


def _run_columns(df: DataFrame, *more) -> DataFrame:
    return df.select("run_id", "document_type", _micros("start_time").alias("start_us"), "extraction_confidence", *more)


@query
def latest_invoice_runs(spark, sf_dir):
    return _run_columns(runs.latest_runs(derived.runs(spark, sf_dir), "invoice", 25))


@query
def latest_runs_per_type(spark, sf_dir):
    latest = runs.latest_runs_per_type(derived.runs(spark, sf_dir), 100)
    return _run_columns(latest, _long("recency").alias("recency"))


@query
def latest_runs_per_type_deep(spark, sf_dir):
    latest = runs.latest_runs_per_type(derived.runs(spark, sf_dir), 1500)
    return _run_columns(latest, _long("recency").alias("recency"))


@query
def prompts_compared(spark, sf_dir):
    return runs.compare_prompts(derived.runs(spark, sf_dir))


@query
def prompts_compared_on_a_page(spark, sf_dir):
    return runs.compare_prompts(derived.runs(spark, sf_dir), limit=COMPARE_LIMIT)


@query
def invoice_prompts_compared(spark, sf_dir):
    return runs.compare_prompts(derived.runs(spark, sf_dir), "invoice", limit=200)


@query
def drift_checked(spark, sf_dir):
    return runs.check_drift(derived.runs(spark, sf_dir))


@query
def drift_checked_wide(spark, sf_dir):
    return runs.check_drift(derived.runs(spark, sf_dir), window=500)


@query
def invoice_drift_checked(spark, sf_dir):
    return runs.check_drift(derived.runs(spark, sf_dir), "invoice", window=150)


def _clustered_runs(spark, sf_dir) -> str:
    """The log in three appends, as its rows come in."""
    path, log = work_dir(spark, "run-log"), derived.runs(spark, sf_dir)
    third = F.floor((F.dayofmonth("start_time") - 1) / 11)
    for part in range(3):
        run_files.append_clustered(log.where(third == part), path, rows_per_file=100_000)
    return path


@query
def latest_runs_per_type_from_files(spark, sf_dir):
    newest = run_files.read_newest(spark, _clustered_runs(spark, sf_dir), 100)
    return _run_columns(runs.latest_runs_per_type(newest, 100), _long("recency").alias("recency"))


@query
def drift_checked_from_files(spark, sf_dir):
    return runs.check_drift(run_files.read_newest(spark, _clustered_runs(spark, sf_dir), 100), window=50)


@query
def runs_summarised(spark, sf_dir):
    summary = runs.metrics_summary(derived.runs(spark, sf_dir))
    by_type = [F.col("documents_by_type")[t].alias(f"{t}_documents") for t in classify.DOCUMENT_TYPES]
    return summary.select("*", *by_type).drop("documents_by_type")


@query
def requests_counted(spark, sf_dir):
    return metrics.count_by(derived.runs(spark, sf_dir), "document_type", "status")


@query
def errors_counted(spark, sf_dir):
    failed = derived.runs(spark, sf_dir).where(F.col("error_type").isNotNull())
    return metrics.count_by(failed, "document_type", "error_type")


def _histogram(name: str) -> Query:
    def run(spark, sf_dir):
        rows = metrics.histogram(derived.runs(spark, sf_dir), *metrics.HISTOGRAMS[name])
        return rows.withColumn("total_sum", py_round(F.col("total_sum"), 4))

    run.__name__ = f"histogram_{name}"
    return run


for _name in metrics.HISTOGRAMS:
    query(_histogram(_name))


@query
def running_total(spark, sf_dir):
    return metrics.running_total(derived.runs(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def documents_in_flight(spark, sf_dir):
    return metrics.in_flight(derived.runs(spark, sf_dir)).select(_micros("at").alias("at_us"), "net", "in_flight")


@query
def peak_in_flight(spark, sf_dir):
    peaks = metrics.peak_in_flight(derived.runs(spark, sf_dir))
    return peaks.select(_micros("bucket_start").alias("bucket_us"), "opening", "peak")


# --- evaluation ---


def _matches(spark, sf_dir) -> DataFrame:
    base = derived.stored_invoice_base(spark, sf_dir)
    answers = extract.parse_model_json(derived.invoice_answers_of(base)).withColumnRenamed("doc_id", "sample_id")
    extracted = answers.select("sample_id", "prompt_version", "data")
    return evaluate.field_matches(extracted, derived.invoice_truth_of(base))


@query
def fields_matched(spark, sf_dir):
    return _matches(spark, sf_dir).select("sample_id", "field", "kind", "match")


@query
def sample_accuracy(spark, sf_dir):
    return evaluate.sample_accuracy(_matches(spark, sf_dir))


@query
def overall_accuracy(spark, sf_dir):
    return evaluate.overall_accuracy(_matches(spark, sf_dir))


@query
def field_accuracy(spark, sf_dir):
    return evaluate.field_accuracy(_matches(spark, sf_dir))


@query
def prompt_accuracy(spark, sf_dir):
    return evaluate.prompt_accuracy(_matches(spark, sf_dir))


@query
def constraints_checked(spark, sf_dir):
    odd = derived.runs(spark, sf_dir).withColumns(
        {
            "ocr_confidence": F.col("ocr_confidence") + 0.05,
            "document_type": F.expr("nullif(document_type, 'unknown')"),
            "status": F.expr("CASE status WHEN 'failed' THEN 'lost' ELSE status END"),
        }
    )
    return score.check_constraints(odd)


# --- the whole document run ---


def _results(spark, sf_dir) -> DataFrame:
    inputs = derived.document_run_inputs(spark, sf_dir, bucketed=True)
    return documents.extract_documents(**inputs, prompts=prompts.prompt_registry(spark))


def _result_columns(results: DataFrame) -> DataFrame:
    return results.select(
        "doc_id",
        "status",
        _long("status_code").alias("status_code"),
        "reason",
        "document_type",
        "engine_used",
        "ocr_confidence",
        "page_count",
        _long(F.length("raw_text")).alias("chars"),
        "prompt_key",
        "prompt_version",
        "parse_path",
        "confidence_score",
        "fields_extracted",
        "total_fields",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query
def documents_extracted(spark, sf_dir):
    return _result_columns(_results(spark, sf_dir))


@query
def documents_extracted_to_runs(spark, sf_dir):
    logged = documents.run_rows(_results(spark, sf_dir), model="model-a")
    return logged.select(
        "run_id",
        "document_id",
        "document_type",
        "ocr_engine",
        "llm_model",
        "ocr_time_ms",
        "error_type",
        "extraction_confidence",
        "field_completeness",
        F.col("tags")["has_warnings"].alias("has_warnings"),
    )


@query
def documents_extracted_to_index(spark, sf_dir):
    rows = documents.index_rows(_results(spark, sf_dir))
    names = ["document_type", "extracted_at", "field_count", "filename", "confidence", "prompt_version"]
    return rows.select(
        "id", _long(F.length("text")).alias("chars"), *[F.col("metadata")[n].alias(n) for n in names]
    )


# --- streams, each run to the end of its input ---


def _event_runs(spark, sf_dir) -> DataFrame:
    schema = derived.table(spark, sf_dir, "events").schema
    return derived.runs_of(streams.stream_table(spark, sf_dir, "events", schema))


def _finished(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    path, checkpoint = work_dir(spark, purpose), work_dir(spark, f"{purpose}-checkpoint")
    streams.write_stream(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_extracted(spark, sf_dir):
    arriving = work_dir(spark, "gathered")
    documents.gather(**derived.document_run_inputs(spark, sf_dir, bucketed=True)).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    stream = streams.stream_extract(streams.read_stream(spark, arriving, schema), prompts.prompt_registry(spark))
    return _finished(spark, _result_columns(stream), "extracted")


@query
def stream_counts(spark, sf_dir):
    counts = streams.stream_counts(_event_runs(spark, sf_dir), ["document_type", "status"], "6 hours", "1 hour")
    rows = _finished(spark, counts, "counts")
    return rows.select(_micros("window_start").alias("window_us"), "document_type", "status", "total")


@query
def stream_counts_sliding(spark, sf_dir):
    counts = streams.stream_counts(
        _event_runs(spark, sf_dir), ["document_type"], "6 hours", "1 hour", slide="3 hours"
    )
    rows = _finished(spark, counts, "sliding")
    return rows.select(_micros("window_start").alias("window_us"), "document_type", "total")


@query
def stream_histogram(spark, sf_dir):
    buckets = streams.stream_histogram(
        _event_runs(spark, sf_dir), "ocr_confidence", CONFIDENCE_BOUNDS, ["ocr_engine"], "12 hours", "1 hour"
    )
    rows = _finished(spark, buckets, "histogram")
    return rows.select(
        _micros("window_start").alias("window_us"),
        "ocr_engine",
        "le",
        "cumulative_count",
        "total_count",
        py_round(F.col("total_sum"), 4).alias("total_sum"),
    )


@query
def stream_upserted(spark, sf_dir):
    schema = derived.table(spark, sf_dir, "documents").schema
    texts = streams.stream_table(spark, sf_dir, "documents", schema)
    metadata = F.create_map(F.lit("document_type"), F.col("lang"))
    stored = texts.select(F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("seq"), "text", metadata.alias("metadata"))
    labelled = texts.join(derived.table(spark, sf_dir, "labels"), "doc_id")
    resent = labelled.select(
        F.col("doc_id").alias("id"),
        F.explode(F.expr("sequence(1L, quality + 1L)")).alias("seq"),
        F.concat("text", F.lit(" again")).alias("text"),
        metadata.alias("metadata"),
    )
    path, checkpoint = work_dir(spark, "documents"), work_dir(spark, "documents-checkpoint")
    streams.stream_upsert(stored.unionByName(resent), path, checkpoint).awaitTermination()
    return _index_columns(streams.read_documents(spark, path))


@query
def stream_similar_texts(spark, sf_dir):
    """As ``similar_texts``, with all rows and updates through a stream, embedded in its batches, compacted after."""
    model, current, updates, asked = _stored_texts(spark, sf_dir)
    arriving = work_dir(spark, "arriving-texts")
    current.write.parquet(arriving)
    # further files bring the updates, all of an id in one; they count as later than rows of the same seq
    updates.withColumn("seq", F.col("seq") + 1).repartition("id").write.mode("append").parquet(arriving)
    path, checkpoint = work_dir(spark, "texts"), work_dir(spark, "texts-checkpoint")
    texts = streams.read_stream(spark, arriving, current.schema, files_per_batch=8)
    streams.stream_upsert(texts, path, checkpoint, model).awaitTermination()
    snapshots.compact(spark, path)
    return _found(embed.search_texts(streams.read_documents(spark, path), asked, model))


@query
def stream_extracted_from_four(spark, sf_dir):
    """As ``stream_extracted``, from four streams that are joined as their rows come; a last row of each ends them."""
    arriving = derived.arriving_invoice_base(spark, sf_dir)
    schema = spark.read.parquet(arriving).schema
    minutes = {"uploads": 0, "primary": 5, "alternate": 10, "responses": 30}
    streamed = {}
    for name in minutes:
        # rows are derived as they are read: four streams of whole texts need no copy of their own on disk
        rows = derived.document_run_inputs_of(streams.read_stream(spark, arriving, schema))[name]
        at = F.lit(1_700_000_000) + F.col("doc_id") % 1000 + 60 * minutes[name]
        # an upload long after all others, of an id that is no document's, moves every watermark past them
        streamed[name] = rows.withColumn("event_time", F.timestamp_seconds(F.when(F.col("doc_id") == -1, 1_800_000_000).otherwise(at)))
    gathered = streams.stream_gather(**streamed)
    results = streams.stream_extract(gathered, prompts.prompt_registry(spark))
    with streams.state_on_disk(spark):
        return _finished(spark, _result_columns(results), "extracted-from-four").where("doc_id >= 0")


@query
def stream_drift_keyed(spark, sf_dir):
    path, checkpoint = work_dir(spark, "keyed-drift"), work_dir(spark, "keyed-drift-checkpoint")
    streams.stream_drift_keyed(_event_runs(spark, sf_dir), path, checkpoint).awaitTermination()
    return streams.latest_keyed_drift(spark, path).drop("idle")


@query
def stream_drift(spark, sf_dir):
    path, checkpoint = work_dir(spark, "drift"), work_dir(spark, "drift-checkpoint")
    streams.stream_drift(_event_runs(spark, sf_dir), path, checkpoint).awaitTermination()
    return streams.latest_drift(spark, path)


@query
def stream_deduplicated(spark, sf_dir):
    twice = _event_runs(spark, sf_dir).unionByName(_event_runs(spark, sf_dir))
    once = streams.stream_dedup(twice, ["run_id"]).select("run_id", "document_type", "extraction_confidence")
    return _finished(spark, once, "deduplicated")
