"""Document-shaped inputs derived from the given tables: runs, uploads, words, invoices, answers.

Every rule is deterministic and covers whole tables, so work on these inputs grows with them.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixed_values import TAX_RATE
from quire.functions.paths import work_dir
from quire.functions.text import py_round


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_events(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def runs_of(events: DataFrame) -> DataFrame:
    """Run-log rows, one per event; works on a table or a stream of events."""
    return _keyed_events(events).selectExpr(
        "event_id AS run_id",
        "CAST(ts AS TIMESTAMP) AS start_time",
        "CAST(event_id AS STRING) AS document_id",
        "CASE event_type WHEN 'click' THEN 'invoice' WHEN 'view' THEN 'contract' WHEN 'purchase' THEN 'report'"
        " WHEN 'signup' THEN 'receipt' ELSE 'unknown' END AS document_type",
        "CASE WHEN k <> 99 THEN concat('v', user_id % 3 + 1) END AS prompt_version",
        "CASE WHEN event_id % 2 = 0 THEN 'tesseract' ELSE 'doctr' END AS ocr_engine",
        "'model-a' AS llm_model",
        "CASE WHEN event_type = 'error' AND k < 20 THEN 'failed' ELSE 'completed' END AS status",
        "CASE WHEN event_type = 'error' AND k < 10 THEN 'TimeoutError'"
        " WHEN event_type = 'error' AND k < 20 THEN 'ValueError' END AS error_type",
        "CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS ocr_confidence",
        "CAST(event_id * 53 % 12000 AS DOUBLE) AS ocr_time_ms",
        # clicks and errors of the last eighteen hours are worse: something for the drift check to find
        "CAST(CASE WHEN event_type IN ('click', 'error') AND ts >= TIMESTAMP_NTZ '2024-01-30 06:00:00'"
        " THEN greatest(k - 30, 0) ELSE k END AS DOUBLE) / 100 AS extraction_confidence",
        "k % 14 AS fields_extracted",
        "CASE WHEN k = 50 THEN 0 ELSE 13 END AS total_fields",
        "CAST((k % 14) AS DOUBLE) / CASE WHEN k = 50 THEN 1 ELSE 13 END AS field_completeness",
        "round(value * 100) AS processing_time_ms",
        "CASE WHEN k % 8 = 0 THEN CAST(array() AS ARRAY<STRING>)"
        " ELSE transform(sequence(1, k % 8), i -> concat('warning ', i)) END AS warnings",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def page_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests, one per web page, with good and bad names and sizes."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS doc_id",
        "CASE page_id % 10 WHEN 0 THEN concat('f', page_id, '.PDF') WHEN 1 THEN concat('f', page_id, '.png')"
        " WHEN 2 THEN concat('f', page_id, '.exe') WHEN 3 THEN concat('f', page_id)"
        " WHEN 4 THEN concat('f', page_id, '.tar.jpeg') WHEN 5 THEN concat('f', page_id, '.tif')"
        " WHEN 6 THEN concat('f', page_id, '.') WHEN 7 THEN '' WHEN 8 THEN NULL"
        " ELSE concat('f', page_id, '.webp') END AS filename",
        "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 52428801 WHEN page_id % 13 = 0 THEN 52428800"
        " ELSE length(html) END AS size",
    )


def words(spark: SparkSession, sf_dir: str, multiplier: int = 31, engine: str = "tesseract") -> DataFrame:
    """Recognised words: whole documents cut at line ends (five lines a page) and blanks."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_at", "line_text")
    )
    cut = lines.select("doc_id", "line_at", F.posexplode(F.split("line_text", " ")).alias("word_at", "value"))
    return cut.selectExpr(
        "doc_id",
        f"'{engine}' AS engine",
        "CAST(line_at div 5 + 1 AS BIGINT) AS page",
        "CAST(1 AS BIGINT) AS block",
        "CAST(line_at + 1 AS BIGINT) AS line",
        "CAST(word_at + 1 AS BIGINT) AS word",
        "value",
        f"CAST((doc_id * {multiplier} + (line_at + 1) * 17 + (word_at + 1) * 7) % 103 - 1 AS DOUBLE) AS conf",
    )


def pages_of_words(spark: SparkSession, sf_dir: str, engine: str = "tesseract") -> DataFrame:
    """Recognised pages: those of ``words`` and a blank last one per document."""
    numbers = F.expr("sequence(1L, CAST((size(split(text, '\n')) - 1) div 5 + 2 AS BIGINT))")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(engine).alias("engine"), F.explode(numbers).alias("page"))


def engine_results(spark: SparkSession, sf_dir: str, alternate: bool) -> DataFrame:
    """One engine's result per document; no text where it failed.

    Neither engine reads every language: the first fails on Spanish, the second on German.
    """
    lang, engine, step = ("de", "doctr", 37) if alternate else ("es", "tesseract", 31)
    text = "concat('  ', text, '\n')" if alternate else "text"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"'{engine}' AS engine",
        f"CASE WHEN lang <> '{lang}' THEN {text} END AS raw_text",
        f"CAST(doc_id * {step} % 128 AS DOUBLE) / 128 AS confidence",
        "CAST((size(split(text, '\n')) - 1) div 5 + 1 AS BIGINT) AS page_count",
    )


TYPE_SUFFIX = (
    "CASE doc_id % 6 WHEN 0 THEN ' Amount Due' WHEN 1 THEN ' AGREEMENT' WHEN 2 THEN ' Findings'"
    " WHEN 3 THEN ' Paid' WHEN 4 THEN ' Receipt total' ELSE '' END"
)


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a closing word that tells the type, and what a caller asked for."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"concat(text, {TYPE_SUFFIX}) AS raw_text",
        "CASE lang WHEN 'en' THEN 'unknown' WHEN 'de' THEN 'contract' WHEN 'es' THEN 'receipt' ELSE 'invoice' END"
        " AS requested_type",
        "CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN '' END AS prompt_version",
        "CASE doc_id % 5 WHEN 0 THEN ' Invoice.' WHEN 1 THEN 'a contract or report' WHEN 2 THEN 'letter'"
        " WHEN 3 THEN NULL ELSE concat('RECEIPT ', source) END AS answer",
    )


def invoice_base(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One invoice per order with lines: parties, items (as JSON and as text) and amounts.

    Rows are placed by order, in ``parts`` if given, while they are still numbers and names; their texts are built
    after that, and the grouping and the join to the orders find them in place, so no text is ever shuffled.
    """
    money = "CAST({} AS DECIMAL(18,2))"
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    named = (
        table(spark, sf_dir, "lineitem")
        .select(columns)
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
        .select(*columns, "p_name", "p_retailprice", "s_name")
    )
    placed = named.repartition(parts, "l_orderkey") if parts else named.repartition("l_orderkey")
    lines = placed.selectExpr(
        "l_orderkey",
        "s_name",
        f"{money.format('l_extendedprice')} AS total",
        "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,"
        f" concat('{{\"description\":\"', p_name, '\",\"quantity\":', {money.format('l_quantity')},"
        f" ',\"unit_price\":', {money.format('p_retailprice')}, ',\"total\":',"
        f" {money.format('l_extendedprice')}, '}}') AS json,"
        f" concat(p_name, '  ', CAST(l_quantity AS BIGINT), '  $', {money.format('p_retailprice')}, '  $',"
        f" {money.format('l_extendedprice')}) AS line) AS item",
    )
    grouped = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min("s_name").alias("vendor"),
        F.sum("total").cast("decimal(18,2)").alias("subtotal"),
        F.array_sort(F.collect_list("item")).alias("items"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    orders = orders.join(customers, F.expr("o_custkey = c_custkey"))
    return (
        grouped.join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            "l_orderkey AS doc_id",
            "o_orderpriority AS priority",
            "date_format(o_orderdate, 'yyyy-MM-dd') AS issued",
            "vendor",
            "c_name AS customer",
            "c_mktsegment AS segment",
            "n_items",
            "array_join(items.json, ',') AS items_json",
            "array_join(items.line, '\n') AS items_text",
            "subtotal",
        )
        .withColumn("tax", py_round(F.col("subtotal").cast("double") * TAX_RATE, 2).cast("decimal(18,2)"))
        .selectExpr("*", "CAST(subtotal + tax AS DECIMAL(18,2)) AS total")
        .selectExpr(
            "*", "CAST(total + CASE WHEN doc_id % 17 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)) AS stated_total"
        )
    )


_BUCKET_ORDERS = 40_000  # of a bucket, about, in a large table
_LEAST_ORDERS = 2_000  # and in a small one


def stored_invoice_base(spark: SparkSession, sf_dir: str, bucketed: bool = True) -> DataFrame:
    """``invoice_base`` written once to the shared work folder, for queries that read it several times.

    It is bucketed by ``doc_id``, so that what is derived from it joins by ``doc_id`` without a shuffle; without
    ``bucketed`` it is read as plain files.
    """
    orders = table(spark, sf_dir, "orders").count()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(usual, orders // _LEAST_ORDERS), orders // _BUCKET_ORDERS)
    path = work_dir(spark, "invoices")
    name = f"quire_invoices_{uuid.uuid4().hex}"
    base = invoice_base(spark, sf_dir, parts)
    base.write.bucketBy(parts, "doc_id").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name) if bucketed else spark.read.parquet(path)


def arriving_invoice_base(spark: SparkSession, sf_dir: str) -> str:
    """A folder of ``invoice_base`` rows, to be read as a stream; a further one, of the id -1, is there to end it."""
    path = work_dir(spark, "invoices")
    invoice_base(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    closing = spark.read.parquet(path).limit(1).withColumn("doc_id", F.lit(-1).cast("long"))
    closing.write.mode("append").parquet(path)
    return path


def invoice_answers_of(base: DataFrame) -> DataFrame:
    """Model answers about invoices: clean, fenced, after a sentence, broken, and with odd values."""
    answer = (
        "concat('{\"invoice_number\":\"INV-', doc_id, '\",\"invoice_date\":\"', issued, '\",\"vendor_name\":',"
        " CASE WHEN doc_id % 8 = 7 THEN 'null' ELSE concat('\"', vendor, '\"') END,"
        " ',\"customer_name\":\"', CASE WHEN doc_id % 19 = 3 THEN lower(customer) ELSE customer END, '\",\"line_items\":',"
        " CASE WHEN doc_id % 19 = 5 THEN 'null' ELSE concat('[', answered_items, ']') END,"
        " CASE WHEN doc_id % 19 = 4 THEN '' ELSE concat(',\"subtotal\":', subtotal) END,"
        " ',\"tax\":', CASE WHEN doc_id % 19 = 7 THEN '\"\"' ELSE CAST(tax AS STRING) END, ',\"total_amount\":',"
        " CASE doc_id % 19 WHEN 0 THEN CAST(CAST(stated_total + 0.005 AS DECIMAL(18,3)) AS STRING)"
        " WHEN 1 THEN CAST(CAST(stated_total + 0.02 AS DECIMAL(18,2)) AS STRING)"
        " WHEN 2 THEN concat('\"', stated_total, '\"') WHEN 6 THEN '\"12.5d\"' ELSE CAST(stated_total AS STRING) END,"
        " ',\"currency\":', CASE WHEN doc_id % 8 = 7 THEN '\"\"' ELSE '\"USD\"' END, '}')"
    )
    # totals of items as text: a number, one with a letter after it, one with its currency
    quoted = "replace(replace(items_json, '\"total\":', '\"total\":\"{}'), '}}', '{}\"}}')"
    items = (
        f"CASE doc_id % 23 WHEN 9 THEN {quoted.format('', '')} WHEN 11 THEN {quoted.format('', 'd')}"
        f" WHEN 13 THEN {quoted.format('$', '')} ELSE items_json END"
    )
    return base.withColumn("answered_items", F.expr(items)).withColumn("answer", F.expr(answer)).selectExpr(
        "doc_id",
        "CASE doc_id % 8 WHEN 3 THEN concat('```json\n', answer, '\n```') WHEN 4 THEN concat('Here it is:\n', answer)"
        " WHEN 5 THEN concat(answer, ' x {\"b\":2}') WHEN 6 THEN CASE doc_id % 3 WHEN 0 THEN 'not json'"
        " WHEN 1 THEN '[1, 2]' END ELSE answer END AS raw",
        "CASE priority WHEN '1-URGENT' THEN 'report' WHEN '2-HIGH' THEN 'receipt' ELSE 'invoice' END AS document_type",
        "CASE WHEN doc_id % 2 = 0 THEN 'v1.0' ELSE 'v2.0' END AS prompt_version",
    )


def invoice_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_answers_of(invoice_base(spark, sf_dir))


def contract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers about contracts, one per customer, some with missing or empty fields."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return (
        table(spark, sf_dir, "customer")
        .join(places, F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "c_custkey AS doc_id",
            "concat('{\"contract_title\":\"Agreement with ', c_name, '\",\"parties\":',"
            " CASE WHEN c_custkey % 5 = 1 THEN '[]' ELSE concat('[\"', c_name, '\",\"', n_name, '\"]') END,"
            " ',\"effective_date\":', CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE '\"1 January 2024\"' END,"
            " CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',\"expiration_date\":\"2025-12-31\"' END,"
            " ',\"contract_value\":', CAST(c_acctbal AS DECIMAL(18,2)), ',\"key_terms\":[\"', c_mktsegment,"
            " '\"],\"governing_law\":', CASE WHEN c_custkey % 4 = 0 THEN '\"\"' ELSE concat('\"', r_name, '\"') END, '}')"
            " AS raw",
            "'contract' AS document_type",
        )
    )


_PLAIN_TEXT = (
    "concat(CASE doc_id % 5 WHEN 0 THEN concat('Invoice Number: INV-', doc_id, '   Date: ', issued)"
    " WHEN 1 THEN concat('INVOICE #INV-', doc_id, '\nDate: ', issued)"
    " ELSE concat('Invoice Number: INV-', doc_id, '\nDate: ', issued) END,"
    " '\nDue: ', issued, '\nFROM: ', vendor, ', Dock ', n_items, '\nTO: ', customer, ', ', segment,"
    " '\n\nItem  Qty  Unit Price  Total\n', items_text, '\n\nSubtotal: $', subtotal, '\nTax (8.5%): $', tax,"
    " '\nTOTAL: $', stated_total, '\nPayment Terms: Net 30')"
)


def invoice_texts_of(base: DataFrame) -> DataFrame:
    """Invoices as plain text in three layouts."""
    return base.selectExpr("doc_id", f"{_PLAIN_TEXT} AS raw_text")


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_texts_of(invoice_base(spark, sf_dir))


def invoice_layouts_of(base: DataFrame) -> DataFrame:
    """Invoices in more layouts: as above, parties side by side, below their labels, and all labels above their values."""
    gap = "rpad('', 44, ' ')"
    columns = (
        "concat(rpad('MILL SERVICES', 55, ' '), 'INVOICE\n\n', rpad(concat('Invoice Number: INV-', doc_id), 44, ' '), 'Date: ',"
        f" issued, '\n', {gap}, 'Due:  ', issued, '\n\n', rpad('FROM:', 44, ' '), 'BILL TO:\n', rpad(vendor, 44, ' '), customer,"
        " '\n', rpad(concat('Dock ', n_items), 44, ' '), segment, '\n\nDescription    Qty    Unit Price    Total\n-----\n',"
        f" items_text, '\n\n', {gap}, 'Subtotal:   $', subtotal, '\n', {gap}, 'Tax (8.5%):   $', tax, '\n', {gap},"
        " 'TOTAL DUE:  $', stated_total, '\n\nPayment Terms: Net 30\n')"
    )
    below = (
        "concat('Invoice Number: INV-', doc_id, '\nInvoice Date: ', issued, '\nPayment Due: ', issued, '\n\nSeller: ', vendor,"
        " '\nDock ', n_items, '\n\nBuyer: ', customer, '\n', segment, '\n\nDescription   Qty   Price   Amount\n',"
        " replace(items_text, '$', '€'), '\n\nNet Total: €', subtotal, '\nVAT (8.5%): €', tax, '\nGrand Total: €', stated_total,"
        " '\nTerms: Net 30')"
    )
    above = (
        "concat(rpad('INVOICE NO:', 20, ' '), rpad('DATE:', 16, ' '), 'DUE DATE:\n', rpad(concat('INV-', doc_id), 20, ' '),"
        " rpad(issued, 16, ' '), issued, '\n\n', rpad('SELLER:', 30, ' '), 'BUYER:\n', rpad(vendor, 30, ' '), customer, '\n',"
        " rpad(concat('Dock ', n_items), 30, ' '), segment, '\n\n', items_text, '\n\n', rpad('Subtotal:', 20, ' '),"
        " rpad('Tax (8.5%):', 20, ' '), 'Grand Total:\n', rpad(concat('$', subtotal), 20, ' '), rpad(concat('$', tax), 20, ' '), '$',"
        " stated_total, '\n\nTerms: Net 30')"
    )
    text = f"CASE doc_id % 4 WHEN 1 THEN {columns} WHEN 2 THEN {below} WHEN 3 THEN {above} ELSE {_PLAIN_TEXT} END AS raw_text"
    return base.selectExpr("doc_id", text)


def invoice_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_layouts_of(invoice_base(spark, sf_dir))


def invoice_truth_of(base: DataFrame) -> DataFrame:
    """Expected fields of every invoice, one row per field."""
    number = "CAST({} AS DOUBLE)"
    return base.selectExpr(
        "doc_id AS sample_id",
        "'invoice' AS document_type",
        "stack(9,"
        " 'invoice_number', 'text', concat('INV-', doc_id), CAST(NULL AS DOUBLE),"
        " 'invoice_date', 'text', issued, CAST(NULL AS DOUBLE),"
        " 'vendor_name', 'text', vendor, CAST(NULL AS DOUBLE),"
        " 'customer_name', 'text', customer, CAST(NULL AS DOUBLE),"
        " 'currency', 'text', 'USD', CAST(NULL AS DOUBLE),"
        f" 'subtotal', 'number', CAST(NULL AS STRING), {number.format('subtotal')},"
        f" 'tax', 'number', CAST(NULL AS STRING), {number.format('tax')},"
        f" 'total_amount', 'number', CAST(NULL AS STRING), {number.format('stated_total')},"
        f" 'line_items_count', 'count', CAST(NULL AS STRING), {number.format('n_items')})"
        " AS (field, kind, expected_text, expected_number)",
    )


def document_run_inputs(spark: SparkSession, sf_dir: str, bucketed: bool = False) -> dict[str, DataFrame]:
    """Inputs of a whole run over the invoices: uploads, both engines' results and model answers; plain or ``bucketed``."""
    return document_run_inputs_of(stored_invoice_base(spark, sf_dir, bucketed))


def document_run_inputs_of(base: DataFrame) -> dict[str, DataFrame]:
    """The same of a table or a stream of ``invoice_base`` rows."""
    uploads = base.selectExpr(
        "doc_id",
        "CASE doc_id % 23 WHEN 0 THEN '' WHEN 1 THEN concat('inv', doc_id, '.docx')"
        " ELSE concat('inv', doc_id, '.pdf') END AS filename",
        "CASE WHEN doc_id % 29 = 0 THEN 52428801 ELSE CAST(1000 + n_items AS BIGINT) END AS size",
        "CASE priority WHEN '1-URGENT' THEN 'contract' WHEN '2-HIGH' THEN 'report' WHEN '3-MEDIUM' THEN 'invoice'"
        " ELSE CASE WHEN doc_id % 37 = 0 THEN 'memo' ELSE 'unknown' END END AS requested_type",
        "CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v9' END AS prompt_version",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id) AS created_at",
        "CAST(doc_id % 700 AS DOUBLE) AS processing_time_ms",
    )
    texts = invoice_texts_of(base)
    primary = texts.selectExpr(
        "doc_id",
        "'tesseract' AS engine",
        "CASE WHEN doc_id % 31 = 0 THEN ' \n ' WHEN doc_id % 13 <> 0 THEN raw_text END AS raw_text",
        "CAST(doc_id % 101 AS DOUBLE) / 100 AS confidence",
        "CAST(1 AS BIGINT) AS page_count",
        "CAST(doc_id % 300 AS DOUBLE) AS time_ms",
    )
    alternate = texts.selectExpr(
        "doc_id",
        "'doctr' AS engine",
        "CASE WHEN doc_id % 9 <> 0 THEN concat(raw_text, '\nContract') END AS raw_text",
        "CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id * 3 % 101 AS DOUBLE) / 100 END AS confidence",
        "CAST(2 AS BIGINT) AS page_count",
        "doc_id % 500 + CAST(0.5 AS DOUBLE) AS time_ms",
    )
    responses = invoice_answers_of(base).selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 41 <> 0 THEN raw END AS raw",
        "CASE WHEN doc_id % 41 = 0 THEN 'TimeoutError: no answer' END AS error",
    )
    return {
        "uploads": uploads,
        "primary": primary,
        "alternate": alternate,
        "responses": responses,
    }


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document index: every embedding, with the text of the document of the same number if any."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        table(spark, sf_dir, "embeddings")
        .join(texts, F.expr("vec_id = doc_id"), "left")
        .selectExpr(
            "vec_id AS id",
            "CAST(0 AS BIGINT) AS seq",
            "coalesce(text, '') AS text",
            "embedding",
            "map('document_type', element_at(array('invoice', 'contract', 'report', 'receipt'), label % 4 + 1),"
            " 'filename', concat('f', vec_id, '.pdf')) AS metadata",
        )
    )


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current index rows, one per document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "CAST(0 AS BIGINT) AS seq", "text", "map('document_type', lang) AS metadata"
    )


def document_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-sent documents: each labelled one, and once more where it is labelled good."""
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    again = labelled.withColumn("seq", F.explode(F.expr("sequence(0, CAST(quality AS INT))")))
    return again.selectExpr(
        "doc_id AS id",
        "CAST(seq AS BIGINT) AS seq",
        "concat(text, ' (', seq, ')') AS text",
        "map('document_type', concat(lang, '-', toxic)) AS metadata",
    )
