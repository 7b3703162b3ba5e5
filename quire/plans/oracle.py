"""The registered queries once more as DuckDB SQL, from the given tables up."""

from quire.fixed_values import (
    BLANK_TEXT,
    CLASSIFY_KEYWORDS,
    DOCUMENT_TYPES,
    DRIFT_ADVICE,
    PROMPTS,
    PYTHON_WHITESPACE,
    STABLE_ADVICE,
)
from quire.operators.metrics import HISTOGRAMS


def text(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("'", "''") + "'"


WS = text(PYTHON_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rnd(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def exact(x: str, digits: int) -> str:
    """Rounded on the exact binary value, through text."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE) / count({x}))"


def keyword_case(x: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({x}), {text(w)})' for w in words)} THEN '{name}'"
        for name, words in CLASSIFY_KEYWORDS
    )
    return f"CASE {whens} ELSE 'invoice' END"


# --- inputs ---

RUNS = """
runs AS (
  SELECT event_id AS run_id, ts AS start_time, CAST(event_id AS VARCHAR) AS document_id,
    CASE event_type WHEN 'click' THEN 'invoice' WHEN 'view' THEN 'contract' WHEN 'purchase' THEN 'report'
      WHEN 'signup' THEN 'receipt' ELSE 'unknown' END AS document_type,
    CASE WHEN k <> 99 THEN 'v' || CAST(user_id % 3 + 1 AS VARCHAR) END AS prompt_version,
    CASE WHEN event_id % 2 = 0 THEN 'tesseract' ELSE 'doctr' END AS ocr_engine,
    CASE WHEN event_type = 'error' AND k < 20 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN event_type = 'error' AND k < 10 THEN 'TimeoutError'
      WHEN event_type = 'error' AND k < 20 THEN 'ValueError' END AS error_type,
    CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS ocr_confidence,
    CAST(event_id * 53 % 12000 AS DOUBLE) AS ocr_time_ms,
    CAST(CASE WHEN event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-30 06:00:00'
      THEN greatest(k - 30, 0) ELSE k END AS DOUBLE) / 100 AS extraction_confidence,
    k % 14 AS fields_extracted,
    CASE WHEN k = 50 THEN 0 ELSE 13 END AS total_fields,
    CAST(k % 14 AS DOUBLE) / greatest(CASE WHEN k = 50 THEN 0 ELSE 13 END, 1) AS field_completeness,
    round(value * 100) AS processing_time_ms,
    list_transform(range(1, k % 8 + 1), lambda i: 'warning ' || CAST(i AS VARCHAR)) AS warnings
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def words(multiplier: int = 31) -> str:
    return f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text,
    generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
cut AS (
  SELECT doc_id, line, unnest(string_split(line_text, ' ')) AS value,
    generate_subscripts(string_split(line_text, ' '), 1) AS word FROM lines),
words AS (
  SELECT doc_id, (line - 1) // 5 + 1 AS page, line, word, value,
    CAST((doc_id * {multiplier} + line * 17 + word * 7) % 103 - 1 AS DOUBLE) AS conf FROM cut)"""


PAGES = """
blank_pages AS (
  SELECT doc_id, unnest(range(1, CAST((len(string_split(text, chr(10))) - 1) // 5 + 3 AS BIGINT))) AS page
  FROM documents)"""

ENGINES = """
primary_engine AS (
  SELECT doc_id, CASE WHEN lang <> 'es' THEN text END AS raw_text, CAST(doc_id * 31 % 128 AS DOUBLE) / 128 AS confidence,
    CAST((len(string_split(text, chr(10))) - 1) // 5 + 1 AS BIGINT) AS page_count
  FROM documents),
alternate_engine AS (
  SELECT doc_id, CASE WHEN lang <> 'de' THEN '  ' || text || chr(10) END AS raw_text,
    CAST(doc_id * 37 % 128 AS DOUBLE) / 128 AS confidence,
    CAST((len(string_split(text, chr(10))) - 1) // 5 + 1 AS BIGINT) AS page_count
  FROM documents)"""

TYPED = """
typed AS (
  SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' Amount Due' WHEN 1 THEN ' AGREEMENT' WHEN 2 THEN ' Findings'
      WHEN 3 THEN ' Paid' WHEN 4 THEN ' Receipt total' ELSE '' END AS raw_text,
    CASE lang WHEN 'en' THEN 'unknown' WHEN 'de' THEN 'contract' WHEN 'es' THEN 'receipt' ELSE 'invoice' END
      AS requested_type,
    CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN '' END AS prompt_version,
    CASE doc_id % 5 WHEN 0 THEN ' Invoice.' WHEN 1 THEN 'a contract or report' WHEN 2 THEN 'letter'
      WHEN 3 THEN NULL ELSE 'RECEIPT ' || source END AS answer
  FROM documents)"""

RESOLVED = f"""{TYPED},
resolved AS (
  SELECT *, CASE WHEN requested_type = 'unknown' THEN {keyword_case('raw_text')} ELSE requested_type END
    AS document_type FROM typed)"""

REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"({text(key)}, {text(version)}, {text(system)}, {text(template)})" for key, version, system, template in PROMPTS
) + ") t(key, version, system, template))"


def chosen(source: str) -> str:
    return f"""
chosen AS (
  SELECT s.*, coalesce(
      (SELECT r.key FROM registry r WHERE s.prompt_version <> '' AND r.key = s.document_type || '_' || s.prompt_version),
      (SELECT max(r.key) FROM registry r WHERE starts_with(r.key, s.document_type)), 'invoice_v2') AS prompt_key
  FROM {source} s)"""


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def _money_text(x: str) -> str:
    return f"CAST({_money(x)} AS VARCHAR)"


_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

BASE = f"""
order_items AS (
  SELECT l_orderkey, count(*) AS n_items, min(s_name) AS vendor,
    CAST(sum({_money('l_extendedprice')}) AS DECIMAL(18,2)) AS subtotal,
    string_agg('{{"description":"' || p_name || '","quantity":' || {_money_text('l_quantity')} || ',"unit_price":'
      || {_money_text('p_retailprice')} || ',"total":' || {_money_text('l_extendedprice')} || '}}', ',' {_ORDER})
      AS items_json,
    string_agg(p_name || '  ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '  $' || {_money_text('p_retailprice')}
      || '  $' || {_money_text('l_extendedprice')}, chr(10) {_ORDER}) AS items_text
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
order_tax AS (
  SELECT *, CAST({exact("CAST(subtotal AS DOUBLE) * CAST(0.085 AS DOUBLE)", 2)} AS DECIMAL(18,2)) AS tax
  FROM order_items),
base AS (
  SELECT o_orderkey AS doc_id, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS issued, vendor,
    c_name AS customer, c_mktsegment AS segment, n_items, items_json, items_text, subtotal, tax,
    CAST(subtotal + tax + CASE WHEN o_orderkey % 17 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)) AS stated_total
  FROM order_tax JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

ANSWERS = f"""{BASE},
plain_answers AS (
  SELECT *, '{{"invoice_number":"INV-' || doc_id || '","invoice_date":"' || issued || '","vendor_name":'
    || CASE WHEN doc_id % 8 = 7 THEN 'null' ELSE '"' || vendor || '"' END
    || ',"customer_name":"' || CASE WHEN doc_id % 19 = 3 THEN lower(customer) ELSE customer END || '","line_items":'
    || CASE WHEN doc_id % 19 = 5 THEN 'null' ELSE '[' || CASE doc_id % 23
      WHEN 9 THEN replace(replace(items_json, '"total":', '"total":"'), '}}', '"}}')
      WHEN 11 THEN replace(replace(items_json, '"total":', '"total":"'), '}}', 'd"}}')
      WHEN 13 THEN replace(replace(items_json, '"total":', '"total":"$'), '}}', '"}}') ELSE items_json END || ']' END
    || CASE WHEN doc_id % 19 = 4 THEN '' ELSE ',"subtotal":' || CAST(subtotal AS VARCHAR) END
    || ',"tax":' || CASE WHEN doc_id % 19 = 7 THEN '""' ELSE CAST(tax AS VARCHAR) END || ',"total_amount":'
    || CASE doc_id % 19 WHEN 0 THEN CAST(CAST(stated_total + 0.005 AS DECIMAL(18,3)) AS VARCHAR)
      WHEN 1 THEN CAST(CAST(stated_total + 0.02 AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 2 THEN '"' || CAST(stated_total AS VARCHAR) || '"' WHEN 6 THEN '"12.5d"'
      ELSE CAST(stated_total AS VARCHAR) END
    || ',"currency":' || CASE WHEN doc_id % 8 = 7 THEN '""' ELSE '"USD"' END || '}}' AS answer FROM base),
answers AS (
  SELECT doc_id,
    CASE doc_id % 8 WHEN 3 THEN '```json' || chr(10) || answer || chr(10) || '```'
      WHEN 4 THEN 'Here it is:' || chr(10) || answer WHEN 5 THEN answer || ' x {{"b":2}}'
      WHEN 6 THEN CASE doc_id % 3 WHEN 0 THEN 'not json' WHEN 1 THEN '[1, 2]' END ELSE answer END AS raw,
    CASE priority WHEN '1-URGENT' THEN 'report' WHEN '2-HIGH' THEN 'receipt' ELSE 'invoice' END AS document_type,
    CASE WHEN doc_id % 2 = 0 THEN 'v1.0' ELSE 'v2.0' END AS prompt_version
  FROM plain_answers)"""

CONTRACT_ANSWERS = """
contract_answers AS (
  SELECT c_custkey AS doc_id, '{"contract_title":"Agreement with ' || c_name || '","parties":'
    || CASE WHEN c_custkey % 5 = 1 THEN '[]' ELSE '["' || c_name || '","' || n_name || '"]' END
    || ',"effective_date":' || CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE '"1 January 2024"' END
    || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"expiration_date":"2025-12-31"' END
    || ',"contract_value":' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ',"key_terms":["' || c_mktsegment
    || '"],"governing_law":' || CASE WHEN c_custkey % 4 = 0 THEN '""' ELSE '"' || r_name || '"' END || '}' AS raw,
    'contract' AS document_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def parsed(source: str) -> str:
    """CTEs that end in ``parsed``: the rows of ``source`` with ``parse_path`` and ``data``."""
    return f"""
unfenced AS (
  SELECT *, CASE WHEN starts_with({strip('raw')}, '```') THEN array_to_string(list_filter(
      string_split({strip('raw')}, chr(10)), lambda x: NOT starts_with({strip('x')}, '```')), chr(10))
    ELSE {strip('raw')} END AS clean FROM {source}),
sliced AS (
  SELECT *, CASE WHEN contains(clean, '{{') AND contains(clean, '}}') THEN substr(clean, strpos(clean, '{{'),
      greatest(length(clean) - strpos(reverse(clean), '}}') + 2 - strpos(clean, '{{'), 0)) END AS slice FROM unfenced),
pathed AS (
  SELECT *, CASE WHEN raw IS NULL THEN 'failed'
      WHEN json_valid(clean) THEN CASE WHEN json_type(TRY_CAST(clean AS JSON)) = 'OBJECT' THEN 'strict'
        ELSE 'non_object' END
      WHEN coalesce(json_valid(slice), false) THEN 'slice' ELSE 'raw' END AS parse_path FROM sliced),
parsed AS (
  SELECT *, CASE parse_path WHEN 'strict' THEN TRY_CAST(clean AS JSON) WHEN 'slice' THEN TRY_CAST(slice AS JSON)
      WHEN 'raw' THEN json_object('raw_output', raw) ELSE CAST('{{}}' AS JSON) END AS data FROM pathed)"""


def field(name: str, data: str = "data") -> str:
    return f"json_extract_string({data}, '$.{name}')"


def filled(name: str) -> str:
    return f"CAST(coalesce({field(name)} <> '', false) AS INTEGER)"


def filled_sum(names: list[str]) -> str:
    return "(" + " + ".join(filled(n) for n in names) + ")"


ITEM_COUNT = "coalesce(json_array_length(data, '$.line_items'), 0)"

_INVOICE = ["invoice_number", "vendor_name", "total_amount", "invoice_date"]
_INVOICE_MORE = ["customer_name", "line_items", "subtotal", "tax", "currency"]
_CONTRACT = ["contract_title", "parties", "effective_date"]
_CONTRACT_MORE = ["expiration_date", "contract_value", "key_terms", "governing_law"]

_INVOICE_SCORE = f"({filled_sum(_INVOICE)} / 4.0::DOUBLE * 0.7::DOUBLE + {filled_sum(_INVOICE_MORE)} / 5.0::DOUBLE * 0.3::DOUBLE)"
_CONTRACT_SCORE = f"({filled_sum(_CONTRACT)} / 3.0::DOUBLE * 0.7::DOUBLE + {filled_sum(_CONTRACT_MORE)} / 4.0::DOUBLE * 0.3::DOUBLE)"
_KEYS = "json_keys(data)"
_FILLED_KEYS = f"len(list_filter({_KEYS}, lambda x: coalesce(json_extract_string(data, '$.' || x) <> '', false)))"
NON_NULL_KEYS = f"len(list_filter({_KEYS}, lambda x: json_extract_string(data, '$.' || x) IS NOT NULL))"
SCORE = f"""CASE document_type WHEN 'invoice' THEN {exact(_INVOICE_SCORE, 4)} WHEN 'contract' THEN {exact(_CONTRACT_SCORE, 4)}
    ELSE CAST({_FILLED_KEYS} AS DOUBLE) / greatest(len({_KEYS}), 1) END"""

SCORED_SOURCE = f"""{ANSWERS},{CONTRACT_ANSWERS},
both_answers AS (
  SELECT doc_id, raw, document_type FROM answers UNION ALL SELECT doc_id, raw, document_type FROM contract_answers),
{parsed('both_answers')}"""

INVOICE_TEXTS = f"""{BASE},
invoice_texts AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Invoice Number: INV-' || doc_id || '   Date: ' || issued
      WHEN 1 THEN 'INVOICE #INV-' || doc_id || chr(10) || 'Date: ' || issued
      ELSE 'Invoice Number: INV-' || doc_id || chr(10) || 'Date: ' || issued END
    || chr(10) || 'Due: ' || issued || chr(10) || 'FROM: ' || vendor || ', Dock ' || n_items || chr(10) || 'TO: '
    || customer || ', ' || segment || chr(10) || chr(10) || 'Item  Qty  Unit Price  Total' || chr(10) || items_text
    || chr(10) || chr(10) || 'Subtotal: $' || subtotal || chr(10) || 'Tax (8.5%): $' || tax || chr(10) || 'TOTAL: $'
    || stated_total || chr(10) || 'Payment Terms: Net 30' AS raw_text
  FROM base)"""

INDEX = """
index_rows AS (
  SELECT vec_id AS id, coalesce(text, '') AS text, embedding,
    ['invoice', 'contract', 'report', 'receipt'][label % 4 + 1] AS document_type
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""

QUERY_VECTORS = """
query_vectors AS (
  SELECT id AS query_id, CAST(embedding AS DOUBLE[]) AS vector FROM index_rows WHERE id % 50 = 0)"""


def nearest(k: int, where: str = "true") -> str:
    return f"""WITH {INDEX}, {QUERY_VECTORS},
scored AS (
  SELECT query_id, id, text, document_type,
    round(1 - list_cosine_similarity(vector, CAST(embedding AS DOUBLE[])), 9) AS distance
  FROM query_vectors CROSS JOIN index_rows WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM scored)
SELECT query_id, rank, id, substr(text, 1, 200) || '...' AS text_preview, document_type,
  {exact('distance', 6)} AS distance FROM ranked WHERE rank <= {k}"""


def recent(n: int, where: str = "true") -> str:
    return f"""
recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY start_time DESC, run_id DESC)
    AS recency FROM runs WHERE {where}) WHERE recency <= {n})"""


def comparison(n: int | None, where: str = "true") -> str:
    chosen = recent(n, where) if n else f"recent AS (SELECT * FROM runs WHERE {where})"
    return f"""WITH {RUNS}, {chosen}
SELECT document_type, prompt_version, count(*) AS run_count,
  {rnd(mean('extraction_confidence'), 4)} AS avg_extraction_confidence,
  {rnd(mean('processing_time_ms'), 2)} AS avg_processing_time_ms,
  {rnd(mean('field_completeness'), 4)} AS avg_field_completeness
FROM recent WHERE prompt_version IS NOT NULL GROUP BY ALL"""


def drift(w: int, where: str = "true") -> str:
    return f"""WITH {RUNS}, {recent(2 * w, where)},
counted AS (SELECT *, count(*) OVER (PARTITION BY document_type) AS n FROM recent),
means AS (
  SELECT document_type, count(*) AS runs,
    {mean(f'CASE WHEN recency <= {w} THEN extraction_confidence END')} AS recent_mean,
    {mean(f'CASE WHEN recency > n - {w} THEN extraction_confidence END')} AS baseline_mean
  FROM counted GROUP BY document_type)
SELECT document_type, runs,
  CASE WHEN runs < {w} THEN 'insufficient_data' WHEN baseline_mean - recent_mean > 0.05::DOUBLE THEN 'drift_detected'
    ELSE 'stable' END AS status,
  CASE WHEN runs >= {w} THEN {rnd('recent_mean', 4)} END AS recent_avg_confidence,
  CASE WHEN runs >= {w} THEN {rnd('baseline_mean', 4)} END AS baseline_avg_confidence,
  CASE WHEN runs >= {w} THEN {rnd('baseline_mean - recent_mean', 4)} END AS drift_magnitude,
  CASE WHEN runs >= {w} THEN 0.85::DOUBLE END AS threshold,
  CASE WHEN runs >= {w} THEN CASE WHEN baseline_mean - recent_mean > 0.05::DOUBLE THEN {text(DRIFT_ADVICE)}
    ELSE {text(STABLE_ADVICE)} END END AS recommendation
FROM means"""


def histogram_parts(value: str, bounds: list[float], labels: list[str], source: str) -> str:
    names = ", ".join(labels)
    rows = [(str(b), f"v <= {b!r}::DOUBLE") for b in bounds] + [("+Inf", "v IS NOT NULL")]
    parts = [
        f"SELECT {names}, '{le}' AS le, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS cumulative_count,"
        f" count(v) AS total_count, {exact('coalesce(sum(v), 0)', 4)} AS total_sum FROM valued GROUP BY {names}"
        for le, cond in rows
    ]
    return f"WITH {source}, valued AS (SELECT *, CAST({value} AS DOUBLE) AS v FROM runs)\n" + "\nUNION ALL ".join(parts)


FLIGHT = f"""{RUNS},
changes AS (
  SELECT epoch_us(start_time) AS at_us, 1 AS change FROM runs
  UNION ALL SELECT epoch_us(start_time) + CAST(floor(processing_time_ms * 1000) AS BIGINT), -1 FROM runs),
flight AS (
  SELECT at_us, CAST(sum(change) AS BIGINT) AS net,
    CAST(sum(sum(change)) OVER (ORDER BY at_us) AS BIGINT) AS in_flight FROM changes GROUP BY at_us)"""


def _truth() -> str:
    fields = [
        ("invoice_number", "text", "'INV-' || doc_id", "NULL"),
        ("invoice_date", "text", "issued", "NULL"),
        ("vendor_name", "text", "vendor", "NULL"),
        ("customer_name", "text", "customer", "NULL"),
        ("currency", "text", "'USD'", "NULL"),
        ("subtotal", "number", "NULL", "subtotal"),
        ("tax", "number", "NULL", "tax"),
        ("total_amount", "number", "NULL", "stated_total"),
        ("line_items_count", "count", "NULL", "n_items"),
    ]
    return "truth AS (" + " UNION ALL ".join(
        f"SELECT doc_id AS sample_id, 'invoice' AS document_type, '{name}' AS field, '{kind}' AS kind,"
        f" CAST({expected} AS VARCHAR) AS expected_text, CAST({number} AS DOUBLE) AS expected_number FROM base"
        for name, kind, expected, number in fields
    ) + ")"


MATCHES = f"""{ANSWERS},{parsed('answers')}, {_truth()},
matches AS (
  SELECT t.sample_id, t.document_type, p.prompt_version, t.field, t.kind, coalesce(CASE t.kind
      WHEN 'count' THEN {ITEM_COUNT} = expected_number
      WHEN 'number' THEN abs(coalesce(CASE WHEN coalesce(json_extract_string(data, '$.' || t.field), '') = '' THEN 0
        ELSE TRY_CAST(json_extract_string(data, '$.' || t.field) AS DOUBLE) END, 1e300) - expected_number) < 0.01::DOUBLE
      ELSE lower({strip("coalesce(json_extract_string(data, '$.' || t.field), '')")}) = lower({strip('expected_text')})
    END, false) AS match
  FROM truth t LEFT JOIN parsed p ON t.sample_id = p.doc_id)"""

ACCURACY = (
    "CAST(count(*) FILTER (WHERE match) AS BIGINT) AS correct, count(*) AS total, "
    + exact("CAST(count(*) FILTER (WHERE match) AS DOUBLE) / greatest(count(*), 1)", 4)
    + " AS accuracy"
)

RESULTS = f"""{ANSWERS},
{INVOICE_TEXTS.removeprefix(BASE + ',')},
uploads AS (
  SELECT b.doc_id, CASE b.doc_id % 23 WHEN 0 THEN '' WHEN 1 THEN 'inv' || b.doc_id || '.docx'
      ELSE 'inv' || b.doc_id || '.pdf' END AS filename,
    CASE WHEN b.doc_id % 29 = 0 THEN 52428801 ELSE 1000 END AS size,
    CASE priority WHEN '1-URGENT' THEN 'contract' WHEN '2-HIGH' THEN 'report' WHEN '3-MEDIUM' THEN 'invoice'
      ELSE CASE WHEN b.doc_id % 37 = 0 THEN 'memo' ELSE 'unknown' END END AS requested_type,
    CASE b.doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v9' END AS prompt_version,
    CASE WHEN b.doc_id % 31 = 0 THEN ' ' || chr(10) || ' ' WHEN b.doc_id % 13 <> 0 THEN raw_text END AS p_text,
    CAST(b.doc_id % 101 AS DOUBLE) / 100 AS p_conf,
    CASE WHEN b.doc_id % 9 <> 0 THEN raw_text || chr(10) || 'Contract' END AS a_text,
    CASE WHEN b.doc_id % 9 <> 0 THEN CAST(b.doc_id * 3 % 101 AS DOUBLE) / 100 END AS a_conf
  FROM base b JOIN invoice_texts t ON b.doc_id = t.doc_id),
read AS (
  SELECT *, p_text IS NULL OR (p_conf < 0.7::DOUBLE AND coalesce(a_conf, 0) > p_conf) AS alternate FROM uploads),
picked AS (
  SELECT *, {strip("coalesce(CASE WHEN alternate THEN a_text ELSE p_text END, '')")} AS raw_text,
    {exact('coalesce(CASE WHEN alternate THEN a_conf ELSE p_conf END, 0)', 4)} AS ocr_confidence,
    CASE WHEN NOT alternate THEN 'tesseract' WHEN a_text IS NOT NULL THEN 'doctr' ELSE 'none' END AS engine_used,
    CASE WHEN NOT alternate THEN CAST(doc_id % 300 AS DOUBLE) WHEN a_text IS NOT NULL THEN doc_id % 500 + 0.5::DOUBLE END AS ocr_time_ms
  FROM read),
coded AS (
  SELECT *, CASE WHEN requested_type = 'memo' THEN 422 WHEN filename = '' OR NOT ends_with(filename, '.pdf') THEN 400 WHEN size > 52428800 THEN 413
      WHEN raw_text = '' THEN 422 ELSE 200 END AS status_code,
    CASE WHEN requested_type = 'memo' THEN 'Unknown document type. Declared: invoice, contract, report, receipt, unknown'
      WHEN filename = '' THEN 'No filename provided.' WHEN NOT ends_with(filename, '.pdf')
      THEN 'Unsupported file type: .docx. Allowed: {{''.bmp'', ''.jpeg'', ''.jpg'', ''.pdf'', ''.png'', ''.tiff'', ''.webp''}}' WHEN size > 52428800 THEN 'File too large. Max size: 50MB'
      WHEN raw_text = '' THEN {text(BLANK_TEXT)} END AS reason FROM picked),
typed_uploads AS (
  SELECT *, CASE WHEN requested_type = 'unknown' THEN {keyword_case('raw_text')} ELSE requested_type END
    AS document_type FROM coded),
{REGISTRY},
{chosen('typed_uploads')},
answered AS (
  SELECT c.*, r.version AS version_used, CASE WHEN c.doc_id % 41 <> 0 THEN a.raw END AS raw FROM chosen c JOIN registry r ON c.prompt_key = r.key
    LEFT JOIN answers a ON c.doc_id = a.doc_id),
{parsed('answered')},
results AS (
  SELECT doc_id, filename, ocr_time_ms, CASE WHEN status_code = 200 THEN 'completed' ELSE 'failed' END AS status, status_code, reason,
    CASE WHEN status_code = 200 THEN document_type END AS document_type,
    CASE WHEN status_code = 200 THEN engine_used END AS engine_used,
    CASE WHEN status_code = 200 THEN ocr_confidence END AS ocr_confidence,
    CASE WHEN status_code = 200 THEN CAST(1 AS BIGINT) END AS page_count,
    CASE WHEN status_code = 200 THEN length(raw_text) END AS chars,
    CASE WHEN status_code = 200 THEN prompt_key END AS prompt_key,
    CASE WHEN status_code = 200 THEN version_used END AS prompt_version,
    CASE WHEN status_code = 200 THEN parse_path END AS parse_path,
    CASE WHEN status_code = 200 THEN {SCORE} END AS confidence_score,
    CASE WHEN status_code = 200 THEN CAST({NON_NULL_KEYS} AS BIGINT) END AS fields_extracted,
    CASE WHEN status_code = 200 THEN CAST(len({_KEYS}) AS BIGINT) END AS total_fields,
    CASE WHEN status_code = 200 AND ocr_confidence < 0.7::DOUBLE THEN 'Low OCR confidence ('
      || printf('%.2f', ocr_confidence) || '). Results may be inaccurate.' ELSE '' END AS warnings
  FROM parsed)"""

RESULT_ROWS = f"""WITH {RESULTS}
SELECT doc_id, status, CAST(status_code AS BIGINT) AS status_code, reason, document_type, engine_used, ocr_confidence,
  page_count, chars, prompt_key, prompt_version, parse_path, confidence_score, fields_extracted, total_fields, warnings
FROM results"""

_UPSERT = """
SELECT id, seq, text, document_type FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, updated DESC) AS r FROM ({rows})) WHERE r = 1"""


def closed_windows(hours: int, slide: int) -> str:
    """Runs joined to the windows of which the end lies before the watermark (latest start less one hour)."""
    steps = hours // slide
    width, hop = hours * 3_600_000_000, slide * 3_600_000_000
    return f"""{RUNS},
spans AS (
  SELECT runs.*, epoch_us(start_time) // {hop} * {hop} - i * {hop} AS window_us
  FROM runs CROSS JOIN (SELECT unnest(range({steps})) AS i)),
closed AS (
  SELECT * FROM spans
  WHERE window_us + {width} <= (SELECT max(epoch_ms(start_time)) * 1000 - 3600000000 FROM runs))"""


ORACLE: dict[str, str] = {
    "runs_logged": f"""WITH {RUNS}
SELECT run_id, document_type, field_completeness, 'production' AS environment,
  CASE WHEN len(warnings) > 0 THEN 'true' END AS has_warnings,
  CASE WHEN len(warnings) > 0 THEN array_to_string(warnings[1:5], '; ') END AS warnings FROM runs""",
    "documents_upserted": _UPSERT.format(
        rows="""SELECT doc_id AS id, CAST(0 AS BIGINT) AS seq, text, lang AS document_type, 0 AS updated FROM documents
  UNION ALL SELECT d.doc_id, s.seq, text || ' (' || s.seq || ')', lang || '-' || toxic, 1
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN (SELECT unnest(range(2)) AS seq) s ON s.seq <= l.quality"""
    ),
    "uploads_routed": """WITH named AS (
  SELECT page_id AS doc_id, coalesce(CASE page_id % 10 WHEN 0 THEN 'f' || page_id || '.PDF'
      WHEN 1 THEN 'f' || page_id || '.png' WHEN 2 THEN 'f' || page_id || '.exe' WHEN 3 THEN 'f' || page_id
      WHEN 4 THEN 'f' || page_id || '.tar.jpeg' WHEN 5 THEN 'f' || page_id || '.tif' WHEN 6 THEN 'f' || page_id || '.'
      WHEN 7 THEN '' WHEN 8 THEN NULL ELSE 'f' || page_id || '.webp' END, '') AS name,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 52428801 WHEN page_id % 13 = 0 THEN 52428800
      ELSE length(html) END AS size FROM pages),
cut AS (
  SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS extension FROM named),
judged AS (
  SELECT *, extension NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp', 'webp') AS bad FROM cut)
SELECT doc_id, extension, CAST(CASE WHEN name = '' OR bad THEN 400 WHEN size > 52428800 THEN 413 ELSE 200 END AS BIGINT)
    AS status_code,
  CASE WHEN name = '' THEN 'No filename provided.' WHEN bad THEN 'Unsupported file type: '
      || CASE WHEN contains(name, '.') THEN '.' ELSE '' END || extension || '. Allowed: {''.bmp'', ''.jpeg'', ''.jpg'', ''.pdf'', ''.png'', ''.tiff'', ''.webp''}'
    WHEN size > 52428800 THEN 'File too large. Max size: 50MB' END AS reason FROM judged""",
    "ocr_flagged": f"""WITH {ENGINES}, blanked AS (
  SELECT doc_id, confidence, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(10) || chr(9) || chr(160) ELSE raw_text END AS raw_text
  FROM primary_engine),
judged AS (SELECT *, {strip("coalesce(raw_text, '')")} = '' AS blank FROM blanked)
SELECT doc_id, CAST(CASE WHEN blank THEN 422 ELSE 200 END AS BIGINT) AS status_code,
  CASE WHEN blank THEN {text(BLANK_TEXT)} END AS reason,
  CASE WHEN NOT blank AND confidence < 0.7::DOUBLE THEN 'Low OCR confidence (' || printf('%.2f', confidence)
    || '). Results may be inaccurate.' ELSE '' END AS warnings FROM judged""",
    "text_assembled": f"""WITH {words()},
line_texts AS (SELECT doc_id, page, line, string_agg(value, ' ' ORDER BY word) AS line_text FROM words GROUP BY ALL),
page_texts AS (
  SELECT doc_id, page, string_agg(line_text, chr(10) ORDER BY line) AS page_text FROM line_texts GROUP BY ALL)
SELECT doc_id, 'tesseract' AS engine, {strip("string_agg(page_text, chr(10) || chr(10) ORDER BY page)")} AS raw_text,
  count(*) AS page_count FROM page_texts GROUP BY doc_id""",
    "text_assembled_with_blank_pages": f"""WITH {words()}, {PAGES},
line_texts AS (SELECT doc_id, page, line, string_agg(value, ' ' ORDER BY word) AS line_text FROM words GROUP BY ALL),
page_texts AS (
  SELECT doc_id, page, string_agg(line_text, chr(10) ORDER BY line) AS page_text FROM line_texts GROUP BY ALL),
all_pages AS (SELECT b.doc_id, b.page, coalesce(page_text, '') AS page_text
  FROM blank_pages b LEFT JOIN page_texts p ON b.doc_id = p.doc_id AND b.page = p.page)
SELECT doc_id, 'tesseract' AS engine,
  length({strip("string_agg(page_text, chr(10) || chr(10) ORDER BY page)")}) AS chars,
  count(*) AS page_count FROM all_pages GROUP BY doc_id""",
    "confidence_by_page": f"""WITH {words()}, {PAGES},
by_page AS (SELECT doc_id, page, avg(conf) / 100 AS c FROM words WHERE conf > 0 GROUP BY ALL)
SELECT b.doc_id, 'tesseract' AS engine, {exact('least(sum(coalesce(c, 0)) / count(*), 1)', 4)} AS confidence,
  count(*) AS page_count
FROM blank_pages b LEFT JOIN by_page p ON b.doc_id = p.doc_id AND b.page = p.page GROUP BY b.doc_id""",
    "confidence_by_word": f"""WITH {words(37)}
SELECT doc_id, 'doctr' AS engine, {exact('avg(greatest(conf, 0) / 128)', 4)} AS confidence, count(conf) AS word_count
FROM words GROUP BY doc_id""",
    "ocr_reconciled": f"""WITH {ENGINES}, both_engines AS (
  SELECT p.doc_id, p.raw_text AS p_text, p.confidence AS p_conf, a.raw_text AS a_text,
    a.confidence AS a_conf, p.page_count,
    p.raw_text IS NULL OR (p.confidence < 0.7::DOUBLE AND a.raw_text IS NOT NULL AND a.confidence > p.confidence)
      AS alternate
  FROM primary_engine p JOIN alternate_engine a ON p.doc_id = a.doc_id)
SELECT doc_id, {strip('CASE WHEN alternate THEN a_text ELSE p_text END')} AS raw_text,
  {exact('CASE WHEN alternate THEN a_conf ELSE p_conf END', 4)} AS confidence,
  CASE WHEN alternate THEN 'doctr' ELSE 'tesseract' END AS engine_used, page_count, CAST(NULL AS DOUBLE) AS ocr_time_ms
FROM both_engines""",
    "classified_by_keywords": f"WITH {TYPED} SELECT doc_id, {keyword_case('raw_text')} AS classified_type FROM typed",
    "classified_from_answers": f"""WITH {TYPED} SELECT doc_id, CASE {' '.join(
        f"WHEN contains(lower(answer), '{t}') THEN '{t}'" for t in DOCUMENT_TYPES
    )} ELSE 'unknown' END AS classified_type FROM typed""",
    "types_resolved": f"WITH {RESOLVED} SELECT doc_id, document_type FROM resolved",
    "prompts_selected": f"""WITH {RESOLVED}, {REGISTRY}, {chosen('resolved')}
SELECT doc_id, prompt_key, version AS version_used FROM chosen JOIN registry ON prompt_key = key""",
    "prompts_rendered": f"""WITH {RESOLVED}, {REGISTRY}, {chosen('resolved')}
SELECT doc_id, version AS version_used, system, replace(template, '{{ocr_text}}', raw_text) AS prompt
FROM chosen JOIN registry ON prompt_key = key""",
    "model_applied": f"""WITH {RESOLVED}, {REGISTRY}, {chosen('resolved')}
SELECT doc_id, CASE WHEN n % 7 <> 0 THEN '{{"chars":' || n || '}}' END AS raw,
  CASE WHEN n % 7 = 0 THEN 'LookupError: refused' END AS error
FROM (SELECT *, length(replace(template, '{{ocr_text}}', raw_text)) AS n FROM chosen JOIN registry ON prompt_key = key)""",
    "classification_prompts_rendered": f"""WITH {TYPED}, {REGISTRY}
SELECT doc_id, replace(template, '{{ocr_text}}', raw_text) AS prompt
FROM typed JOIN registry ON key = 'classify_v1'""",
    "answers_parsed": f"""WITH {ANSWERS}, {parsed('answers')}
SELECT doc_id, parse_path, {field('invoice_number')} AS invoice_number, {field('vendor_name')} AS vendor_name,
  {field('raw_output')} AS raw_output FROM parsed""",
    "invoices_typed": f"""WITH {ANSWERS}, {parsed('answers')}
SELECT doc_id, {', '.join(f'{field(n)} AS {n}' for n in (
        'invoice_number', 'invoice_date', 'due_date', 'vendor_name', 'vendor_address', 'customer_name',
        'customer_address', 'currency', 'payment_terms'))},
  {', '.join(f'TRY_CAST({field(n)} AS DOUBLE) AS {n}' for n in ('subtotal', 'tax', 'total_amount'))},
  CAST({ITEM_COUNT} AS BIGINT) AS line_items FROM parsed""",
    "contracts_typed": f"""WITH {CONTRACT_ANSWERS}, {parsed('contract_answers')}
SELECT doc_id, {', '.join(f'{field(n)} AS {n}' for n in (
        'contract_title', 'effective_date', 'expiration_date', 'governing_law', 'termination_clause'))},
  TRY_CAST({field('contract_value')} AS DOUBLE) AS contract_value,
  {', '.join(f"array_to_string(CAST(json_extract(data, '$.{n}') AS VARCHAR[]), '|') AS {n}" for n in (
        'parties', 'key_terms'))} FROM parsed""",
}

_ITEMS = f"""{ANSWERS}, {parsed('answers')},
counted AS (SELECT doc_id, data, {ITEM_COUNT} AS n FROM parsed),
numbered AS (SELECT doc_id, data, CAST(unnest(range(CAST(n AS BIGINT))) AS BIGINT) AS item_no FROM counted),
items AS (
  SELECT doc_id, item_no, json_extract_string(data, '$.line_items[' || item_no || '].description') AS description,
    {', '.join(
        f"TRY_CAST(json_extract_string(data, '$.line_items[' || item_no || '].{n}') AS DOUBLE) AS {n}"
        for n in ('quantity', 'unit_price', 'total'))} FROM numbered
  UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM counted WHERE n = 0)"""

_TOTALS = f"""{_ITEMS},
sums AS (
  SELECT doc_id, CASE WHEN count(total) = count(item_no) THEN
      CAST(coalesce(sum(CAST(total AS DECIMAL(28,8))), 0) AS DOUBLE) END AS subtotal, count(item_no) AS item_count
  FROM items GROUP BY doc_id),
taxed AS (SELECT *, {exact('subtotal * 0.085::DOUBLE', 2)} AS tax FROM sums),
totals AS (SELECT *, {exact('subtotal + tax', 2)} AS total FROM taxed)"""


def _close(stated: str, computed: str) -> str:
    gap = exact(f"abs(TRY_CAST({field(stated)} AS DOUBLE) - {computed})", 6)
    return f"CASE WHEN {computed} IS NOT NULL THEN coalesce({gap} <= 0.01::DOUBLE, false) END"


# tokens at the place their MD5 names, weighed by how few documents have the place
_TEXTS_SEARCHED = f"""WITH updates AS (
  SELECT doc_id AS id, unnest(range(CAST(quality AS BIGINT) + 1)) AS seq, text, lang, toxic FROM labels JOIN documents USING (doc_id)),
store AS (
  SELECT doc_id AS id, coalesce(text, '') AS text, lang AS document_type FROM documents WHERE doc_id NOT IN (SELECT id FROM updates)
  UNION ALL SELECT id, arg_max(text || ' (' || seq || ')', seq), any_value(lang || '-' || toxic) FROM updates GROUP BY id),
fitted AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
questions AS (SELECT item_id AS id, text FROM benchmark),
token AS (
  SELECT kind, id, CAST('0x' || substr(md5(token), 1, 7) AS INTEGER) % 256 AS place FROM (
    SELECT 'fit' AS kind, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM fitted
    UNION ALL SELECT 'doc', id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM store
    UNION ALL SELECT 'ask', id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM questions)),
weights AS (
  SELECT place, ln(((SELECT count(*) FROM fitted) + 1)::DOUBLE / (n + 1)) + 1 AS weight FROM (
    SELECT range AS place, (SELECT count(DISTINCT id) FROM token t WHERE kind = 'fit' AND t.place = r.range) AS n FROM range(256) r)),
weighed AS (SELECT kind, id, place, count(*) * any_value(weight) AS x FROM token JOIN weights USING (place) GROUP BY ALL),
lengths AS (SELECT kind, id, sqrt(sum(x * x)) AS length FROM weighed GROUP BY ALL),
units AS (SELECT kind, id, place, CAST(CAST(x / length AS FLOAT) AS DOUBLE) AS x FROM weighed JOIN lengths USING (kind, id)),
norms AS (SELECT kind, id, sqrt(sum(x * x)) AS norm FROM units GROUP BY ALL),
dots AS (
  SELECT a.id AS query_id, d.id, sum(a.x * d.x) AS dot FROM units a JOIN units d ON a.kind = 'ask' AND d.kind = 'doc' AND a.place = d.place
  GROUP BY ALL),
scored AS (
  SELECT q.id AS query_id, s.id, s.text, document_type, round(1 - coalesce(dot / (qn.norm * sn.norm), 0), 9) + 0.0 AS distance
  FROM questions q CROSS JOIN store s LEFT JOIN dots ON dots.query_id = q.id AND dots.id = s.id
  LEFT JOIN norms qn ON qn.kind = 'ask' AND qn.id = q.id LEFT JOIN norms sn ON sn.kind = 'doc' AND sn.id = s.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM scored)
SELECT query_id, rank, id, substr(text, 1, 200) || '...' AS text_preview, document_type,
  {exact('distance', 6)} AS distance FROM ranked WHERE rank <= 5"""

ORACLE |= {n: _TEXTS_SEARCHED for n in ("similar_texts", "similar_texts_of_a_newer_model", "stream_similar_texts")}

ORACLE |= {
    "line_items_exploded": f"WITH {_ITEMS} SELECT * FROM items",
    "invoices_totalled": f"WITH {_TOTALS} SELECT doc_id, subtotal, item_count, tax, total FROM totals",
    "totals_verified": f"""WITH {_TOTALS}
SELECT t.doc_id, t.subtotal, t.tax, t.total, {_close('subtotal', 't.subtotal')} AS subtotal_ok,
  {_close('tax', 't.tax')} AS tax_ok, {_close('total_amount', 't.total')} AS total_ok
FROM totals t JOIN parsed p ON t.doc_id = p.doc_id""",
    "invoice_numbers": f"""WITH {INVOICE_TEXTS}, first_lines AS (
  SELECT doc_id, list_filter(string_split({strip('raw_text')}, chr(10)), lambda x: contains(x, ':')
    AND regexp_matches(lower(x), 'invoice|inv#|inv-|number'))[1] AS line FROM invoice_texts)
SELECT doc_id, nullif({strip("string_split(line, ':')[-1]")}, '') AS invoice_number FROM first_lines""",
    # what was printed on each page, whatever its layout
    "invoice_fields": f"""WITH {BASE}
SELECT doc_id, 'INV-' || doc_id AS invoice_number, issued AS invoice_date, issued AS due_date, 'Net 30' AS payment_terms,
  vendor AS vendor_name, 'Dock ' || n_items AS vendor_address, customer AS customer_name, segment AS customer_address,
  CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax, CAST(stated_total AS DOUBLE) AS total_amount,
  CASE WHEN doc_id % 4 = 2 THEN 'EUR' ELSE 'USD' END AS currency, n_items AS line_items_count FROM base""",
    "invoice_lines_read": f"""
SELECT o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderkey {_ORDER}) - 1 AS item_no, p_name AS description,
  CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, CAST({_money('p_retailprice')} AS DOUBLE) AS unit_price,
  CAST({_money('l_extendedprice')} AS DOUBLE) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey""",
    "confidence_scored": f"WITH {SCORED_SOURCE} SELECT doc_id, document_type, {SCORE} AS confidence_score FROM parsed",
    "fields_counted": f"""WITH {SCORED_SOURCE}
SELECT doc_id, document_type, CAST({NON_NULL_KEYS} AS BIGINT) AS fields_extracted,
  CAST(len({_KEYS}) AS BIGINT) AS total_fields,
  CAST({NON_NULL_KEYS} AS DOUBLE) / greatest(len({_KEYS}), 1) AS field_completeness FROM parsed""",
    "length_bands": f"""WITH {TYPED}, sized AS (SELECT length({strip('raw_text')}) AS n FROM typed)
SELECT CASE WHEN n > 500 THEN 'long' WHEN n > 100 THEN 'medium' ELSE 'short' END AS length_band,
  CASE WHEN n > 500 THEN 0.82::DOUBLE WHEN n > 100 THEN 0.65::DOUBLE ELSE 0.4::DOUBLE END AS expected_low,
  CASE WHEN n > 500 THEN 0.96::DOUBLE WHEN n > 100 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS expected_high,
  count(*) AS documents FROM sized GROUP BY ALL""",
    "confidence_bands": f"""WITH {SCORED_SOURCE}, scored AS (SELECT document_type, {SCORE} AS c FROM parsed)
SELECT document_type, CASE WHEN c > 0.8::DOUBLE THEN 'green' WHEN c > 0.6::DOUBLE THEN 'orange' ELSE 'red' END
  AS confidence_band, count(*) AS documents FROM scored GROUP BY ALL""",
    "index_rows_built": f"""WITH {TYPED}
SELECT doc_id AS id, length(raw_text) AS chars, requested_type AS document_type, '2024-01-01T00:00:00' AS extracted_at,
  CAST(doc_id % 14 AS VARCHAR) AS field_count, 'f' || doc_id || '.pdf' AS filename,
  CAST(CAST(doc_id % 1000 AS DOUBLE) / 1000 AS VARCHAR) AS confidence, prompt_version FROM typed""",
    "similar_documents": nearest(5),
    "similar_invoices": nearest(20, "document_type = 'invoice'"),
    "similar_documents_indexed": nearest(5),
    "similar_invoices_indexed": nearest(20, "document_type = 'invoice'"),
    "collection_counted": f"""WITH {INDEX}
SELECT coalesce(document_type, '*') AS document_type, count(*) AS total_documents
FROM index_rows GROUP BY ROLLUP (document_type)""",
    "latest_invoice_runs": f"""WITH {RUNS}
SELECT run_id, document_type, epoch_us(start_time) AS start_us, extraction_confidence FROM runs
WHERE document_type = 'invoice' ORDER BY start_time DESC, run_id DESC LIMIT 25""",
    "latest_runs_per_type": f"""WITH {RUNS}, {recent(100)}
SELECT run_id, document_type, epoch_us(start_time) AS start_us, extraction_confidence, recency FROM recent""",
    "latest_runs_per_type_deep": f"""WITH {RUNS}, {recent(1500)}
SELECT run_id, document_type, epoch_us(start_time) AS start_us, extraction_confidence, recency FROM recent""",
    "prompts_compared": comparison(None),
    "prompts_compared_on_a_page": comparison(500),
    "invoice_prompts_compared": comparison(200, "document_type = 'invoice'"),
    "drift_checked": drift(50),
    "drift_checked_wide": drift(500),
    "invoice_drift_checked": drift(150, "document_type = 'invoice'"),
    "runs_summarised": f"""WITH {RUNS}
SELECT count(*) AS total_documents, {rnd('avg(extraction_confidence)', 4)} AS avg_confidence,
  {rnd('avg(processing_time_ms)', 2)} AS avg_processing_time_ms,
  {rnd("CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) / count(*)", 4)} AS extraction_success_rate,
  {', '.join(
        f"CAST(count(*) FILTER (WHERE document_type = '{t}') AS BIGINT) AS {t}_documents" for t in DOCUMENT_TYPES)}
FROM runs""",
    "requests_counted": f"WITH {RUNS} SELECT document_type, status, count(*) AS total FROM runs GROUP BY ALL",
    "errors_counted": f"""WITH {RUNS}
SELECT document_type, error_type, count(*) AS total FROM runs WHERE error_type IS NOT NULL GROUP BY ALL""",
    "running_total": f"""WITH {RUNS}
SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS documents,
  CAST(sum(count(*)) OVER (ORDER BY strftime(start_time, '%Y-%m-%d')) AS BIGINT) AS total_documents
FROM runs GROUP BY 1""",
    "documents_in_flight": f"WITH {FLIGHT} SELECT at_us, net, in_flight FROM flight",
    "peak_in_flight": f"""WITH {FLIGHT},
minutes AS (SELECT unnest(range(min(at_us) // 60000000, max(at_us) // 60000000 + 1)) AS minute FROM flight),
changed AS (SELECT at_us // 60000000 AS minute, max(in_flight) AS highest FROM flight GROUP BY 1),
opened AS (
  SELECT minute, coalesce(in_flight, 0) AS opening FROM minutes ASOF LEFT JOIN (SELECT at_us, in_flight FROM flight) f
    ON minute * 60000000 - 1 >= at_us)
SELECT minute * 60000000 AS bucket_us, opening, greatest(highest, opening) AS peak FROM opened LEFT JOIN changed USING (minute)""",
    "documents_identified": """WITH marked AS (
  SELECT page_id, sha256(coalesce(length(url) || ':' || url, '-') || ';' || coalesce(length(html) || ':' || html, '-')) AS h FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR)
  ELSE h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS document_id FROM marked""",
    "fields_matched": f"WITH {MATCHES} SELECT sample_id, field, kind, match FROM matches",
    "sample_accuracy": f"WITH {MATCHES} SELECT sample_id, {ACCURACY} FROM matches GROUP BY sample_id",
    "overall_accuracy": f"""WITH {MATCHES}
SELECT document_type, count(DISTINCT sample_id) AS total_samples, {ACCURACY}, CAST(NULL AS VARCHAR) AS error FROM matches GROUP BY document_type""",
    "field_accuracy": f"WITH {MATCHES} SELECT field, {ACCURACY} FROM matches GROUP BY field",
    "prompt_accuracy": f"WITH {MATCHES} SELECT prompt_version, {ACCURACY} FROM matches GROUP BY prompt_version",
    "constraints_checked": f"""WITH {RUNS}, checked AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE ocr_confidence + 0.05::DOUBLE > 1) AS a,
    count(*) FILTER (WHERE extraction_confidence NOT BETWEEN 0 AND 1) AS b,
    count(*) FILTER (WHERE document_type = 'unknown') AS d, count(*) FILTER (WHERE status = 'failed') AS e FROM runs)
SELECT 'ocr_confidence_in_0_1' AS rule, a AS violations, n AS checked FROM checked
UNION ALL SELECT 'extraction_confidence_in_0_1', b, n FROM checked
UNION ALL SELECT 'document_id_present', CAST(0 AS BIGINT), n FROM checked
UNION ALL SELECT 'document_type_known', d, n FROM checked
UNION ALL SELECT 'status_known', e, n FROM checked""",
    "documents_extracted": RESULT_ROWS,
    "documents_extracted_to_runs": f"""WITH {RESULTS}
SELECT doc_id AS run_id, CAST(doc_id AS VARCHAR) AS document_id, document_type, engine_used AS ocr_engine,
  'model-a' AS llm_model, ocr_time_ms, CASE WHEN doc_id % 41 = 0 THEN 'TimeoutError: no answer' END AS error_type, confidence_score AS extraction_confidence,
  CAST(fields_extracted AS DOUBLE) / greatest(total_fields, 1) AS field_completeness,
  CASE WHEN warnings <> '' THEN 'true' END AS has_warnings FROM results WHERE status = 'completed'""",
    "documents_extracted_to_index": f"""WITH {RESULTS}
SELECT doc_id AS id, chars, document_type,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S.%f') AS extracted_at,
  CAST(fields_extracted AS VARCHAR) AS field_count, filename, CAST(confidence_score AS VARCHAR) AS confidence,
  prompt_version FROM results WHERE status = 'completed'""",
    "stream_extracted": RESULT_ROWS,
    "stream_extracted_from_four": RESULT_ROWS,
    "stream_counts": f"""WITH {closed_windows(6, 6)}
SELECT window_us, document_type, status, count(*) AS total FROM closed GROUP BY ALL""",
    "stream_counts_sliding": f"""WITH {closed_windows(6, 3)}
SELECT window_us, document_type, count(*) AS total FROM closed GROUP BY ALL""",
    "stream_upserted": _UPSERT.format(
        rows="""SELECT doc_id AS id, CAST(0 AS BIGINT) AS seq, text, lang AS document_type, 0 AS updated FROM documents
  UNION ALL SELECT d.doc_id, l.quality + 1, text || ' again', lang, 1
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
    ),
    "stream_drift": drift(50),
    "stream_drift_keyed": drift(50),
    "stream_deduplicated": f"WITH {RUNS} SELECT run_id, document_type, extraction_confidence FROM runs",
}

ORACLE["documents_upserted_in_buckets"] = ORACLE["documents_upserted"]
ORACLE["latest_runs_per_type_from_files"] = ORACLE["latest_runs_per_type"]
ORACLE["drift_checked_from_files"] = ORACLE["drift_checked"]

for _name, (_value, _bounds, _labels) in HISTOGRAMS.items():
    ORACLE[f"histogram_{_name}"] = histogram_parts(_value, _bounds, _labels, RUNS)

ORACLE["stream_histogram"] = histogram_parts(
    "ocr_confidence", HISTOGRAMS["ocr_confidence"][1], ["window_us", "ocr_engine"], closed_windows(12, 12)
).replace("AS v FROM runs)", "AS v FROM closed)")
