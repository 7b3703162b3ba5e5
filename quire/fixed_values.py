"""They must equal the behaviour being matched, so they are stated plainly here."""

# --- fixed values: document types (declaration order decides ties) and statuses ---
DOCUMENT_TYPES = ["invoice", "contract", "report", "receipt", "unknown"]
EXTRACTION_STATUSES = ["pending", "processing", "completed", "failed"]

# --- fixed values: upload rules ---
ALLOWED_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp"]
MAX_FILE_SIZE_MB = 50
NO_FILENAME = "No filename provided."
BLANK_TEXT = "OCR produced no text. The document may be blank or unreadable."

# --- fixed values: recognition threshold and warning text ---
OCR_CONFIDENCE_THRESHOLD = 0.7
LOW_CONFIDENCE_WARNING = "Low OCR confidence (%.2f). Results may be inaccurate."

# --- fixed values: classification words, tested group by group in this order ---
CLASSIFY_KEYWORDS = [
    ("invoice", ["invoice", "bill", "amount due", "total"]),
    ("contract", ["contract", "agreement", "party", "terms"]),
    ("report", ["report", "summary", "analysis", "findings"]),
    ("receipt", ["receipt", "paid", "transaction"]),
]
CLASSIFY_DEFAULT = "invoice"
CLASSIFY_CHARS = 500

# --- fixed values: words that mark an invoice-number line, and the sales tax rate ---
INVOICE_NUMBER_WORDS = ["invoice", "inv#", "inv-", "number"]
TAX_RATE = 0.085

# --- fixed values: confidence score fields and weights ---
SCORE_FIELDS = {
    "invoice": {
        "critical": ["invoice_number", "vendor_name", "total_amount", "invoice_date"],
        "important": ["customer_name", "line_items", "subtotal", "tax", "currency"],
    },
    "contract": {
        "critical": ["contract_title", "parties", "effective_date"],
        "important": ["expiration_date", "contract_value", "key_terms", "governing_law"],
    },
}
LIST_FIELDS = ["line_items", "parties", "key_terms"]
CRITICAL_WEIGHT = 0.7
IMPORTANT_WEIGHT = 0.3

# --- fixed values: bands as (name, lower limit exclusive), and what each stands for ---
LENGTH_BANDS = [("long", 500, 0.82, 0.96), ("medium", 100, 0.65, 0.85), ("short", None, 0.40, 0.65)]
CONFIDENCE_BANDS = [("green", 0.8), ("orange", 0.6), ("red", None)]

# --- fixed values: run log, comparison and drift ---
ENVIRONMENT_TAG = "production"
WARNINGS_IN_TAG = 5
COMPARE_LIMIT = 500
DRIFT_WINDOW = 50
DRIFT_WINDOW_RANGE = (10, 500)
DRIFT_LIMIT = 0.05
ACCURACY_THRESHOLD = 0.85
DRIFT_ADVICE = "Consider retraining or updating prompts"
STABLE_ADVICE = "No action needed"

# --- fixed values: similarity search ---
SEARCH_K = 5
SEARCH_K_RANGE = (1, 20)
PREVIEW_CHARS = 200

# --- fixed values: histogram bounds ---
DURATION_SECONDS_BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
CONFIDENCE_BOUNDS = [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0]
OCR_MILLISECONDS_BOUNDS = [100.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0]
FIELD_COUNT_BOUNDS = [1.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0]
SCRAPE_WINDOW = "10 seconds"

# --- fixed values: evaluation ---
NUMERIC_TOLERANCE = 0.01

# --- fixed values: Python's whitespace, as removed by str.strip() ---
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: prompt registry (key, logged version, system text, template) ---
TEXT_PLACEHOLDER = "{ocr_text}"
FALLBACK_PROMPT = "invoice_v2"
CLASSIFY_PROMPT = "classify_v1"
PROMPTS = [
    (
        "invoice_v1",
        "v1.0",
        "You are a document extraction specialist. Extract structured data "
        "from the provided invoice text. Return ONLY valid JSON matching the "
        "schema exactly. If a field cannot be found, use null.",
        """Extract the following fields from this invoice text:

**Required Fields:**
- invoice_number, invoice_date, due_date
- vendor_name, vendor_address
- customer_name, customer_address
- line_items (array of: description, quantity, unit_price, total)
- subtotal, tax, total_amount, currency, payment_terms

**Invoice Text:**
```
{ocr_text}
```

Return as JSON:
""",
    ),
    (
        "invoice_v2",
        "v2.0",
        "You are an expert financial document processor. Your task is to "
        "extract every piece of structured data from invoices with maximum "
        "precision. When data is ambiguous, provide your best interpretation "
        "and note the ambiguity. Return ONLY valid JSON.",
        """Carefully analyze this invoice and extract ALL structured data.

**Step-by-step approach:**
1. First identify the vendor and customer sections
2. Locate invoice metadata (number, dates, terms)
3. Parse each line item with quantities and prices
4. Calculate and verify totals

**Invoice Text:**
```
{ocr_text}
```

Return as JSON with these fields:
{
  "invoice_number": str | null,
  "invoice_date": str | null,
  "due_date": str | null,
  "vendor_name": str | null,
  "vendor_address": str | null,
  "customer_name": str | null,
  "customer_address": str | null,
  "line_items": [{ "description": str, "quantity": float, "unit_price": float, "total": float }],
  "subtotal": float | null,
  "tax": float | null,
  "total_amount": float | null,
  "currency": str | null,
  "payment_terms": str | null
}
""",
    ),
    (
        "contract_v1",
        "v1.0",
        "You are a legal document analysis specialist. Extract key terms "
        "and metadata from contracts. Return ONLY valid JSON.",
        """Extract the following from this contract text:

**Required Fields:**
- contract_title, parties (list), effective_date, expiration_date
- contract_value, key_terms (list), governing_law, termination_clause

**Contract Text:**
```
{ocr_text}
```

Return as JSON:
""",
    ),
    (
        "classify_v1",
        "v1.0",
        "You classify documents into types. Return ONLY a single word.",
        """Classify this document into one of: invoice, contract, report, receipt

**Document Text (first 500 chars):**
```
{ocr_text}
```

Type:""",
    ),
]
