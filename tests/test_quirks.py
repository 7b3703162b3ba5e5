"""Small rules, row by row, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions.text import decimal_text, np_round, py_float, py_round, py_strip, two_decimals
from quire.operators import classify, extract, ingest, ocr, prompts, score, search, store
from quire.operators.prompts import prompt_registry, render_prompts, select_prompt


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_strip_like_python(spark):
    texts = [" \t\xa0a　\n", "\x1c\x1fb\x85", "", "   ", "a b", " x ", "​z"]
    assert column(spark, texts, "string", py_strip) == [t.strip() for t in texts]


def test_round_half_even_on_the_binary_value(spark):
    values = [0.03125, 0.12345, 0.5, 1.00005, 2 / 3, 0.175]
    assert column(spark, values, "double", lambda c: py_round(c, 4)) == [round(v, 4) for v in values]
    money = [n / 100 * 0.085 for n in range(1, 20000)] + [n / 1000 for n in range(1, 20000, 5)] + [-0.125, -1.115]
    assert column(spark, money, "double", lambda c: py_round(c, 2)) == [round(v, 2) for v in money]
    shares = [c / t for t in range(1, 129) for c in range(t + 1)]
    assert column(spark, shares, "double", lambda c: py_round(c, 4)) == [round(v, 4) for v in shares]


def test_numpy_rounding_differs(spark):
    assert column(spark, [1.115, 0.03125], "double", lambda c: np_round(c, 2)) == [1.12, 0.03]
    assert column(spark, [1.115], "double", lambda c: py_round(c, 2)) == [1.11]


def test_two_decimals(spark):
    values = [0.125, 0.6, 0.695, 0.0, 1.0, 0.145]
    assert column(spark, values, "double", two_decimals) == [f"{v:.2f}" for v in values]


def test_float_like_python(spark):
    texts = ["3.5", " 3.5 ", "3.5d", "3.5f", "0x1p3", "1_000", "1__0", "_1", ".5", "5.", "1e3", "+2", "-2.5E-1", "", "x", "."]

    def python(text):
        try:
            return float(text)
        except ValueError:
            return None

    assert column(spark, texts, "string", py_float) == [python(t) for t in texts]


def test_decimal_text(spark):
    values = [0.93, 1.0, 0.0, 0.0001, 0.00025, 0.001, 12.5]
    assert column(spark, values, "double", decimal_text) == [str(v) for v in values]


# answer text, how it is read, what it holds (None: the text itself, kept raw)
ANSWERS = [
    ('{"a":1}', "strict", {"a": 1}), ('{"a":1} x', "slice", {"a": 1}), ('{"a":1}]', "slice", {"a": 1}), ('{"a":1}}', "raw", None),
    ("[1,2]", "non_object", {}), ("1,2", "raw", None), ('1,"x":2', "raw", None), ("null", "non_object", {}), ("5", "non_object", {}),
    ('"t"', "non_object", {}), ("", "raw", None), ("   ", "raw", None), ("{", "raw", None), ("}", "raw", None), ("}{", "raw", None),
    ("{'a':1}", "raw", None), ('{"a":1,}', "raw", None), ('{"a":01}', "raw", None), ('{"a":"\t"}', "raw", None),
    ("\ufeff{}", "slice", {}), ('{"a":1}\n', "strict", {"a": 1}), ('```\n{"a":1}\n```', "strict", {"a": 1}),
    ('```json\n{"a":1}\n  ```\n', "strict", {"a": 1}), ('```{"a":1}```', "raw", None), ('x {"a":{"b":2}} y', "slice", {"a": {"b": 2}}),
    ('x {"a":1} {"b":2}', "raw", None), ("x {a} y", "raw", None), ("true", "non_object", {}), ('{"a":1,"a":2}', "strict", {"a": 2}),
    ('{"a":[1,{"b":null}]}', "strict", {"a": [1, {"b": None}]}), ('[{"a":1}]', "non_object", {}), ("1],[2", "raw", None),
    ('1},"x":{"y":1', "raw", None),
]


def parsed(spark, raws, kind="invoice"):
    df = spark.createDataFrame([(i, r, kind) for i, r in enumerate(raws)], "doc_id long, raw string, document_type string")
    return extract.parse_model_json(df)


def test_hostile_answers(spark):
    texts = [t for t, _, _ in ANSWERS]
    rows = parsed(spark, texts).select("doc_id", "parse_path", F.to_json("data").alias("j")).orderBy("doc_id").collect()
    got = [(r["parse_path"], json.loads(r["j"])) for r in rows]
    assert got == [(path, {"raw_output": text} if value is None else value) for text, path, value in ANSWERS]


def test_known_parse_deviation_and_failed_call(spark):
    rows = parsed(spark, ['{"a":NaN}', None]).orderBy("doc_id").select("parse_path", F.to_json("data")).collect()
    assert [tuple(r) for r in rows] == [("raw", '{"raw_output":"{\\"a\\":NaN}"}'), ("failed", "{}")]


def scores(spark, data, kind):
    rows = score.score_and_count(parsed(spark, [json.dumps(d) for d in data], kind)).orderBy("doc_id").collect()
    return [(r["confidence_score"], r["fields_extracted"], r["total_fields"]) for r in rows]


FULL = {
    "invoice_number": "R-77", "vendor_name": "North Mill", "total_amount": 218, "invoice_date": "2031-05-06",
    "customer_name": "Lake House", "line_items": [{"desc": "flour"}], "subtotal": 200, "tax": 18, "currency": "CHF",
}


def test_scores_of_invoices(spark):
    partial = {"invoice_number": "INV-001", "vendor_name": None, "total_amount": None, "invoice_date": None}
    odd = {**FULL, "line_items": [], "tax": 0, "currency": "", "subtotal": False}
    got = scores(spark, [FULL, partial, odd, {}], "invoice")
    assert got == [(1.0, 9, 9), (0.175, 1, 4), (0.94, 9, 9), (0.0, 0, 0)]


def test_scores_of_contracts_and_others(spark):
    contract = {"contract_title": "T", "parties": [], "effective_date": None, "key_terms": "", "governing_law": {}}
    assert scores(spark, [contract], "contract")[0][0] == round(2 / 3 * 0.7 + 1 / 4 * 0.3, 4)
    other = {"a": None, "b": "", "c": 0, "d": [], "e": False, "f": {}}
    assert scores(spark, [other, {}], "report") == [(4 / 6, 5, 6), (0.0, 0, 0)]


def test_unusable_answers_score_by_type(spark):
    for kind, expected in (("invoice", 0.0), ("contract", 0.0), ("report", 1.0), ("unknown", 1.0)):
        rows = score.score_confidence(parsed(spark, ["not json"], kind)).collect()
        assert rows[0]["confidence_score"] == expected


def test_keyword_order(spark):
    texts = {
        "RECEIPT  total": "invoice", "Payment Terms: Net": "contract", "summary": "report", "Paid": "receipt",
        "": "invoice", "hello": "invoice", "Contract invoice": "invoice", "third-party findings": "contract",
    }
    df = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    got = {r["raw_text"]: r["classified_type"] for r in classify.classify_keywords(df).collect()}
    assert got == texts


def test_answer_labels_in_declaration_order(spark):
    answers = {" Report or invoice ": "invoice", "It is a CONTRACT.": "contract", "letter": "unknown", None: "unknown"}
    df = spark.createDataFrame([(a,) for a in answers], "answer string")
    assert {r["answer"]: r["classified_type"] for r in classify.classify_from_response(df).collect()} == answers


def test_prompt_choice(spark):
    asked = {
        ("invoice", "v1"): ("invoice_v1", "v1.0"), ("invoice", None): ("invoice_v2", "v2.0"),
        ("invoice", "v7"): ("invoice_v2", "v2.0"), ("contract", ""): ("contract_v1", "v1.0"),
        ("report", "v1"): ("invoice_v2", "v2.0"), ("unknown", None): ("invoice_v2", "v2.0"),
    }
    df = spark.createDataFrame(list(asked), "document_type string, prompt_version string")
    rows = select_prompt(df, prompt_registry(spark)).collect()
    got = {(r["document_type"], r["prompt_version"]): (r["prompt_key"], r["version_used"]) for r in rows}
    assert got == asked


def test_latest_prompt_is_the_last_in_text_order(spark):
    more = spark.createDataFrame([(f"invoice_v{n}", f"v{n}.0", "s", "{ocr_text}!") for n in (2, 9, 10)], prompt_registry(spark).schema)
    df = spark.createDataFrame([("invoice", None, "body {x}")], "document_type string, prompt_version string, raw_text string")
    row = render_prompts(df, more).first()
    assert (row["prompt_key"], row["prompt"]) == ("invoice_v9", "body {x}!")


def test_a_large_prompt_table_needs_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr("quire.operators.prompts.is_small", lambda prompts: False)
    df = spark.createDataFrame([("invoice", "v1"), ("report", None)], "document_type string, prompt_version string")
    keys = {r["prompt_key"] for r in select_prompt(df, prompt_registry(spark)).collect()}
    assert keys == {"invoice_v1", "invoice_v2"}


def test_upload_rules_in_order(spark):
    rows = [
        ("a.PDF", 10, 200), ("a.tar.jpeg", None, 200), ("a.exe", 99999999999, 400), ("", 1, 400), (None, 1, 400),
        ("pdf", 1, 400), ("a.", 1, 400), ("b.png", 52428801, 413), ("b.png", 52428800, 200), ("b.png", 0, 200),
        ("a.tif", 1, 400),
    ]
    df = spark.createDataFrame([(i, n, s) for i, (n, s, _) in enumerate(rows)], "i int, filename string, size long")
    got = [r["status_code"] for r in ingest.route_uploads(df).orderBy("i").collect()]
    assert got == [code for _, _, code in rows]


def test_weak_and_blank_text(spark):
    df = spark.createDataFrame([(1, " \n\xa0", 0.1), (2, "x", 0.695), (3, "x", 0.7), (4, None, 0.9)], "i int, raw_text string, confidence double")
    rows = {r["i"]: (r["status_code"], r["warnings"]) for r in ocr.flag_ocr(df).collect()}
    assert rows == {
        1: (422, []),
        2: (200, ["Low OCR confidence (0.69). Results may be inaccurate."]),
        3: (200, []),
        4: (422, []),
    }


def test_engine_choice(spark):
    kind = "doc_id long, engine string, raw_text string, confidence double, page_count long"
    primary = spark.createDataFrame([(1, "p", "a", 0.9, 1), (2, "p", "a", 0.5, 1), (3, "p", "a", 0.5, 1), (4, "p", None, None, 2), (6, "p", " a\n", 0.69996, 1), (7, "p", "a", 0.1, 1)], kind)
    alternate = spark.createDataFrame([(1, "q", "b", 1.0, 1), (2, "q", "b", 0.5, 1), (3, "q", "b", 0.51, 1), (5, "q", "b", 0.2, 3), (7, "q", None, 0.9, 1)], kind)
    rows = {r["doc_id"]: (r["engine_used"], r["raw_text"], r["confidence"]) for r in ocr.reconcile_ocr(primary, alternate).collect()}
    assert rows == {
        1: ("p", "a", 0.9), 2: ("p", "a", 0.5), 3: ("q", "b", 0.51), 4: ("none", "", 0.0), 5: ("q", "b", 0.2),
        6: ("p", "a", 0.7), 7: ("p", "a", 0.1),
    }


def test_page_confidence(spark):
    words = [(1, "t", 1, 1, 1, w, "x", c) for w, c in enumerate([90.0, 70.0, -1.0, 0.0, 55.5, None])]
    words.append((1, "t", 2, 1, 1, 1, "x", -1.0))
    df = spark.createDataFrame(words, "doc_id long, engine string, page long, block long, line long, word long, value string, conf double")
    pages = spark.createDataFrame([(1, "t", p) for p in (1, 2)] + [(2, "t", 1)], "doc_id long, engine string, page long")
    rows = {r["doc_id"]: r["confidence"] for r in ocr.confidence_by_page(df, pages).collect()}
    assert rows == {1: 0.4, 2: 0.0}


def test_assembly_follows_blocks_lines_and_pages(spark):
    words = [
        (1, "t", 2, 1, 1, 1, "last", 0.5), (1, "t", 1, 2, 1, 2, "d", 0.5), (1, "t", 1, 2, 1, 1, "c", 0.5),
        (1, "t", 1, 1, 10, 1, "b", 0.5), (1, "t", 1, 1, 2, 1, "a", 0.5),
    ]
    df = spark.createDataFrame(words, "doc_id long, engine string, page long, block long, line long, word long, value string, conf double")
    row = ocr.assemble_text(df).first()
    assert (row["raw_text"], row["page_count"]) == ("a\nb\nc d\n\nlast", 2)


def test_invoice_number_takes_the_last_colon(spark):
    texts = {
        "Invoice Number: X   Date: March 15, 2024": "March 15, 2024",
        "INVOICE #INV-2024-0847\nDate: x": None,
        "\n\nInvoice Number: 20240322-A\nother: y": "20240322-A",
        "inv# :  ": None,
        "phone number: 5\ninvoice: 6": "5",
    }
    df = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    assert {r["raw_text"]: r["invoice_number"] for r in extract.invoice_number(df).collect()} == texts


def test_totals_and_their_check(spark):
    answers = [
        {"line_items": [{"total": 2400.0}, {"total": 450}, {"total": "500"}], "subtotal": 3350.0, "tax": 284.75, "total_amount": 3634.75},
        {"line_items": [{"total": 10.0}], "subtotal": 10.01, "tax": 0.85, "total_amount": 11.85},
        {"line_items": None},
    ]
    invoices = extract.as_invoices(parsed(spark, [json.dumps(a) for a in answers]))
    rows = extract.verify_totals(invoices).orderBy("doc_id").collect()
    assert (rows[0]["subtotal"], rows[0]["tax"], rows[0]["total"]) == (3350.0, 284.75, 3634.75)
    assert [(r["subtotal_ok"], r["tax_ok"], r["total_ok"]) for r in rows] == [(True, True, True), (True, True, False), (False, False, False)]
    items = extract.explode_line_items(invoices)
    assert items.count() == 5
    totals = {r["doc_id"]: r["total"] for r in extract.invoice_totals(items).collect()}
    assert totals == {0: 3634.75, 1: 10.85, 2: 0.0}


def test_bands(spark):
    df = spark.createDataFrame([("x" * n, c) for n, c in ((501, 0.81), (500, 0.8), (101, 0.61), (100, 0.6))], "raw_text string, confidence_score double")
    rows = score.confidence_band(score.length_band(df)).collect()
    assert [(r["length_band"], r["confidence_band"]) for r in rows] == [("long", "green"), ("medium", "orange"), ("medium", "orange"), ("short", "red")]


def test_preview_always_ends_in_dots(spark):
    assert column(spark, ["short", "y" * 300], "string", search.preview) == ["short...", "y" * 200 + "..."]


def test_metadata_overrides_standard_entries(spark):
    df = spark.createDataFrame([(1, "t", "invoice", 4, "mine", 0.5)], "doc_id long, raw_text string, document_type string, fields_extracted long, extracted_at string, confidence double")
    df = df.withColumn("created_at", F.lit("2024-01-01T00:00:00"))
    row = store.build_index_rows(df, extra=("extracted_at", "confidence")).first()
    assert row["metadata"] == {"document_type": "invoice", "extracted_at": "mine", "field_count": "4", "confidence": "0.5"}


def test_upsert_keeps_the_last_write(spark):
    kind = "id long, seq long, text string, metadata map<string,string>"
    current = spark.createDataFrame([(1, 0, "old", {}), (2, 5, "kept", {}), (3, 1, "same", {})], kind)
    updates = spark.createDataFrame([(1, 1, "a", {}), (1, 2, "b", {}), (2, 4, "late", {}), (3, 1, "new", {}), (4, 0, "add", {})], kind)
    got = {r["id"]: r["text"] for r in store.upsert_documents(current, updates).collect()}
    assert got == {1: "b", 2: "kept", 3: "new", 4: "add"}


def test_constraints(spark):
    df = spark.createDataFrame([(1.2, "invoice"), (float("nan"), "letter"), (None, None), (0.5, "unknown")], "confidence double, document_type string")
    got = {r["rule"]: (r["violations"], r["checked"]) for r in score.check_constraints(df).collect()}
    assert got == {"confidence_in_0_1": (2, 4), "document_type_known": (2, 4)}


@pytest.mark.parametrize("k", [0, 21])
def test_search_bounds(spark, k):
    with pytest.raises(ValueError):
        search.search_similar(None, None, k=k)


def test_fields_beside_each_other_on_one_line(spark):
    text = "Invoice Number: X-1   Date: 2024-02-03\nFROM: Mill, Dock 3    TO: House, Lane\nTotal: $5.00"
    df = spark.createDataFrame([(1, text)], "doc_id long, raw_text string")
    row = extract.extract_invoice_fields(df).first()
    assert (row["invoice_date"], row["vendor_name"], row["customer_name"], row["total_amount"]) == ("2024-02-03", "Mill", "House", 5.0)


def test_item_numbers_are_read_as_text(spark):
    def answer(*totals):
        items = [{"description": "x", "quantity": "2", "unit_price": 1e3, "total": t} for t in totals]
        return json.dumps({"line_items": items, "subtotal": 16.0, "tax": 1.36, "total_amount": 17.36})

    answers = [answer(10, "6.0"), answer("3.5d", 12.5), answer("$12.50", 3.5), answer(16, None), answer(), json.dumps({"line_items": [{"total": 16}]})]
    invoices = extract.as_invoices(parsed(spark, answers))
    items = {r["doc_id"]: r["line_items"] for r in invoices.collect()}
    assert [i["total"] for i in items[0]] == [10.0, 6.0] and items[0][0]["quantity"] == 2.0 and items[0][0]["unit_price"] == 1000.0
    assert [i["total"] for i in items[1]] == [None, 12.5] and [i["total"] for i in items[2]] == [None, 3.5]
    rows = {r["doc_id"]: r for r in extract.verify_totals(invoices).collect()}
    assert (rows[0]["subtotal"], rows[0]["subtotal_ok"], rows[0]["total_ok"]) == (16.0, True, True)
    for unknown in (1, 2, 3):
        assert [rows[unknown][c] for c in ("subtotal", "tax", "total", "subtotal_ok", "tax_ok", "total_ok")] == [None] * 6
    assert (rows[4]["subtotal"], rows[4]["subtotal_ok"]) == (0.0, False) and rows[5]["subtotal_ok"] is False
    totals = {r["doc_id"]: r["total"] for r in extract.invoice_totals(extract.explode_line_items(invoices)).collect()}
    assert totals == {0: 17.36, 1: None, 2: None, 3: None, 4: 0.0, 5: 17.36}


def test_undeclared_types_are_refused(spark):
    df = spark.createDataFrame([("a.pdf", 1, t) for t in ("invoice", "foo", None, "unknown", "Invoice")], "filename string, size long, requested_type string")
    routed = ingest.route_uploads(df).collect()
    assert [r["status_code"] for r in routed] == [200, 422, 200, 200, 422]
    assert routed[1]["reason"] == "Unknown document type. Declared: invoice, contract, report, receipt, unknown"
    typed = classify.resolve_type(df.withColumn("classified_type", F.lit("report"))).collect()
    assert [r["document_type"] for r in typed] == ["invoice", None, "report", "report", None]


def test_reason_names_what_is_allowed(spark):
    df = spark.createDataFrame([("a.EXE", 1), ("a", 1), ("a.", 1)], "filename string, size long")
    allowed = "{'.bmp', '.jpeg', '.jpg', '.pdf', '.png', '.tiff', '.webp'}"
    want = [f"Unsupported file type: {e}. Allowed: {allowed}" for e in (".exe", "", ".")]
    assert [r["reason"] for r in ingest.route_uploads(df).collect()] == want


def test_ids_from_content(spark):
    rows = [(None, "a", "b"), (None, "a", "b"), (None, "ab", ""), (None, None, "ab"), ("x", "a", "b"), (None, "a;1:b", None)]
    ids = [r["document_id"] for r in ingest.with_document_ids(spark.createDataFrame(rows, "document_id string, u string, v string"), ["u", "v"]).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 5 and ids[4] == "x"
    assert [len(p) for p in ids[0].split("-")] == [8, 4, 4, 4, 12]


def test_model_errors_leave_a_trace(spark):
    def model(batch):
        if (batch["prompt"] == "bad").any():
            raise KeyError("answer")
        return batch["prompt"].str.upper()

    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "bad")], "doc_id long, system string, prompt string").coalesce(1)
    assert sorted(map(tuple, prompts.apply_model(df, model).collect())) == [(1, "A", None), (2, None, "KeyError: 'answer'")]
