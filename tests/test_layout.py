"""The layout reader on pages whose fields stand side by side, below their labels, or nowhere."""

import time

import pytest

from quire.operators import extract

# fixed value: the reference page in two columns
TWO_COLUMNS = """ACME CLOUD SERVICES                                    INVOICE

Invoice Number: INV-2024-0847               Date: March 15, 2024
                                            Due:  April 15, 2024

FROM:                                       BILL TO:
Acme Cloud Services                         Widget Corp
123 Tech Boulevard                          456 Innovation Drive
San Francisco, CA 94105                     Austin, TX 78701

Description                          Qty    Unit Price    Total
--------------------------------------------------------------
Cloud Hosting (monthly)               1      $2,400.00   $2,400.00
API Calls (10K bundle)                3        $150.00     $450.00
Premium Support                       1        $500.00     $500.00

                                            Subtotal:   $3,350.00
                                            Tax (8.5%):   $284.75
                                            TOTAL DUE:  $3,634.75

Payment Terms: Net 30
"""


def read(spark, text):
    return extract.extract_invoice_fields(spark.createDataFrame([(1, text)], "doc_id long, raw_text string")).first()


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_parties_side_by_side(spark, eol):
    row = read(spark, TWO_COLUMNS.replace("\n", eol))
    assert (row["invoice_number"], row["invoice_date"], row["due_date"]) == ("INV-2024-0847", "March 15, 2024", "April 15, 2024")
    assert (row["vendor_name"], row["vendor_address"]) == ("Acme Cloud Services", "123 Tech Boulevard, San Francisco, CA 94105")
    assert (row["customer_name"], row["customer_address"]) == ("Widget Corp", "456 Innovation Drive, Austin, TX 78701")
    assert (row["subtotal"], row["tax"], row["total_amount"], row["currency"]) == (3350.0, 284.75, 3634.75, "USD")
    assert (row["payment_terms"], row["line_items_count"]) == ("Net 30", 3)
    assert tuple(row["line_items"][1]) == ("API Calls (10K bundle)", 3.0, 150.0, 450.0)


def test_labels_above_their_values(spark):
    page = "INVOICE NO:     DATE:        DUE DATE:\nI-7             1 May 2024   2 May 2024\n\nSELLER:\n\nBUYER:\n  Bob Ltd\n  1 Road\n  Ham\n\nleft"
    row = read(spark, page)
    assert (row["invoice_number"], row["invoice_date"], row["due_date"]) == ("I-7", "1 May 2024", "2 May 2024")
    assert (row["vendor_name"], row["customer_name"], row["customer_address"]) == (None, "Bob Ltd", "1 Road, Ham")


def test_columns_that_are_not_quite_straight(spark):
    page = "FROM:               TO:\nA long name of mill  House\nDock 3             Lane 4\n"
    row = read(spark, page)
    assert (row["vendor_name"], row["vendor_address"]) == ("A long name of mill", "Dock 3")
    assert (row["customer_name"], row["customer_address"]) == ("House", "Lane 4")


def test_tabs_and_a_label_without_value(spark):
    row = read(spark, "Invoice #:\tZ-1\nTotal:\nTax:\tnone\nSubtotal:\t$1,000.5\nVendor: Übel & Söhne, 語 street")
    assert (row["total_amount"], row["tax"], row["subtotal"]) == (None, None, 1000.5)
    assert (row["vendor_name"], row["vendor_address"]) == ("Übel & Söhne", "語 street")


@pytest.mark.parametrize("text", [None, "", " \n\n ", ":", "to:", "TO:\nTO:"])
def test_nothing_to_read(spark, text):
    row = read(spark, text)
    assert row["customer_name"] is None and row["line_items"] == [] and row["line_items_count"] == 0


def test_no_text_is_slow(spark):
    texts = ["a  " * 300_000, " " * 1_000_000, "TO:\n" * 100_000, "1 " * 500_000, "to " * 300_000, "date (" * 200_000, "$1,1" * 200_000, "x\n" * 200_000, "to:  " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    begin = time.time()
    assert extract.extract_invoice_fields(df).count() == len(texts)
    extract.extract_invoice_fields(df).collect()
    assert time.time() - begin < 60


def test_odd_pages(spark):
    """Remarks with colons, labels twice in a line, line ends of other kinds, digits that are no number."""
    row = read(spark, "Tax (a: b) : $1.50\nTotal:  Total: $9\nSUBTOTAL:\n   $7.\nDue: x\x85Date: y\nnuts  3  $1.2.3  €4,0 \r\n 2 $1 $2\nx 3 $1  $2.")
    assert (row["tax"], row["total_amount"], row["subtotal"], row["due_date"], row["invoice_date"]) == (1.5, None, 7.0, "x\x85Date: y", None)
    assert [tuple(item) for item in row["line_items"]] == [("nuts", 3.0, None, 40.0), ("x", 3.0, 1.0, 2.0)]
    assert row["currency"] == "EUR"
