"""Model output to typed data, line items and totals, and fields read from text by rule."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.fixed_values import INVOICE_NUMBER_WORDS, TAX_RATE
from quire.functions.json import is_object_text, strict_parse
from quire.functions.text import py_float, py_round, py_strip
from quire.operators.layout import amount, cell_block, cell_value, colon_lines, item_rows, label_cell, party, text_lines
from quire.schemas import LINE_ITEM

_FENCE = "```"


def _without_fences(text: Column) -> Column:
    """Text without its code-fence lines, if it starts with one."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~py_strip(line).startswith(_FENCE))
    return F.when(text.startswith(_FENCE), F.array_join(kept, "\n")).otherwise(text)


def _outer_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, or null."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & text.contains("}") & (end >= start), F.substring(text, start, end - start + 1))


def parse_model_json(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ``data`` (VARIANT object) and ``parse_path``.

    ``strict``: the fence-free text is JSON; ``slice``: its outermost braces are; ``raw``: neither, the
    text is kept under ``raw_output``. ``non_object`` (JSON but no object) and ``failed`` (no answer)
    give an empty object. Steps are separate columns so that no text is parsed twice.
    """
    raw = F.col(raw_col)
    kept = F.to_variant_object(F.struct(raw.alias("raw_output")))
    path = (
        F.when(raw.isNull(), "failed")
        .when(F.col("_strict").isNotNull(), F.when(is_object_text(F.col("_clean")), "strict").otherwise("non_object"))
        .when(F.col("_slice").isNotNull(), "slice")
        .otherwise("raw")
    )
    data = (
        F.when(F.col("parse_path") == "strict", F.col("_strict"))
        .when(F.col("parse_path") == "slice", F.col("_slice"))
        .when(F.col("parse_path") == "raw", kept)
        .otherwise(F.parse_json(F.lit("{}")))
    )
    return (
        df.withColumn("_stripped", py_strip(raw))
        .withColumn("_clean", _without_fences(F.col("_stripped")))
        .withColumn("_strict", strict_parse(F.col("_clean")))
        .withColumn("_cut", F.when(F.col("_strict").isNull(), _outer_braces(F.col("_clean"))))
        .withColumn("_slice", strict_parse(F.col("_cut")))
        .withColumn("parse_path", path)
        .withColumn("data", data)
        .drop("_stripped", "_clean", "_strict", "_cut", "_slice")
    )


def _numbered_items(items: Column) -> Column:
    """Line items whose numbers are read as Python reads them: text counts, a unit or currency sign does not."""
    numbers = ("quantity", "unit_price", "total")
    return F.transform(items, lambda item: F.struct(item["description"].alias("description"), *[py_float(item[n]).alias(n) for n in numbers]))


def _typed(data: Column, fields: dict[str, str]) -> list[Column]:
    """Columns of an object VARIANT; a missing or unfit list is an empty list."""
    columns = []
    for name, kind in fields.items():
        if kind == "double":
            value = py_float(F.try_variant_get(data, f"$.{name}", "string"))
        elif name == "line_items":
            value = _numbered_items(F.try_variant_get(data, f"$.{name}", kind.replace("double", "string")))
        else:
            value = F.try_variant_get(data, f"$.{name}", kind)
        if kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        columns.append(value.alias(name))
    return columns


def as_invoices(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Typed invoice columns of ``data``. Dates stay text; numbers written as text are read as numbers."""
    fields = {
        "invoice_number": "string",
        "invoice_date": "string",
        "due_date": "string",
        "vendor_name": "string",
        "vendor_address": "string",
        "customer_name": "string",
        "customer_address": "string",
        "line_items": f"array<{LINE_ITEM}>",
        "subtotal": "double",
        "tax": "double",
        "total_amount": "double",
        "currency": "string",
        "payment_terms": "string",
    }
    return df.select(id_col, *_typed(F.col("data"), fields))


def as_contracts(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Typed contract columns of ``data``."""
    fields = {
        "contract_title": "string",
        "parties": "array<string>",
        "effective_date": "string",
        "expiration_date": "string",
        "contract_value": "double",
        "key_terms": "array<string>",
        "governing_law": "string",
        "termination_clause": "string",
    }
    return df.select(id_col, *_typed(F.col("data"), fields))


def explode_line_items(invoices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per line item; an invoice without items keeps one row of nulls."""
    return invoices.select(id_col, F.posexplode_outer("line_items").alias("item_no", "item")).select(
        id_col, "item_no", "item.description", "item.quantity", "item.unit_price", "item.total"
    )


def _cents(value: Column) -> Column:
    """In decimal, so that sums do not depend on the order of rows; null beyond 20 digits before the point."""
    return value.try_cast("decimal(28,8)")


def _with_tax(df: DataFrame, rate: float) -> DataFrame:
    return df.withColumn("tax", py_round(F.col("subtotal") * F.lit(rate), 2)).withColumn(
        "total", py_round(F.col("subtotal") + F.col("tax"), 2)
    )


def invoice_totals(items: DataFrame, rate: float = TAX_RATE, id_col: str = "doc_id") -> DataFrame:
    """Subtotal, tax and total per invoice from its items (sums combine before the shuffle).

    All three are null where the total of any item is missing or unreadable; without items they are 0.
    """
    known = F.count(_cents(F.col("total"))) == F.count("item_no")
    total = F.coalesce(F.sum(_cents(F.col("total"))), F.lit(0)).cast("double")
    sums = items.groupBy(id_col).agg(F.when(known, total).alias("subtotal"), F.count("item_no").alias("item_count"))
    return _with_tax(sums, rate)


def verify_totals(
    invoices: DataFrame, rate: float = TAX_RATE, tol: float = 0.01, id_col: str = "doc_id"
) -> DataFrame:
    """Compare stated subtotal, tax and total with those of the items, within ``tol``; no shuffle.

    ``tol`` must allow one cent: tax rounding may differ by that much on exact halves. The checks are null where an
    item's total is missing or unreadable, false where a stated amount is.
    """
    item_sum = F.aggregate(
        "line_items",
        F.lit(0).cast("decimal(38,8)"),
        lambda acc, item: (acc + _cents(item["total"])).cast("decimal(38,8)"),
    ).cast("double")
    stated = invoices.select(
        id_col,
        item_sum.alias("subtotal"),
        F.col("subtotal").alias("stated_subtotal"),
        F.col("tax").alias("stated_tax"),
        F.col("total_amount").alias("stated_total"),
    )
    computed = _with_tax(stated, rate)

    def agrees(stated_col: str, computed_col: str) -> Column:
        # rounded first: a difference of exactly tol counts as close
        gap = py_round(F.abs(F.col(stated_col) - F.col(computed_col)), 6)
        return F.when(F.col(computed_col).isNotNull(), F.coalesce(gap <= tol, F.lit(False)))

    return computed.withColumns(
        {
            "subtotal_ok": agrees("stated_subtotal", "subtotal"),
            "tax_ok": agrees("stated_tax", "tax"),
            "total_ok": agrees("stated_total", "total"),
        }
    )


def invoice_number(df: DataFrame, text_col: str = "raw_text", out: str = "invoice_number") -> DataFrame:
    """Add the text after the last colon of the first line that names an invoice and has a colon."""
    pattern = "|".join(INVOICE_NUMBER_WORDS)
    lines = F.split(py_strip(F.coalesce(text_col, F.lit(""))), "\n")
    first = F.try_element_at(
        F.filter(lines, lambda line: F.lower(line).rlike(pattern) & line.contains(":")), F.lit(1)
    )
    return df.withColumn(out, F.nullif(py_strip(F.substring_index(first, ":", -1)), F.lit("")))


# labels of the rule-based reader, and what may stand for an invoice number without a colon
LABELS = {
    "invoice_date": "invoice date|date",
    "due_date": "payment due|due date|due",
    "payment_terms": "payment terms|terms",
}
PARTIES = {"vendor": "from|seller|vendor|bill from", "customer": "to|buyer|customer|bill to|billed to|sold to"}
AMOUNT_LABELS = {"subtotal": "subtotal|net total", "tax": "tax|vat", "total_amount": "grand total|total due|amount due|total"}
NUMBER_LABELS = r"invoice number|invoice no\.?|inv no\.?"
NUMBER_PATTERN = r"(?im)^[ \t]*+invoice[ \t]*+#[ \t]*+([^\s:]\S*+)"


def extract_invoice_fields(df: DataFrame, text_col: str = "raw_text", id_col: str = "doc_id") -> DataFrame:
    """Invoice fields read off the page by labels and places; a field without a value is null.

    A label owns the text beside it or, failing that, the cells of the column below it (see ``layout``), so that two
    parties side by side, and labels above their values, are read. A party's name ends at the first comma; the rest of
    it and the lines below are its address. ``line_items`` are the lines that end in a count and two amounts.
    """
    # texts, lines and label cells are columns of their own, so that each is found once
    names = LABELS | PARTIES | AMOUNT_LABELS | {"number": NUMBER_LABELS}
    cut = df.withColumn("_text", F.coalesce(text_col, F.lit(""))).withColumn("_lines", text_lines(F.col("_text")))
    cut = cut.withColumn("_labels", colon_lines(F.col("_lines")))
    cut = cut.withColumns({f"_{name}": label_cell(F.col("_lines"), F.col("_labels"), labels) for name, labels in names.items()})
    cut = cut.withColumns({f"_{name}": cell_block(F.col("_lines"), F.col(f"_{name}")) for name in PARTIES})
    number = F.nullif(F.regexp_extract("_text", NUMBER_PATTERN, 1), F.lit(""))
    labelled = F.nullif(F.regexp_extract(cell_value(F.col("_number")), r"^(\S+)", 1), F.lit(""))
    columns = {"invoice_number": F.coalesce(number, labelled)}
    columns |= {name: cell_value(F.col(f"_{name}")) for name in LABELS}
    for name in PARTIES:
        columns[f"{name}_name"], columns[f"{name}_address"] = party(F.col(f"_{name}"))
    columns |= {name: amount(cell_value(F.col(f"_{name}"))) for name in AMOUNT_LABELS}
    columns["currency"] = F.when(F.col("_text").contains("€"), "EUR").when(F.col("_text").contains("$"), "USD")
    columns["line_items"] = item_rows(F.col("_lines"))
    read = cut.select(id_col, *[c.alias(n) for n, c in columns.items()])
    return read.withColumn("line_items_count", F.size("line_items").cast("bigint"))
