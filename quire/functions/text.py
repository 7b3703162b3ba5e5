"""Text, rounding and number rules, as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.fixed_values import PYTHON_WHITESPACE

# digits as Python's float() reads them; no type suffix, no hexadecimal
_FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def py_strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (plain ``trim`` removes only blanks)."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def np_round(value: Column, digits: int) -> Column:
    """Round as numpy does: scale, round half to even, scale back. For means."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def py_round(value: Column, digits: int) -> Column:
    """Round as Python's ``round``: on the exact binary value, half to even. (``F.round`` is half-up.)

    Scaling can land on a half that the exact product only comes close to. The product's rounding
    error, computed without loss by splitting the value in two, then tells which way to go.
    """
    scale = F.lit(float(10**digits))
    scaled = value * scale
    wide = value * F.lit(134217729.0)  # 2**27 + 1: keeps the upper half of the digits
    high = wide - (wide - value)
    error = (high * scale - scaled) + (value - high) * scale
    near_half = (scaled - F.floor(scaled)) == 0.5
    whole = (
        F.when(near_half & (error > 0), F.floor(scaled) + 1)
        .when(near_half & (error < 0), F.floor(scaled))
        .otherwise(F.rint(scaled))
    )
    return whole / scale


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounded as Python does."""
    return F.format_string("%.2f", py_round(value, 2))


def py_float(text: Column) -> Column:
    """Number in ``text`` where Python's ``float`` accepts it, else null."""
    stripped = py_strip(text)
    return F.when(stripped.rlike(_FLOAT_TEXT), F.replace(stripped, F.lit("_"), F.lit("")).try_cast("double"))


def decimal_text(value: Column) -> Column:
    """Text of a double; values below 0.001 keep decimal notation down to 0.0001, as in ``str``."""
    small = (F.abs(value) < 0.001) & (F.abs(value) >= 0.0001)
    plain = F.regexp_replace(F.format_string("%.12f", value), "0+$", "")
    return F.when(small, plain).otherwise(value.cast("string"))


def exact_mean(value: Column) -> Column:
    """Mean through a decimal sum: the same whatever order rows arrive in. For small bounded groups."""
    clean = F.when(~F.isnan(value), value)
    return F.sum(clean.cast("decimal(28,10)")).cast("double") / F.count(clean)


def content_id(*columns: str) -> Column:
    """An id in the form of a UUID from the SHA-256 of the columns' texts, each with its length before it; null is "-"."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.sha2(F.concat_ws(";", *parts), 256)
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
