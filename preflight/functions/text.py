"""Text and number expressions used in check details and result text.

All helpers return ``Column`` expressions so they stay inside whole-stage
codegen; nothing is formatted row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_text(c) -> Column:
    """Whole number with thousands separators: 45257 -> '45,257'."""
    return F.format_number(_col(c).cast("long"), 0)


_PCT_CACHE: dict = {}


def rounded_pct(part, whole, scale: int) -> Column:
    """``ROUND(100.0 * part / NULLIF(whole, 0), scale)`` as DOUBLE.

    Computed exactly in integer arithmetic (round half up, counts are never
    negative) so that boundary cases do not depend on floating point:
    floor((2 * part * 100 * 10^scale + whole) / (2 * whole)) / 10^scale.
    NULL when ``whole`` is 0 or either side is NULL.  Expressions over
    named columns are built once and reused.
    """
    if isinstance(part, str) and isinstance(whole, str):
        key = (part, whole, scale)
        if key not in _PCT_CACHE:
            _PCT_CACHE[key] = _rounded_pct(F.col(part), F.col(whole), scale)
        return _PCT_CACHE[key]
    return _rounded_pct(_col(part), _col(whole), scale)


def _rounded_pct(part: Column, whole: Column, scale: int) -> Column:
    p = _col(part).cast("decimal(38,0)")
    w = _col(whole).cast("decimal(38,0)")
    factor = 2 * 100 * (10 ** scale)
    scaled = F.when(w != 0, (p * F.lit(factor) + w) / (w * 2))
    # decimal / decimal keeps enough scale; floor gives the exact quotient
    return (F.floor(scaled).cast("decimal(38,0)") / F.lit(10 ** scale)).cast("double")


def pct_text(c, scale: int = 4) -> Column:
    """Text of a rounded percentage the way a float prints it:
    33.41 -> '33.41', 100 -> '100.0', 0.0001 -> '0.0001', 0 -> '0.0'."""
    s = _col(c).cast(f"decimal(30,{scale})").cast("string")
    if scale > 0:
        s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", ".0")
    return s


def value_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text of a reported value; NULL prints as 'None', booleans as
    'True'/'False'."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("None")).when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit("None"))


def number_text(c: Column, dtype: T.DataType) -> Column:
    """Readable number: integers with separators; fractional values whole ->
    integer text, else one decimal; anything else as text ('None' for NULL).
    Booleans print as 1 / 0 (they are integers for this purpose)."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), "None").when(c, "1").otherwise("0")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.format_number(c, 0), F.lit("None"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return F.coalesce(
            F.when(d == F.floor(d), F.format_number(F.floor(d), 0))
             .otherwise(F.format_number(d, 1)),
            F.lit("None"))
    return value_text(c, dtype)


def file_stem(path) -> Column:
    """'models/marts/fact_orders.sql' -> 'fact_orders'."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1)


# Fixed pattern: single-argument ref('name') / ref("name") calls in model code.
REF_PATTERN = r"""\{\{\s*ref\(\s*['"](\w+)['"]\s*\)\s*\}\}"""


def ref_names(code) -> Column:
    """Array of model names referenced with single-argument ref() calls."""
    return F.regexp_extract_all(_col(code), F.lit(REF_PATTERN), 1)
