"""Typed numbers out of text, range rules and guarded ratios.

Everything here is safe in ANSI mode: text that is no number, an overflow or a
zero denominator gives NULL or the stated default, never an error that would
end a job because of one bad row. The text parsers mention their argument once
(text_to_int twice, the second time for text that is no whole number), so a chain
of repairs is evaluated once per row and generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart.functions.text import SIGNED_DECIMAL

# Sign and whole part of a plain decimal with optional blanks around it.
WHOLE_PART = r"^\s*([+-]?)(?=\.?\d)(\d*)(?:\.\d*)?\s*$"


def text_to_int(c: Column) -> Column:
    """Truncating text -> int: '3.7' gives 3; exponents, words and overflow give NULL.

    What is a whole number already is cast; only the rest is looked at by pattern.
    """
    return F.coalesce(c.try_cast("int"), _whole_part(c))


def _whole_part(c: Column) -> Column:
    return F.regexp_replace(c, WHOLE_PART, "$10$2").try_cast("int")


def digits_to_int(c: Column) -> Column:
    """Text of digits only -> int, anything else NULL."""
    return F.regexp_extract(c, r"^\d+$", 0).try_cast("int")


def digits_to_int_or_zero(c: Column) -> Column:
    """Text of digits only -> int, anything else (NULL too) 0; an overflow is NULL."""
    text = F.coalesce(c, F.lit(""))
    return F.regexp_replace(text, r"(?s)^(?!\d+$).*$", "0").try_cast("int")


def signed_decimal_to_float(c: Column) -> Column:
    """Plain decimal text with an optional minus -> float, anything else NULL."""
    return F.regexp_extract(c, SIGNED_DECIMAL, 0).try_cast("float")


def text_to_double(c: Column) -> Column:
    return c.try_cast("double")


def text_to_float(c: Column) -> Column:
    return c.try_cast("float")


def null_outside(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value where low <= value <= high (either side may be open), otherwise NULL."""
    if low is None and high is None:
        raise ValueError("give at least one bound")
    if low is None:
        return F.when(c <= F.lit(high), c)
    if high is None:
        return F.when(c >= F.lit(low), c)
    return F.when(c.between(F.lit(low), F.lit(high)), c)


def clip_to_zero(c: Column) -> Column:
    """The value where it is positive; zero for everything else, NULL included."""
    return F.when(c > 0, c).otherwise(F.lit(0))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a float; 0 where the denominator is 0 or NULL."""
    return (
        F.when(denominator != 0, F.try_divide(numerator, denominator))
        .otherwise(F.lit(0.0))
        .try_cast("float")
    )


def instalments_missed(overdue: Column, due: Column) -> Column:
    """Whole instalments covered by the overdue amount, 0 where nothing was due.

    More than an int holds count as the largest int; NULL stays NULL.
    """
    ratio = F.try_divide(overdue, due)
    most = float(2**31 - 1)
    inside = F.when(ratio > most, F.lit(most)).when(ratio < -most, F.lit(-most)).otherwise(ratio)
    return F.when(due != 0, F.ceil(inside)).otherwise(F.lit(0)).cast("int")
