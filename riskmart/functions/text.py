"""Repairs of text columns: stray underscores, placeholder tokens, masks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = r"^\d+$"
SIGNED_DECIMAL = r"^-?\d+(\.\d+)?$"


def strip_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(""))


def keep_if_digits(c: Column) -> Column:
    """The text where it is digits only, otherwise NULL."""
    return F.when(c.rlike(DIGITS), c)


def keep_if_signed_decimal(c: Column) -> Column:
    """The text where it is a plain decimal with an optional minus, otherwise NULL."""
    return F.when(c.rlike(SIGNED_DECIMAL), c)


def tokens_to(c: Column, tokens: Iterable[str], default: str) -> Column:
    """Replace placeholder tokens. NULL is no token and stays NULL.

    Both branches are text, so ANSI mode never coerces the column to a number.
    """
    return F.when(c.isin(*tokens), F.lit(default)).otherwise(c)


def blank_to(c: Column, default: str) -> Column:
    """Replace NULL and the empty text."""
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def mask_to_null(c: Column, mask: str) -> Column:
    """NULL wherever the mask occurs in the text."""
    return F.when(~F.contains(c, F.lit(mask)), c)
