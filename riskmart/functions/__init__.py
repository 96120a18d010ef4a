"""Column builders shared by the cleaning and feature operators."""

from riskmart.functions.dates import (
    add_months_py,
    first_missed_date,
    history_months,
    month_series,
    parse_date,
)
from riskmart.functions.numeric import (
    clip_to_zero,
    digits_to_int,
    digits_to_int_or_zero,
    instalments_missed,
    null_outside,
    ratio_or_zero,
    signed_decimal_to_float,
    text_to_double,
    text_to_float,
    text_to_int,
)
from riskmart.functions.text import (
    blank_to,
    keep_if_digits,
    keep_if_signed_decimal,
    mask_to_null,
    strip_underscores,
    tokens_to,
)

__all__ = [
    "add_months_py",
    "blank_to",
    "clip_to_zero",
    "digits_to_int",
    "digits_to_int_or_zero",
    "first_missed_date",
    "history_months",
    "instalments_missed",
    "keep_if_digits",
    "keep_if_signed_decimal",
    "mask_to_null",
    "month_series",
    "null_outside",
    "parse_date",
    "ratio_or_zero",
    "signed_decimal_to_float",
    "strip_underscores",
    "text_to_double",
    "text_to_float",
    "text_to_int",
    "tokens_to",
]
