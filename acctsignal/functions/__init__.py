"""Column expressions: every function takes and returns ``Column``, no Python UDFs."""

from acctsignal.functions.geo import great_circle_miles
from acctsignal.functions.numbers import flag, rate
from acctsignal.functions.text import (
    digit_count,
    entropy,
    has_all_terms,
    leading_digits,
    trailing_digits,
    xml_escape,
)
from acctsignal.functions.times import dump_date, inversions, post_time, table_time

__all__ = [
    "digit_count", "dump_date", "entropy", "flag", "great_circle_miles",
    "has_all_terms", "inversions", "leading_digits", "post_time", "rate", "table_time",
    "trailing_digits", "xml_escape",
]
