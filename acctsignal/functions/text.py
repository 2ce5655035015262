"""Screen-name statistics and text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters; '' gives 0.0, NULL gives NULL."""
    total = F.length(text)
    occurrences = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda ch: (total - F.length(F.replace(text, ch, F.lit("")))) / total,
    )
    bits = F.aggregate(occurrences, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(total == 0, F.lit(0.0)).otherwise(bits)


def leading_digits(text: Column) -> Column:
    """Length of the digit run at the start."""
    return F.length(F.regexp_extract(text, r"^(\p{Nd}*)", 1))


def trailing_digits(text: Column) -> Column:
    """Length of the digit run at the end."""
    return leading_digits(F.reverse(text))


def digit_count(text: Column) -> Column:
    """Number of digits anywhere."""
    return F.length(F.regexp_replace(text, r"\P{Nd}", ""))


def has_all_terms(text: Column, query: str) -> Column:
    """True if the text holds every whitespace-separated term of ``query``, in any case."""
    found = F.lit(True)
    for term in query.lower().split():
        found = found & F.lower(text).contains(term)
    return found


def xml_escape(text: Column) -> Column:
    """Escape the five XML special characters; & goes first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
