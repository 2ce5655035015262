"""Timestamps in the three text formats of the inputs, and order statistics on them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text formats the inputs use.
POST_TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"  # behind a three-letter weekday
TABLE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DUMP_DATE_FORMAT = "yyyy-MM-dd"
DUMP_FILE_PATTERN = r".accounts-(\d{4}-\d{2}-\d{2})."


def post_time(text: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008`` as a timestamp; NULL if it does not parse.

    Spark does not parse weekday names, so the first four characters are cut off.
    """
    return F.try_to_timestamp(F.substring(text, 5, 64), F.lit(POST_TIME_FORMAT))


def table_time(text: Column) -> Column:
    """``2008-08-27 13:08:45`` as a timestamp; NULL if it does not parse."""
    return F.try_to_timestamp(text, F.lit(TABLE_TIME_FORMAT))


def dump_date(file_name: Column) -> Column:
    """The date in ``….accounts-2018-08-05.…``; NULL for other names."""
    return F.try_to_timestamp(F.regexp_extract(file_name, DUMP_FILE_PATTERN, 1), F.lit(DUMP_DATE_FORMAT))


def inversions(values: Column) -> Column:
    """Number of pairs i < j with values[i] > values[j]. Quadratic: for short arrays only."""
    smaller_after = F.transform(
        values,
        lambda x, i: F.size(F.filter(F.slice(values, i + 2, F.size(values)), lambda y: y < x)),
    )
    return F.aggregate(smaller_after, F.lit(0), lambda acc, n: acc + n)
