import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from acctsignal import functions as X


def values(spark, kind, items, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_entropy(spark):
    got = values(spark, "string", ["aab1", "", None, "aaaa", "ab", "abcd"], X.entropy)
    assert got[:2] == [1.5, 0.0] and got[2] is None and got[3:] == [0.0, 1.0, 2.0]


def test_digit_runs(spark):
    names = ["12ab3", "abc", "", None, "123", "a1b22", "٣a"]
    assert values(spark, "string", names, X.leading_digits) == [2, 0, 0, None, 3, 0, 1]
    assert values(spark, "string", names, X.trailing_digits) == [1, 0, 0, None, 3, 2, 0]
    assert values(spark, "string", names, X.digit_count) == [3, 0, 0, None, 3, 3, 1]


def test_flag(spark):
    assert values(spark, "boolean", [True, False, None], X.flag) == [1, 0, 0]
    assert values(spark, "int", [1, 0, None, 7], X.flag) == [1, 0, 0, 1]


def test_rate_of_zero_is_null(spark):
    assert values(spark, "int", [4, 0], lambda x: X.rate(F.lit(2), x)) == [0.5, None]


def test_times(spark):
    seconds = lambda f: lambda x: F.unix_timestamp(f(x))
    assert values(spark, "string", ["Wed Aug 27 13:08:45 +0000 2008", "Wed Aug 27 13:08:45 +0100 2008",
                                    "rubbish", "", None], seconds(X.post_time)) == [
        1219842525, 1219838925, None, None, None]
    assert values(spark, "string", ["2008-08-27 13:08:45", "2008"], seconds(X.table_time)) == [1219842525, None]
    assert values(spark, "string", ["s3a://b/x.accounts-2018-08-05.json.gz", "accounts.json.gz"],
                  seconds(X.dump_date)) == [1533427200, None]


@pytest.mark.parametrize("points, miles", [
    ((0.0, 0.0, 0.0, 90.0), 6371.009 / 1.609344 * math.pi / 2),
    ((90.0, 0.0, -90.0, 0.0), 6371.009 / 1.609344 * math.pi),
    ((12.5, 7.0, 12.5, 7.0), 0.0),
    ((float("nan"), 0.0, 0.0, 0.0), None),
    ((None, 0.0, 0.0, 0.0), None),
])
def test_distance(spark, points, miles):
    df = spark.createDataFrame([points], "a double, b double, c double, d double")
    got = df.select(X.great_circle_miles(*[F.col(c) for c in "abcd"])).first()[0]
    assert got is None if miles is None else got == pytest.approx(miles)


def test_keywords(spark):
    texts = ["Free BITCOIN now", "bitcoin", "", None]
    assert values(spark, "string", texts, lambda t: X.has_all_terms(t, "bitcoin  FREE")) == [
        True, False, False, None]


def test_xml_escape(spark):
    assert values(spark, "string", ["a<b>&\"'"], X.xml_escape) == ["a&lt;b&gt;&amp;&quot;&apos;"]


def test_inversions(spark):
    rng = random.Random(1)
    lists = [[], [1], [3, 1, 2], [2, 2, 2], [5, 4, 3, 2, 1]] + [
        [rng.randrange(20) for _ in range(rng.randrange(60))] for _ in range(20)]
    expected = [sum(a > b for a, b in itertools.combinations(v, 2)) for v in lists]
    assert values(spark, "array<int>", lists, X.inversions) == expected
