import datetime as dt

from pyspark.sql import functions as F

from tidewake.functions.aggregates import confidence_score, cut_outliers, strict_greatest
from tidewake.functions.intervals import split


def test_split_granularities():
    first, last = dt.date(2020, 1, 1), dt.date(2020, 3, 2)
    assert split("all", first, last) == [first, dt.date(2020, 3, 3)]
    assert split("month", first, last) == [first, dt.date(2020, 2, 1), dt.date(2020, 3, 1), dt.date(2020, 3, 3)]
    assert split("aligned week", first, last)[:2] == [first, dt.date(2020, 1, 6)]
    assert split("2 month", first, last) == [first, dt.date(2020, 3, 1), dt.date(2020, 3, 3)]
    assert len(split("day", first, last)) == 63


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (3, None)], "a int, b int")
    assert [r[0] for r in df.select(strict_greatest(F.col("a"), F.col("b"))).collect()] == [2, None, None]
    df = spark.createDataFrame([(10.0, 8.0, 12.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)], "v double, l double, h double")
    assert [r[0] for r in df.select(confidence_score(F.col("v"), F.col("l"), F.col("h"))).collect()] == [60, 100, 0]


def test_outlier_cut_takes_the_nearest_rank(spark):
    df = spark.createDataFrame([("g", 946857600 + i, i) for i in range(11)], "g string, t long, x long")
    assert sorted(r.x for r in cut_outliers(df, ["g"], "t", "x", 0.0, 0.75).collect()) == list(range(9))  # rint(7.5) = 8


def test_median_ranks_hold_the_stated_share():
    from math import comb

    from tidewake.functions.order_statistics import median_ranks

    assert median_ranks(1) == (1, 1) and median_ranks(10) == (4, 7)
    for n in range(1, 60):
        low, high = median_ranks(n)
        assert 1 <= low <= high <= n
        assert sum(comb(n, k) for k in range(low)) >= 0.1 * 2**n  # the tail is the smallest count that reaches a tenth


def test_timeline_steps(spark):
    from tidewake.operators.tracker import timeline

    rows = spark.createDataFrame([(19723 + 40, 19723, 30), (19723 + 40, 19723, 100), (19723 + 40, 19723, 400), (19730, 19728, 400)], "day long, first long, span long")
    assert [r[0] for r in rows.select(timeline(F.col("day"), F.col("first"), F.col("span"))).collect()] == [19763, 19758, 19723 + 31, 19728]
