"""Bootstrap bounds of means."""

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators.bootstrap import bootstrap_mean, poisson_count


def test_counts_are_poisson_and_fixed(spark):
    n = spark.range(20000).select(poisson_count(F.col("id"), F.lit(3)).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20000 for r in n}
    assert all(abs(share[k] - p) < 0.012 for k, p in {0: 0.3679, 1: 0.3679, 2: 0.1839, 3: 0.0613}.items())


def test_bounds_agree_with_the_normal_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 300.0, 900)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("one", 1, 50.0), ("same", 1, 7.0), ("same", 2, 7.0), ("low", 1, 0.0), ("low", 2, 0.0), ("low", 3, 90.0), ("none", 1, None)], "g string, id long, sample double")
    got = {r.g: r for r in bootstrap_mean(rows, ["g"]).collect()}
    half = 1.2816 * x.std(ddof=1) / 30
    assert got["a"].n == 900 and abs(got["a"].mean - x.mean()) < 1e-6
    assert abs(got["a"].low - (x.mean() - half)) < 0.3 * half and abs(got["a"].high - (x.mean() + half)) < 0.3 * half
    assert (got["one"].low, got["one"].mean, got["one"].high) == (0.5, 50.0, 5000.0)
    assert (got["same"].low, got["same"].high) == (7.0, 7.0)
    assert got["low"].low == 0.0 and got["low"].high > 30 and "none" not in got
    again = {r.g: r for r in bootstrap_mean(rows.repartition(5), ["g"]).collect()}
    assert abs(again["a"].low - got["a"].low) < 1e-9
