"""Means with bootstrap bounds: replicates are weighed by seeded Poisson counts and summed up in one grouping."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from .metrics import SAMPLES

#: Replicates of a cell of up to ``FULL`` samples, and the fewest of any; between them their number falls so that the work of a cell stays the same.
REPLICATES, FULL, FEWEST = 2000, 200, 10
#: The bounds hold this share of the replicates.
CONFIDENCE = 0.8
#: A single sample's bounds: a hundredth and a hundred times of it.
SINGLE = 100
_STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_count(key: Column, replicate: Column) -> Column:
    """How often a replicate takes the row ``key``: a Poisson count of mean 1, the same whenever it is asked for."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= s, 1).otherwise(0) for s in _STEPS), F.lit(0))


def bootstrap_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, low, high) of each cell's samples, none of which may be negative. rows: (keys, id, sample); ``id`` tells a cell's rows apart.

    The bounds are pivotal: twice the mean less the upper and lower ends of the
    replicates' means, and never below 0. Rows never meet in one place: a replicate
    is two sums. Work is rows times replicates, which is at most ``REPLICATES`` times
    ``FULL`` a cell, or ``FEWEST`` times its rows. Null samples don't count.
    """
    rows = rows.where("sample is not null").select(*keys, "id", F.col("sample").cast("double").alias("sample"))
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("sample").alias("mean"))
    cells = cells.withColumn("replicates", F.greatest(F.lit(FEWEST), F.floor(REPLICATES * F.least(F.lit(1.0), FULL / F.col("n")))).cast("int"))
    drawn = rows.join(cells.where("n > 1").select(*keys, "replicates"), keys).select(*keys, "id", "sample", F.explode(F.sequence(F.lit(1), F.col("replicates"))).alias("b"))
    drawn = drawn.withColumn("w", poisson_count(F.col("id"), F.col("b"))).where("w > 0")
    means = drawn.groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("sample")) / F.sum("w")).alias("m"))
    tail = (1 - CONFIDENCE) / 2
    ends = means.groupBy(*keys).agg(F.percentile("m", F.lit(tail)).alias("a"), F.percentile("m", F.lit(1 - tail)).alias("z"))
    single = F.col("n") == 1
    low, high = F.greatest(2 * F.col("mean") - F.col("z"), F.lit(0.0)), 2 * F.col("mean") - F.col("a")
    return cells.join(ends, keys, "left").select(*keys, "n", "mean", F.when(single, F.col("mean") / SINGLE).otherwise(low).alias("low"), F.when(single, F.col("mean") * SINGLE).otherwise(high).alias("high"))


_LEAD = SAMPLES["lead"]
_COUNT = " + ".join(f"CASE WHEN u >= {s!r} THEN 1 ELSE 0 END" for s in _STEPS)


@query("prs", "SELECT region, n, round(mean, 3) AS mean, round(CASE WHEN n = 1 THEN mean / 100 ELSE greatest(2 * mean - z, 0) END, 3) AS low, round(CASE WHEN n = 1 THEN mean * 100 ELSE 2 * mean - a END, 3) AS high FROM cells LEFT JOIN (SELECT region, quantile_cont(m, 0.1) AS a, quantile_cont(m, 0.9) AS z FROM means GROUP BY 1) USING (region)", f"""samples AS (SELECT region, node_id, CAST({_LEAD[0]} AS DOUBLE) AS x FROM prs WHERE ({_LEAD[0]}) IS NOT NULL),
cells AS (SELECT region, count(*) AS n, avg(x) AS mean, CAST(greatest(10, floor(2000 * least(1.0, 200 / count(*)))) AS BIGINT) AS reps FROM samples GROUP BY 1),
drawn AS (SELECT region, b, x, {_COUNT} AS w FROM (SELECT *, CAST('0x' || substr(md5(node_id || ':' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT region, node_id, x, unnest(range(1, reps + 1)) AS b FROM samples JOIN cells USING (region) WHERE n > 1))),
means AS (SELECT region, b, sum(w * x) / sum(w) AS m FROM drawn WHERE w > 0 GROUP BY ALL)""")
def e02_bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lead time of each region with its bootstrap bounds."""
    rows = facts(spark, sf_dir, "prs").select("region", F.col("node_id").alias("id"), F.expr(_LEAD[0]).alias("sample"))
    found = bootstrap_mean(rows, ["region"])
    return found.select("region", "n", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])
