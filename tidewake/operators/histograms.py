"""Histograms of many metrics and groups at once: bins are found from moments in one pass and filled in a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from .metrics import SAMPLES

#: Seconds that durations are kept within: a minute and 30 days.
SHORTEST, LONGEST = 60, 2592000


def counted(rows: DataFrame, keys: list[str], durations: bool) -> DataFrame:
    """(keys, sample, n): samples with their counts, durations clamped; so later steps see distinct values, 2.6 million a group at most for durations."""
    x = F.col("sample")
    x = F.greatest(F.lit(SHORTEST), F.least(x, F.lit(LONGEST))) if durations else x
    return rows.where("sample is not null").groupBy(*keys, x.cast("double").alias("sample")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, keys: list[str], durations: bool = True, log: bool = False, bins: int = 0) -> DataFrame:
    """(keys, bins, idx, low, high, frequency, q25, q75): equal bins of each group's samples, empty ones too. rows: (keys, sample).

    ``bins`` 0 finds their number: that of Doane's rule or of Freedman and
    Diaconis', whichever is more. With ``log`` the bins are equal on a logarithmic
    scale, and samples of 0 or less raise an error. The last bin holds its upper
    edge; a group of one value has a bin of width 1 around it. The quartiles are of
    the samples themselves.
    """
    cells = counted(rows, keys, durations)
    x = F.col("sample")
    if log:
        x = F.ln(F.when(x > 0, x).otherwise(F.raise_error(F.lit("a logarithmic scale needs samples over 0")).cast("double")))
    cells = cells.withColumn("x", x)
    quarter = lambda c, q: F.percentile(c, q, F.col("n"))
    n, total = F.sum("n"), F.sum(F.col("x") * F.col("n"))
    told = cells.groupBy(*keys).agg(n.alias("size"), (total / n).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), quarter("sample", 0.25).alias("q25"), quarter("sample", 0.75).alias("q75"), quarter("x", 0.25).alias("x25"), quarter("x", 0.75).alias("x75"))
    off = F.col("x") - F.col("mean")
    third = cells.join(told.select(*keys, "mean"), keys).groupBy(*keys).agg((F.sum(off * off * F.col("n")) / n).alias("m2"), (F.sum(off * off * off * F.col("n")) / n).alias("m3"))
    told = told.join(third, keys).withColumn("span", F.col("most") - F.col("least"))
    least_width = 0.0 if log or not durations else 1.0  # bins of whole seconds are a second wide at least
    size = F.col("size")
    fd = F.greatest(2 * (F.col("x75") - F.col("x25")) / F.cbrt(size), F.when(F.col("x75") > F.col("x25"), F.lit(least_width)).otherwise(0.0))
    doubt = F.sqrt(6.0 * (size - 2) / ((size + 1.0) * (size + 3)))
    lopsided = F.abs(F.col("m3") / F.pow("m2", F.lit(1.5)))
    doane = F.when((size > 2) & (F.col("m2") > 0), F.greatest(F.col("span") / (1 + F.log2(size) + F.log2(1 + lopsided / doubt)), F.lit(least_width))).otherwise(0.0)
    many = lambda width: F.when(width > 0, F.ceil(F.col("span") / width)).otherwise(1)
    found = F.greatest(many(fd), many(doane)) if not bins else F.lit(bins)
    flat = F.col("span") == 0
    told = told.withColumn("bins", F.when(flat & F.lit(not bins), 1).otherwise(found).cast("int")).withColumn("least", F.col("least") - F.when(flat, 0.5).otherwise(0.0)).withColumn("most", F.col("most") + F.when(flat, 0.5).otherwise(0.0))
    told = told.withColumn("step", (F.col("most") - F.col("least")) / F.col("bins")).select(*keys, "bins", "least", "step", "q25", "q75")
    edge = lambda i: F.col("least") + i * F.col("step")
    at = F.least(F.floor((F.col("x") - F.col("least")) / F.col("step")), F.col("bins") - 1)
    placed = cells.join(told, keys).withColumn("at", at)
    placed = placed.withColumn("at", F.when(F.col("x") < edge(F.col("at")), F.col("at") - 1).when((F.col("x") >= edge(F.col("at") + 1)) & (F.col("at") < F.col("bins") - 1), F.col("at") + 1).otherwise(F.col("at")))
    full = placed.groupBy(*keys, F.col("at").cast("int").alias("idx")).agg(F.sum("n").alias("frequency"))
    out = F.exp if log else (lambda c: c)
    every = told.select(*keys, "bins", "least", "step", "q25", "q75", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("idx"))
    return every.join(full, [*keys, "idx"], "left").select(*keys, "bins", "idx", out(edge(F.col("idx"))).alias("low"), out(edge(F.col("idx") + 1)).alias("high"), F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"), "q25", "q75")


def ticked_histogram(rows: DataFrame, keys: list[str], ticks: list[float], durations: bool = True) -> DataFrame:
    """(keys, idx, low, high, frequency): samples between the given ticks; what lies outside has a bin of its own, -1 below and the number of ticks less 1 above, if there is any.

    The last bin, whichever that is, holds its upper edge.
    """
    ticks = [float(min(max(t, SHORTEST), LONGEST)) if durations else float(t) for t in ticks]
    cells = counted(rows, keys, durations)
    ends = cells.groupBy(*keys).agg(F.min("sample").alias("least"), F.max("sample").alias("most"))
    cells = cells.join(ends, keys)
    last, x = len(ticks) - 1, F.col("sample")
    at = F.lit(-1)
    for i, t in enumerate(ticks):
        at = F.when(x >= t, i).otherwise(at) if i == 0 else F.when(x >= t, F.lit(i)).otherwise(at)
    at = F.when((x == ticks[-1]) & (F.col("most") == ticks[-1]), last - 1).otherwise(at)
    full = cells.groupBy(*keys, at.cast("int").alias("idx")).agg(F.sum("n").alias("frequency"))
    inner = ends.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(zip(ticks, ticks[1:], strict=False))])).alias("b"))
    below = ends.where(F.col("least") < ticks[0]).select("*", F.struct(F.lit(-1).alias("idx"), F.col("least").alias("low"), F.lit(ticks[0]).alias("high")).alias("b"))
    over = ends.where(F.col("most") > ticks[-1]).select("*", F.struct(F.lit(last).alias("idx"), F.lit(ticks[-1]).alias("low"), F.col("most").alias("high")).alias("b"))
    every = inner.unionByName(below).unionByName(over).select(*keys, "b.*")
    return every.join(full, [*keys, "idx"], "left").select(*keys, "idx", "low", "high", F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"))


_NAMES = ("lead", "open", "wip", "review", "merging")
_STACKED = "samples AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, region, CAST(greatest(60, least({SAMPLES[n][0]}, 2592000)) AS DOUBLE) AS x FROM prs WHERE ({SAMPLES[n][0]}) IS NOT NULL" for n in _NAMES) + ")"


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    prs = facts(spark, sf_dir, "prs")
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.expr(SAMPLES[n][0]).cast("long").alias("sample")) for n in _NAMES])
    return prs.select("region", F.explode(each).alias("m")).select("m.metric", "region", "m.sample")


def _by_sql(scale: str, back: str, width: str) -> str:
    return f"""SELECT e.metric, e.region, bins, idx, round({back}(e.lo + idx * step), 6) AS low, round({back}(e.lo + (idx + 1) * step), 6) AS high, coalesce(f, 0) AS frequency, q25, q75 FROM (SELECT *, unnest(range(0, bins)) AS idx FROM shape) e
LEFT JOIN (SELECT metric, region, CASE WHEN y < lo + place * step THEN place - 1 WHEN y >= lo + (place + 1) * step AND place < bins - 1 THEN place + 1 ELSE place END AS idx, count(*) AS f FROM (SELECT s.*, h.lo, h.step, h.bins, CAST(least(floor((y - h.lo) / h.step), h.bins - 1) AS BIGINT) AS place FROM (SELECT *, {scale}(x) AS y FROM samples) s JOIN shape h USING (metric, region)) GROUP BY ALL) f USING (metric, region, idx)""" + "", f"""{_STACKED}, base AS (SELECT metric, region, count(*) AS n, min({scale}(x)) AS lo, max({scale}(x)) AS hi, avg({scale}(x)) AS mean, stddev_pop({scale}(x)) AS sd, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, quantile_cont({scale}(x), 0.75) - quantile_cont({scale}(x), 0.25) AS iqr FROM samples GROUP BY ALL),
skew AS (SELECT metric, region, avg(pow(({scale}(x) - mean) / nullif(sd, 0), 3)) AS g FROM samples JOIN base USING (metric, region) GROUP BY ALL),
shape AS (SELECT metric, region, q25, q75, CAST(CASE WHEN hi = base.lo THEN 1 ELSE greatest(CASE WHEN iqr > 0 THEN ceil((hi - base.lo) / greatest(2 * iqr / cbrt(n), {width})) ELSE 1 END, CASE WHEN n > 2 THEN ceil((hi - base.lo) / greatest((hi - base.lo) / (1 + log2(n) + log2(1 + abs(g) / sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3))))), {width})) ELSE 1 END) END AS BIGINT) AS bins,
  base.lo - CASE WHEN hi = base.lo THEN 0.5 ELSE 0 END AS lo, (hi - base.lo + CASE WHEN hi = base.lo THEN 1 ELSE 0 END) / bins AS step FROM base JOIN skew USING (metric, region))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("prs", *_by_sql("", "", "1.0"))
def e14_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of five durations for each region, bins found from the samples."""
    return _rounded(histogram(_stacked(spark, sf_dir), ["metric", "region"]))


@query("prs", *_by_sql("ln", "exp", "0.0"))
def e14_log_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(histogram(_stacked(spark, sf_dir), ["metric", "region"], log=True))


@query("prs", "SELECT metric, region, idx, low, high, count(x) AS frequency FROM bars LEFT JOIN samples s USING (metric, region) WHERE true AND (x IS NULL OR (x >= low AND (x < high OR (last AND x = high)))) GROUP BY ALL UNION ALL SELECT metric, region, idx, low, high, 0 FROM bars b WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.metric = b.metric AND s.region = b.region AND x >= low AND (x < high OR (last AND x = high)))", _STACKED + """, ends AS (SELECT metric, region, min(x) AS lo, max(x) AS hi FROM samples GROUP BY ALL),
bars AS (SELECT metric, region, idx, low, high, idx = max(idx) OVER (PARTITION BY metric, region) AS last FROM (SELECT metric, region, -1 AS idx, lo AS low, 86400.0::DOUBLE AS high FROM ends WHERE lo < 86400 UNION ALL SELECT metric, region, 0, 86400.0, 604800.0 FROM ends UNION ALL SELECT metric, region, 1, 604800.0, 1209600.0 FROM ends UNION ALL SELECT metric, region, 2, 1209600.0, hi FROM ends WHERE hi > 1209600))""")
def e14_ticked_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same durations between a day, a week and two, and outside."""
    return ticked_histogram(_stacked(spark, sf_dir), ["metric", "region"], [86400, 604800, 1209600])
