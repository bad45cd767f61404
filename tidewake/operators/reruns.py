"""Check runs: suites split where runs were started again, and runs told apart that several requests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query

#: Seconds since a session's start from which a run opens the next one.
SESSION = 12 * 3600
#: Seconds that a check may start after its request was closed.
GRACE = 3600


def split_reruns(runs: DataFrame) -> DataFrame:
    """(event_id, suite, epoch, part, conclusion): the virtual suite of each run and what that suite concludes. runs: (event_id, suite, name, started, conclusion, suite_conclusion).

    From the newest run back, a name that the session has already opens the next
    epoch; within an epoch, a run 12 hours or more after its part's first run opens
    the next part. A suite that succeeded, or was neutral, takes a run's failure,
    else cancellation, else time-out as its own conclusion. Runs of a suite are few,
    so they are folded as one sorted array; runs without start come first.
    """
    run = F.struct(F.coalesce("started", F.lit(0).cast("long")).alias("started"), "event_id", "name", "conclusion", "suite_conclusion")
    rows = runs.groupBy("suite").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    back = F.aggregate(
        F.reverse("runs"), F.struct(F.lit(0).alias("epoch"), F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("out")),
        lambda s, r: _stepped(s, r["name"]), lambda s: F.reverse(s["out"]),
    )
    rows = rows.select("suite", F.arrays_zip("runs", back.alias("epoch")).alias("runs"))
    start = F.struct(F.lit(-1).alias("epoch"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("since"), F.array().cast("array<int>").alias("out"))
    parts = F.aggregate("runs", start, lambda s, r: _parted(s, r["epoch"], r["runs"]["started"]), lambda s: s["out"])
    each = rows.select("suite", F.explode(F.arrays_zip(F.col("runs.runs").alias("run"), F.col("runs.epoch").alias("epoch"), parts.alias("part"))).alias("x")).select("suite", "x.run.*", "x.epoch", "x.part")
    said = each.groupBy("suite", "epoch", "part").agg(*[F.bool_or(F.col("conclusion") == c).alias(c) for c in ("FAILURE", "CANCELLED", "TIMED_OUT")])
    worst = F.when(F.col("FAILURE"), "FAILURE").when(F.col("CANCELLED"), "CANCELLED").when(F.col("TIMED_OUT"), "TIMED_OUT")
    told = F.when(F.col("suite_conclusion").isin("SUCCESS", "NEUTRAL"), F.coalesce(worst, "suite_conclusion")).otherwise(F.col("suite_conclusion"))
    return each.drop("conclusion").join(said, ["suite", "epoch", "part"]).select("event_id", "suite", "epoch", "part", told.alias("conclusion"))


def _stepped(s, name):
    again = F.array_contains(s["names"], name)
    epoch = s["epoch"] + F.when(again, 1).otherwise(0)
    return F.struct(epoch.alias("epoch"), F.when(again, F.array(name)).otherwise(F.array_append(s["names"], name)).alias("names"), F.array_append(s["out"], epoch).alias("out"))


def _parted(s, epoch, started):
    new, late = s["epoch"] != epoch, started - s["since"] >= SESSION
    part = F.when(new, 0).when(late, s["part"] + 1).otherwise(s["part"])
    return F.struct(epoch.alias("epoch"), part.alias("part"), F.when(new | late, started).otherwise(s["since"]).alias("since"), F.array_append(s["out"], part).alias("out"))


def disambiguated(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """(run, pr): the one request of each run, or null. runs: (run, suite, started, author, pr), a row for each request that holds the run's commit; requests: (pr, author, created, closed, commits).

    The suite must start while the request is open, an hour of grace after. Of the
    requests left of a run with several rows, those by the run's author stay, and
    of them the one with the fewest commits, then the first created, then the least id.
    """
    first = runs.groupBy("suite").agg(F.min("started").alias("suite_started"))
    asked = requests.select("pr", F.col("author").alias("pr_author"), "created", "closed", "commits")
    rows = runs.join(first, "suite").join(asked, "pr", "left")
    inside = (F.col("suite_started") >= F.col("created")) & (F.col("closed").isNull() | (F.col("suite_started") < F.col("closed") + GRACE))
    rows = rows.select("run", F.when(inside, F.col("pr")).alias("pr"), (F.col("author") == F.col("pr_author")).alias("own"), "commits", "created").dropDuplicates(["run", "pr"])
    best = F.struct(F.col("commits").isNull().alias("unknown"), "commits", "created", "pr")
    told = rows.groupBy("run").agg(F.count("*").alias("n"), F.max("pr").alias("only"), F.min(F.when(F.col("own") & F.col("pr").isNotNull(), best)).alias("best"))
    return told.select("run", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("best.pr")).alias("pr"))


_SUITED = "suited AS (SELECT *, arg_max(conclusion, completed * 1000000 + event_id) OVER (PARTITION BY suite) AS suite_conclusion, row_number() OVER (PARTITION BY suite ORDER BY started DESC, event_id DESC) AS i FROM checks)"
_FOLDED = f"""{_SUITED},
fold(suite, i, epoch, names) AS (SELECT suite, i, 0, [name] FROM suited WHERE i = 1 UNION ALL SELECT o.suite, o.i, CASE WHEN list_contains(names, o.name) THEN epoch + 1 ELSE epoch END, CASE WHEN list_contains(names, o.name) THEN [o.name] ELSE list_append(names, o.name) END FROM fold f JOIN suited o ON o.suite = f.suite AND o.i = f.i + 1),
epochs AS (SELECT s.*, f.epoch, row_number() OVER (PARTITION BY s.suite, f.epoch ORDER BY s.i DESC) AS j FROM suited s JOIN fold f USING (suite, i)),
timed(suite, epoch, j, part, since) AS (SELECT suite, epoch, j, 0, started FROM epochs WHERE j = 1 UNION ALL SELECT e.suite, e.epoch, e.j, CASE WHEN e.started - since >= 43200 THEN part + 1 ELSE part END, CASE WHEN e.started - since >= 43200 THEN e.started ELSE since END FROM timed t JOIN epochs e ON e.suite = t.suite AND e.epoch = t.epoch AND e.j = t.j + 1)"""


def _suited(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = facts(spark, sf_dir, "checks")
    last = runs.groupBy("suite").agg(F.max_by("conclusion", F.struct("completed", "event_id")).alias("suite_conclusion"))
    return runs.join(last, "suite")


@query("checks", "SELECT event_id, suite, epoch, part, CASE WHEN suite_conclusion IN ('SUCCESS', 'NEUTRAL') THEN CASE WHEN bool_or(conclusion = 'FAILURE') OVER w THEN 'FAILURE' WHEN bool_or(conclusion = 'CANCELLED') OVER w THEN 'CANCELLED' ELSE suite_conclusion END ELSE suite_conclusion END AS conclusion FROM epochs JOIN timed USING (suite, epoch, j) WINDOW w AS (PARTITION BY suite, epoch, part)", _FOLDED)
def c22_split_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with its virtual suite, and the virtual suite's conclusion (before: that of the suite's last run)."""
    return split_reruns(_suited(spark, sf_dir))


_SHARED = """asked AS (SELECT pr, min(started) - 3600 AS created, CASE WHEN pr % 3 <> 0 THEN max(started) - 43200 END AS closed, pr % 4 AS author, count(DISTINCT commit) AS commits FROM checks WHERE pr IS NOT NULL GROUP BY pr),
held AS (SELECT DISTINCT commit, pr FROM checks WHERE pr IS NOT NULL),
pairs AS (SELECT c.event_id AS run, h.pr, c.event_id % 4 AS author, min(c.started) OVER (PARTITION BY c.suite) AS suite_started FROM checks c LEFT JOIN held h USING (commit)),
kept AS (SELECT DISTINCT run, CASE WHEN suite_started >= created AND (closed IS NULL OR suite_started < closed + 3600) THEN pr END AS pr, p.author FROM pairs p LEFT JOIN (SELECT pr, created, closed FROM asked) USING (pr)),
counted AS (SELECT k.*, count(*) OVER (PARTITION BY run) AS n, a.created, a.commits, a.author = k.author AS own FROM kept k LEFT JOIN asked a USING (pr))"""


@query("checks", "SELECT run, CASE WHEN max(n) = 1 THEN max(pr) ELSE (min(ROW(commits, created, pr)) FILTER (own AND pr IS NOT NULL))[3] END AS pr FROM counted GROUP BY run", _SHARED)
def c23_runs_to_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of each check run, where a commit lies in several: by life, author and size."""
    runs = facts(spark, sf_dir, "checks")
    mapped = runs.where("pr is not null")
    asked = mapped.groupBy("pr").agg((F.min("started") - 3600).alias("created"), F.when(F.col("pr") % 3 != 0, F.max("started") - 43200).alias("closed"), F.countDistinct("commit").alias("commits")).withColumn("author", F.col("pr") % 4)
    held = mapped.select("commit", "pr").distinct()
    pairs = runs.select(F.col("event_id").alias("run"), "suite", "started", (F.col("event_id") % 4).alias("author"), "commit").join(held, "commit", "left")
    return disambiguated(pairs, asked)
