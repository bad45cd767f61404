"""Lists of both signs, label maps, first and last of several times, active repositories, and logical repositories of equal settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..functions.aggregates import strict_greatest
from ..sources.tables import table

#: Lists up to the first are written into the plan, up to the second broadcast; longer ones are joined.
INLINE, BROADCAST = 100, 100_000


def listed(rows: DataFrame, column: str, values: list, wanted: bool = True) -> DataFrame:
    """``rows`` whose column is among the values, or (``wanted`` false) is not; a null column is in neither, a None among the values is ignored."""
    values = list(dict.fromkeys(v for v in values if v is not None))
    known = rows.where(F.col(column).isNotNull())
    if len(values) <= INLINE:
        among = F.col(column).isin(*values)
        return known.where(among if wanted else ~among)
    told = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} {dict(rows.dtypes)[column]}")
    return known.join(F.broadcast(told) if len(values) <= BROADCAST else told, column, "left_semi" if wanted else "left_anti")


def labelled(labels: Column, having: dict[str, str], lacking: dict[str, str]) -> Column:
    """Whether a map of labels holds one of the pairs ``having`` (none asked: any map does) and none of ``lacking``; a null map is an empty one."""
    holds = lambda pairs: F.greatest(F.lit(False), F.lit(False), *[F.coalesce(labels[k] == v, F.lit(False)) for k, v in pairs.items()])
    return (holds(having) if having else F.lit(True)) & ~holds(lacking)


def upserted_labels(held: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, labels): ``held`` (name, labels: map of strings) with the latest change of each key put in.

    changes: (name, key, value, at), of equal ``at`` the greater value wins; those
    of an unknown name or a null key are left out. A null value is kept as such.
    """
    latest = changes.where("key is not null").groupBy("name", "key").agg(F.max(F.struct("at", "value")).alias("last"))
    new = latest.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("last.value").alias("value")))).alias("tw_new"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = held.join(new, "name", "left").withColumns({"labels": F.coalesce("labels", none), "tw_new": F.coalesce("tw_new", none)})
    kept = F.map_filter("labels", lambda k, _: ~F.map_contains_key("tw_new", k))
    return both.select("name", F.map_concat(kept, "tw_new").alias("labels"))


def active_repositories(activity: DataFrame, since: int, until: int, pending: DataFrame | None = None) -> DataFrame:
    """(repo, active): repositories with activity (repo, at) from ``since`` to before ``until``, and the others that ``pending`` (repo) names, as inactive."""
    found = activity.where((F.col("at") >= since) & (F.col("at") < until)).select("repo", F.lit(True).alias("active"))
    if pending is not None:
        found = found.unionByName(pending.select("repo", F.lit(False).alias("active")))
    return found.where("repo is not null").groupBy("repo").agg(F.bool_or("active").alias("active"))


def logical_duplicates(rows: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """``rows`` (repo, key, ...) where logical repositories of one root and equal settings count a key once, in the first of them by name.

    settings: (repo, root, ...), a row a logical repository, the other columns
    being its settings. Repositories without settings, and logical ones alone in
    theirs, keep all their rows. Null settings equal each other.
    """
    told = [c for c in settings.columns if c not in ("repo", "root")]
    group = F.sha2(F.to_json(F.struct("root", *told), {"ignoreNullFields": "false"}), 256)
    known = rows.join(settings.select("repo", group.alias("tw_group")), "repo", "left")
    own = F.coalesce("tw_group", F.col("repo"))
    first = known.groupBy(own.alias("tw_own"), key).agg(F.min("repo").alias("repo"))
    return known.withColumn("tw_own", own).join(first, ["tw_own", key, "repo"], "left_semi").drop("tw_own", "tw_group")


@query("prs", "SELECT node_id FROM prs WHERE author NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 1000 AND c_custkey % 3 = 0) AND label NOT IN ('1-URGENT', '5-LOW') AND grp IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_8')")
def q04_lists_of_both_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list that is wanted, a short and a long one that are not."""
    rows = listed(facts(spark, sf_dir, "prs").select("node_id", "author", "label", "grp"), "grp", [f"NATION_{k}" for k in (1, 3, 5, 8)])
    return listed(listed(rows, "label", ["1-URGENT", "5-LOW"], False), "author", list(range(0, 1000, 3)), False).select("node_id")


@query("prs", "SELECT node_id, greatest(released, closed) AS latest, CASE WHEN released IS NOT NULL AND closed IS NOT NULL THEN greatest(released, closed) END AS latest_if_both, least(first_review_request, first_comment) AS first_touch, strpos(label, '-') AS dash FROM prs")
def q19_first_and_last_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest and least that skip nulls, the greatest that doesn't, and a position in a text."""
    return facts(spark, sf_dir, "prs").select("node_id", F.greatest("released", "closed").alias("latest"), strict_greatest(F.col("released"), F.col("closed")).alias("latest_if_both"), F.least("first_review_request", "first_comment").alias("first_touch"), F.instr("label", "-").cast("long").alias("dash"))


@query("deployments", "SELECT event_id AS name, CAST(1 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS labels, CASE WHEN event_id % 6 = 0 THEN 'late' ELSE CAST(lines AS VARCHAR) END AS k FROM deployments WHERE (event_id % 6 = 0 OR lines IN (3, 14, 15) OR event_id % 4 = 0) AND NOT (event_id % 6 <> 0 AND lines = 15)")
def q24_labels_of_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels out of JSON, some changed and some added later, and deployments picked by pairs of key and value."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    held = rows.select(F.col("event_id").alias("name"), F.from_json("props", "map<string,string>").alias("labels"))
    change = lambda every, key, value, at: rows.where(F.col("event_id") % every == 0).select(F.col("event_id").alias("name"), F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(at).alias("at"))
    changes = change(6, "k", "early", 1).unionByName(change(6, "k", "late", 2)).unionByName(change(4, "stage", "final", 1))
    wanted = labelled(F.col("labels"), {"k": "3", "stage": "final"}, {"k": "15"}) | labelled(F.col("labels"), {"k": "14"}, {}) | labelled(F.col("labels"), {"k": "late"}, {})
    return upserted_labels(held, changes).where(wanted).select("name", F.size("labels").cast("long").alias("labels"), F.col("labels")["k"].alias("k"))


_REPO = "grp || '/' || label"


@query("prs", f"SELECT repo, bool_or(active) AS active FROM (SELECT {_REPO} AS repo, TRUE AS active FROM prs JOIN (SELECT o_orderkey AS active_one FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate = DATE '1996-01-02' UNION SELECT node_id FROM prs WHERE created // 86400 = 9497 OR closed // 86400 = 9497 OR released // 86400 = 9497) ON active_one = node_id UNION ALL SELECT {_REPO}, FALSE FROM prs WHERE created < 820627200 AND created >= 820022400 AND ((closed IS NULL OR closed >= 820627200) OR (merged IS NOT NULL AND released >= 820627200))) GROUP BY 1")
def v14_repositories_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with any activity on 1996-01-02, and idle ones with a request of the week before still open or unreleased."""
    rows = facts(spark, sf_dir, "prs").withColumn("repo", F.expr(_REPO))
    end = 820627200
    pending = rows.where((F.col("created") < end) & (F.col("created") >= end - 7 * 86400) & (F.col("closed").isNull() | (F.col("closed") >= end) | (F.col("merged").isNotNull() & (F.col("released") >= end))))
    return active_repositories(rows.select("repo", F.explode(F.transform("activity_days", lambda d: d * 86400)).alias("at")), end - 86400, end, pending)


@query("prs", "SELECT repo, count(*) AS prs FROM (SELECT CASE WHEN label IN ('1-URGENT', '2-HIGH') THEN grp || '/a' WHEN label = '5-LOW' THEN grp || '/b' ELSE grp || '/c' END AS repo, node_id FROM prs UNION ALL SELECT grp || '/b', node_id FROM prs WHERE label = '2-HIGH' AND ascii(right(grp, 1)) % 2 = 1 UNION ALL SELECT grp || '/c', node_id FROM prs WHERE label = '1-URGENT') GROUP BY 1")
def e10_logical_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of three logical repositories a root that overlap: a and b have equal settings in half of the roots, c has others everywhere."""
    prs = facts(spark, sf_dir, "prs").select("grp", "node_id", "label")
    parts = {"a": ["1-URGENT", "2-HIGH"], "b": ["5-LOW", "2-HIGH"], "c": ["3-MEDIUM", "4-NOT SPECIFIED", "1-URGENT"]}
    held = F.array_compact(F.array(*[F.when(F.col("label").isin(*labels), F.concat_ws("/", "grp", F.lit(name))) for name, labels in parts.items()]))
    rows = prs.select(F.explode(held).alias("repo"), "node_id")
    roots = table(spark, sf_dir, "nation").select(F.col("n_name").alias("root"))
    odd = F.ascii(F.right("root", F.lit(1))) % 2 == 1
    tag = F.when((F.col("part") == "a") | ((F.col("part") == "b") & ~odd), "v.*").otherwise(F.concat(F.lit("release-"), "part"))
    settings = roots.select("root", F.explode(F.array(*[F.lit(p) for p in parts])).alias("part")).select(F.concat_ws("/", "root", "part").alias("repo"), "root", tag.alias("tags"))
    return logical_duplicates(rows, settings, "node_id").groupBy("repo").agg(F.count("*").alias("prs"))
