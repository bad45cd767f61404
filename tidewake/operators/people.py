"""Bots, users by login, and the people of a request without bots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import facts, query
from ..sources.tables import table

#: Kinds of users in the order in which a login's several rows are listed.
USER_KINDS = ["BOT", "MANNEQUIN", "ORGANIZATION", "USER"]


def bot_logins(extra: DataFrame, owned: DataFrame, team: DataFrame, users: DataFrame, accounts: list[int]) -> DataFrame:
    """(login), distinct and not null: bots of everyone, bots of the accounts, and members of their team of bots.

    extra: (login); owned: (account, login); team: (id) of its members; users:
    (account, id, login). A member without a user in the accounts, or whose user
    has no login, gives nothing.
    """
    mine = F.col("account").isin(*accounts)
    members = users.where(mine).join(team.select("id"), "id", "left_semi")
    every = extra.select("login").unionByName(owned.where(mine).select("login")).unionByName(members.select("login"))
    return every.where("login is not null").distinct()


def users_of(users: DataFrame, logins: DataFrame, accounts: list[int]) -> DataFrame:
    """(login, place, id, kind, name, ...): the accounts' users of the logins; a login of several users has a row each, ``place`` from 1 by kind, then id.

    users: (account, id, login, kind, ...). Kinds outside ``USER_KINDS`` come last.
    """
    kinds = F.array(*[F.lit(k) for k in USER_KINDS])
    rank = F.coalesce(F.nullif(F.array_position(kinds, F.col("kind")), F.lit(0)), F.lit(len(USER_KINDS) + 1))
    found = users.where(F.col("account").isin(*accounts)).join(logins.select("login").where("login is not null").distinct(), "login", "left_semi")
    rest = [c for c in users.columns if c not in ("account", "login")]
    gathered = found.groupBy("login").agg(F.array_sort(F.collect_list(F.struct(rank.alias("tw_rank"), *rest))).alias("all"))
    return gathered.select("login", F.posexplode("all").alias("pos", "u")).select("login", (F.col("pos") + 1).alias("place"), *[F.col(f"u.{c}").alias(c) for c in rest])


def participants(roles: DataFrame, bots: DataFrame) -> DataFrame:
    """(node_id, participants): distinct people of all roles that aren't bots; 0 where all are.

    roles: (node_id, login), a row a role, null logins ignored. People are made
    distinct before they meet the bots, so a person's many roles are joined once.
    """
    people = roles.distinct()
    human = people.join(bots.select("login", F.lit(True).alias("tw_bot")), "login", "left")
    return human.groupBy("node_id").agg(F.count(F.when(F.col("tw_bot").isNull(), F.col("login"))).alias("participants"))


def _account() -> Column:
    return F.col("c_nationkey").cast("long")


def stand_in_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, id, login, kind, name) of customers: a tenth of them shares its login with another user, some have none."""
    login = F.when(F.col("c_custkey") % 29 != 0, F.concat(F.lit("u"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 10 == 9, 9).otherwise(0)).cast("string")))
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "BOT").when(F.col("c_mktsegment") == "FURNITURE", "MANNEQUIN").when(F.col("c_mktsegment") == "BUILDING", "ORGANIZATION").otherwise("USER")
    return table(spark, sf_dir, "customer").select(_account().alias("account"), F.col("c_custkey").alias("id"), login.alias("login"), kind.alias("kind"), F.col("c_name").alias("name"))


def stand_in_bots(spark: SparkSession, sf_dir: str, accounts: list[int]) -> DataFrame:
    """Bots of everyone: suppliers in debt; of an account: its users of kind BOT and even id; of the team: each eleventh id."""
    users = stand_in_users(spark, sf_dir)
    extra = table(spark, sf_dir, "supplier").where("s_acctbal < 500").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("login"))
    owned = users.where("kind = 'BOT' and id % 2 = 0").select("account", "login")
    return bot_logins(extra, owned, users.where("id % 11 = 4").select("id"), users, accounts)


_ACCOUNTS = list(range(0, 25, 2))
_PEOPLE = """users AS (SELECT c_nationkey AS account, c_custkey AS id, CASE WHEN c_custkey % 29 <> 0 THEN 'u' || (c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 9 ELSE 0 END) END AS login, CASE c_mktsegment WHEN 'MACHINERY' THEN 'BOT' WHEN 'FURNITURE' THEN 'MANNEQUIN' WHEN 'BUILDING' THEN 'ORGANIZATION' ELSE 'USER' END AS kind, c_name AS name FROM customer),
bots AS (SELECT DISTINCT login FROM (SELECT 'u' || s_suppkey AS login FROM supplier WHERE s_acctbal < 500 UNION ALL SELECT login FROM users WHERE account % 2 = 0 AND ((kind = 'BOT' AND id % 2 = 0) OR id % 11 = 4)) WHERE login IS NOT NULL)"""


@query("prs", "SELECT login FROM bots", _PEOPLE)
def v16_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins of bots, for the accounts of even number."""
    return stand_in_bots(spark, sf_dir, _ACCOUNTS)


@query("prs", "SELECT login, row_number() OVER (PARTITION BY login ORDER BY CASE kind WHEN 'BOT' THEN 1 WHEN 'MANNEQUIN' THEN 2 WHEN 'ORGANIZATION' THEN 3 ELSE 4 END, id) AS place, id, kind, name FROM users WHERE account % 2 = 0 AND login IN (SELECT 'u' || author FROM prs WHERE merged IS NOT NULL)", _PEOPLE)
def v16_users_by_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the users who wrote merged requests; a login's users of several kinds are all listed."""
    logins = facts(spark, sf_dir, "prs").where("merged is not null").select(F.concat(F.lit("u"), F.col("author").cast("string")).alias("login"))
    return users_of(stand_in_users(spark, sf_dir), logins, _ACCOUNTS).withColumn("place", F.col("place").cast("long"))


@query("prs", "SELECT node_id, count(DISTINCT login) FILTER (login NOT IN (SELECT login FROM bots)) AS participants FROM (SELECT o_orderkey AS node_id, 'u' || o_custkey AS login FROM orders UNION ALL SELECT o_orderkey, 'u' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate) GROUP BY 1", _PEOPLE)
def f03_participants_without_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a request in any role, once each and without bots: its author and who committed, commented or reviewed."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    login = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("login")
    others = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate").select(F.col("o_orderkey").alias("node_id"), login("l_suppkey"))
    return participants(orders.select(F.col("o_orderkey").alias("node_id"), login("o_custkey")).unionByName(others), stand_in_bots(spark, sf_dir, _ACCOUNTS))
