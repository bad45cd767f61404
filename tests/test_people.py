"""Bots of three origins, users of one login, and who counts as a participant."""

from tidewake.operators.people import bot_logins, participants, users_of


def test_bots_of_three_origins(spark):
    extra = spark.createDataFrame([("x",), ("both",), (None,)], "login string")
    owned = spark.createDataFrame([(1, "mine"), (1, "both"), (2, "theirs"), (1, None)], "account int, login string")
    users = spark.createDataFrame([(1, 10, "member"), (2, 11, "far"), (1, 12, None), (1, 13, "human")], "account int, id long, login string")
    team = spark.createDataFrame([(10,), (10,), (11,), (12,), (99,)], "id long")
    got = sorted(r.login for r in bot_logins(extra, owned, team, users, [1]).collect())
    assert got == ["both", "member", "mine", "x"]


def test_users_of_a_login_by_kind(spark):
    users = spark.createDataFrame([(1, 1, "a", "USER"), (1, 2, "a", "BOT"), (1, 3, "a", "OTHER"), (1, 5, "a", "BOT"), (2, 6, "a", "BOT"), (1, 7, "b", None), (1, 8, None, "USER"), (1, 9, "c", "USER")], "account int, id long, login string, kind string")
    logins = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "login string")
    got = sorted((r.login, r.place, r.id) for r in users_of(users, logins, [1]).collect())
    assert got == [("a", 1, 2), ("a", 2, 5), ("a", 3, 1), ("a", 4, 3), ("b", 1, 7)]


def test_participants_are_distinct_people(spark):
    roles = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "bot"), (1, None), (2, "bot"), (3, None)], "node_id long, login string")
    bots = spark.createDataFrame([("bot",), ("other",)], "login string")
    assert {r.node_id: r.participants for r in participants(roles, bots).collect()} == {1: 2, 2: 0, 3: 0}
    assert {r.node_id: r.participants for r in participants(roles, bots.where("false")).collect()} == {1: 3, 2: 1, 3: 0}
