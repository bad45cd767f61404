"""Which match applies to a repository, and what notifications resolve to."""

from tidewake.operators.matching import AROUND, applied_matches, pushed_releases, tagged_releases

SETTINGS = "repo long, match string, tag_rule string, branch_rule string, event_rule string"
NAMED = "repo long, sha long, name string, published long, author long"


def settings_of(spark, *rows):
    return spark.createDataFrame([(r, m, "v.*", "main", "v[0-4]") for r, m in rows], SETTINGS)


def test_tags_count_within_four_weeks_around(spark):
    since, until = 100_000_000, 101_000_000
    at = {1: since - AROUND, 2: since - AROUND - 1, 3: until + AROUND - 1, 4: until + AROUND, 5: since}
    tagged = spark.createDataFrame([(r, r, "v", t, 0) for r, t in at.items()] + [(8, 8, "v", since, 0), (5, 9, "v", since, 0)], NAMED)
    kinds = [(r, "tag_or_branch") for r in range(1, 7)] + [(7, "tag"), (8, "branch"), (9, "event")]
    got = {r.repo: r.applied for r in applied_matches(settings_of(spark, *kinds), tagged, since, until).collect()}
    assert got == {1: "tag", 2: "branch", 3: "tag", 4: "branch", 5: "tag", 6: "branch", 7: "tag", 8: "branch", 9: "event"}


def test_tags_match_in_full(spark):
    rows = spark.createDataFrame([(1, 1, "v1", 5, 0), (1, 2, "xv1", 5, 0), (1, 3, None, 5, 0), (2, 4, "v2", 5, 0)], "repo long, sha long, tag string, published long, author long")
    got = tagged_releases(rows, settings_of(spark, (1, "tag"))).collect()
    assert [(r.sha, r.name) for r in got] == [(1, "v1")]


def test_notifications_resolve_by_short_or_whole_hash(spark):
    commits = spark.createDataFrame([(1, 10, "aaaaaaa111"), (1, 11, "aaaaaaa222"), (1, 12, "bbbbbbb333"), (2, 13, "bbbbbbb333")], "repo long, sha long, hash string")
    notes = [(1, "aaaaaaa", "v1", 5, 7), (1, "aaaaaaa222", "v1.5", 6, None), (1, "aaaaaaa999", "v1", 6, 7), (1, "bbbbbbb", "v9", 6, 7), (1, "bbbbbbb", None, 6, 7), (1, "bbbbbbb", "v3", 10, 7), (1, "bbbbbbb", "v3", 10, 7), (1, "bbbbbbb", "v3", 11, 7), (3, "bbbbbbb", "v3", 6, 7), (1, None, "v3", 6, 7)]
    rows = spark.createDataFrame(notes, "repo long, hash string, name string, published long, author long")
    got = sorted((r.repo, r.sha, r.name, r.published, r.author) for r in pushed_releases(rows, commits, settings_of(spark, (1, "event"), (2, "event")), 5, 10).collect())
    assert got == [(1, 10, "v1", 5, 7), (1, 11, "v1.5", 6, None), (1, 12, "v3", 10, 7), (1, 12, "v3", 10, 7)]


def test_empty_tables(spark):
    none = settings_of(spark).where("false")
    tagged = spark.createDataFrame([], NAMED)
    assert applied_matches(none, tagged, 0, 1).count() == 0
    assert pushed_releases(spark.createDataFrame([], "repo long, hash string, name string, published long, author long"), spark.createDataFrame([], "repo long, sha long, hash string"), none, 0, 1).count() == 0
