"""People matched by their names."""

from tidewake.operators import identities
from tidewake.operators.identities import match_identities


def matched(spark, ours, theirs, known=None):
    side = lambda names: spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "id long, name string")
    pairs = None if known is None else spark.createDataFrame(known, "our long, their long")
    return {(r.our, r.their): r.confidence for r in match_identities(side(ours), side(theirs), pairs).collect()}


def test_order_accents_and_letters(spark):
    got = matched(spark, ["Ana Pérez", "Bo Larsen", "Chi Wu", "Dan", None, "--"], ["perez, ana", "Bo Larson", "Dan Brown", "Zed", ""])
    assert got[1, 1] == 1.0 and 0.5 <= got[2, 2] < 0.8 and set(got) <= {(1, 1), (2, 2), (4, 3)}


def test_each_is_the_others_best(spark):
    got = matched(spark, ["Kim Lee", "Kim Lee", "Kim Leek"], ["Kim Lee", "Kim Lee Park"])
    assert got[1, 1] == 1.0 and all(our != 2 for our, _ in got) and len({t for _, t in got}) == len(got)


def test_known_people_take_no_part(spark):
    assert set(matched(spark, ["Kim Lee", "Kim Lee"], ["Kim Lee", "Kim Lee"], [(1, 1)])) == {(2, 2)}
    assert matched(spark, [], ["Kim"]) == {} == matched(spark, ["Kim"], ["Ro"])


def test_common_parts_look_up_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(identities, "COMMON", 1)
    got = matched(spark, ["Kim Lee", "Kim Park", "Kim"], ["Lee Kim", "Park Kim", "Kim"])
    assert got == {(1, 1): got[1, 1], (2, 2): got[2, 2], (3, 3): 1.0} and got[1, 1] == 1.0
