"""Each rule of valence in context by a case worked out by hand."""

import math

import pytest

from threadloom.operators import valence

GOOD, BAD = 2.0, -1.5


def unit(s):
    return s / math.sqrt(s * s + 15)


CASES = {
    "good": GOOD,
    "(good), bad.": GOOD + BAD,
    "not good": GOOD * -0.74,
    "never was it good": GOOD * -0.74,
    "not that it was good": GOOD,  # four words off
    "very good": GOOD + 0.293,
    "very bad": BAD - 0.293,
    "hardly good": GOOD - 0.293,
    "so a good": GOOD + 0.293 * 0.95,
    "so a b good": GOOD + 0.293 * 0.9,
    "not so good": (GOOD + 0.293) * -0.74,
    "so not good": GOOD * -0.74 + 0.293 * 0.95,
    "it is GOOD": GOOD + 0.733,
    "it is BAD": BAD - 0.733,
    "GOOD": GOOD,  # all in capitals
    "VERY good": GOOD + 0.293 + 0.733,
    "good but bad": GOOD * 0.5 + BAD * 1.5,
    "good!!": GOOD + 2 * 0.292,
    "bad!!!!!!": BAD - 4 * 0.292,
    "good?": GOOD,
    "good??": GOOD + 2 * 0.18,
    "good?????": GOOD + 0.96,
    "Can't be good": GOOD * -0.74,
}


def test_rules(spark):
    words = spark.createDataFrame([("good", GOOD), ("bad", BAD)], "word string, valence double")
    rows = spark.createDataFrame([*CASES.items(), ("nothing here", None), (None, None), ("", None), (" !! ", None)], "body string, want double")
    rows = rows.selectExpr("body as key", "body", "want")
    got = {r.key: r.score for r in valence.scores(rows.select("key", "body"), words).collect()}
    assert set(got) == set(CASES)
    for body, want in CASES.items():
        assert got[body] == pytest.approx(unit(want)), body
    none = valence.Context((), (), (), "zzz")
    got = {r.key: r.score for r in valence.scores(rows.select("key", "body"), words, none).collect()}
    assert got["not so good"] == pytest.approx(unit(GOOD)) and got["good but bad"] == pytest.approx(unit(GOOD + BAD))
