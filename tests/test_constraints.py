"""Each rule finds its one violation and no other; evidence and candidates against plain counts."""

import random
from collections import defaultdict

import pytest

from folioflow.operators import constraints as c

RULES = [
    c.Check("positive", "child", "amount > 0"),
    c.Check("small-when-open", "child", "amount < 100", "state = 'open'"),
    c.complete("closed-has-date", "child", "state = 'closed'", ["closed_at", "amount"]),
    c.Unique("child-id", "child", ("id",)),
    c.Unique("one-open", "child", ("parent", "slot"), "state = 'open'"),
    c.Reference("has-parent", "child", ("parent",), "parents", ("id",)),
    c.Agrees("same-book", "child", ("parent",), "parents", ("id",), "book = o_book"),
    c.Agrees("within", "child", ("parent",), "parents", ("id",), "amount <= coalesce(o_most, 1000)", alone=True),
    c.AtLeast("two-children", "child", ("parent",), "amount", 2, "state <> 'draft'"),
    c.Count("children", "child"),
]
CHILD = "id long, parent long, book long, slot long, state string, amount long, closed_at string"
GOOD = [(1, 10, 1, 1, "open", 5, None), (2, 10, 1, 2, "open", 7, None), (3, 11, 2, 1, "closed", 500, "d"), (4, 11, 2, 1, "closed", 9, "d"), (5, None, 3, None, "draft", None, None)]
BAD = {
    "positive": [(6, 10, 1, 9, "draft", 0, None)],
    "small-when-open": [(6, 10, 1, 9, "open", 100, None)],
    "closed-has-date": [(6, 10, 1, 9, "closed", 5, None)],
    "child-id": [(1, 10, 1, 9, "open", 5, None)],
    "one-open": [(6, 10, 1, 1, "open", 5, None)],
    "has-parent": [(6, 77, 1, 9, "open", 5, None), (7, 77, 1, 8, "open", 5, None)],
    "same-book": [(6, 10, 2, 9, "open", 5, None)],
    "within": [(6, 11, 2, 9, "closed", 501, "d")],
    "two-children": [(6, 12, 3, 9, "open", 5, None)],
}


def tables(spark, extra=()):
    return {"child": spark.createDataFrame([*GOOD, *extra], CHILD), "parents": spark.createDataFrame([(10, 1, None), (11, 2, 500), (12, 3, None)], "id long, book long, most long")}


@pytest.mark.parametrize("key", [None, *BAD])
def test_one_violation_each(spark, key):
    got = {r.check_key: r for r in c.check_rows(tables(spark, BAD.get(key, ())), RULES).collect()}
    assert set(got) == {r.key for r in RULES} and got["children"].passed and got["children"].actual_value == str(len(GOOD) + len(BAD.get(key, ())))
    assert [k for k, r in got.items() if not r.passed] == ([key] if key else [])
    if key:
        rule = next(r for r in RULES if r.key == key)
        assert c.violations(tables(spark, BAD[key]), rule).count() == int(got[key].actual_value) > 0


def test_evidence(spark):
    kinds = "check_key string, severity string, passed boolean, expected_value string, actual_value string"
    rows = [("a ", "blocking", True, "0", "0"), ("b", "warning", True, "0", "0"), ("c", "blocking", None, "0", "0"), ("d", "blocking", True, "0", "3"), ("e", "blocking", True, "0", "0"), ("e", "blocking", True, "0", "0"), ("x", "blocking", True, None, None)]
    expected = [("a", "0"), ("b", None), ("c", "0"), ("d", "0"), ("e", "0"), ("f", "0")]
    got = c.evidence_errors(spark.createDataFrame(rows, kinds), spark.createDataFrame(expected, "check_key string, expected_value string"))
    assert sorted(map(tuple, got.collect())) == [("b", "not-blocking"), ("c", "not-passed"), ("d", "wrong-value"), ("e", "duplicate"), ("f", "missing"), ("x", "unexpected")]
    nothing = c.evidence_errors(spark.createDataFrame([], kinds), spark.createDataFrame(expected[:1], "check_key string, expected_value string"))
    assert [tuple(r) for r in nothing.collect()] == [("a", "missing")]


def test_candidates(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice([None, float("nan"), 1.0, 2.0, 2.0]), rng.choice([None, True, False]), rng.random() < 0.7) for d in range(60) for _ in range(rng.randint(0, 4))]
    got = {r.decision_id: r for r in c.candidate_evidence(spark.createDataFrame([(d,) for d in range(62)], "decision_id long"), spark.createDataFrame(rows, "decision_id long, score double, selected boolean, same_page boolean")).collect()}
    own = defaultdict(list)
    for d, score, chosen, same in rows:
        own[d].append((score if score == score else None, bool(chosen), same))
    for d in range(62):
        r, mine = got[d], own[d]
        scores = [s for s, _, _ in mine if s is not None]
        assert (r.candidates, r.selected, r.strongest, r.ties) == (len(mine), sum(x for _, x, _ in mine), max(scores, default=None), scores.count(max(scores, default=None)))
        assert r.availability == ("no-candidates" if not mine else "all-scores-available" if len(scores) == len(mine) else "partial-scores-available" if scores else "scores-unavailable")
        assert r.confidence == (None if not mine else "high" if len(mine) == 1 or all(x for _, _, x in mine) else "medium")
