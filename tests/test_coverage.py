"""Lines that have many of a title's words: against plain Python, and without a shuffle of lines."""

import random

import pytest

from folioflow.operators import coverage
from folioflow.plans import lines


@pytest.mark.parametrize(("titles_at_once", "cells"), [(1 << 14, 1 << 20), (3, 7)])
def test_covered_lines(spark, monkeypatch, titles_at_once, cells):
    monkeypatch.setattr(coverage, "TITLES", titles_at_once)
    monkeypatch.setattr(coverage, "CELLS", cells)
    rng = random.Random(2)
    some = lambda most: [rng.choice("abcdefgh") for _ in range(rng.randint(0, most))]
    docs = [(f"d{k}", [sorted(set(some(9))) for _ in range(rng.randint(0, 6))]) for k in range(40)] + [("none", None), ("blank", [[]])]
    titles = [(k, t) for k in range(11) if (t := some(6))] + [(50, ["zz"]), (51, ["a", "zz", "zz"])]
    want = []
    for item, t in titles:
        for doc, found in docs:
            for k, words in enumerate(found or []):
                hits = sum(w in words for w in t)
                if hits and hits >= 0.5 * len(t):
                    want.append((item, doc, k, hits, len(t), len({*t} & {*words}), len({*t}), len(words)))
    got = coverage.covered_lines(spark.createDataFrame(docs, "doc_id string, found array<array<string>>"), spark.createDataFrame(titles, "item_id long, expected array<string>"), 0.5)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert coverage.covered_lines(spark.createDataFrame(docs, "doc_id string, found array<array<string>>"), spark.createDataFrame([], "item_id long, expected array<string>"), 0.5).count() == 0


def test_anchors_shuffle_no_lines(spark, data, monkeypatch):
    """What is shuffled has a row for each anchor, not one for each line or word; anchors sent in parts give the same rows."""
    plan = lines.anchor_pairs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    whole = sorted(map(tuple, lines.ordered_anchors(spark, data).collect()))
    monkeypatch.setattr(lines, "ANCHORS", 5)
    assert whole and sorted(map(tuple, lines.ordered_anchors(spark, data).collect())) == whole
    read = lines.ordered_anchors(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in read.split("BroadcastExchange")[0]
    tokens = lambda text: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    title = {r.item_id: tokens(r.title) for r in lines.titles(spark, data).collect()}
    text = {(r.doc_id, r.line): tokens(r.text) for r in lines.lines(spark, data).collect()}
    place = {(r.item_id, r.doc_id): r.line for r in lines.anchor_pairs(spark, data).collect()}
    for item, doc, ordered in whole:
        at, hits = 0, 0
        for w in title[item]:
            if w in text[doc, place[item, doc]][at:]:
                at, hits = text[doc, place[item, doc]].index(w, at) + 1, hits + 1
        assert ordered == pytest.approx(hits / len(title[item]), abs=2e-6)
