"""Matching blocks of many pairs, and the best of very many titles."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioflow.functions.matching import Second, ratios
from folioflow.functions.similarity import folded_similarity, opening_ratio, word_order_ratio
from folioflow.functions.text import search_text
from folioflow.operators import anchors, linkage


def test_ratios_equal_difflib():
    rng = random.Random(4)
    made = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 40, 260]))))
    both = [(made(letters), made(letters)) for letters in ("ab", "abc é", "abcdefghij 0123") for _ in range(200)]
    assert ratios(*map(list, zip(*both, strict=True))).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in both]
    assert ratios([], []).tolist() == []


def test_first_scores_few_of_many_likely_pairs(monkeypatch):
    """Numbered names are all alike, so that bounds leave nearly every pair."""
    rng, scored, similarities = random.Random(7), [], linkage._similarities
    monkeypatch.setattr(linkage, "_similarities", lambda x, y: scored.append(len(x)) or similarities(x, y))
    lefts = [f"supplier {rng.randint(0, 14999):09d}" for _ in range(150)] + ["africa", "", "supplier"]
    rights = [f"supplier {k:09d}" for k in rng.sample(range(1000), 120)] + ["", "africa", "supplier of africa"]
    best, at = linkage._first(lefts, rights, 0.82)
    for k, x in enumerate(lefts):
        scores = [round(folded_similarity(x, y), 6) for y in rights]
        assert (best[k], at[k]) == ((max(scores), scores.index(max(scores))) if max(scores) >= 0.82 else (-1, -1))
    assert sum(scored) < len(lefts) * len(rights) / 5


def test_chunks_fit_blocks(spark):
    """Each of many small blocks is one piece of work; titles that fold alike are one, and each row gets its match."""
    rows = spark.range(4000).select((F.col("id") % 20).alias("block"), F.col("id").alias("a"), F.concat(F.lit("Título "), F.col("id") % 500).alias("a_title"))
    right = rows.select("block", F.col("a").alias("b"), F.upper("a_title").alias("b_title"), (-F.col("a")).alias("ord"))
    assert linkage._work(rows, right, "block", "a", "b").count() == 20
    got = {r.a: (r.b, r.score) for r in linkage.best_of_all(rows, right, "block").collect()}
    assert got == {a: (a % 500 + 3500, 1.0) for a in range(4000)}


def test_second_equals_difflib():
    """Short and long second sequences, of characters and words, with and without what is popular."""
    rng = random.Random(6)
    for letters in ("ab", "abc é", "abcdefghijklmnopqrstuvwxyz 0123", "aaaaaaaaaabbbbbbbbcdefgz "):
        for size in (0, 5, 199, 200, 500, 700):
            b = "".join(rng.choice(letters) for _ in range(size))
            for make in (str, lambda s: s.split()):
                second = Second(make(b))
                for _ in range(6):
                    a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
                    if size > 100 and rng.random() < 0.5:
                        a += b[40:70] + a[:5]
                    assert second.ratio(make(a)) == SequenceMatcher(None, make(a), make(b)).ratio()


def test_ratios_of_a_text_are_known_once(monkeypatch):
    made = []

    class Counted(Second):
        def __init__(self, b):
            made.append(len(b))
            super().__init__(b)

    monkeypatch.setattr(anchors, "Second", Counted)
    texts = [search_text(f"Livro {k} da montanha " * 40) for k in range(3)]
    titles = [search_text(f"Casa da montanha {k}") for k in range(20)]
    pairs = [(t, x) for x in texts for t in titles]
    got = anchors._ratios(*zip(*pairs, strict=True))
    assert got == [(word_order_ratio(t, x), opening_ratio(t, x)) for t, x in pairs] and len(made) == 6
