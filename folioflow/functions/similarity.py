"""Similarities of titles and text windows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

from folioflow.functions.text import fold_title, search_text, significant_words


def jaccard(a, b) -> Column:
    """Of two arrays of tokens; 0 without any."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(expected, found) -> Column:
    """The share of expected tokens, repeats counted, that are found."""
    hits = F.size(F.filter(expected, lambda t: F.array_contains(found, t)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(F.lit(0.0))


def set_coverage(expected, found) -> Column:
    """As coverage, repeats not counted."""
    return coverage(F.array_distinct(expected), found)


def ordered_coverage(expected, found) -> Column:
    """The share of expected tokens that are found one after the other, each taken at its first place after the last."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"))

    def step(acc, token):
        place = F.array_position(F.slice(found, acc["at"] + 1, F.greatest(F.size(found) - acc["at"], F.lit(0))), token).cast("int")
        return F.when(place > 0, F.struct((acc["at"] + place).alias("at"), (acc["hits"] + 1).alias("hits"))).otherwise(acc)

    return F.when(F.size(expected) > 0, F.aggregate(expected, start, step)["hits"] / F.size(expected)).otherwise(F.lit(0.0))


def title_likeness(a: str | None, b: str | None) -> float:
    """0 if either folds to nothing, 1 if they fold alike, else the larger of token Jaccard and matching-block ratio."""
    return folded_similarity(fold_title(a), fold_title(b))


def folded_similarity(x: str, y: str) -> float:
    """``title_likeness`` of titles that are folded already."""
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    s, t = set(x.split()), set(y.split())
    return max(len(s & t) / len(s | t), SequenceMatcher(None, x, y).ratio())


def title_likeness_column(a, b) -> Column:
    """``title_likeness`` over two columns, in Arrow batches."""

    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([title_likeness(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(apply, "double")(a, b)


def uppercase_share(column) -> Column:
    letters = F.regexp_count(column, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(column, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def word_order_ratio(expected: str | None, found: str | None) -> float:
    """Matching blocks of significant words; 0 if either has none."""
    return ordered_ratio(significant_words(expected), significant_words(found))


def opening_ratio(expected: str | None, found: str | None) -> float:
    """Matching blocks of characters with the first 500, or five times the expected ones, of what is found."""
    return sequence_ratio(search_text(expected), search_text(found))


def ordered_ratio(a: list[str], b: list[str]) -> float:
    """``word_order_ratio`` of significant words."""
    return SequenceMatcher(None, a, b).ratio() if len(a) and len(b) else 0.0


def sequence_ratio(a: str, b: str) -> float:
    """``opening_ratio`` of normalised texts."""
    return SequenceMatcher(None, a, b[: max(500, 5 * len(a))]).ratio() if a and b else 0.0


def anchor_score(exact, covered, distinctive, ordered, sequence, bonus, proximity, penalty, n_lines) -> Column:
    """Of a block as the anchor of a title; blocks of more than eight lines count less."""
    return 8 * exact.cast("int") + 5 * covered + 2 * distinctive + 1.5 * ordered + sequence + bonus + proximity - penalty - 0.03 * F.greatest(F.lit(0), n_lines - 8)


def heading_score(exact, covered, ratio, n_lines) -> Column:
    """Of a window of lines as a heading."""
    return 4 * exact.cast("int") + 2 * covered + ratio - 0.04 * (n_lines - 1)


def title_window_score(exact, covered, set_covered, ratio, surplus, n_lines, exact_weight: int = 1) -> Column:
    """Of a window as a title; the stricter variant counts an exact one twice."""
    return exact_weight * exact.cast("int") + covered + set_covered + ratio - 0.03 * surplus - 0.01 * (n_lines - 1)


def successor_score(exact, covered, ratio, surplus, n_lines) -> Column:
    return 2 * exact.cast("int") + covered + ratio - 0.025 * surplus - 0.01 * (n_lines - 1)


def part_title_score(exact, covered, distance, n_lines) -> Column:
    return 4 + exact.cast("int") + covered + (1 - distance / 120) - 0.035 * (n_lines - 1)
