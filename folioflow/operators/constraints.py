"""Constraints as data, and evidence that they held.

All row rules of a table are compiled into one scan of it; uniqueness is one grouping, a reference one join without its
matches. As in SQL a condition that is null holds. ``check_rows`` gives counts, ``violations`` the rows or keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SEVERITIES = ("blocking", "warning", "info")


@dataclass(frozen=True)
class Check:
    """``condition`` holds of each row, where ``where`` does."""

    key: str
    table: str
    condition: str
    where: str = "true"
    severity: str = "blocking"


def complete(key: str, table: str, when: str, columns: Iterable[str], severity: str = "blocking") -> Check:
    """None of ``columns`` is null in rows where ``when`` holds."""
    return Check(key, table, " AND ".join(f"{c} IS NOT NULL" for c in columns), when, severity)


@dataclass(frozen=True)
class Unique:
    """No two rows have the same values; counts the values that several have. Nulls differ from each other."""

    key: str
    table: str
    columns: tuple[str, ...]
    where: str = "true"
    severity: str = "blocking"


@dataclass(frozen=True)
class AtLeast:
    """Each value of ``columns`` has ``least`` rows with a ``counted`` at least; counts the values that haven't."""

    key: str
    table: str
    columns: tuple[str, ...]
    counted: str
    least: int
    where: str = "true"
    severity: str = "blocking"


@dataclass(frozen=True)
class Reference:
    """Each row's ``columns`` are those of a row of ``other``; rows with a null refer to nothing."""

    key: str
    table: str
    columns: tuple[str, ...]
    other: str
    others: tuple[str, ...]
    where: str = "true"
    severity: str = "blocking"


@dataclass(frozen=True)
class Agrees:
    """``condition`` over a row and the row of ``other`` that it refers to, whose columns are named with ``o_``.

    With ``alone``, rows that refer to none are looked at too, with nulls; ``other`` has one row for each key.
    """

    key: str
    table: str
    columns: tuple[str, ...]
    other: str
    others: tuple[str, ...]
    condition: str
    alone: bool = False
    where: str = "true"
    severity: str = "blocking"


@dataclass(frozen=True)
class Count:
    """How many rows there are; never fails."""

    key: str
    table: str
    where: str = "true"
    severity: str = "info"


Rule = Check | Unique | AtLeast | Reference | Agrees | Count


def _broken(rule: Check) -> Column:
    return F.expr(f"({rule.where}) AND NOT coalesce({rule.condition}, true)")


def violations(tables: dict[str, DataFrame], rule: Rule) -> DataFrame:
    """The rows that break a rule; for keys, the values with their count."""
    rows = tables[rule.table]
    if isinstance(rule, Check):
        return rows.filter(_broken(rule))
    rows = rows.filter(rule.where)
    match rule:
        case Unique():
            return rows.dropna(subset=list(rule.columns)).groupBy(*rule.columns).agg(F.count("*").alias("n")).filter("n > 1")
        case AtLeast():
            return rows.groupBy(*rule.columns).agg(F.count(rule.counted).alias("n")).filter(F.col("n") < rule.least)
        case Reference():
            keys = tables[rule.other].select(*(F.col(c).alias(f"o_{c}") for c in rule.others)).distinct()
            on = [F.col(a) == F.col(f"o_{b}") for a, b in zip(rule.columns, rule.others, strict=True)]
            return rows.dropna(subset=list(rule.columns)).join(keys, on, "left_anti")
        case Agrees():
            other = tables[rule.other].select(*(F.col(c).alias(f"o_{c}") for c in tables[rule.other].columns))
            on = [F.col(a) == F.col(f"o_{b}") for a, b in zip(rule.columns, rule.others, strict=True)]
            return rows.join(other, on, "left" if rule.alone else "inner").filter(f"NOT coalesce({rule.condition}, true)").select(*rows.columns)
    return rows


def check_rows(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """``(check_key, severity, passed, expected_value, actual_value)`` of all rules; a count expects nothing."""
    parts = []
    for name in dict.fromkeys(r.table for r in rules):
        own = [r for r in rules if r.table == name and isinstance(r, (Check, Count))]
        if own:
            counted = (_broken(r) if isinstance(r, Check) else F.expr(r.where) for r in own)
            once = tables[name].agg(*(F.count_if(c).alias(f"v{k}") for k, c in enumerate(counted)))
            parts.append(once.select(F.inline(F.array(*(_row(r, F.col(f"v{k}")) for k, r in enumerate(own))))))
    parts += [violations(tables, r).agg(F.count("*").alias("n")).select(F.inline(F.array(_row(r, F.col("n"))))) for r in rules if not isinstance(r, (Check, Count))]
    return reduce(DataFrame.unionByName, parts)


def _row(rule: Rule, actual: Column) -> Column:
    free = isinstance(rule, Count)
    return F.struct(
        F.lit(rule.key).alias("check_key"), F.lit(rule.severity).alias("severity"), (F.lit(True) if free else actual == 0).alias("passed"),
        F.lit(None if free else "0").cast("string").alias("expected_value"), actual.cast("string").alias("actual_value"),
    )


def evidence_errors(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``(check_key, problem)``: how exported check rows differ from ``expected(check_key, expected_value)``.

    Each key is there once, blocks, passed, and has the value that is expected, if one is. Keys are trimmed.
    """
    said = rows.withColumn("check_key", F.trim("check_key"))
    wanted = expected.select(F.trim("check_key").alias("check_key"), F.col("expected_value").alias("wanted"))
    problem = lambda frame, name: frame.select("check_key", F.lit(name).alias("problem"))
    known = said.join(wanted, "check_key")
    found = [
        problem(wanted.join(said, "check_key", "left_anti"), "missing"), problem(said.join(wanted, "check_key", "left_anti"), "unexpected"),
        problem(said.groupBy("check_key").count().filter("count > 1"), "duplicate"), problem(said.filter("coalesce(trim(severity), '') <> 'blocking'"), "not-blocking"),
        problem(said.filter("NOT coalesce(passed, false)"), "not-passed"), problem(known.filter("wanted IS NOT NULL AND NOT coalesce(actual_value = wanted, false)"), "wrong-value"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def candidate_evidence(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """What ``candidates(decision_id, score, selected, same_page)`` say for each of ``decisions(decision_id)``.

    Their number, the strongest score with the number of its ties, whether all, some or none have a score, why none can be selected,
    and the confidence. Scores are grouped before decisions, so that a decision with very many candidates is spread over its scores.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    levels = candidates.withColumn("score", score).groupBy("decision_id", "score").agg(F.count("*").alias("n"), F.count_if(F.coalesce("selected", F.lit(False))).alias("chosen"), F.count_if(F.coalesce("same_page", F.lit(False))).alias("same"))
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", "n"))).alias("best")
    found = levels.groupBy("decision_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)).alias("scored"), F.sum("chosen").alias("chosen"), F.sum("same").alias("same"), best)
    rows = decisions.select("decision_id").distinct().join(found, "decision_id", "left")
    none, ties = F.col("n").isNull(), F.coalesce("best.n", F.lit(0))
    available = F.when(none, "no-candidates").when(F.col("scored") == F.col("n"), "all-scores-available").when(F.col("scored") > 0, "partial-scores-available").otherwise("scores-unavailable")
    reason = (
        F.when(none, "no candidate records exist in inspected candidate sources").when(F.col("chosen") == 0, "candidate records exist but none is adjudication-selected")
        .when(ties > 1, "candidate records include a tied strongest score").otherwise("candidate evidence remains insufficient to authorize a deterministic outcome")
    )
    return rows.select(
        "decision_id", F.coalesce("n", F.lit(0)).alias("candidates"), F.coalesce("chosen", F.lit(0)).alias("selected"), available.alias("availability"), F.col("best.score").alias("strongest"), ties.alias("ties"),
        reason.alias("reason"), F.when(none, None).when((F.col("n") == 1) | (F.col("same") == F.col("n")), "high").otherwise("medium").alias("confidence"),
    )
