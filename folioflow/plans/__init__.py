"""Queries over the input tables, by theme."""

from folioflow.plans import anchors, audits, checks, constraints, json_values, lines, pairs, progress, reading, rules, segments, structure  # noqa: F401
