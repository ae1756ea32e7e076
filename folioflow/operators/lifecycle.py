"""Keys, fingerprints and outcomes of gated changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_key(label: str, fields: list[tuple[str, Column]]) -> Column:
    """SHA-256 of a label and of fields that carry their lengths, so that no two lists of fields read alike."""
    parts = [F.lit(label)]
    for name, value in fields:
        text = value.cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat_ws("\n", *parts), 256)


def set_hash(column: str) -> Column:
    """A hash of a set of keys, whatever their order (an aggregate; for target sets of bounded size)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), "\n"), 256)


def folded_hash(rows: DataFrame, group: str, key: str, size: int = 1000) -> DataFrame:
    """``(group, set_hash)`` of any number of integer keys: hashes of ``size`` keys, then of ``size`` of those, then of the rest."""
    level = rows.select(group, F.col(key).alias("part"), F.col(key).cast("string").alias("h"))
    for _ in range(2):
        level = level.groupBy(group, F.floor(F.col("part") / size).alias("next")).agg(_joined_hash("part", "h").alias("h")).withColumnRenamed("next", "part")
    return level.groupBy(group).agg(_joined_hash("part", "h").alias("set_hash"))


def _joined_hash(order: str, value: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n"), 256)


def row_hash(*columns: str) -> Column:
    """A hash of the named columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def drift(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def reconciled(applied: Column, ready: Column) -> Column:
    """Of a set of targets (an aggregate)."""
    return F.when(F.bool_and(applied), "all-applied").when(F.bool_and(ready), "all-ready").when(F.count(applied) < F.count("*"), "inconsistent").otherwise("partial")


def run_state(applied: Column, total: int) -> Column:
    """First run, complete repeat, or partial, by the number of applied targets (an aggregate)."""
    n = F.count_if(applied)
    return F.when(n == 0, "first-run").when(n == total, "complete-repeat").otherwise("partial")


def window_open(since: Column, now: Column, hours: int = 24) -> Column:
    """Whether the observation window has passed."""
    return F.unix_timestamp(now) - F.unix_timestamp(since) >= hours * 3600


def authorised(required: Column, roles: Column, *flags: Column) -> Column:
    """All required roles are there, and all flags hold."""
    out = F.size(F.array_except(required, roles)) == 0
    for f in flags:
        out = out & F.coalesce(f, F.lit(False))
    return out


#: Fixed values of the audit of reviewed boundaries.
REVIEWED_LABEL = "sha256-v1-length-delimited-reviewed-boundary-event-key"
REVIEWED_EVENT = "reading-segment-reviewed-boundary."
REVIEWED_TABLE, REVIEWED_VERSION = "content_staging.reading_segments", "1.0.0"
REVIEWED_STATUSES = {"status-advanced": ("boundary-review", "content-review"), "status-rollback": ("content-review", "boundary-review")}
REVIEWED_KEY = ("package_id", "event_action", "run_id", "decision_id", "book_id", "segment_key", "event_version")
REVIEWED_DETAILS = (
    "package_id", "package_version", "event_version", "event_action", "decision_id", "run_id", "book_id", "segment_key", "previous_approval_status",
    "resulting_approval_status", "target_table", "target_identity", "authority_manifest_hash", "package_hash",
)


def reviewed_event_key() -> Column:
    """The key of a reviewed event from its own columns, each with its length."""
    parts = [F.concat(F.lit(f"|{name}="), F.length(F.col(name).cast("string")).cast("string"), F.lit(":"), F.col(name).cast("string")) for name in REVIEWED_KEY]
    return F.sha2(F.concat(F.lit(REVIEWED_LABEL), *parts), 256)


def contract_violations() -> Column:
    """Names of what a reviewed event breaks, by name and comma-joined: its columns, its recomputed key, and each of its details.

    ``details`` is JSON; a detail that is absent or null breaks its rule.
    """
    said = lambda name: F.get_json_object("details", f"$.{name}")
    same = {name: said(name) == F.col(name).cast("string") for name in ("package_id", "event_version", "event_action", "decision_id", "run_id", "book_id", "segment_key")}
    hashes = {name: said(name).rlike("^[a-f0-9]{64}$") for name in ("authority_manifest_hash", "package_hash")}
    before, after = said("previous_approval_status"), said("resulting_approval_status")
    statuses = F.lit(False)
    for action, (one, two) in REVIEWED_STATUSES.items():
        statuses = statuses | ((F.col("event_action") == action) & (before == one) & (after == two))
    identity = F.get_json_object("details", "$.target_identity")
    whole = F.map_from_entries(F.array(*(F.struct(F.lit(name), F.col(name).cast("string")) for name in ("run_id", "book_id", "segment_key"))))
    rules = same | hashes | {
        "package_version": said("package_version") == REVIEWED_VERSION, "target_table": said("target_table") == REVIEWED_TABLE, "statuses": statuses,
        "target_identity": F.coalesce(F.map_entries(F.from_json(identity, "map<string,string>")), F.array()) == F.map_entries(whole),
        "event_key": F.col("event_key") == reviewed_event_key(), "event_type": F.col("event_type") == F.concat(F.lit(REVIEWED_EVENT), "event_action"), "segment_key_form": F.col("segment_key").rlike("^[a-f0-9]{20,64}$"),
        "event_version_number": F.col("event_version") == 1, "event_action_known": F.col("event_action").isin(*REVIEWED_STATUSES),
    }
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]
    return F.concat_ws(",", *broken)
