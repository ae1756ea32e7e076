"""Copy-on-write changes of tables, and checks of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow import scratch


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key: an upsert of the union of old and new rows."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def insert_new(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with those rows of ``batch`` whose key it lacks."""
    return stored.unionByName(batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def load_in_order(rows: DataFrame, path: str, order: list[str]) -> None:
    """Append rows to a table in order, so that each file holds a range of it."""
    rows.orderBy(*order).write.mode("append").parquet(path)


def guarded_update(rows: DataFrame, targets: DataFrame, keys: list[str], column: str, before: str, after: str) -> DataFrame:
    """``column`` becomes ``after`` in targets where it is ``before``."""
    marked = rows.join(targets.select(*keys).distinct().withColumn("target_", F.lit(True)), keys, "left")
    changed = F.col("target_").isNotNull() & (F.col(column) == before)
    return marked.withColumn(column, F.when(changed, F.lit(after)).otherwise(F.col(column))).drop("target_")


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    return expected.select(key).join(actual.select(key), key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        actual.select(key).join(expected.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))
    )


def check_rows(rows: DataFrame, checks: list[tuple[str, str, Column, int]]) -> DataFrame:
    """``(check_key, severity, expected, actual, passed)`` from (key, severity, aggregate, expected), in one pass."""
    once = rows.agg(*(value.cast("long").alias(f"v{k}") for k, (_, _, value, _) in enumerate(checks)))
    parts = [F.struct(F.lit(key).alias("check_key"), F.lit(severity).alias("severity"), F.lit(expected).cast("long").alias("expected"), F.col(f"v{k}").alias("actual")) for k, (key, severity, _, expected) in enumerate(checks)]
    return once.select(F.inline(F.array(*parts))).withColumn("passed", F.col("expected") == F.col("actual"))


def replace_snapshot(rows: DataFrame, checks: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its path, unless a blocking check fails.

    Readers are pointed to the returned path, so they see the whole change or none of it.
    """
    failed = [r.check_key for r in checks.filter("severity = 'blocking' AND NOT coalesce(passed, false)").select("check_key").collect()]
    if failed:
        raise ValueError(f"checks failed: {', '.join(sorted(failed))}")
    version = scratch.fresh(rows.sparkSession, "snapshot") if not path else path
    rows.write.parquet(version)
    return version
