"""Tables that change all at once or not at all.

A version is a small file that names the folders of its tables; its number is taken by creating that file, which
only one writer can do. Data is written before and checked as written, so a reader sees the old version or the new one, and a
writer who loses or fails leaves no version. A table is made of parts, one folder each, so that what belongs to one
run is replaced without touching what belongs to others. The shared file system must refuse to create a file twice,
as HDFS and local ones do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow import scratch
from folioflow.operators.lifecycle import set_hash
from folioflow.operators.tables import check_rows, guarded_update

#: Rows of a set of targets, whose sorted keys are hashed as one text.
MOST_TARGETS = 1_000_000


class Refused(RuntimeError):
    """Nothing was changed."""


class Lost(Refused):
    """Another writer took the next version."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Of each table, the folder of each part.
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    runs: tuple[str, ...] = ()


class Store:
    """Versions of some tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> Version:
        """The greatest version that was made."""
        folder = self._path("versions")
        numbers = [int(f.getPath().getName()) for f in self.files.listStatus(folder)] if self.files.exists(folder) else []
        if not numbers:
            return Version()
        text = self.spark.read.text(f"{self.path}/versions/{max(numbers):012d}", wholetext=True).first()[0]
        found = json.loads(text)
        return Version(found["number"], found["tables"], tuple(found["runs"]))

    def read(self, version: Version, table: str) -> DataFrame:
        return self.spark.read.parquet(*version.tables[table].values())

    def commit(self, base: Version, parts: dict[tuple[str, str], DataFrame], run: str | None = None, check: Callable[[Version], DataFrame] | None = None) -> Version:
        """The version after ``base`` with these ``(table, part)`` written anew; the rest is ``base``'s.

        ``check`` gets the version as written and gives check rows; one that blocks and fails refuses it.
        """
        tables = {t: dict(own) for t, own in base.tables.items()}
        written = []
        try:
            for (name, part), rows in parts.items():
                written.append(scratch.fresh(self.spark, name).replace(scratch.folder(self.spark), self.path, 1))
                rows.write.parquet(written[-1])
                tables.setdefault(name, {})[part] = written[-1]
            after = Version(base.number + 1, tables, base.runs if run is None or run in base.runs else (*base.runs, run))
            if check is not None:
                failed = [r.check_key for r in check(after).filter("severity = 'blocking' AND NOT coalesce(passed, false)").select("check_key").collect()]
                if failed:
                    raise Refused(f"checks failed: {', '.join(sorted(failed))}")
            self._take(after)
        except BaseException:
            for path in written:
                scratch.delete(self.spark, path)
            raise
        return after

    def _take(self, version: Version) -> None:
        text = json.dumps({"number": version.number, "tables": version.tables, "runs": version.runs})
        target = self._path(f"versions/{version.number:012d}")
        try:
            out = self.files.create(target, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or self.files.exists(target):
                raise Lost(f"version {version.number} exists") from None
            raise
        out.write(bytearray(text.encode()))
        out.close()


def target_hash(rows: DataFrame, key: str) -> str:
    """The sha256 of the sorted keys, joined by line feeds."""
    n = rows.limit(MOST_TARGETS + 1).count()
    if n > MOST_TARGETS:
        raise Refused(f"more than {MOST_TARGETS} targets: hash them in parts (lifecycle.folded_hash)")
    return rows.agg(set_hash(key).alias("h")).first().h


def event_rows(rows: DataFrame, run: str, kind: str, key: str, payload: Column) -> DataFrame:
    """One event for each row: its key, which tells a repeat, its run, kind and payload."""
    named = F.sha2(F.concat_ws("\n", F.lit(run), F.lit(kind), F.col(key).cast("string")), 256)
    return rows.select(named.alias("event_key"), F.lit(run).alias("run_id"), F.lit(kind).alias("event_type"), F.col(key).cast("string").alias("target"), payload.alias("payload"))


def apply_reviewed(store: Store, run: str, table: str, key: str, targets: DataFrame, expected_hash: str, column: str, before: str, after: str, checks: list[tuple[str, str, Column, int]] = ()) -> Version:
    """``column`` goes from ``before`` to ``after`` in all ``targets``, with one event for each, or nothing changes.

    Refused if the targets that are ``before`` aren't the reviewed set any more, if another writer was first, or if a blocking check of
    the written table fails. A run that was applied already changes nothing.
    """
    base = store.current()
    if run in base.runs:
        return base
    rows = store.read(base, table)
    open_rows = rows.join(targets.select(key).distinct(), key, "left_semi").filter(F.col(column) == before)
    if target_hash(open_rows, key) != expected_hash:
        raise Refused("the targets are not those that were reviewed")
    payload = F.to_json(F.struct(F.lit(after).alias("after"), F.lit(before).alias("before"), F.col(key).alias("target")))
    changed = guarded_update(rows, targets, [key], column, before, after)
    events = event_rows(open_rows, run, f"{column}-{after}", key, payload)
    check = (lambda v: check_rows(store.read(v, table), list(checks))) if checks else None
    return store.commit(base, {(table, ""): changed, ("events", run): events}, run, check)


def recompute(store: Store, run: str, table: str, rows: DataFrame, kind: str, details: Callable[[int], dict]) -> Version:
    """Replace what ``table`` has of a known run by ``rows``, with one event; other runs stay as they are."""
    base = store.current()
    if run not in base.runs:
        raise Refused(f"unknown run {run}")
    staged = scratch.stage(rows.withColumn("run_id", F.lit(run)), "run")
    event = store.spark.createDataFrame([(run, json.dumps(details(staged.count()), sort_keys=True))], "target string, payload string")
    return store.commit(base, {(table, run): staged, ("events", f"{run}/{kind}"): event_rows(event, run, kind, "target", F.col("payload"))})
