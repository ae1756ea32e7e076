"""Reading progress over ``events``: user, event_type as the book, one session a row.

Dates are parameters; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.operators.progress import minutes_per_day
from folioflow.operators.tables import insert_new, latest
from folioflow.scratch import table

AS_OF = "2024-01-20"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, user_id, book, section, read_at, seconds)``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("session_id"), "user_id", F.col("event_type").alias("book"), (F.col("event_id") % 50).alias("section"), F.to_date("ts").alias("read_at"), F.round(F.col("value") * 60).cast("long").alias("seconds"))


SESSIONS = "s AS (SELECT event_id AS session_id, user_id, event_type AS book, event_id % 50 AS section, CAST(ts AS DATE) AS read_at, CAST(round(value * 60) AS BIGINT) AS seconds FROM events)"


@query("minutes_per_day", f"WITH {SESSIONS} SELECT user_id, CAST(read_at AS VARCHAR) AS read_at, coalesce(CAST((10 * sum(seconds) + 30) // 60 AS DOUBLE) / 10, 0) AS minutes FROM s GROUP BY 1, 2")
def q_minutes_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes_per_day(sessions(spark, sf_dir).withColumnRenamed("seconds", "duration_s")).withColumn("read_at", F.col("read_at").cast("string"))


@query("session_dependencies", f"WITH {SESSIONS} SELECT book, count(*) AS sessions, count(DISTINCT user_id) AS users, count(DISTINCT section) AS sections, CAST(min(read_at) AS VARCHAR) AS first_date, CAST(max(read_at) AS VARCHAR) AS last_date FROM s GROUP BY book")
def session_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("book").agg(
        F.count("*").alias("sessions"), F.count_distinct("user_id").alias("users"), F.count_distinct("section").alias("sections"), F.min("read_at").cast("string").alias("first_date"), F.max("read_at").cast("string").alias("last_date")
    )


PROGRESS = "p AS (SELECT user_id, book, max(section) AS current_section, max(read_at) AS last_read FROM s GROUP BY 1, 2)"


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("user_id", "book").agg(F.max("section").alias("current_section"), F.max("read_at").alias("last_read"))


@query("progress_dependencies", f"WITH {SESSIONS}, {PROGRESS} SELECT book, count(*) AS readers, min(current_section) AS least, max(current_section) AS most, count(*) FILTER (WHERE current_section = 49) AS finished FROM p GROUP BY book")
def progress_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.col("current_section")
    return progress(spark, sf_dir).groupBy("book").agg(F.count("*").alias("readers"), F.min(section).alias("least"), F.max(section).alias("most"), F.count_if(section == 49).alias("finished"))


@query(
    "reading_window",
    f"""
    WITH {SESSIONS}, {PROGRESS}, t AS (SELECT DISTINCT book, section FROM s)
    SELECT user_id, book, section, rank FROM (
      SELECT p.user_id, p.book, t.section, CAST(row_number() OVER (PARTITION BY p.user_id, p.book ORDER BY t.section) AS INTEGER) AS rank
      FROM p JOIN t ON p.book = t.book AND t.section >= p.current_section) WHERE rank <= 15
    """,
)
def reading_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifteen sections of each reader, from the current one on."""
    known = sessions(spark, sf_dir).select("book", "section").distinct()
    ahead = progress(spark, sf_dir).join(known, "book").filter(F.col("section") >= F.col("current_section"))
    rank = F.row_number().over(W.partitionBy("user_id", "book").orderBy("section"))
    return ahead.withColumn("rank", rank).filter("rank <= 15").select("user_id", "book", "section", "rank")


@query(
    "upsert_latest",
    f"WITH {SESSIONS} SELECT user_id, book, session_id, section, seconds FROM s QUALIFY row_number() OVER (PARTITION BY user_id, book ORDER BY session_id DESC) = 1",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new rows as one table, the newest of each key."""
    rows = sessions(spark, sf_dir)
    old, new = rows.filter("session_id % 3 <> 0"), rows.filter("session_id % 3 = 0")
    return latest(old.unionByName(new), ["user_id", "book"], "session_id").select("user_id", "book", "session_id", "section", "seconds")


@query(
    "idempotent_insert",
    f"WITH {SESSIONS} SELECT user_id, CAST(read_at AS VARCHAR) AS read_at, min(session_id) AS session_id FROM s GROUP BY 1, 2",
)
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of which a part is stored already; each key is stored once."""
    keyed = sessions(spark, sf_dir).groupBy("user_id", "read_at").agg(F.min("session_id").alias("session_id"))
    return insert_new(keyed.filter("user_id % 2 = 0"), keyed, ["user_id", "read_at"]).withColumn("read_at", F.col("read_at").cast("string"))


@query(
    "reminder_targets",
    f"""
    WITH {SESSIONS} SELECT DISTINCT user_id FROM s WHERE user_id % 5 = 0 AND user_id NOT IN (SELECT user_id FROM s WHERE read_at = DATE '{AS_OF}')
    """,
)
def reminder_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers (every fifth user) who have not read on the day."""
    rows = sessions(spark, sf_dir)
    today = rows.filter(F.col("read_at") == F.lit(AS_OF).cast("date")).select("user_id")
    return rows.filter("user_id % 5 = 0").select("user_id").distinct().join(today, "user_id", "left_anti")


@query(
    "reading_totals",
    f"WITH {SESSIONS}, b AS (SELECT book, sum(seconds) AS seconds FROM s GROUP BY 1) SELECT book, CAST(seconds AS BIGINT) AS seconds, CAST(greatest(max(seconds) OVER (), 1) AS BIGINT) AS most, CAST(sum(seconds) OVER () AS BIGINT) AS total FROM b",
)
def reading_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = sessions(spark, sf_dir).groupBy("book").agg(F.sum("seconds").alias("seconds"))
    totals = books.agg(F.greatest(F.max("seconds"), F.lit(1)).alias("most"), F.sum("seconds").alias("total"))
    return books.join(F.broadcast(totals))  # one row


@query(
    "reading_streak",
    f"""
    WITH {SESSIONS}, d AS (SELECT DISTINCT user_id, read_at FROM s),
    g AS (SELECT user_id, read_at, date_diff('day', DATE '2024-01-01', read_at) - row_number() OVER (PARTITION BY user_id ORDER BY read_at) AS island FROM d),
    i AS (SELECT user_id, island, count(*) AS days FROM g GROUP BY 1, 2) SELECT user_id, max(days) AS longest FROM i GROUP BY 1
    """,
)
def reading_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of days; a design of this library."""
    days = sessions(spark, sf_dir).select("user_id", "read_at").distinct()
    island = F.date_diff("read_at", F.lit("2024-01-01").cast("date")) - F.row_number().over(W.partitionBy("user_id").orderBy("read_at"))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("days"))
    return runs.groupBy("user_id").agg(F.max("days").alias("longest"))
