"""Reading progress as functions of tables.

``progress(user_id, book_id, current_section, last_read_at, completed_at)``, ``sections(section_id, book_id, sec_position, word_count)``,
``sessions(user_id, book_id, section_id, read_at, duration_s)``. Dates are parameters; nothing reads the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Words a minute; without history a reader reads ten minutes a day.
WORDS_A_MINUTE = 200
DEFAULT_PACE = 10 * WORDS_A_MINUTE
WINDOW_DAYS = 7

ACCEPTED, UNAUTHORISED, NEGATIVE, FOREIGN, UNKNOWN = "accepted", "unauthorised", "negative_duration", "section_of_other_book", "no_progress"


def minutes(seconds: Column) -> Column:
    """Whole seconds as minutes with one digit, half up; no seconds are 0."""
    return F.coalesce(F.floor((seconds * 10 + 30) / 60) / 10, F.lit(0.0))


def minutes_per_day(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id", "read_at").agg(minutes(F.sum("duration_s")).alias("minutes"))


def running(rows: DataFrame, keys: list[str], piece: Column, order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with running values, named and given as (column, ``max`` or ``sum``), of each of ``keys`` in ``order``.

    ``piece`` never falls in that order. Values run within the pieces of a key, and over the totals of its pieces, so that a
    key with very many rows is spread over its pieces.
    """
    cut = rows.withColumn("piece_", piece)
    inside = W.partitionBy(*keys, "piece_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*keys).orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "piece_").agg(*(getattr(F, how)(column).alias(f"{name}_t") for name, (column, how) in values.items()))
    before = totals.select(*keys, "piece_", *(getattr(F, how)(f"{name}_t").over(earlier).alias(f"{name}_b") for name, (_, how) in values.items()))
    out = cut.select("*", *(getattr(F, how)(column).over(inside).alias(f"{name}_i") for name, (column, how) in values.items())).join(before, [*keys, "piece_"])
    for name, (_, how) in values.items():
        both = F.col(f"{name}_i"), F.col(f"{name}_b")
        whole = F.greatest(*both) if how == "max" else F.when(both[0].isNotNull() | both[1].isNotNull(), F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0)))
        out = out.withColumn(name, whole).drop(f"{name}_i", f"{name}_b")
    return out.drop("piece_")


@dataclass(frozen=True)
class Completions:
    """What a batch of events gives: its outcomes, the progress after it and the sessions that it adds."""

    outcomes: DataFrame
    progress: DataFrame
    sessions: DataFrame


def judged(progress: DataFrame, sections: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` with ``outcome``, the position of the section and whether it is the last of its book.

    Which events count doesn't depend on other events: a batch never makes a progress row.
    """
    last = sections.groupBy("book_id").agg(F.max("sec_position").alias("last_"))
    placed = sections.select("section_id", "book_id", "sec_position").join(last, "book_id")
    known = progress.select("user_id", "book_id", F.lit(True).alias("known_"))
    rows = events.join(placed, ["section_id", "book_id"], "left").join(known, ["user_id", "book_id"], "left")
    outcome = (
        F.when(F.col("caller").isNotNull() & (F.col("caller") != F.col("user_id")), UNAUTHORISED).when(F.col("duration_s") < 0, NEGATIVE)
        .when(F.col("sec_position").isNull(), FOREIGN).when(F.col("known_").isNull(), UNKNOWN).otherwise(ACCEPTED)
    )
    return rows.withColumn("outcome", outcome).withColumn("ends_book", F.col("sec_position") >= F.col("last_")).drop("last_", "known_")


def folded(accepted: DataFrame) -> DataFrame:
    """``(user_id, book_id, position, last_at, ended_at)``: what a batch does to a progress row.

    The greatest next position, the last time and the first time that an event ended the book: parts of a batch
    can be folded apart and in any order.
    """
    return accepted.groupBy("user_id", "book_id").agg(
        F.max(F.col("sec_position") + 1).alias("position"), F.max("at").alias("last_at"), F.min(F.when(F.col("ends_book"), F.col("at"))).alias("ended_at")
    )


def merged(progress: DataFrame, fold: DataFrame) -> DataFrame:
    """Progress after a fold: positions never go back, and the first completion stays."""
    rows = progress.join(fold, ["user_id", "book_id"], "left")
    ahead, last, done = F.greatest("current_section", "position"), F.greatest("last_read_at", "last_at"), F.coalesce("completed_at", "ended_at")
    return rows.withColumns({"current_section": ahead, "last_read_at": last, "completed_at": done}).select(*progress.columns)


def complete_sections(progress: DataFrame, sections: DataFrame, sessions: DataFrame, events: DataFrame) -> Completions:
    """Apply ``events(event_id, at, caller, user_id, book_id, section_id, duration_s, read_date)`` in order of ``at``, then ``event_id``.

    Each outcome has what the reader sees after its event: the next position, whether the section was the last of its book, and
    the minutes of its date in all books. A rejected event has its reason, no values and no effect. Null durations and
    0 seconds are sessions without a duration; a null caller is trusted.
    """
    rows = judged(progress, sections, events)
    good = rows.filter(F.col("outcome") == ACCEPTED).withColumn("seconds", F.nullif("duration_s", F.lit(0))).withColumn("next_", F.col("sec_position") + 1)
    good = running(good, ["user_id", "book_id"], F.to_date("at"), ["at", "event_id"], {"furthest": ("next_", "max")})
    good = running(good, ["user_id", "read_date"], F.date_trunc("hour", "at"), ["at", "event_id"], {"so_far": ("seconds", "sum")})
    stored = sessions.groupBy("user_id", F.col("read_at").alias("read_date")).agg(F.sum("duration_s").alias("stored"))
    good = good.join(progress.select("user_id", "book_id", "current_section"), ["user_id", "book_id"]).join(stored, ["user_id", "read_date"], "left")
    seen = minutes(F.when(F.col("stored").isNotNull() | F.col("so_far").isNotNull(), F.coalesce("stored", F.lit(0)) + F.coalesce("so_far", F.lit(0))))
    told = good.select("event_id", "outcome", F.greatest("current_section", "furthest").alias("next_position"), F.col("ends_book").alias("book_completed"), seen.alias("minutes_read_on_date"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in told.dtypes[2:]]
    outcomes = told.unionByName(rows.filter(F.col("outcome") != ACCEPTED).select("event_id", "outcome", *empty))
    accepted = rows.filter(F.col("outcome") == ACCEPTED)
    added = accepted.select("user_id", "book_id", "section_id", F.col("read_date").alias("read_at"), F.nullif("duration_s", F.lit(0)).alias("duration_s"))
    return Completions(outcomes, merged(progress, folded(accepted)), added)


def words_per_day(sessions: DataFrame, sections: DataFrame, as_of: str) -> DataFrame:
    """``(user_id, book_id, per_day)``: mean words of the days with sessions since seven days before ``as_of``, that day included.

    A section counts once for each of its sessions.
    """
    recent = sessions.filter(F.col("read_at") >= F.date_sub(F.lit(as_of).cast("date"), WINDOW_DAYS))
    read = recent.join(sections.select("section_id", "word_count"), "section_id")
    return read.groupBy("user_id", "book_id").agg((F.coalesce(F.sum("word_count"), F.lit(0)) / F.count_distinct("read_at")).alias("per_day"))


def words_remaining(progress: DataFrame, sections: DataFrame) -> DataFrame:
    """``(book_id, current_section, remaining)`` for each position that a reader of a book is at.

    Positions of readers are distinct first, so a book's window has its sections and at most as many positions again.
    """
    places = progress.select("book_id", F.coalesce("current_section", F.lit(1)).cast("long").alias("position"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("asked")).distinct()
    marks = sections.select("book_id", F.col("sec_position").cast("long").alias("position"), F.coalesce("word_count", F.lit(0)).cast("long").alias("words"), F.lit(False).alias("asked"))
    later = W.partitionBy("book_id").orderBy(F.desc("position")).rangeBetween(W.unboundedPreceding, W.currentRow)
    return places.unionByName(marks).withColumn("remaining", F.sum("words").over(later)).filter("asked").select("book_id", "position", "remaining")


def completion_estimate(progress: DataFrame, sessions: DataFrame, sections: DataFrame, as_of: str) -> DataFrame:
    """Words left from the current section on, pace, days, date and minutes; without history the default pace, with a pace of 0 no days."""
    rows = progress.select("user_id", "book_id", F.coalesce("current_section", F.lit(1)).cast("long").alias("position"))
    rows = rows.join(words_remaining(progress, sections), ["book_id", "position"]).join(words_per_day(sessions, sections, as_of), ["user_id", "book_id"], "left")
    pace = F.coalesce("per_day", F.lit(float(DEFAULT_PACE)))
    days = F.ceil(F.col("remaining") / F.nullif(pace, F.lit(0.0))).cast("long")
    return rows.select(
        "user_id", "book_id", F.col("remaining").alias("words_remaining"), pace.alias("avg_words_per_day"), days.alias("estimated_days"),
        F.date_add(F.lit(as_of).cast("date"), days.cast("int")).alias("estimated_date"), F.ceil(F.col("remaining") / WORDS_A_MINUTE).cast("long").alias("minutes_remaining"),
    )


def reader_state(progress: DataFrame, sessions: DataFrame, read_date: str) -> DataFrame:
    """Each progress row with its pace, the minutes of a date in all books, whether they reach the daily goal, and whether the book is done.

    Only a pace in minutes has a daily goal. ``progress`` has ``pace_mode``, ``pace_minutes`` and ``pace_deadline`` too.
    """
    today = sessions.filter(F.col("read_at") == F.lit(read_date).cast("date")).groupBy("user_id").agg(minutes(F.sum("duration_s")).alias("minutes_read_on_date"))
    rows = progress.join(today, "user_id", "left").withColumn("minutes_read_on_date", F.coalesce("minutes_read_on_date", F.lit(0.0)))
    goal = F.when((F.col("pace_mode") == "minutes") & F.col("pace_minutes").isNotNull(), F.col("minutes_read_on_date") >= F.col("pace_minutes")).otherwise(False)
    return rows.select(
        "user_id", "book_id", "current_section", "pace_mode", "pace_minutes", "pace_deadline", "minutes_read_on_date", goal.alias("daily_goal_reached"), F.col("completed_at").isNotNull().alias("book_completed")
    )
