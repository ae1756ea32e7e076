"""What a reader is shown: progress in words, the daily goal, the phase, and the index of a book.

Labels are fixed values of the reading application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.operators.progress import WORDS_A_MINUTE

DEFAULT_PART, DEFAULT_CHAPTER, FALLBACK = "Conteúdo", "Trechos", "Trecho "
PART_OPENING, CHAPTER_OPENING = "Abertura da parte", "Abertura do capítulo"
#: Words of a section and minutes a day, where a reader's own are not known.
SECTION_WORDS, PACE_MINUTES = 500, 10


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def percent(current: Column, total: Column) -> Column:
    """Sections before the current one in percent; 0 without progress or sections."""
    return F.when(current.isNull() | (F.coalesce(total, F.lit(0)) == 0), 0).otherwise(_rounded((current - 1) / total * 100)).cast("long")


def reading_time(words: Column) -> Column:
    minutes = F.ceil(F.coalesce(words, F.lit(0)) / WORDS_A_MINUTE)
    return F.when(minutes < 1, "< 1 min").otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def finish_date(current: Column, total: Column, mode: Column, minutes: Column, deadline: Column, as_of: Column) -> Column:
    """When the book will be done: the deadline of a reader who has one, else by sections a day; null when it is done, or nothing is known."""
    left = total - current + 1
    a_day = F.greatest(F.lit(1), _rounded(F.coalesce(F.nullif(minutes, F.lit(0)), F.lit(PACE_MINUTES)) * WORDS_A_MINUTE / SECTION_WORDS))
    counted = F.date_add(as_of, F.ceil(left / a_day).cast("int"))
    return F.when((F.coalesce(total, F.lit(0)) == 0) | (left <= 0), None).when((mode == "deadline") & deadline.isNotNull(), deadline).otherwise(counted)


def reaches_goal(mode: Column, pace_minutes: Column, minutes_today: Column, session_seconds: Column, acknowledged: Column) -> Column:
    """Whether today's minutes and this session's seconds reach a goal in minutes that the reader has not yet been told of."""
    goal = F.coalesce(pace_minutes, F.lit(0))
    seconds = F.coalesce(minutes_today, F.lit(0.0)) * 60 + F.coalesce(session_seconds, F.lit(0))
    return F.coalesce(~F.coalesce(acknowledged, F.lit(False)) & (mode == "minutes") & (goal > 0) & (seconds >= goal * 60), F.lit(False))


def phase(book_completed: Column, goal_reached: Column, acknowledged: Column) -> Column:
    """A complete book comes before a reached goal, which is told once."""
    return F.when(book_completed, "book-complete").when(goal_reached & ~F.coalesce(acknowledged, F.lit(False)), "daily-goal-complete").otherwise("reading")


def _said(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def section_label(title: str = "title") -> Column:
    """The first of a section's names that fits its kind."""
    own = _said(title)
    opening = F.when(F.col("kind") == "part_intro", F.coalesce(own, F.lit(PART_OPENING))).when(F.col("kind") == "chapter_intro", F.coalesce(_said("chapter_title"), own, F.lit(CHAPTER_OPENING)))
    return F.coalesce(_said("section_title"), opening, own, F.concat(F.lit(FALLBACK), F.col("sec_position").cast("string")))


def book_index(sections: DataFrame) -> DataFrame:
    """``sections`` with their part and chapter, numbered as they are first seen in a book, and their own label.

    A row for each section: no part or chapter is gathered in one row. The windows have a row for each part and chapter of a book.
    """
    keyed = sections.withColumn("part", F.coalesce(_said("part_title"), F.lit(DEFAULT_PART))).withColumn("chapter", F.coalesce(_said("chapter_label"), _said("chapter_title"), F.lit(DEFAULT_CHAPTER)))
    first = F.struct("sec_position", F.coalesce("chapter_label", F.lit("")).alias("label"), _said("chapter_title").alias("own_title"))
    chapters = keyed.groupBy("book_id", "part", "chapter").agg(F.min(first).alias("first"))
    by_part = W.partitionBy("book_id", "part")
    chapters = chapters.withColumn("chapter_no", F.row_number().over(by_part.orderBy("first.sec_position"))).withColumn("part_first", F.min("first.sec_position").over(by_part))
    chapters = chapters.withColumn("part_no", F.dense_rank().over(W.partitionBy("book_id").orderBy("part_first")))
    named = chapters.select("book_id", "part", "chapter", "part_no", "chapter_no", F.col("first.label").alias("chapter_name"), F.coalesce("first.own_title", "chapter").alias("chapter_heading"))
    rows = keyed.join(named, ["book_id", "part", "chapter"])
    return rows.select(
        "book_id", "section_id", "sec_position", F.concat(F.lit("part-"), "part_no").alias("part_id"), "part", F.concat(F.lit("part-"), "part_no", F.lit("-chapter-"), "chapter_no").alias("chapter_id"),
        "chapter_name", "chapter_heading", section_label().alias("label"),
    )


def item_state(position: Column, viewed: Column, persisted: Column, completed: Column) -> Column:
    """How the index shows a section: where the reader looks, what is read, what isn't."""
    return F.when(position == viewed, "current").when(F.coalesce(completed, F.lit(False)) | (position < persisted), "read").otherwise("unread")
