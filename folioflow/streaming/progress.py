"""Progress over a stream of reading events: an addition, as structured streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as their files arrive in a folder."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(folder)


def daily_minutes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Minutes by user and day; a day leaves when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("value").alias("minutes")).select("user_id", F.to_date("window.start").alias("day"), "minutes")


def furthest(events: DataFrame) -> DataFrame:
    """The furthest section of each user and book so far; it never goes back, whatever order events come in."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        for batch in batches:
            best = max(best, int(batch["section"].max()))
        state.update((best,))
        yield pd.DataFrame({"user_id": [key[0]], "book": [key[1]], "current_section": [best]})

    rows = events.select("user_id", F.col("event_type").alias("book"), (F.col("event_id") % 50).alias("section"))
    return rows.groupBy("user_id", "book").applyInPandasWithState(step, "user_id long, book string, current_section long", "section long", "update", "NoTimeout")
