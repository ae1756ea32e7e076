"""Sharding over fixed virtual slots (DataFrame and SQL functions only).

A record's virtual slot is a hash of its ``doc_id``, so it never moves. Bytes are summed by slot, and a
versioned table maps each slot to a shard. The map is all that is edited when shards are added or their
sizes drift apart; it has one row for each slot, so it is of fixed size whatever the input.

Defined results: a null text has no bytes (size 16, crc32 0); a null ``doc_id`` has a slot like any
other value; repeated rows each get a position of their own in their shard, ties in any order since such
rows are alike; a text of any length counts whole; an empty table gives an empty result and a map that deals slots round; columns of
the input that are named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch

SLOTS = 4096
SHARDS = 40
#: Rows that are numbered together, at most on average.
GROUP_ROWS = 50_000


def slot_of(column: str = "doc_id", n_slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n_slots)).cast("int")


def record_size():
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot of ``records(virtual_slot, size)``."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def balanced_map(sizes: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, version: int = 1) -> DataFrame:
    """Slot-to-shard map: the largest slot that is left goes to the shard with the fewest bytes.

    The fold is over one array of ``n_slots`` entries, a fixed number.
    """
    every = sizes.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    filled = every.join(F.broadcast(sizes), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    ordered = filled.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes"))).alias("slots"))
    folded = ordered.selectExpr(
        "slots",
        f"""aggregate(
            slots,
            named_struct('loads', array_repeat(0L, {n_shards}), 'shards', cast(array() as array<int>)),
            (acc, x) -> transform(
                array(cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)),
                b -> named_struct(
                    'loads', transform(acc.loads, (v, i) -> if(i = b, v + greatest(x.bytes, 1L), v)),
                    'shards', concat(acc.shards, array(b))
                )
            )[0]
        ).shards AS shards""",
    )
    return folded.selectExpr("inline(arrays_zip(slots.virtual_slot, slots.bytes, shards))").toDF("virtual_slot", "bytes", "shard").withColumn("map_version", F.lit(version))


def grown_map(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``current`` for one more shard: every shard gives slots, none takes any but the new one.

    Each shard gives its smallest slots until it is left with its share of the new mean.
    """
    known = current.drop("bytes").join(F.broadcast(sizes.select("virtual_slot", "bytes")), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    small_first = W.partitionBy("shard").orderBy("bytes", "virtual_slot")
    share = F.sum("bytes").over(W.partitionBy(F.lit(1))) / (n_shards + 1)
    spare = F.greatest(F.sum("bytes").over(W.partitionBy("shard")) - share, F.lit(0))
    goes = F.sum("bytes").over(small_first) <= spare
    return known.select("virtual_slot", "bytes", F.when(goes, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("map_version") + 1).alias("map_version"))


def drifted_map(current: DataFrame, sizes: DataFrame, n_shards: int = SHARDS, tolerance: float = 0.05) -> DataFrame:
    """The next version of ``current`` for sizes that have drifted apart: few slots move, no others.

    A shard beyond the mean by more than ``tolerance`` gives its largest slots that together don't exceed its surplus.
    The given slots, end to end, are laid along the room that shards below the mean have, and each goes where its middle
    falls. Both tables have a fixed number of rows, at most one for each slot.
    """
    all_rows = W.partitionBy(F.lit(1))
    known = current.drop("bytes").join(F.broadcast(sizes.select("virtual_slot", "bytes")), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    shards = sizes.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = shards.join(known.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").fillna(0).withColumn("mean", F.sum("load").over(all_rows) / n_shards)
    surplus = known.join(loads.filter(F.col("load") > F.col("mean") * (1 + tolerance)), "shard").withColumn("over", F.col("load") - F.col("mean")).filter("bytes > 0 AND bytes <= over")
    large_first = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    given = surplus.withColumn("sum", F.sum("bytes").over(large_first)).filter("sum <= over").select("virtual_slot", "bytes")
    given = given.withColumn("at", F.sum("bytes").over(all_rows.orderBy(F.desc("bytes"), "virtual_slot")) - F.col("bytes") / 2)
    takers = loads.filter("load < mean").withColumn("room", F.col("mean") - F.col("load")).withColumn("end", F.sum("room").over(all_rows.orderBy(F.desc("room"), "shard")))
    takers = takers.select(F.col("shard").alias("taker"), (F.col("end") - F.col("room")).alias("start"), "end")
    moves = given.join(F.broadcast(takers), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("virtual_slot", "taker")
    moved = known.join(F.broadcast(moves), "virtual_slot", "left")
    return moved.select("virtual_slot", "bytes", F.coalesce("taker", "shard").cast("int").alias("shard"), (F.col("map_version") + 1).alias("map_version"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map; versions are never rewritten."""
    slot_map.coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one unless told."""
    every = spark.read.schema("virtual_slot int, bytes long, shard int, map_version int").parquet(path)
    if version is None:
        return every.join(F.broadcast(every.agg(F.max("map_version").alias("map_version"))), "map_version", "left_semi")
    return every.filter(F.col("map_version") == version)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records(virtual_slot, ...)`` with shard and map_version. The map has a fixed number of rows, so it is broadcast."""
    return records.join(F.broadcast(slot_map.select("virtual_slot", "shard", "map_version")), "virtual_slot", "left")


def numbered(placed: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds ``slot``: the row's position in its shard, from 0 without gaps.

    Rows are numbered within parts of slots of about GROUP_ROWS rows; the parts' counts are summed by shard.
    """
    parts = max(1, -(-rows // (SLOTS * GROUP_ROWS)))
    cut = placed.withColumn("part_", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(parts)).cast("int"))
    counts = cut.groupBy("shard", "virtual_slot", "part_").agg(F.count("*").alias("n_"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "part_").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    ranked = cut.withColumn("rank_", F.row_number().over(W.partitionBy("virtual_slot", "part_").orderBy(*order)))
    return ranked.join(starts, ["virtual_slot", "part_"]).withColumn("slot", (F.col("start_") + F.col("rank_") - 1).cast("long")).drop("part_", "n_", "start_", "rank_")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``docs`` with virtual_slot, shard and map_version; sizes of shards are near equal."""
    spark = docs.sparkSession
    kept = docs.drop("virtual_slot", "shard", "map_version")
    sizes = scratch.stage(slot_sizes(docs.select(slot_of().alias("virtual_slot"), record_size().alias("size"))), "slots")
    path = scratch.fresh(spark, "slot-map")
    store_map(balanced_map(sizes, n_shards), path)
    return place(kept.withColumn("virtual_slot", slot_of()), stored_map(spark, path))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    records = scratch.stage(
        docs.select("doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), slot_of().alias("virtual_slot")), "records"
    )
    sizes = scratch.stage(slot_sizes(records), "slots")
    path = scratch.fresh(spark, "slot-map")
    store_map(balanced_map(sizes), path)
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    return numbered(place(records, stored_map(spark, path)), ["doc_id", "text_crc32", "size"], rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
