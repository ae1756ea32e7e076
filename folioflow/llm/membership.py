"""Which rows of a wide table have a key in a list of any length, without shuffling the wide rows next to the list.

The list's keys set bits of a bitmap of ``BITS`` bits, a fixed size, which is broadcast. A row whose bit is not set has
no key in the list. The more keys, the more rows have a bit by chance; for these there is an exact join, so that a full
bitmap costs time but no right result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow import scratch

#: 4 MB.
BITS = 1 << 25
#: Bits of a row, as ``bitmap_construct_agg`` makes them.
PER_ROW = 1 << 15
#: Bits of a bitmap for ``has`` at most (32 MB), bits of a part of it, and hashes that a task holds before it sends them.
MOST_BITS, PART_BITS, HELD = 1 << 28, 1 << 17, 1 << 20


def _slot(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITS))


def bitmap(keys: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """``(part_, bits_)``: at most BITS / PER_ROW rows of 4 kB."""
    slots = keys.select(_slot(F.col(column), seed).alias("slot"))
    return slots.groupBy(F.floor(F.col("slot") / PER_ROW).cast("int").alias("part_")).agg(F.bitmap_construct_agg(F.col("slot") % PER_ROW).alias("bits_"))


def marked(rows: DataFrame, column: str, bits: DataFrame, flag: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``flag``: whether the bit of ``column`` is set. ``rows`` have no columns ``part_`` and ``bits_``."""
    slot = _slot(F.col(column), seed)
    joined = rows.join(F.broadcast(bits), F.floor(slot / PER_ROW).cast("int") == F.col("part_"), "left")
    byte = F.conv(F.hex(F.substring("bits_", F.floor(slot % PER_ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(flag, F.coalesce(F.getbit(byte, slot % 8) == 1, F.lit(False))).drop("part_", "bits_")


def packed(rows: DataFrame, column: str) -> np.ndarray:
    """The bits of a column of hashes as BITS / 8 bytes, for ``has``; at most BITS / PER_ROW rows of 4 kB come to the driver."""
    slot = F.pmod(F.col(column), F.lit(BITS))
    found = rows.groupBy(F.floor(slot / PER_ROW).cast("int").alias("part")).agg(F.bitmap_construct_agg(slot % PER_ROW).alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part * PER_ROW // 8 : (part + 1) * PER_ROW // 8] = np.frombuffer(bits, np.uint8)
    return out


def _marks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part and the places in it."""

    def sent(held):
        slots = np.unique((np.concatenate(held).view(np.uint64) % np.uint64(bits)).astype(np.int64))
        parts, first = np.unique(slots // PART_BITS, return_index=True)
        places = np.split((slots % PART_BITS).astype(np.uint32), first[1:])
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([p.tobytes() for p in places], pa.binary())], ["part", "places"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        n += batch.num_rows
        if n >= HELD:
            yield sent(held)
            held, n = [], 0
    if n:
        yield sent(held)


def _merged(table: pa.Table) -> pa.Table:
    set_ = np.zeros(PART_BITS, bool)
    for places in table.column("places").to_pylist():
        set_[np.frombuffer(places, np.uint32)] = True
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(set_, bitorder="little").tobytes()], pa.binary())})


def sized(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """As ``packed``, with as many bits as asked, a power of two from PART_BITS to MOST_BITS; places go to their parts, not bitmaps."""
    marks = rows.select(column).mapInArrow(lambda it: _marks(it, bits), "part int, places binary")
    found = marks.groupBy("part").applyInArrow(_merged, "part int, bits binary").toArrow()  # bits / 8 bytes at most
    out = np.zeros((bits // PART_BITS, PART_BITS // 8), np.uint8)
    for part, some in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(some, np.uint8)
    return out.ravel()


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (64 bits, signed or not) have their bit in ``packed`` or ``sized`` ones."""
    slot = (hashes.view(np.uint64) % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone(gone_)``; a null key stays.

    A second bitmap has the keys that have a bit of ``gone`` by chance, found on keys alone. Only rows with a bit in
    both are joined exactly.
    """
    bits = scratch.stage(bitmap(gone, "gone_"), "gone-bits")
    keys = marked(docs.select(key.alias("key_")).filter("key_ IS NOT NULL"), "key_", bits, "maybe_").filter("maybe_")
    chance = scratch.stage(bitmap(keys.join(gone.hint("merge"), F.col("key_") == F.col("gone_"), "left_anti"), "key_", 1), "chance-bits")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key_"))
    told = marked(marked(rows, "key_", bits, "maybe_"), "key_", chance, "doubt_", 1)
    sure = told.filter("NOT maybe_ OR key_ IS NULL").select("row.*")
    open_rows = told.filter("maybe_ AND doubt_ AND key_ IS NOT NULL")
    return sure.unionByName(open_rows.join(gone.hint("merge"), F.col("key_") == F.col("gone_"), "left_anti").select("row.*"))
