"""Exact top-k by inner product with vector-approximation files.

Components become floor(64 * x). Each dimension's range over all vectors is cut into ``CELLS`` equal cells, and a
vector is approximated by its cells, a byte for each dimension. A query's product with the middle of the cells, more or
less half a cell times the query's absolute components, bounds its score.

1. The cells are scanned: for each query and block of vectors the k-th largest lower bound is found; the largest over all
   blocks is a floor that the k-th result can't fall below. A second scan keeps the vectors whose upper bound reaches it.
2. Of these, the ``FIRST`` with the largest bounds are read exactly for each query. Their k-th score is a better floor; only
   vectors whose bound reaches that are read too, so that the k-th result is certain.

Only cells are paired with queries; exact vectors are joined by vec_id, for what is left alone. Queries and
vectors both come in blocks of bounded size, joined by block numbers, so no task, no broadcast and no driver holds a
whole side. Block pairs are the work that an exact search of a query set against all rows has.

Defined results: a vector that is null, or has a null or non-finite component, takes no part, nor does a
row without a vec_id; components are 64-bit integers, the largest or least of which stands for what is beyond; products are
summed exactly in any case, and a score beyond 64 bits is given as the largest or least that fits; shorter vectors are filled
with zeros, so an empty one scores 0; rows with one vec_id count as one row, with the least of their vectors; equal
scores rank by vec_id; a query with fewer than k candidates has them all; an empty table gives an empty result; vectors
may have any number of components; further columns, of any names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch

K = 20
CELLS = 64
VECTORS = 8192
QUERIES = 512
SCALE = 64
#: Vectors of a query that are read first.
FIRST = 60


def integer_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, v array<long>)`` of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    known = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False)))
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros up to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    low = high = None
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column("v"), width)
            low = m.min(0) if low is None else np.minimum(low, m.min(0))
            high = m.max(0) if high is None else np.maximum(high, m.max(0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])


def _blocks(block: str, rows: int):
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-rows // {"v": VECTORS, "q": QUERIES}[block])))).cast("int")


def _pack_vectors(table: pa.Table, low: np.ndarray, step: np.ndarray) -> pa.Table:
    m = _matrix(table.column("v").combine_chunks(), len(low))
    cells = np.clip(((m - low) / step).astype(np.int64), 0, CELLS - 1).astype(np.uint8)
    ids = table.column("vec_id").to_numpy().astype("<i8")
    return pa.table({"vb": pa.array([table.column("vb")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary())})


def _pack_queries(table: pa.Table, width: int) -> pa.Table:
    m = _matrix(table.column("v").combine_chunks(), width)
    floors = table.column("floor").to_numpy().astype("<f8") if "floor" in table.column_names else np.zeros(0)
    ids = table.column("vec_id").to_numpy().astype("<i8")
    return pa.table({"qb": pa.array([table.column("qb")[0].as_py()], pa.int32()), "q_ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([m.astype("<i8").tobytes()], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary())})


def _bounds(row: dict, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, queries, vector ids, the middles' products (query x vector) and half the bounds' width by query."""
    d = len(low)
    q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    q = np.frombuffer(row["q"], "<i8").reshape(len(q_ids), d)
    middle = low + (np.frombuffer(row["cells"], np.uint8).reshape(len(ids), d) + 0.5) * step
    products = q.astype(np.float64) @ middle.T
    # A cell's values are within half a step of its middle; the rest is for rounding.
    half = np.abs(q).astype(np.float64) @ (step / 2 + 1e-6) + 1e-6 * (1 + np.abs(q).astype(np.float64) @ (np.abs(low) + step * CELLS))
    products[q_ids[:, None] == ids[None, :]] = -np.inf
    return q_ids, q, ids, products, half


def _floors(batches: Iterator[pa.RecordBatch], low: np.ndarray, step: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, _, ids, products, half = _bounds(row, low, step)
            kth = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k] - half if len(ids) >= k else np.full(len(q_ids), -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(kth)], ["vec_id", "floor"])


def _survivors(batches: Iterator[pa.RecordBatch], low: np.ndarray, step: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs whose upper bound reaches the query's floor."""
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, _, ids, products, half = _bounds(row, low, step)
            upper = products + half[:, None]
            i, j = np.nonzero((upper >= np.frombuffer(row["floors"], "<f8")[:, None]) & (upper > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(upper[i, j])], ["query_id", "vec_id", "bound"])


def _scores(batches: Iterator[pa.RecordBatch], width: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Exact products; with integers of any length if 64 bits may not suffice."""
    kind, limits = (object, np.iinfo(np.int64)) if wide else (np.int64, None)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, y = (_matrix(part.column(c), width).astype(kind) for c in ("q", "v"))
            found = (x * y).sum(axis=1)
            if wide:
                found = np.array([min(max(s, limits.min), limits.max) for s in found], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vec_id"), pa.array(found, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both inputs are ``(vec_id, v array<long>)``, ids distinct."""
    with scratch.Room(vectors.sparkSession) as room:
        return scratch.stage(_top_k(vectors, queries, k, room), "nearest")


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, room: scratch.Room) -> DataFrame:
    scratch.send_code(vectors.sparkSession)
    spark = vectors.sparkSession
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = queries.count()
    if not seen.n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, seen.d)
    ranges = vectors.mapInArrow(lambda it: _ranges(it, width), "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    limits = ranges.orderBy("d").collect()  # a row for each dimension
    wide = sum(max(-r.low, r.high) ** 2 for r in limits) >= 1 << 62
    low = np.array([r.low for r in limits], np.float64)
    step = np.maximum(np.array([r.high for r in limits], np.float64) - low, 1.0) / CELLS * (1 + 1e-9)
    packed = vectors.withColumn("vb", _blocks("v", seen.n)).groupBy("vb").applyInArrow(lambda t: _pack_vectors(t, low, step), "vb int, ids binary, cells binary")
    packed = room.stage(packed, "cells")
    n_vb, n_qb = max(1, -(-seen.n // VECTORS)), max(1, -(-asked // QUERIES))
    numbered = queries.withColumn("qb", _blocks("q", asked))

    def query_blocks(rows: DataFrame) -> DataFrame:
        blocks = rows.groupBy("qb").applyInArrow(lambda t: _pack_queries(t, width), "qb int, q_ids binary, q binary, floors binary")
        return blocks.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_vb - 1))))

    def pairs(blocks: DataFrame) -> DataFrame:
        return packed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))).join(blocks, ["vb", "qb"])

    def scored(rows: DataFrame) -> DataFrame:
        both = rows.join(queries.toDF("query_id", "q"), "query_id").join(vectors, "vec_id").select("query_id", "vec_id", "q", "v")
        return both.mapInArrow(lambda it: _scores(it, width, wide), "query_id long, vec_id long, score long")

    floors = pairs(query_blocks(numbered)).mapInArrow(lambda it: _floors(it, low, step, k), "vec_id long, floor double")
    floors = room.stage(floors.groupBy("vec_id").agg(F.max("floor").alias("floor")), "floors")
    left = pairs(query_blocks(numbered.join(floors, "vec_id"))).mapInArrow(lambda it: _survivors(it, low, step), "query_id long, vec_id long, bound double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id"))
    left = room.stage(left.withColumn("place", place), "survivors")
    first = room.stage(scored(left.filter(F.col("place") <= max(FIRST, k))), "first-scores")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    certain = first.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").alias("least"))
    rest = left.filter(F.col("place") > max(FIRST, k)).join(certain, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    every = first.unionByName(scored(rest))
    return every.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scratch.stage(integer_vectors(scratch.table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
