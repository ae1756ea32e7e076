"""Linking records by the similarity of their titles.

All pairs of a block are candidates. Both sides are cut into bounded chunks by a hash, and each pair of chunks is one row
of work. What a pair can score at most, by the longest common subsequence and the shared words of the folded titles,
is computed for a chunk at once; only pairs that can still count are scored. Where only the best right row of each left one
is asked for and titles alone count, titles that fold alike are looked for once.

Pairs are ordered by falling score, title score and label score, then by ``a``, ``ord`` and ``b``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions.matching import ratios
from folioflow.functions.similarity import folded_similarity, title_likeness
from folioflow.functions.text import fold_title, normalised
from folioflow.scratch import send_code, stage

MATCH, ASSIGN = 0.82, 0.58
#: Of title, label and division of a chapter.
WEIGHTS = (0.72, 0.18, 0.10)
LEFT_CHUNK, RIGHT_CHUNK = 256, 1024
#: Candidates of a left row that are scored one by one, the most likely first; then twice as many each time.
SINGLE = 4
#: Tasks for each core that chunks are dealt to.
WORK = 4
CODES = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}
#: Scores are compared after rounding to six digits.
ROUNDING = 1e-6


def title_bounds(lefts: list[str], rights: list[str]) -> np.ndarray:
    """By right and left row, what the similarity of two folded titles is at most."""
    masks = np.zeros((len(CODES) + 1, len(lefts)), np.uint64)
    for k, s in enumerate(lefts):
        for at, c in enumerate(s[:64]):
            masks[CODES[c], k] |= np.uint64(1 << at)
    sizes, long = np.array([len(s) for s in lefts]), np.array([len(s) > 64 for s in lefts])
    holders = defaultdict(list)
    for k, s in enumerate(lefts):
        for w in set(s.split()):
            holders[w].append(k)
    holders = {w: np.array(ks) for w, ks in holders.items()}
    counts = np.array([len(set(s.split())) for s in lefts])
    out = np.zeros((len(rights), len(lefts)))
    for start in range(0, len(rights), 64):
        part = rights[start : start + 64]
        codes = np.full((len(part), max(map(len, part), default=0)), len(CODES))
        for k, s in enumerate(part):
            codes[k, : len(s)] = [CODES[c] for c in s]
        v = np.full((len(part), len(lefts)), ~np.uint64(0))
        for at in range(codes.shape[1]):
            u = v & masks[codes[:, at]]
            v = (v + u) | (v - u)
        total = sizes + np.array([len(s) for s in part])[:, None]
        rows = 2.0 * np.bitwise_count(~v) / np.maximum(total, 1)
        rows[:, long] = 1.0
        for k, s in enumerate(part):
            words = set(s.split())
            shared = np.zeros(len(lefts))
            for w in words & holders.keys():
                shared[holders[w]] += 1
            rows[k] = np.maximum(rows[k], shared / np.maximum(counts + len(words) - shared, 1))
            rows[k, sizes == 0] = 0.0
            if not s:
                rows[k] = 0.0
        out[start : start + 64] = rows
    return out


def _division(a: str | None, b: str | None) -> float:
    return title_likeness(a, b) if a or b else 1.0


def _by_pair(function: Callable, lefts: list, rights: list) -> np.ndarray:
    known = {(x, y): function(x, y) for x in set(lefts) for y in set(rights)}
    return np.array([[known[x, y] for x in lefts] for y in rights])


def _scored(batches: Iterator[pa.RecordBatch], least: float, best: bool, weighted: bool, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pairs of each two chunks that score ``least`` or more, or the best of each left row."""
    for batch in batches:
        for row in batch.to_pylist():
            lefts, rights, found = row["lefts"], row["rights"], []
            x, y = [fold_title(r["a_title"]) for r in lefts], [fold_title(r["b_title"]) for r in rights]
            label = rest = np.zeros((len(rights), len(lefts)))
            if weighted:
                label = _by_pair(title_likeness, [r["a_label"] for r in lefts], [r["b_label"] for r in rights])
                rest = WEIGHTS[1] * label + WEIGHTS[2] * _by_pair(_division, [r["a_part"] for r in lefts], [r["b_part"] for r in rights])
            weight = WEIGHTS[0] if weighted else 1.0
            most = weight * title_bounds(x, y) + rest + ROUNDING
            for k, left in enumerate(lefts):
                top = None
                for j in np.argsort(-most[:, k], kind="stable"):
                    if most[j, k] < least or top and most[j, k] < top[-1]["score"]:
                        break
                    right, title = rights[j], folded_similarity(x[k], y[j])
                    score = round(float(weight * title + rest[j, k]), 6)
                    key = (-score, -title, -float(label[j, k]), left["a"], right["ord"], right["b"])
                    if score < least or right["held"] and key >= tuple(right["held"].values()):
                        continue
                    pair = {"block": row["block"], **left, **right, "score": score, "title_score": title, "label_score": float(label[j, k])}
                    if not best:
                        found.append(pair)
                    elif top is None or key < top[0]:
                        top = key, pair
                if top:
                    found.append(top[1])
            yield pa.RecordBatch.from_pylist([{n: p[n] for n in kinds.names} for p in found], kinds)


def _similarities(lefts: list[str], rights: list[str]) -> np.ndarray:
    """``folded_similarity`` of each two titles, rounded."""
    out = ratios(lefts, rights)
    for k, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        if not x or not y:
            out[k] = 0.0
        elif x != y:
            s, t = set(x.split()), set(y.split())
            out[k] = max(len(s & t) / len(s | t), out[k])
    return np.round(out, 6)


def _first(lefts: list[str], rights: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each left title the best score of ``least`` or more and the first right title that has it; -1 without any.

    A title is done when nothing that is left can score more, or as much and come first.
    """
    most = np.ascontiguousarray(np.round(title_bounds(lefts, rights), 6).T)
    most[most < least] = -1.0
    best, at = np.full(len(lefts), -1.0), np.full(len(lefts), -1)
    opened, rounds = np.arange(len(lefts)), 0
    while len(opened):
        rest = most[opened]
        place = rest.argmax(axis=1)
        top = rest[np.arange(len(opened)), place]
        live = (top >= 0) & ((top > best[opened]) | (top == best[opened]) & (place < at[opened]))
        opened, rest, place = opened[live], rest[live], place[live]
        if rounds < SINGLE:
            k, j = opened, place
        else:
            n = min(2 ** (rounds - SINGLE + 1), len(rights))
            chosen = np.argpartition(-rest, n - 1, axis=1)[:, :n]
            rows, columns = np.nonzero(np.take_along_axis(rest, chosen, 1) >= np.maximum(best[opened], 0)[:, None])
            k, j = opened[rows], chosen[rows, columns]
        rounds += 1
        scores = _similarities([lefts[x] for x in k], [rights[y] for y in j])
        most[k, j] = -1.0
        order = np.lexsort((j, -scores, k))
        k, j, scores = k[order], j[order], scores[order]
        head = np.flatnonzero(np.diff(k, prepend=-1))
        k, j, scores = k[head], j[head], scores[head]
        better = (scores >= least) & ((scores > best[k]) | (scores == best[k]) & (j < at[k]))
        best[k[better]], at[k[better]] = scores[better], j[better]
    return best, at


def _firsts(batches: Iterator[pa.RecordBatch], least: float, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rights = sorted(row["rights"], key=lambda r: (r["ord"], r["b"]))
            lefts = [r["folded"] for r in row["lefts"]]
            best, at = _first(lefts, [r["folded"] for r in rights], least)
            found = [{**rights[at[k]], "block": row["block"], "folded": lefts[k], "score": float(best[k])} for k in np.flatnonzero(at >= 0)]
            yield pa.RecordBatch.from_pylist([{n: p[n] for n in kinds.names} for p in found], kinds)


def _chunks(rows: DataFrame, key: str, size: int, block: str, name: str) -> DataFrame:
    """Rows of each block in as many chunks as it needs."""
    cuts = rows.groupBy(F.col(block).alias("block_")).agg(F.ceil(F.count("*") / size).alias("cuts_"))
    fields = F.struct(*(c for c in rows.columns if c != block))
    placed = rows.withColumn("row_", fields).join(cuts, F.col(block) == F.col("block_")).withColumn("chunk_", F.pmod(F.xxhash64(key), F.col("cuts_")))
    return placed.groupBy(F.col(block).alias("block"), "chunk_").agg(F.collect_list("row_").alias(name)).drop("chunk_")


def _work(left: DataFrame, right: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """``(block, lefts, rights)``: each two chunks of a block."""
    x, y = _chunks(left, a, LEFT_CHUNK, block, "lefts"), _chunks(right, b, RIGHT_CHUNK, block, "rights")
    return x.join(y, "block").select("block", "lefts", "rights").repartition(left.sparkSession.sparkContext.defaultParallelism * WORK)


def _kinds(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _key() -> Column:
    return F.struct((-F.col("score")).alias("score"), (-F.col("title_score")).alias("title"), (-F.col("label_score")).alias("label"), "a", "ord", "b")


def _search(left: DataFrame, right: DataFrame, block: str, least: float, best: bool, held: DataFrame | None = None) -> DataFrame:
    """Scored pairs; of the ``held(block, b, key)`` only those that come before what is held."""
    send_code(left.sparkSession)
    weighted = {"a_label", "a_part"} <= set(left.columns) and {"b_label", "b_part"} <= set(right.columns)
    a, b, ord_ = left.schema["a"].dataType.simpleString(), right.schema["b"].dataType.simpleString(), right.schema["ord"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<score:double,title:double,label:double,a:{a},ord:{ord_},b:{b}>")
    right = right.withColumn("held", none) if held is None else right.join(held.select(F.col("block").alias(block), "b", F.col("key").alias("held")), [block, "b"], "left")
    work = _work(left, right, block, "a", "b")
    kind = left.schema[block].dataType.simpleString()
    schema = f"block {kind}, a {a}, a_title string, b {b}, b_title string, ord {ord_}, score double, title_score double, label_score double"
    kinds = _kinds(left.sparkSession, schema)
    return work.mapInArrow(lambda it: _scored(it, least, best, weighted, kinds), schema)


def scored_pairs(left: DataFrame, right: DataFrame, block: str, least: float = 0.0) -> DataFrame:
    """``left(block, a, a_title)`` x ``right(block, b, b_title, ord)`` within blocks, all pairs with a score of ``least`` or more.

    With the columns ``a_label, a_part, b_label, b_part`` the score is that of title, label and division by ``WEIGHTS``.
    """
    return _search(left, right, block, least, False).withColumnRenamed("block", block)


def best_match(pairs: DataFrame, threshold: float = MATCH) -> DataFrame:
    """The best right row of each left row; the first in order on ties; none below the threshold."""
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "ord", "b"))
    return pairs.filter(F.col("score") >= threshold).withColumn("rank", rank).filter("rank = 1").drop("rank")


def best_of_all(left: DataFrame, right: DataFrame, block: str, threshold: float = MATCH) -> DataFrame:
    """``best_match`` of all pairs, without a table of them."""
    if {"a_label", "a_part"} <= set(left.columns) and {"b_label", "b_part"} <= set(right.columns):
        return best_match(_search(left, right, block, threshold, True), threshold).withColumnRenamed("block", block)
    send_code(left.sparkSession)
    named = stage(left.select(F.col(block).alias("block"), "a", "a_title", normalised(fold_title, "a_title").alias("folded")).filter("block IS NOT NULL"), "left-titles")
    heads = right.select(F.col(block).alias("block"), "b", "b_title", "ord", normalised(fold_title, "b_title").alias("folded")).filter("block IS NOT NULL")
    heads = heads.groupBy("block", "folded").agg(F.min(F.struct("ord", "b", "b_title")).alias("m")).select("block", "folded", "m.*")
    work = _work(named.select("block", "folded").distinct(), stage(heads, "right-titles"), "block", "folded", "folded")
    kind, b, ord_ = left.schema[block].dataType.simpleString(), right.schema["b"].dataType.simpleString(), right.schema["ord"].dataType.simpleString()
    schema = f"block {kind}, folded string, score double, ord {ord_}, b {b}, b_title string"
    kinds = _kinds(left.sparkSession, schema)
    found = work.mapInArrow(lambda it: _firsts(it, threshold, kinds), schema)
    first = found.groupBy("block", "folded").agg(F.min(F.struct((-F.col("score")).alias("less"), "ord", "b", "b_title")).alias("m"))
    first = stage(first.select("block", "folded", "m.b", "m.b_title", "m.ord", (-F.col("m.less")).alias("score")), "best-titles")
    return best_match(named.join(first, ["block", "folded"]).drop("folded"), threshold).withColumnRenamed("block", block)


def _assigned(offers: Callable[[DataFrame | None, DataFrame | None], DataFrame]) -> DataFrame:
    """Greedy assignment in rounds: free left rows offer to their best right row, which holds the first pair in order.

    ``offers(held, free)`` gives for each free row the first of its pairs that come before what is held.
    As both sides follow one order of pairs, what is held in the end is what a greedy pass would take.
    """
    held = free = None
    while True:
        offered = offers(held, free)
        pairs = (offered if held is None else held.unionByName(offered)).withColumn("rank", F.row_number().over(W.partitionBy("block", "b").orderBy("key")))
        pairs = stage(pairs, "offers")
        held, free = pairs.filter("rank = 1").drop("rank"), pairs.filter("rank > 1").select("block", "a")
        if free.isEmpty():
            return held


def one_to_one(pairs: DataFrame, block: str, threshold: float = ASSIGN) -> DataFrame:
    """Greedy assignment by falling score within each block; each row is used once. A block is one work's chapters."""
    rows = stage(pairs.filter(F.col("score") >= threshold).withColumnRenamed(block, "block").withColumn("key", _key()), "pairs")

    def offers(held, free):
        some = rows if free is None else rows.join(free, ["block", "a"], "left_semi")
        if held is not None:
            some = some.join(held.select("block", "b", F.col("key").alias("held")), ["block", "b"], "left").filter("held IS NULL OR key < held").drop("held")
        return some.withColumn("best", F.row_number().over(W.partitionBy("block", "a").orderBy("key"))).filter("best = 1").select(*rows.columns)

    return _assigned(offers).withColumnRenamed("block", block).select(*pairs.columns)


def one_to_one_of_all(left: DataFrame, right: DataFrame, block: str, threshold: float = ASSIGN) -> DataFrame:
    """``one_to_one`` of all pairs, without a table of them."""

    def offers(held, free):
        some = left if free is None else left.join(free.withColumnRenamed("block", block), [block, "a"], "left_semi")
        found = _search(some, right, block, threshold, True, held).withColumn("key", _key())
        return found.withColumn("best", F.row_number().over(W.partitionBy("block", "a").orderBy("key"))).filter("best = 1").drop("best")

    return _assigned(offers).withColumnRenamed("block", block).drop("key")
