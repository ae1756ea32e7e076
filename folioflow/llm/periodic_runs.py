r"""Stretches of a text in which the same words come again and again, found by probing a harmonic grid.

For each period p the words at jp and (j+1)p are compared. A run of four periods has four points of the grid and three equal
pairs in a row, and every word from the first of these points to the third equals the one p later; so only three pairs
in a row survive, and some words between them are looked at before a survivor is extended. All periods have n/1 + n/2
+ ... points, n log n in all: up to the root of n a period is probed at all its points at once, beyond it a point at all
periods at once. A survivor is extended to both sides by comparing chunks that double. Points within a run that is found
already, with this period or one that divides it, are skipped, so that a text of one word costs no more than another.

A run is a stretch of words with smallest period q and at least ``max(6, 4 * q)`` words that no neighbour extends.
If a stretch that long has a smaller period, that divides q (Fine and Wilf), so the run is known from that period.

Documents are independent: one narrow pass, no shuffle, memory by the longest text of a slice.

Defined results: words are `[^\x20\x09-\x0D]+` of the whole text, however long, and are compared as they are; a null or empty text
has no words and no runs and collapses to the empty text; repeated rows give repeated rows; a null doc_id is kept;
all columns of the input but those of the result are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow import scratch

#: Words and periods that a run has at least.
LEAST, PERIODS = 6, 4
#: Fractions of two periods at which survivors are compared before they are extended.
LOOKS = (0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875)
#: Words of the first chunk of an extension; rows that are split into words together.
CHUNK, SLICE = 32, 64

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _equal_stretch(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many words from ``at`` on, forward or backward, equal the word ``p`` later."""
    n, size, i = len(w) - p, CHUNK, at
    while True:
        lo, hi = (i, min(i + size, n)) if step > 0 else (max(i - size + 1, 0), i + 1)
        if lo >= hi:
            return abs(i - at)
        differs = np.flatnonzero(w[lo:hi] != w[lo + p : hi + p])
        if len(differs):
            return differs[0] + lo - at if step > 0 else at - (differs[-1] + lo)
        i, size = (hi, size * 2) if step > 0 else (lo - 1, size * 2)


def _three(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(same[:-2] & same[1:-1] & same[2:])


def _outside(at: np.ndarray, p: int, long: np.ndarray) -> np.ndarray:
    """The points whose three pairs don't lie in one run of a period that divides ``p``."""
    known = long[p % long[:, 2] == 0]
    if not len(known):
        return at
    known = known[np.argsort(known[:, 0])]
    # such runs overlap by less than two periods, so only the last that starts before a point can hold its three pairs
    k = np.searchsorted(known[:, 0], at, "right") - 1
    return at[(k < 0) | (at + 3 * p >= known[k, 1])]


def _far(w: np.ndarray, first: int, last: int, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Periods from ``first`` to ``last`` and points where three pairs in a row are equal, outside the runs of ``long``."""
    n = len(w)
    periods, points, grid = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for j in range((n - 1) // first):
        end = min(last, (n - 1) // (j + 1))
        same = w[j * first : j * end + 1 : j] == w[(j + 1) * first : (j + 1) * end + 1 : j + 1] if j else w[0] == w[first : end + 1]
        grid.append(same)
        if j < 2:
            continue
        at = j - 2
        three = grid[at][: len(same)] & grid[at + 1][: len(same)] & same
        grid[at] = None
        for start, stop, q in long:
            lo, hi = max(first, -(-start // at) if at else first if start == 0 else end + 1), min(end + 1, -(-stop // (at + 3)))
            lo += -lo % q
            if lo < hi:
                three[lo - first : hi - first : q] = False
        found = np.flatnonzero(three) + first
        periods.append(found)
        points.append(found * at)
    return np.concatenate(periods), np.concatenate(points)


class _Looks:
    """A few words between the first and the third point of survivors, and the next word that isn't the commonest."""

    def __init__(self, w: np.ndarray):
        self.w, self.next = w, None

    def agree(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which survivors are equal there too."""
        w = self.w
        left = np.arange(len(at))
        for part in LOOKS:
            i = at[left] + (2 * p[left] * part).astype(np.int64)
            left = left[w[i] == w[i + p[left]]]
        if len(left):
            if self.next is None:
                other = np.where(w == np.bincount(w).argmax(), len(w), np.arange(len(w)))
                self.next = np.minimum.accumulate(other[::-1])[::-1]
            i = np.minimum(self.next[at[left]], at[left] + 2 * p[left])
            left = left[w[i] == w[i + p[left]]]
        return left


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of each run of an array of word codes from 0, by start, then period."""
    n = len(w)
    if n < LEAST:
        return []
    looks = _Looks(w)
    found: dict[tuple[int, int], int] = {}
    long = np.zeros((0, 3), np.int64)

    def extend(at: np.ndarray, p: int, long: np.ndarray) -> np.ndarray:
        """Add the runs around these points; ``long`` with them, without what is too short for this period."""
        new, end = [], -1
        for i in at.tolist():
            if i < end:
                continue
            start = i - _equal_stretch(w, i, p, -1) + 1
            end = i + _equal_stretch(w, i, p, 1)
            if end + p - start >= max(LEAST, PERIODS * p) and (start, end + p) not in found:
                found[start, end + p] = p
                new.append((start, end + p, p))
        return np.concatenate([long, np.array(new, np.int64)]) if new else long

    root = int(n**0.5)
    for p in range(1, min(root, n // PERIODS) + 1):
        at = _three(w[: n - p : p] == w[p::p]) * p
        if len(at):
            long = long[long[:, 1] - long[:, 0] >= PERIODS * p]
            at = _outside(at, p, long)
            at = at[looks.agree(at, np.full(len(at), p))]
            long = extend(at, p, long)
    first, last = root + 1, n // PERIODS
    if first <= last:
        long = long[long[:, 1] - long[:, 0] >= PERIODS * first]
        periods, points = _far(w, first, last, long)
        keep = looks.agree(points, periods)
        keep = keep[np.lexsort((points[keep], periods[keep]))]
        periods, points = periods[keep], points[keep]
        bounds = np.flatnonzero(np.diff(periods, prepend=0, append=-1))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            p = int(periods[lo])
            long = long[long[:, 1] - long[:, 0] >= PERIODS * p]
            long = extend(_outside(points[lo:hi], p, long), p, long)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are not repeats: in each run only the first period is kept."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover)[:n] == 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            lists = pc.ascii_split_whitespace(pc.fill_null(part.column("text"), ""))
            sizes, every, texts = [], [], []
            for words in lists:
                words = words.values.filter(pc.not_equal(pc.binary_length(words.values), 0))
                mine = runs(words.dictionary_encode().indices.to_numpy()) if len(words) >= LEAST else []
                sizes.append(len(words))
                every.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                texts.append(" ".join((words.filter(pa.array(_kept(len(words), mine))) if mine else words).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(every, pa.list_(RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: all runs of each text, by start, and the text with each run's first period only."""
    scratch.send_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth, told by the checksum of the doc_id, goes on with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")
    lines = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    chosen = F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^ \t-\r]"), words)
    lines = lines.withColumn("words", chosen).withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("words").isNotNull(), F.col("g") % F.col("n")))
    return lines.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(_repeating()).alias("text"))


def _repeating() -> Column:
    a, n, g = F.col("a"), F.col("n"), F.col("g")
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at("words", (a + i % p + 1).cast("int")))
    return F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), place), " ")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic, and digests of all runs and of the collapsed texts."""
    found = periodic_runs(planted(scratch.table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    named = found.withColumn("best", best).withColumn("lines", lines)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
