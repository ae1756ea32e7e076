"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in tasks. Trees are grown on the statistics of a bounded sample of labelled
rows (``SAMPLE``, by a hash of the doc_id): each statistic is cut into at most ``BINS`` ranges, gradients are
summed by range, and a node takes the split with the largest gain. All trees have one depth and lie in flat
arrays, node k above nodes 2k + 1 and 2k + 2, so that a batch of rows goes down all trees at once.

Defined results: a null or empty text has statistics of zero; labels that are null, other than 0 and 1, or of no document, are not
used; a doc_id with several labels is used with each; without training rows the score is 0, with rows of one
class it is near that class; repeated rows and ties of statistics have equal scores; a text of any length is measured whole; an empty
table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch
from folioflow.llm.toxicity import is_held_out, labelled_sample

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, LEAST_ROWS, RIDGE = 48, 4, 80, 0.15, 5, 1.0
THRESHOLD = 0.3

UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
SPACES, STOPS, SYMBOLS, BRACKETS = b" \t\n\r\v\f", b".,;:?'\"", b"#$%&*~^@=+\\/_`", b"()[]{}<>"


def statistics(text: str | None) -> list[float]:
    """Shares and logarithms of counts, over the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    groups = [size - len(raw.translate(None, g)) if raw else 0 for g in (UPPER, LOWER, DIGITS, SPACES, STOPS, SYMBOLS, BRACKETS, b"!", b"|", bytes(range(128, 256)))]
    again = sum(map(eq, words, words[1:]))
    twice = sum(map(eq, words, words[2:]))
    most = max(counts.values(), default=0)
    line_counts = Counter(lines)
    return [
        float(np.log1p(len(words))), (len(raw) / n), len(counts) / n, again / n, float(np.log1p(again)), twice / n, most / n, float(np.log1p(most)),
        *(g / size for g in groups), *(float(np.log1p(g)) for g in groups[:1] + groups[5:9]),
        len(line_counts) / max(1, len(lines)), float(np.log1p(len(lines))), float(np.log1p(max(map(len, lines), default=0))), float(np.log1p(max(line_counts.values(), default=0))),
    ]


@dataclass
class Forest:
    """``split`` and ``cut`` are (trees, 2**DEPTH - 1), ``leaf`` is (trees, 2**DEPTH)."""

    split: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.split))[None, :]
        at = np.zeros((len(x), len(self.split)), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.split[trees, at]] > self.cut[trees, at])
        return self.base + self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**DEPTH - 1
    split, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(binned), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best, gain_of = np.full(width, -1), np.full(width, 1e-9)
        where = np.zeros(width, np.int64)
        node = at - first
        for f in range(binned.shape[1]):
            slot = node * BINS + binned[:, f]
            sums = [np.bincount(slot, v, width * BINS).reshape(width, BINS) for v in (g, h, np.ones(len(g)))]
            left_g, left_h, left_n = (np.cumsum(s, axis=1) for s in sums)
            all_g, all_h, all_n = (s[:, -1:] for s in (left_g, left_h, left_n))
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_n < LEAST_ROWS) | (all_n - left_n < LEAST_ROWS)] = 0
            top = gain.argmax(axis=1)
            better = gain[np.arange(width), top] > gain_of
            best[better], where[better], gain_of[better] = f, top[better], gain[np.arange(width), top][better]
        for k in np.flatnonzero(best >= 0):
            split[first + k], cut[first + k] = best[k], edges[best[k]][where[k]] if where[k] < len(edges[best[k]]) else np.inf
        chosen = split[at]
        value = np.array([where[k] if best[k] >= 0 else BINS for k in range(width)])[node]
        at = 2 * at + 1 + (binned[np.arange(len(binned)), chosen] > value)
    leaves = at - inner
    leaf = -RATE * np.bincount(leaves, g, 2**DEPTH) / (np.bincount(leaves, h, 2**DEPTH) + RIDGE)
    return split, cut, leaf, leaves


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting of the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-13
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), base)
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        split, cut, leaf, leaves = _tree(binned, edges, p - y, p * (1 - p))
        margin = margin + leaf[leaves]
        trees.append((split, cut, leaf))
    return Forest(*(np.array(a) for a in zip(*trees, strict=True)), base)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label_"), pa.array(stats, pa.list_(pa.float64()))], ["label_", "stats"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Fitted on the statistics of at most ``most`` labelled rows that are not held out."""
    scratch.send_code(docs.sparkSession)
    sample = labelled_sample(labels.filter(~is_held_out(mod=5, rest=0)), "quality", most).filter("label_ IN (0, 1)")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label_").mapInArrow(_measured, "label_ int, stats array<double>").toArrow()
    y = rows.column("label_").to_numpy().astype(float)
    x = np.array(rows.column("stats").to_pylist(), float).reshape(len(y), len(statistics("")))
    order = np.lexsort([*x.T, y]) if len(y) else []
    return fit(x[order], y[order])


def _scored(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float)
        found = np.concatenate([forest.scores(x[k : k + 4096]) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])


def scores(docs: DataFrame, forest: Forest) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``."""
    scratch.send_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, forest), f"doc_id {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, scratch.table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out(mod=5, rest=0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
