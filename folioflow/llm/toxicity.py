"""Toxicity by compression distance.

Pairs of zstandard dictionaries of equal size are trained on a bounded sample of labelled documents: one on windows of toxic documents, one on
as many bytes of windows of ordinary ones, both windows as they are, words and all. Documents are split in two halves in ``SPLITS``
ways by bits of a hash, and each half of each split has a pair of its own. A document is cut into windows of ``WINDOW``
words, which are compressed with both dictionaries of a pair; the difference of the lengths is what the toxic one saves.

What is common beside toxic words is by chance in one dictionary and not in the other, so a single pair tells little. But
that chance is another one in each pair, and what one document has alone is in one half of a split only, while what many toxic
documents share is in nearly all halves. So a window counts by the second least of its savings over all pairs, and
windows that two pairs save nothing on are not looked at further, which leaves two pairs to most.

The largest savings of a document are the features of a logistic model, which is calibrated on sampled documents that no
dictionary was trained on; the threshold is fixed. A dictionary tells what occurs, not how often: toxic texts that are labelled
ordinary put their words into the ordinary dictionaries too.

Windows are compressed by the fast strategy without entropy coding of literals, so that a word that only one dictionary
knows shows in whole bytes, and behind a phrase that both know, so that none is stored raw.

Sample: at most ``SAMPLE`` labelled rows, by a hash of the doc_id, of which texts that are alike count once. Windows of these, at
most ``TRAINED_BYTES`` of a class and the same of both, are picked by their hash and brought together by pair, where a task trains its two
dictionaries; the dictionaries and the features for calibration go to the driver. All documents are scored over their whole text.

Defined results: a null or empty text has no windows and the score of a text without savings; labels that
are null, or of no document, are not used; a doc_id with several labels is used with each; without
toxic or without ordinary training rows the score is the share of toxic ones, 0 without any; repeated
rows have equal scores; a text of any length is scored whole; an empty table gives an empty result; further columns, of any
names, don't matter and are carried by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch
from folioflow.llm.decontamination import split_words

WINDOW = 10
SAMPLE = 20_000
THRESHOLD = 0.3
#: Ways to split documents in halves, and how many pairs may see no savings in a window.
SPLITS, DISSENT = 4, 1
#: Bytes of windows of a class that are trained on; bytes of a dictionary, and what it is trained on for each at least.
TRAINED_BYTES, DICTIONARY_BYTES, SAMPLES_PER_BYTE = 4 << 20, 256 << 10, 3
#: Bytes of the segments that the trainer picks, and of what it counts in them.
SEGMENT, COUNTED = 16, 6
#: Blank bytes in front of a dictionary: they make its hash table sparse, so that entries don't displace each other.
BLANK = 3 * 80_000
#: What both dictionaries of a pair end with and every window begins with.
PHRASE = b" zqzqzq qzqzqz "
#: A trained dictionary's content follows its three first offsets, 1, 4 and 8.
FIRST_OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"
#: The trainer cuts as many bytes off its best segments as its header has; this text, in a sample after every third, is cut instead.
CUT = bytes(np.random.default_rng(2).choice(np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8), 256))
BEST = 3


def words_of(text: str | None) -> list[bytes]:
    return split_words(text.encode("utf-8", "replace")) if text else []


def windows_of(text: str | None) -> list[bytes]:
    words = words_of(text)
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    #: Header, ordinary and toxic content of each pair, the contents without blanks.
    pairs: list[tuple[bytes, bytes, bytes]]
    weights: list[float]
    constant: float | None = None


class Scorer:
    """Compares windows of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.codecs = [tuple(self._codec(header + b"\0" * BLANK + content + PHRASE) for content in contents) for header, *contents in model.pairs]
        self.dissent = min(DISSENT, len(self.codecs) - 1)

    @staticmethod
    def _codec(dictionary: bytes):
        how = zstandard.ZstdCompressionParameters(
            window_log=20, hash_log=20, chain_log=6, search_log=1, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress

    def savings(self, window: bytes) -> tuple[int, int, int] | None:
        """What nearly all pairs save at least, what all save, and what half of them do; None if more than ``dissent`` save nothing."""
        found, against, text = [], 0, PHRASE + window
        for ordinary, toxic in self.codecs:
            saved = len(ordinary(text)) - len(toxic(text))
            found.append(saved)
            if saved <= 0:
                against += 1
                if against > self.dissent:
                    return None
        found.sort()
        return found[self.dissent], found[0], found[len(found) // 2]

    def features(self, text: str | None) -> list[float]:
        """The largest savings, the logarithm of the number of windows, and sums over windows by the root of their number."""
        windows = windows_of(text)
        saved = [s for w in windows if (s := self.savings(w))]
        by_kind = [sorted(x, reverse=True) for x in zip(*saved, strict=True)] or [[], [], []]
        nearly, every, half = ((x + [0] * BEST)[:BEST] for x in by_kind)
        root = max(1.0, len(windows) ** 0.5)
        sums = [sum(by_kind[0]) / root, *(sum(x >= k for x in by_kind[0]) / root for k in (3, 5))]
        return [1.0, *map(float, nearly), float(every[0]), float(half[0]), float(np.log1p(len(windows))), *sums]

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.model.weights), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the ridge keeps separable classes finite."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _content(samples: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Header and content of a trained dictionary; raw text if there is too little to train on."""
    try:
        given = [x for k in range(0, len(samples), 3) for x in (*samples[k : k + 3], CUT)]
        trained = zstandard.train_dictionary(size + len(CUT), given, k=SEGMENT, d=COUNTED).as_bytes()
        at = trained.index(FIRST_OFFSETS) + len(FIRST_OFFSETS)
        return trained[:at], trained[at:]
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[:size]


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """A pair, both of one size and trained on as many bytes of windows."""
    n = min(sum(map(len, ordinary)), sum(map(len, toxic)))
    header, contents = b"", []
    for samples in (toxic, ordinary):
        kept = np.cumsum([len(s) for s in samples]) - len(samples[0]) < n
        header, content = _content([s for s, k in zip(samples, kept, strict=True) if k], max(1024, min(DICTIONARY_BYTES, n // SAMPLES_PER_BYTE)))
        contents.append(content)
    size = max(map(len, contents))
    return header, *(c.rjust(size, b" ") for c in reversed(contents))


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each text, with a hash."""
    for batch in batches:
        windows = [windows_of(t) for t in batch.column("text").to_pylist()]
        flat = [w for own in windows for w in own]
        owner = pa.array(np.repeat(np.arange(len(windows)), [len(own) for own in windows]))
        hashes = [xxhash.xxh64_intdigest(w) >> 1 for w in flat]
        yield pa.RecordBatch.from_arrays([batch.column("bits").take(owner), batch.column("label_").take(owner), pa.array(hashes, pa.int64()), pa.array(flat, pa.binary())], ["bits", "label_", "hash", "window"])


def _trained(table: pa.Table) -> pa.Table:
    """The dictionaries of one pair."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("label_", "hash", "window")), strict=True))
    # equal windows must not stand together, or the trainer takes the text for exhausted
    rows = [rows[k] for k in np.random.default_rng(1).permutation(len(rows))]
    header, ordinary, toxic = dictionaries(*([w for label, _, w in rows if label == own] for own in (0, 1))) if {r[0] for r in rows} == {0, 1} else (b"", b"", b"")
    return pa.table([table.column("pair").slice(0, 1), *(pa.array([x], pa.binary()) for x in (header, ordinary, toxic))], ["pair", "header", "ordinary", "toxic"])


def _pairs(train: DataFrame, room: scratch.Room) -> list[tuple[bytes, bytes, bytes]]:
    """A pair of dictionaries for each half of each split of ``train(text, label_)``."""
    hashed = train.select("text", "label_", F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 8).alias("bits"))
    windows = room.stage(hashed.mapInArrow(_windowed, "bits long, label_ int, hash long, window binary"), "windows")
    sizes = {r["label_"]: r["n"] for r in windows.groupBy("label_").agg(F.sum(F.octet_length("window")).alias("n")).collect()}
    most = min(TRAINED_BYTES, *(sizes.get(label, 0) for label in (0, 1)))
    share = F.when(F.col("label_") == 1, most / max(1, sizes.get(1, 0))).otherwise(most / max(1, sizes.get(0, 0)))
    some = windows.filter(F.col("hash") < share * float(1 << 63))
    halves = F.array(*(2 * k + F.shiftright("bits", k).bitwiseAND(1) for k in range(SPLITS)))
    found = some.withColumn("pair", F.explode(halves)).groupBy("pair").applyInArrow(_trained, "pair long, header binary, ordinary binary, toxic binary")
    return [(bytes(r.header), bytes(r.ordinary), bytes(r.toxic)) for r in sorted(found.collect(), key=lambda r: r.pair) if r.toxic]


def _featured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        found = [scorer.features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label_"), pa.array(found, pa.list_(pa.float64()))], ["label_", "features"])


def fit(rows: DataFrame, room: scratch.Room) -> Model:
    """``rows(text, label_)``, each text once; a third, by a hash of the text, is for calibration only."""
    fold = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(3))
    train, hold = rows.filter(fold != 0), rows.filter(fold == 0)
    seen = {(r["held"], r["label_"]): r["count"] for r in rows.groupBy((fold == 0).alias("held"), "label_").count().collect()}
    pairs = _pairs(train, room) if len(seen) == 4 else []
    if not pairs:
        return Model([], [], sum(n for (_, y), n in seen.items() if y) / max(1, sum(seen.values())))
    model = Model(pairs, [])
    sent = rows.sparkSession.sparkContext.broadcast(model)
    found = hold.mapInArrow(lambda it: _featured(it, sent.value), "label_ int, features array<double>").toArrow()
    y = found.column("label_").to_numpy().astype(float)
    x = np.array(found.column("features").to_pylist(), float)
    order = np.lexsort([*x.T, y])
    model.weights = _logistic(x[order], y[order]).tolist()
    return model


def is_held_out(doc_id=None, mod: int = 4, rest: int = 2):
    c = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, label_)`` of at most ``most`` labelled rows, by a hash of the doc_id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label_"))
    share = min(1.0, 0.95 * most / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(scores, pa.float64())], [*names, "score"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, key_, score)``; key_ is a hash of the text."""
    scratch.send_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 4 MB
    return docs.select("doc_id", F.xxhash64("text").alias("key_"), "text").mapInArrow(lambda it: _scored(it, sent.value), f"doc_id {kind}, key_ long, score double")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fitted on labelled rows that are not held out."""
    scratch.send_code(docs.sparkSession)
    sample = labelled_sample(labels.filter(~is_held_out()), "toxic", most).filter("label_ IN (0, 1)")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label_")
    with scratch.Room(docs.sparkSession) as room:
        return fit(room.stage(rows.dropDuplicates(["text", "label_"]), "labelled"), room)


def _clean(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score reaches the threshold: one pass over whole rows, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # some 4 MB
    return docs.mapInArrow(lambda it: _clean(it, sent.value, threshold), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, scratch.table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
