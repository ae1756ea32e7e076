"""Token ids in a binary table: each document compressed by itself with a shared zstandard dictionary.

Format. A written dataset has two Parquet tables. ``dictionary`` has one row: its sha256, the dictionary, the
numpy type of the ids and the end id. ``segments`` has rows ``(part, segment, first_doc_id, last_doc_id,
dictionary, n_docs, n_tokens, doc_ids, tokens, offsets, crcs, payload)``: payload is the zstandard frames of
n_docs documents end to end, ``offsets`` their n_docs + 1 bounds in it, ``tokens`` their numbers of ids and
``dictionary`` the sha256 of the dictionary to use. Rows are in ascending order of doc_id within a part and from
part to part, so one document is read by its segment's bounds, its offset and a single frame.

The dictionary is trained on the serialized ids of at most ``SAMPLE_DOCS`` documents, picked by a hash of the
doc_id, with at most ``SAMPLE_IDS`` ids of each; it affects sizes only, never ids.

Defined results: a null or empty text has the end id only; a null doc_id sorts first; rows that share a
doc_id are in order of their checksum and length; an empty table gives an empty dataset with an empty
dictionary; texts are taken whole, however long; further columns, of any names, are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch

VOCABULARY = "word_bpe_49k.json"
END = 1
SAMPLE_DOCS = 1000
SAMPLE_IDS = 4096
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 1 << 20
LEVEL = 3
#: Words that a worker remembers, and bytes of text that it takes together.
REMEMBERED = 400_000
SLICE_BYTES = 12 << 20


#: A word of Latin-1 letters, and ASCII signs after it. No apostrophe: the library splits some of those off with letters.
WORD = "^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"
#: Words that the library's model gets in one text, such texts that it gets at once (it holds some 100 bytes for each id), and words whose
#: ids are put together at once.
JOINED, LINES, TOGETHER = 500, 8, 100_000


def _gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values[f : f + k]`` for each ``f`` of ``first`` and ``k`` of ``n``, end to end."""
    ends = np.cumsum(n)
    return values[np.repeat(first - ends + n, n) + np.arange(ends[-1])] if len(n) else values[:0]


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


class Encoder:
    """Ids of texts, as arrays of 32-bit integers.

    This vocabulary's library normalises and splits text at white space first, so the ids of a text are those of
    its parts between white space; each distinct part of a slice is encoded by the library once. Parts are remembered as rows
    of ``first`` and ``length``, which are places in ``ids``; when they are too many, those of the present slice stay.

    A part that is letters and signs is split into both, and letters are folded, as the library does, so that fewer
    differ. Such letters are what the library's model would get from normaliser and splitter, so many go to it in one text, an end
    of line apart; the model says by its suffix which ids end a word. A text that holds an added token of the vocabulary, which the
    library finds before it splits, goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.words = self._word_library(path)
        self.ends = np.zeros(self.size, bool)
        self.ends[[k for t, k in self.library.get_vocab(False).items() if t.endswith("</w>")]] = True
        self._forget()

    @staticmethod
    def _word_library(path: str):
        """The library with the same model, for lower-case words an end of line apart."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True
        words.normalizer = normalizers.Sequence([])
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return words

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _remember(self, parts: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.first = np.concatenate([self.first, _starts(length) + len(self.ids)])
        self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids])

    def _by_library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for k in range(0, len(parts), 4096) for x in self.library.encode_batch_fast(parts[k : k + 4096], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _by_model(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = ["\n".join(stems[k : k + JOINED]) for k in range(0, len(stems), JOINED)]
        found = (x for k in range(0, len(lines), LINES) for x in self.words.encode_batch_fast(lines[k : k + LINES], add_special_tokens=False))
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(x.ids, "<u4") for x in found)])
        length = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return (ids, length) if len(length) == len(stems) and length.sum() == len(ids) else self._by_library(stems)

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, end to end, and how many each has."""
        split = pc.extract_regex(parts, WORD)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(split.filter(pa.array(plain)).field("stem")).dictionary_encode()
        tails = split.filter(pa.array(plain)).field("tail").dictionary_encode()
        kinds = [self._by_model(stems.dictionary.to_pylist()), self._by_library([*tails.dictionary.to_pylist(), ""]), self._by_library(parts.filter(pa.array(~plain)).to_pylist())]
        length = np.concatenate([n for _, n in kinds])
        base = np.cumsum([0, *(len(n) for _, n in kinds)])
        two = np.full((len(parts), 2), base[2] - 1)  # the second of a part that isn't plain: nothing
        two[plain, 0], two[plain, 1] = stems.indices.to_numpy(), base[1] + tails.indices.to_numpy()
        two[~plain, 0] = base[2] + np.arange(len(parts) - plain.sum())
        return _gathered(np.concatenate([ids for ids, _ in kinds]), _starts(length)[two.ravel()], length[two.ravel()]), length[two].sum(axis=1)

    def _parts(self, parts: pa.Array) -> np.ndarray:
        """The row of each of these distinct parts."""
        words = parts.to_pylist()
        rows = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(self.known) + len(missing) > REMEMBERED:
            held = np.flatnonzero(rows >= 0)
            length = self.length[rows[held]]
            ids = _gathered(self.ids, self.first[rows[held]], length)
            self._forget()
            self._remember([words[k] for k in held], ids, length)
            rows[held] = np.arange(len(held))
        if len(missing):
            rows[missing] = np.arange(len(missing)) + len(self.known)
            self._remember([words[k] for k in missing], *self._learn(parts.take(pa.array(missing))))
        return rows

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """In slices of some MB of text, so that parts and their ids are joined by arrays."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(at, end - at))
            at = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        rows = self._parts(coded.dictionary)
        first, length, every = self.first[rows], self.length[rows], self.ids
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, "right")) - 1)
            own = codes[bounds[at] : bounds[end]]
            n = length[own]
            ids = _gathered(every, first[own], n)
            places = np.concatenate([[0], np.cumsum(n)])[bounds[at : end + 1] - bounds[at]]
            for k in range(at, end):
                if special[k]:
                    yield np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
                else:
                    yield ids[places[k - at] : places[k - at + 1]]
            at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker keeps its encoder, and what that remembers, from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _sampled(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x[:SAMPLE_IDS].astype(kind).tobytes() for x in encoder(path).encode(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])


def train(docs: DataFrame, path: str, kind: str) -> bytes:
    """The dictionary; empty if there is too little to train on."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text").limit(SAMPLE_DOCS)
    samples = [bytes(r.ids) for r in picked.mapInArrow(lambda it: _sampled(it, path, kind), "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _encoded(batches: Iterator[pa.RecordBatch], path: str, kind: str, dictionary: bytes, end: int) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)
    for batch in batches:
        n, crcs, frames = [], [], []
        for ids in encoder(path).encode(batch.column("text")):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            n.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
            frames.append(compressor.compress(ids.astype(kind).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "ids_crc32", "frame"])


SEGMENT = (
    "part int, segment int, first_doc_id long, last_doc_id long, dictionary string, n_docs long, n_tokens long, "
    "doc_ids array<long>, tokens array<long>, offsets array<long>, crcs array<long>, payload binary"
)


def _packed(batches: Iterator[pa.RecordBatch], sha: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, segment = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        ids, tokens, crcs, frames = zip(*rows, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
        values = [part, segment, ids[0], ids[-1], sha, len(ids), sum(tokens), ids, tokens, offsets, crcs, b"".join(frames)]
        long, longs = pa.int64(), pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), long, long, pa.string(), long, long, longs, longs, longs, longs, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in SEGMENT.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids_crc32", "frame")), strict=True):
            rows.append(row)
            size += len(row[3]) + 32
            if size >= SEGMENT_BYTES:
                yield close()
                rows, size, segment = [], 0, segment + 1
    if rows:
        yield close()


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write the dataset to ``path``, a folder of any file system that Spark writes to."""
    scratch.send_code(docs.sparkSession)
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    kind = "<u2" if max(end, encoder(vocabulary).size - 1) < 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train(docs, vocabulary, kind)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary), kind, end)], "dictionary string, bytes binary, kind string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = docs.mapInArrow(lambda it: _encoded(it, vocabulary, kind, dictionary, end), "doc_id long, n_tokens long, ids_crc32 long, frame binary")
    frames = scratch.stage(frames, "frames")
    ordered = frames.repartitionByRange(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens")
    ordered.mapInArrow(lambda it: _packed(it, sha), SEGMENT).write.parquet(f"{path}/segments")


class Reader:
    """Decodes frames of a dataset; the dictionary is a row of at most DICTIONARY_BYTES."""

    def __init__(self, sha: str, dictionary: bytes, kind: str):
        if hashlib.sha256(dictionary).hexdigest() != sha:
            raise ValueError("the dictionary does not have its hash")
        self.sha, self.kind = sha, kind
        self.codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, sha: str, frame: bytes) -> np.ndarray:
        if sha != self.sha:
            raise ValueError("the segment was written with another dictionary")
        return np.frombuffer(self.codec.decompress(frame), self.kind).astype("<u4")


def _decoded(batches: Iterator[pa.RecordBatch], sha: str, dictionary: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    reader = Reader(sha, dictionary, kind)
    for batch in batches:
        for s in batch.to_pylist():
            n, crcs = [], []
            for a, b in zip(s["offsets"], s["offsets"][1:], strict=False):
                ids = reader.ids(s["dictionary"], s["payload"][a:b])
                n.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            before = np.concatenate([[0], np.cumsum(n)[:-1]]) if n else []
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s["part"]] * k, pa.int32()), pa.array([s["segment"]] * k, pa.int32()), pa.array(s["doc_ids"], pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    d = spark.read.schema("dictionary string, bytes binary, kind string, end_id int").parquet(f"{path}/dictionary").first()
    return d.dictionary, bytes(d.bytes), d.kind


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, decoded from all frames.

    Starts are summed up in two steps: the parts' totals, then the segments' within their part.
    """
    sha, dictionary, kind = _dictionary(spark, path)
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    docs = segments.select("part", "segment", "dictionary", "doc_ids", "offsets", "payload").mapInArrow(
        lambda it: _decoded(it, sha, dictionary, kind), "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    totals = segments.select("part", "segment", "n_tokens")
    zero = F.lit(0)
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), zero).alias("part_start"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), zero)
    starts = totals.withColumn("segment_start", within).join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("segment_start"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each row with this doc_id: the segments' bounds prune the scan, one frame is decoded."""
    reader = Reader(*_dictionary(spark, path))
    found = spark.read.schema(SEGMENT).parquet(f"{path}/segments").filter((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    at = F.expr(f"filter(sequence(0, size(doc_ids) - 1), i -> doc_ids[i] = {int(doc_id)})")
    rows = found.select("part", "segment", "dictionary", "offsets", "payload", F.explode(at).alias("i")).selectExpr("part", "segment", "i", "dictionary", "substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int)) AS frame")
    return [reader.ids(r.dictionary, bytes(r.frame)).tolist() for r in rows.orderBy("part", "segment", "i").collect()]


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh(spark, "tokens")
    write_tokens(scratch.table(spark, sf_dir, "documents"), path)
    return read_index(spark, path)
