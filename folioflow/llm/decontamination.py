r"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item, or the whole item if it has fewer. A window is in
a document only if each of its word shingles is, so one shingle suffices as its prefix: the one that is
rarest in all documents. Documents are joined with the windows on prefix shingles; where one occurs, its place
in the window and the window's length say which words of the document to compare (the positional and
the length bound), and those words must equal the whole window.

The windows are broadcast if they take at most ``BROADCAST_BYTES``, which is measured first. Beyond that, prefix
shingles are joined by a shuffle and each document is verified against its own candidates. Both ways give the same rows.

Defined results: words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z in lower case; a null or empty text has no
words, no hits and no items; an item without words, or without an id, has no windows; items and windows that
occur twice count once; repeated documents each get their row; an empty benchmark hits nothing, and an empty table of
documents gives an empty result; texts are taken whole, however long; other columns, of any names, don't matter and
are carried by ``clean_documents``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch
from folioflow.llm import membership

WINDOW = 10
#: Words of a shingle; a shorter item is one shingle.
SHINGLE = 3
BROADCAST_BYTES = 16 << 20

#: A-Z to lower case; every other ASCII character but digits and letters to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _windows_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, windows, lengths = [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), _texts(batch), strict=True):
            words = split_words(text)
            n = min(size, len(words))
            seen = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ()
            ids += [item] * len(seen)
            windows += seen
            lengths += [n] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary()), pa.array(lengths, pa.int32())], ["item", "window", "length"])


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item, window, length)``: the distinct windows of each item."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(lambda it: _windows_of(it, size), "item string, window binary, length int").distinct()


def _shingles(window: bytes) -> list[tuple[int, bytes]]:
    """(offset, shingle) of a window."""
    words = window.split(b" ")
    k = min(SHINGLE, len(words))
    return [(i, b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


def _count(batches: Iterator[pa.RecordBatch], wanted: dict[int, set[bytes]]) -> Iterator[pa.RecordBatch]:
    """How often each wanted shingle, and each one's first word, occurs."""
    counts: Counter[bytes] = Counter()
    first = {s.split(b" ", 1)[0] for group in wanted.values() for s in group}
    for batch in batches:
        for text in _texts(batch):
            words = split_words(text)
            at = [i for i, w in enumerate(words) if w in first]
            counts.update(words[i] for i in at)
            for k, group in wanted.items():
                if k > 1:
                    counts.update(s for i in at if (s := b" ".join(words[i : i + k])) in group)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])


class Index:
    """Windows by their prefix shingle."""

    def __init__(self, windows: dict[bytes, list[str]], counts: dict[bytes, int]):
        self.items = windows
        #: Shingle length -> shingle -> (offset, window length), each once.
        self.prefixes: dict[int, dict[bytes, set[tuple[int, int]]]] = {}
        for window in windows:
            offset, shingle = min(_shingles(window), key=lambda x: (counts.get(x[1], 0), counts.get(x[1].split(b" ", 1)[0], 0), x))
            size = shingle.count(b" ") + 1
            self.prefixes.setdefault(size, {}).setdefault(shingle, set()).add((offset, window.count(b" ") + 1))
        self.first = {s.split(b" ", 1)[0] for group in self.prefixes.values() for s in group}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, window) of each occurrence of a window."""
        if self.first.isdisjoint(words):
            return
        n = len(words)
        for at in [i for i, w in enumerate(words) if w in self.first]:
            for size, group in self.prefixes.items():
                for offset, length in group.get(b" ".join(words[at : at + size]), ()):
                    start = at - offset
                    if start >= 0 and start + length <= n and (window := b" ".join(words[start : start + length])) in self.items:
                        yield start, length, window


def _hits(words: list[bytes], found) -> tuple[int, list[tuple[int, int]], set[bytes]]:
    """Words hit, their spans (merged) and the windows."""
    windows, spans = set(), []
    for start, length, window in sorted(found):
        windows.add(window)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + length)
        else:
            spans.append([start, start + length])
    return sum(b - a for a, b in spans), [tuple(x) for x in spans], windows


OUT = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"


def _columns(rows: list[tuple[int, int, list[str], list[tuple[int, int]]]]) -> list[pa.Array]:
    n_words, n_hit, items, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], kind)]


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in _texts(batch):
            words = split_words(text)
            n_hit, spans, windows = _hits(words, index.find(words))
            rows.append((len(words), n_hit, sorted({x for w in windows for x in index.items[w]}), spans))
        yield pa.RecordBatch.from_arrays(_as_spark(batch)[0] + _columns(rows), _as_spark(batch)[1] + ["n_words", "n_hit", "items", "spans"])


def _as_spark(batch: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    keep = [k for k in batch.schema.names if k != "text"]
    return [batch.column(k) for k in keep], keep


def _counts(docs: DataFrame, wanted: dict[int, set[bytes]]) -> DataFrame:
    return docs.select("text").mapInArrow(lambda it: _count(it, wanted), "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _sent_index(docs: DataFrame, windows: DataFrame) -> Callable[[], Index]:
    """The windows with their prefixes, broadcast; what is returned loads them in a task."""
    items: dict[bytes, list[str]] = {}
    for r in windows.select("window", "item").collect():  # measured: at most BROADCAST_BYTES
        items.setdefault(bytes(r.window), []).append(r.item)
    wanted: dict[int, set[bytes]] = {}
    for window in items:
        for _, s in _shingles(window):
            wanted.setdefault(s.count(b" ") + 1, set()).add(s)
    counts = {bytes(r.shingle): r.n for r in _counts(docs, wanted).collect()}  # shingles of those windows
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Index(items, counts)))
    loaded: dict[str, Index] = {}

    def load() -> Index:
        if not loaded:
            loaded["index"] = pickle.loads(sent.value)
        return loaded["index"]

    return load


def _by_broadcast(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    load = _sent_index(keyed, windows)
    return keyed.mapInArrow(lambda it: _scan(it, load()), f"key_ long, id_ string, {OUT}")


def _uncontaminated(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([next(index.find(split_words(t)), None) is None for t in _texts(batch)], pa.bool_()))


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def _positions(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, doc, text in zip(batch.column("key_").to_pylist(), batch.column("id_").to_pylist(), _texts(batch), strict=True):
            words = split_words(text)
            for k in sizes:
                n = max(0, len(words) - k + 1)
                shingles = pa.array([_hash(b" ".join(words[i : i + k])) for i in range(n)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([doc] * n, pa.string()), pa.array(range(n), pa.int32()), shingles], ["key_", "id_", "at", "shingle"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, o, _hash(s)) for w, n in zip(batch.column("window").to_pylist(), batch.column("length").to_pylist(), strict=True) for o, s in _shingles(w)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["window", "length", "offset", "shingle"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, candidates in zip(_texts(batch), batch.column("candidates").to_pylist(), strict=True):
            words = split_words(text)
            found = {(c["start"], c["length"], c["window"]) for c in candidates or () if b" ".join(words[c["start"] : c["start"] + c["length"]]) == c["window"]}
            n_hit, spans, windows = _hits(words, found)
            rows.append((len(words), n_hit, sorted(windows), spans))
        cols, names = _as_spark(batch)
        a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        more = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.binary())), pa.array([[{"first": x, "last": y} for x, y in s] for s in d], kind)]
        keep = [i for i, n in enumerate(names) if n != "candidates"]
        yield pa.RecordBatch.from_arrays([cols[i] for i in keep] + more, [names[i] for i in keep] + ["n_words", "n_hit", "windows", "spans"])


def _by_shuffle(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of any number: rarity, prefixes and candidates by joins."""
    distinct = windows.select("window", "length").distinct()
    shingles = scratch.stage(distinct.mapInArrow(_shingle_rows, "window binary, length int, offset int, shingle long"), "shingles")
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    positions = keyed.mapInArrow(lambda it: _positions(it, sizes), "key_ long, id_ string, at int, shingle long")
    seen = positions.select("shingle").join(shingles.select("shingle").distinct(), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(seen, "shingle", "left").groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("p"))
    prefixes = ranked.select("window", "length", "p.offset", "p.shingle")
    start = F.col("at") - F.col("offset")
    candidates = positions.join(prefixes, "shingle").filter(start >= 0).select("key_", "id_", start.alias("start"), "length", "window").distinct()
    grouped = candidates.groupBy("key_", "id_").agg(F.collect_list(F.struct("start", "length", "window")).alias("candidates"))
    pairs = keyed.withColumnRenamed("key_", "k_").withColumnRenamed("id_", "i_").join(grouped, (F.col("k_") == F.col("key_")) & F.col("i_").eqNullSafe(F.col("id_")), "left")
    checked = scratch.stage(
        pairs.select(F.col("k_").alias("key_"), F.col("i_").alias("id_"), "text", "candidates").mapInArrow(_verify, "key_ long, id_ string, n_words long, n_hit long, windows array<binary>, spans array<struct<first:int,last:int>>"), "verified"
    )
    named = checked.select("key_", "id_", F.explode("windows").alias("window")).distinct().join(windows.select("window", "item"), "window")
    items = named.groupBy("key_", "id_").agg(F.array_sort(F.collect_set("item")).alias("found")).withColumnsRenamed({"key_": "k_", "id_": "i_"})
    out = checked.join(items, (F.col("k_") == F.col("key_")) & F.col("i_").eqNullSafe(F.col("id_")), "left")
    return out.select("key_", "id_", "n_words", "n_hit", F.coalesce("found", F.array().cast("array<string>")).alias("items"), "spans")


def _measured(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """The windows, and whether they are small enough to be broadcast."""
    scratch.send_code(docs.sparkSession)
    windows = scratch.stage(windows_of(benchmark, size), "windows")
    took = windows.agg(F.sum(F.length("window") + F.length("item") + 32)).first()[0] or 0
    return windows, took <= broadcast_bytes


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("key_"), F.col("doc_id").cast("string").alias("id_"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(id_, n_words, n_hit, items, spans)`` for each row of ``docs``; id_ is the doc_id as text.

    key_ is a hash of the text, so that rows that share a doc_id stay apart.
    """
    windows, small = _measured(docs, benchmark, size, broadcast_bytes)
    return _by_broadcast(_keyed(docs), windows) if small else _by_shuffle(_keyed(docs), windows)


def clean_documents(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item: one pass over whole rows, without a join.

    Only with windows beyond ``broadcast_bytes``, documents are told apart by a list of contaminated ones.
    """
    windows, small = _measured(docs, benchmark, WINDOW, broadcast_bytes)
    if small:
        load = _sent_index(docs, windows)
        return docs.mapInArrow(lambda it: _uncontaminated(it, load()), docs.schema)
    same = F.xxhash64(F.xxhash64("text"), F.col("doc_id").cast("string"))
    gone = _by_shuffle(_keyed(docs), windows).filter("n_hit > 0").select(F.xxhash64("key_", "id_").alias("gone_")).distinct()
    return membership.without(docs, same, scratch.stage(gone, "contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    found = contamination(docs, scratch.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id_").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (
  SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
