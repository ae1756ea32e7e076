"""Repeated passages by sliding sentence spans.

A span is the shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words from a sentence on, or up to a
sentence. Of a longer run that repeats, each sentence is in one of these that stays inside it, so the runs
of all lengths need no hashes. Spans are hashed to 128 bits and grouped over all documents. The first
occurrence of a span is the one of the least doc_id and place; the sentences of all others are removed.

Spans, and what is first of each, are written before they are joined, so that Spark can split a span that very many
documents share; an occurrence is one narrow row.

A sentence of more than ``LONG`` words counts as several. It is cut, and so are its parts, before the word that has the
least hash with its neighbour, until parts have fewer than ``WORDS`` words, and at least half as many, so that a
passage is cut alike in most places. Of a passage within longer sentences, what is not between common cuts is kept.

Defined results: sentences end with a stop, question or exclamation mark of any script before white space (those of Chinese
and Japanese without), or at a line feed, and are compared by their words in lower case; each character of a script
without spaces is a word; a null text stays null, one of fewer words than a span stays as it is; rows alike
in doc_id and text are one document and get the same result; a null doc_id comes first; a passage of a single
sentence of up to ``LONG`` words is not a span; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch

SENTENCES, WORDS = 2, 20
LONG = 40
ASCII_END = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*")
#: Stops of Arabic, Urdu, Hindi, Armenian, Ethiopic, Burmese, Khmer and Tibetan; then those of Chinese and Japanese.
END = re.compile(r"[.!?\u2026\u203c\u2047-\u2049\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u1368\u104a\u104b\u17d4\u17d5\u0f0d\u0f0e]+[\"')\]\u00bb\u201d\u2019]*\s+|[\u3002\uff01\uff1f\uff0e\uff61]+[\"')\]\u00bb\u201d\u2019\u300d\u300f\uff09]*\s*|\n\s*")
#: Thai to Burmese, Khmer, kana, Chinese.
SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_SPACELESS = re.compile(f"[{SPACELESS}]")
WORD = re.compile(rf"[{SPACELESS}]|[^\s{SPACELESS}]+")
SPACED = re.compile(r"\S+")


def _words(text: str) -> list[str]:
    return text.split() if text.isascii() or not ANY_SPACELESS.search(text) else WORD.findall(text)


def _inner_cuts(text: str, start: int, end: int) -> list[int]:
    """Where a long sentence is cut."""
    found = [(m.start(), m.group().lower().encode("utf-8", "replace")) for m in (WORD if ANY_SPACELESS.search(text, start, end) else SPACED).finditer(text, start, end)]
    hashes = [0, *(xxhash.xxh3_64_intdigest(b"%b %b" % (v, w)) for (_, v), (_, w) in zip(found, found[1:], strict=False))]
    cuts, todo, least = [], [(0, len(found))], WORDS // 2
    while todo:
        a, b = todo.pop()
        if b - a >= WORDS:
            some = hashes[a + least : b - least + 1]
            cut = a + least + some.index(min(some))
            cuts.append(found[cut][0])
            todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, or part of a long one, with the white space after it; they make up the text."""
    plain = not text or text.isascii()
    cuts = [0, *(m.end() for m in (ASCII_END if plain else END).finditer(text))] if text else [0]
    if text and cuts[-1] < len(text):
        cuts.append(len(text))
    least, out = (2 * LONG if plain else LONG), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = [a, *_inner_cuts(text, a, b), b] if b - a > least and len(_words(text[a:b])) > LONG else [a, b]
        out += zip(inner, inner[1:], strict=False)
    return out


def spans(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, last sentence, hash) of each span; sentences without words don't count."""
    parts = [(k, _words(text[a:b].lower())) for k, (a, b) in enumerate(sentences(text))]
    parts = [(k, len(w), " ".join(w)) for k, w in parts if w]
    for start, end in _runs([p[1] for p in parts]):
        yield parts[start][0], parts[end - 1][0], xxhash.xxh3_128_digest(" ".join(p[2] for p in parts[start:end]).encode())


def _runs(counts: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest run from each sentence, and of the shortest up to each unless it is one of the first."""
    n, end, words = len(counts), 0, 0
    ends = []
    for start in range(n):
        while end < n and (end - start < SENTENCES or words < WORDS):
            words += counts[end]
            end += 1
        if end - start < SENTENCES or words < WORDS:
            break
        ends.append(end)
        yield start, end
        words -= counts[start]
    start, words = 0, 0
    for end in range(1, n + 1):
        words += counts[end - 1]
        while end - start > SENTENCES and words - counts[start] >= WORDS:
            words -= counts[start]
            start += 1
        if end - start >= SENTENCES and words >= WORDS and ends[start] != end:
            yield start, end


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = (batch.column(c).to_pylist() for c in ("id_", "key_", "text"))
        rows = [(i, k, a, b, h) for i, k, t in zip(ids, keys, texts, strict=True) for a, b, h in spans(t)]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (batch.column("id_").type, pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id_", "key_", "first", "last", "span"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cleaned, counts, removed, ranges = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            cuts = sentences(text)
            out = {k for a, b in ((g["first"], g["last"]) for g in gone or ()) for k in range(a, b + 1)}
            cleaned.append(text if not out else "".join(text[a:b] for k, (a, b) in enumerate(cuts) if k not in out))
            counts.append(len(cuts))
            removed.append(len(out))
            ranges.append([{"first": cuts[k][0], "last": cuts[k][1]} for k in sorted(out)])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        more = [pa.array(cleaned, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32()), pa.array(ranges, kind)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *more], ["row", "clean", "n_sentences", "n_removed", "removed"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(id_, key_, gone)`` of the documents with a span that is not the first of its kind; key_ is a hash of the text."""
    scratch.send_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("key_"), "text")
    found = scratch.stage(keyed.mapInArrow(_spanned, f"id_ {kind}, key_ long, first int, last int, span binary"), "spans")
    place = F.struct("id_", "key_", "first")
    first = found.groupBy("span").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("span", "lo")
    first = scratch.stage(first, "first-spans")
    later = found.join(first, "span").filter(place != F.col("lo"))
    return scratch.stage(later.groupBy("id_", "key_").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "later-spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(row, clean, n_sentences, n_removed, removed)``: row has all columns of ``docs``, removed the ranges of characters."""
    gone = repeated_spans(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left").select("row", "text", "gone")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_without, f"row {row}, clean string, n_sentences int, n_removed int, removed array<struct<first:int,last:int>>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts without repeated passages."""
    return without_repeats(docs).select(*(F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return without_repeats(docs).select("row.doc_id", F.col("clean").alias("text"), "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeated"), spans.alias("spans"))
