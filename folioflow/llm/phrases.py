r"""Phrases whose words come together more often than their parts would, by levels of length.

1. Level 1 counts words by language. A level's frequent entries set bits of a bitmap of fixed size, which is sent to all tasks.
2. Level k counts phrases of k words, and only those whose two overlapping parts of k - 1 words have their bit set. No
   frequent phrase is lost, since its parts are at least as frequent; a bit set by chance only lets a rare phrase be counted,
   which its count removes. So what is sent never grows, and is right for any number of frequent parts.
3. Counts are summed within slices of texts (numpy), within tasks (Spark's partial aggregation) and then by phrase, so
   a word or a language with most of the text costs a row for each task.
4. Each cut of a frequent phrase is scored from the level tables by joins; products are decimals of 38 digits, which
   holds ``1000000 * a * a`` up to counts of 10**16.

A piece is text between two of ``.,;:!?`` and line ends, a word is ``[^\x20\x09]+`` of a piece, A-Z in lower case. Phrases don't cross pieces.

Defined results: texts count whole, however long; a null or empty text has no words; a null language is ``und``; repeated rows count as
often as they are there; ties of score and count go by the phrase's UTF-8 bytes; an empty table gives an empty result; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch
from folioflow.llm import membership

SCORE = "(1000000BD * (cast(a AS decimal(16, 0)) * cast(a AS decimal(16, 0)))) div (cast(l AS decimal(16, 0)) * cast(r AS decimal(16, 0)))"
#: Parts of a language that are ranked apart before the best of each are ranked together.
RANKED_APART = 32
#: Bytes of text that are counted together; a longer text is counted alone.
SLICE = 1 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Of each byte: 0 in a word, 1 between words, 2 between pieces; and the byte in lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of ``texts`` (no nulls), the row of each, and whether the next word follows in the same piece."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kind = KIND[raw]
    inside = kind == 0
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[bounds[:-1]] = True
    start = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    kept = LOWER[raw[inside]]
    place = np.cumsum(inside)  # letters up to each byte, itself included
    offsets = np.concatenate([place[start] - 1, [len(kept)]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    row = np.searchsorted(bounds, start, "right") - 1
    breaks = np.cumsum(kind == 2)
    follows = np.zeros(len(start), bool)
    follows[:-1] = (breaks[start[1:]] == breaks[start[:-1]]) & (row[1:] == row[:-1])
    return words, row, follows


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if k > at and size + (n or 0) > SLICE:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _counted(batches: Iterator[pa.RecordBatch], k: int, bits: Callable[[], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of ``k`` words whose two parts of ``k - 1`` words have a bit, by slice."""
    for batch in batches:
        for part in _slices(batch):
            words, row, follows = words_of(pc.fill_null(part.column("text"), ""))
            langs = part.column("lang").dictionary_encode()
            coded = words.dictionary_encode()
            names, seeds = coded.dictionary, _hashes(langs.dictionary)
            # a word of a language has a code of its own; `own` and `of` are its places in `names` and `langs`
            lang = langs.indices.to_numpy()[row].astype(np.int64)
            pairs, code = np.unique(lang * len(names) + coded.indices.to_numpy(), return_inverse=True)
            own, of = pairs % max(len(names), 1), pairs // max(len(names), 1)
            with np.errstate(over="ignore"):
                hashes = _mix(_hashes(names)[own] * _M1 + seeds[of])[code]
                starts = np.ones(len(code), bool)
                for j in range(k - 1):
                    starts[: len(code) - j] &= follows[j:]
                    starts[len(code) - j :] = False
                first = np.flatnonzero(starts)
                if k > 1:
                    shorter = _joined(hashes, np.arange(len(code) - k + 2), k - 1)
                    known = membership.has(bits(), shorter)
                    first = first[known[first] & known[first + 1]]
                gram = code[first]
                for j in range(1, k):
                    _, gram = np.unique(gram * len(own) + code[first + j], return_inverse=True)
                _, sample, count = np.unique(gram, return_index=True, return_counts=True)
                at = first[sample]
                found = _joined(hashes, at, k)
            if len(at):
                parts = [names.take(pa.array(own[code[at + j]])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of[code[at]])), phrase, pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "phrase", "hash", "f"])


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


def _joined(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each place on."""
    out = hashes[at]
    for j in range(1, k):
        out = _mix(out * _M1 + hashes[at + j])
    return out


def level(docs: DataFrame, k: int, frequent: DataFrame | None = None) -> DataFrame:
    """``(lang, phrase, hash, f)`` of phrases of ``k`` words of ``docs(lang, text)``, whose parts ``frequent(hash)`` may have."""
    if frequent is None:
        bits = lambda: None
    else:
        sent = docs.sparkSession.sparkContext.broadcast(membership.packed(frequent, "hash"))
        bits = lambda: sent.value
    counts = docs.mapInArrow(lambda it: _counted(it, k, bits), "lang string, phrase string, hash long, f long")
    return counts.groupBy("lang", "phrase").agg(F.first("hash").alias("hash"), F.sum("f").alias("f"))


def levels(docs: DataFrame, longest: int, least: int, room: scratch.Room) -> tuple[list[DataFrame], DataFrame]:
    """For each length up to ``longest`` the phrases with a count of ``least`` or more, and ``(lang, n)``, all words."""
    scratch.send_code(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = room.stage(level(docs, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tables = [words.filter(F.col("f") >= least)]
    for k in range(2, longest + 1):
        tables.append(room.stage(level(docs, k, tables[-1].select("hash")).filter(F.col("f") >= least), f"phrases-{k}"))
    return tables, totals


def _cut(phrases: DataFrame, k: int, length: int, tables: list[DataFrame]) -> DataFrame:
    """``phrases(lang, phrase, a)`` of ``length`` words with the counts ``l`` and ``r`` of their first k words and of the rest."""
    words = F.split("phrase", " ")
    split = phrases.withColumn("left", F.array_join(F.slice(words, 1, k), " ")).withColumn("right", F.array_join(F.slice(words, k + 1, length - k), " "))
    first = tables[k - 1].select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = tables[length - k - 1].select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    return split.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).select("lang", "phrase", "a", F.lit(k).alias("k"), "l", "r", F.expr(SCORE).alias("score"))


def _covering(longer: list[DataFrame], length: int) -> DataFrame:
    """``(lang, phrase, most)``: the greatest count of a longer phrase that holds the phrase of ``length`` words."""
    words = F.split("phrase", " ")
    places = F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), lambda at: F.array_join(F.slice(words, at, length), " "))
    held = [table.select("lang", F.explode(places).alias("phrase"), "f") for table in longer]
    return reduce(DataFrame.unionByName, held).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase scores by its least likely cut. One whose words lie in a longer candidate with ``cover`` percent of its count is left out.
    """
    with scratch.Room(docs.sparkSession) as room:
        tables, totals = levels(docs, longest, least, room)
        cuts = []
        for length in range(2, longest + 1):
            phrases = tables[length - 1].select("lang", "phrase", F.col("f").alias("a"))
            if length < longest:
                held = phrases.join(_covering(tables[length:], length), ["lang", "phrase"], "left")
                phrases = held.filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).drop("most")
            cuts += [_cut(phrases, k, length, tables) for k in range(1, length)]
        worst = F.min(F.struct("score", "k", "l", "r")).alias("m")
        best = reduce(DataFrame.unionByName, cuts).groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
        best = room.stage(best, "scored")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        apart = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order))
        best = best.withColumn("rank", apart).filter(F.col("rank") <= top)
        ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        result = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return scratch.stage(result, "collocations")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(scratch.table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), g AS (
  SELECT lang, k, list_slice(ws, i, i + k - 1) AS ws
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY 1, 2, 3
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (
  SELECT lang, k, phrase, ws, f AS a FROM f WHERE k > 1 AND f >= 10
), held AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2
), open AS (
  SELECT c.* FROM c LEFT JOIN held ON c.k = 2 AND c.lang = held.lang AND c.phrase = held.phrase WHERE most IS NULL OR 100 * most < 50 * a
), cut AS (
  SELECT lang, phrase, a, 1 AS cut, ws[1] AS first, array_to_string(ws[2:], ' ') AS rest FROM open
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(ws[1:2], ' '), ws[3] FROM open WHERE k = 3
), s AS (
  SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""
