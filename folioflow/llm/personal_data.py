r"""Personal data by bootstrapped contextual extraction.

Strict forms of four kinds (e-mail, IP address, card, phone) are the base spans and the seeds. Looser forms, such
as a number of digits that passes no check or a spelled-out address, are candidates of the kinds that they look like, and any other
token with a digit or an at sign is one of all kinds: the patterns that it stands in tell its kind. The words beside an
occurrence are lexical patterns: the word before, the two words before, and the word after. Patterns and
instances make a graph, which Spark scores in rounds: a pattern's score for a kind is the sum of its instances'
confidence in it over the number of all its instances plus ``DOUBT``; a candidate's confidence in a kind
that its form allows is that at least one of its patterns is right. A pattern counts once it has ``SUPPORT`` seeds or
candidates above ``SURE``, so that what is found induces further patterns, until none is added. Candidates that end
above ``SURE`` are added, wherever they occur; base spans always stay.

Defined results: a null or empty text has no spans; rows that share doc_id and text have equal spans; spans are in
the order of kinds, then of starts, in code points; counts are of base spans, ``n_spans`` of all; texts are searched whole,
however long; an empty table gives an empty result; further columns, of any names, don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DOUBT, SURE, SUPPORT = 3, 2.0, 0.8, 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starting after a non-digit and not giving digits back finds the same as trying each digit.
DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

#: Loose forms and the kinds that they may be.
LOOSE = (
    (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){0,8}"), ("email",)),
    (re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), ("ip",)),
    (re.compile(r"(?<![0-9A-Za-z+])[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"), ("card", "phone")),
    # Any other token with a digit or an at sign; only the contexts that it stands in can tell its kind.
    (re.compile(r"(?<!\S)[(\"'<\[]?(?=\S{0,63}[0-9@])[^\s,;]{5,63}[^\s.,;:!?)\"'>\]](?=[.,;:!?)\"'>\]]*(?:\s|$))"), KINDS),
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms, in order."""
    found: list[tuple[int, int, int]] = []
    last = 0
    for m in HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in DOTTED.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NO_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in PLUS.finditer(text) if "+" in text else ():
        if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
            found.append((3, *m.span()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[tuple[str, ...], int, int]]:
    """(kinds, start, end) of loose forms that touch no base span, nor one of an earlier form."""
    out: list[tuple[tuple[str, ...], int, int]] = []
    taken = _merged((a, b) for _, a, b in base)
    for pattern, kinds in LOOSE:
        if kinds == ("email",) and "@" not in text and "at)" not in text and "at]" not in text or kinds == ("ip",) and ":" not in text:
            continue
        starts, found = [a for a, _ in taken], []
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.end())
            if not k or taken[k - 1][1] <= m.start():
                found.append((kinds, *m.span()))
        out += found
        taken = _merged([*taken, *((a, b) for _, a, b in found)])
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, those that overlap as one, so that ends rise with starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns beside a span; words are cut at 40 characters."""
    before = text[max(0, start - 100) : start].lower().split()[-2:]
    after = text[end : end + 50].lower().split()[:1]
    found = [f"L {before[-1][-40:]}"] if before else []
    if len(before) == 2:
        found.append(f"LL {before[0][-40:]} {before[1][-40:]}")
    return found + [f"R {after[0][:40]}" for _ in after]


SPAN = pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
SEEN = pa.struct([("instance", pa.int64()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("first", pa.int32()), ("last", pa.int32()), ("patterns", pa.list_(pa.string()))])
FOUND = "doc_id {}, key_ long, base array<struct<kind:int,first:int,last:int>>, seen array<struct<instance:long,seed:int,kinds:array<int>,first:int,last:int,patterns:array<string>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, seen = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spots = [(kind, [kind], a, b) for kind, a, b in base] + [(None, [KINDS.index(k) for k in kinds], a, b) for kinds, a, b in candidates(text, base)]
            bases.append([{"kind": k, "first": a, "last": b} for k, a, b in base])
            seen.append([{"instance": xxhash.xxh64_intdigest(text[a:b].lower().encode()) - (1 << 63), "seed": k, "kinds": kinds, "first": a, "last": b, "patterns": contexts(text, a, b)} for k, kinds, a, b in spots])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key_"), pa.array(bases, pa.list_(SPAN)), pa.array(seen, pa.list_(SEEN))], ["doc_id", "key_", "base", "seen"])


def confident(edges: DataFrame) -> DataFrame:
    """``(instance, kind)`` of the candidates that the graph is sure of.

    ``edges(pattern, instance, seed, kinds)`` are distinct. Each round is two grouped sums, one by pattern and one by instance.
    Neither scores nor confidences fall from round to round, so that rounds end when no pattern and no sure instance is added.
    """
    patterns = scratch.stage(edges.groupBy("pattern").agg(F.count_distinct("instance").alias("size")), "patterns")
    open_edges = edges.filter("seed IS NULL").select("pattern", "instance", F.explode("kinds").alias("kind")).distinct()
    strict = edges.filter("seed IS NOT NULL").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count_distinct("instance").alias("seeds"))
    believed, before, rounds = None, -1, 0
    while True:
        support = strict.withColumns({"more": F.lit(0.0), "sure": F.lit(0)})
        if believed is not None:
            held = open_edges.join(believed, ["instance", "kind"]).groupBy("pattern", "kind")
            held = held.agg(F.sum("confidence").alias("more"), F.count_if(F.col("confidence") >= SURE).alias("sure"))
            support = strict.join(held, ["pattern", "kind"], "full").fillna(0, ["seeds", "more", "sure"])
        scored = support.filter(F.col("seeds") + F.col("sure") >= SUPPORT).join(patterns, "pattern")
        scored = scratch.stage(scored.select("pattern", "kind", ((F.col("seeds") + F.col("more")) / (F.col("size") + DOUBT)).alias("score")), "scored")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        believed = scratch.stage(open_edges.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - doubt).alias("confidence")), "believed")
        known, rounds = (scored.count(), believed.filter(F.col("confidence") >= SURE).count()), rounds + 1
        if rounds >= ROUNDS and known == before:
            break
        before = known
    best = believed.filter(F.col("confidence") >= SURE).groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("less"))).alias("m"))
    return best.select("instance", (-F.col("m.less")).cast("int").alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` for each row of ``docs``, both as sorted arrays of (kind, first, last)."""
    scratch.send_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key_"), "text")
    found = scratch.stage(keyed.mapInArrow(_found, FOUND.format(kind)), "found")
    seen = found.select("doc_id", "key_", F.explode("seen").alias("s"))
    edges = scratch.stage(seen.select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.seed", "s.kinds").distinct(), "edges")
    sure = scratch.stage(confident(edges), "sure")
    spots = seen.filter("s.seed IS NULL").select("doc_id", "key_", "s.instance", "s.first", "s.last").distinct().join(sure, "instance")
    more = spots.groupBy("doc_id", "key_").agg(F.collect_set(F.struct("kind", "first", "last")).alias("more")).withColumnsRenamed({"doc_id": "id_", "key_": "k_"})
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left")
    none = F.array().cast("array<struct<kind:int,first:int,last:int>>")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _written(column: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"].cast("string"), s["last"].cast("string"))), ",")


def _is(kind: int):
    return lambda span: span["kind"] == kind


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(scratch.table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
