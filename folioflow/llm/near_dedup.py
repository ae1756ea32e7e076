r"""Near-duplicate documents by HyperMinHash, confirmed on whole shingle sets.

1. Each document's distinct shingles are hashed to 64 bits. The upper bits choose one of ``REGISTERS`` buckets; a
   bucket keeps its least value as a count of leading zeros and ``MANTISSA`` bits after the leading one. An
   empty bucket takes the register of one that isn't, the first in an order of its own.
2. Documents with the same set are one class, known by its least doc_id. Only class representatives go on.
3. Bands of six registers are hashed to 42 keys. Two sets with a Jaccard similarity of 0.85 share none of them
   with a probability of about 2e-9.
4. In each group of documents that share a key, all are compared with one leader, the document that meets
   the most others in all groups, so a large group of copies costs as many comparisons as it has members.
   Such a comparison drops pairs by the bound on their sizes and by the estimate from registers, corrected for chance
   collisions and with a margin of six standard deviations, and confirms the rest on the whole sets.
5. Documents of groups that are still unconnected are compared exactly. Of the shingles of each, rarest first, only a
   prefix must be looked at: two sets with the similarity asked for share one of it. Documents that share one make
   a family, so what is common to many documents joins none. A family is cut into blocks of bounded size, and two
   blocks are compared within a task, with those documents of each that share a prefix shingle with the other; only links leave it.
6. Components are found by joins (``graph.components``).

Texts are read twice, for sketches and for the sets of documents that share a key, and never shuffled: a bitmap of fixed
size tells which documents those are (``membership``). Intermediate tables are deleted before the result is returned.

Defined results: texts count whole, however long; columns of any names are carried by ``kept_documents``; words are `[^\x20\x09-\x0D]+` with A-Z in lower case; a document of fewer words than a shingle is
one shingle; one without words, or null, has 0 shingles and is linked with nothing; rows with one doc_id
are one document whose links are those of all its rows; a row without a doc_id has no component and is
kept; repeated rows and ties give the least doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import scratch
from folioflow.llm import membership
from folioflow.llm.graph import components

REGISTERS = 252
MANTISSA = 10


@dataclass(frozen=True)
class Measure:
    """Words of a shingle, the least Jaccard similarity in percent, and registers of a band."""

    shingle: int = 3
    percent: int = 85
    width: int = 6

    @property
    def bands(self) -> int:
        return REGISTERS // self.width

    @property
    def least(self) -> float:
        """The estimate that is kept: six standard deviations below the threshold."""
        j = self.percent / 100
        return j - 6 * (j * (1 - j) / REGISTERS) ** 0.5


#: What a stage of a pipeline takes; with 0.8, no key is shared with a probability of about 2e-9.
FIVE_WORDS = Measure(5, 80, 5)


#: Rows that are hashed together.
SLICE = 256

EVERY = np.arange(REGISTERS)
#: For each bucket a fixed order of all: an empty one takes the register of the first that isn't, so that
#: another value changes only those that prefer it.
PREFERENCE = np.random.default_rng(7).permuted(np.tile(EVERY.astype(np.uint8), (REGISTERS, 1)), axis=1)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the bounds of each text in them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), offsets


def shingle_sets(column: pa.Array, shingle: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = _word_hashes(column)
    with np.errstate(over="ignore"):
        rolled = np.full(max(0, len(words) - shingle + 1), shingle, np.uint64)
        for k in range(shingle):
            rolled = _mix(rolled * _M1 + words[k : len(words) - shingle + 1 + k])
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= shingle:
                yield np.unique(rolled[a : b - shingle + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    whole = _mix(whole * _M1 + w)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of sorted distinct hashes, at least one."""
    scaled = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    mantissa, exponent = np.frexp((scaled[first] & np.uint64(0xFFFFFFFF)).astype(np.float64))
    values = ((32 - exponent) << MANTISSA) + ((mantissa - 0.5) * (2 << MANTISSA)).clip(0).astype(np.int64)
    filled = bucket[first]
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = values
    empty = np.setdiff1d(EVERY, filled, assume_unique=True)
    if len(empty):
        out[empty] = values[PREFERENCE[np.ix_(empty, filled)].argmin(axis=1)]
    return out


def band_keys(sketches: np.ndarray, how: Measure) -> np.ndarray:
    """Keys of each row of registers, by band."""
    rows = sketches[:, : how.bands * how.width].reshape(len(sketches), how.bands, how.width).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, how.bands + 1, dtype=np.uint64), rows.shape[:2])
        for k in range(rows.shape[2]):
            keys = _mix(keys * _M1 + rows[:, :, k])
    return keys.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], how: Measure) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sizes, one, two, sketches, full = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(part.column("text"), how.shingle):
                    sizes.append(len(s))
                    one.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                    two.append(np.add.reduce(_mix(s + _M1)) if len(s) else np.uint64(0))
                    full.append(len(s) > 0)
                    if len(s):
                        sketches.append(registers(s))
            keys = iter(band_keys(np.array(sketches), how).tolist()) if sketches else iter(())
            stored = iter(sketches)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.array([next(keys) if x else None for x in full], pa.list_(pa.int64())), pa.array([next(stored).astype("<u2").tobytes() if x else None for x in full], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_one", "set_two", "bands", "registers"],
            )


def sketches(docs: DataFrame, how: Measure = Measure()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _sketched(it, how), "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>, registers binary")


def _sets(batches: Iterator[pa.RecordBatch], how: Measure) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), how.shingle)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), values], ["node", "hashes"])


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Columns of a matrix; shingles of a block from which a family is cut, up to so many blocks; shingles and documents of a
#: block at most.
COLUMNS, SPREAD, BLOCKS, BLOCK, ROWS = 4096, 16_000, 24, 500_000, 2048
#: Counters that tell how rare a shingle is, a fixed number; shingles that share one count together.
COUNTERS = 1 << 20

#: That two different values fall on one register: the chance of equal leading zeros, then of equal mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA)


def _likely(batches: Iterator[pa.RecordBatch], how: Measure) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, REGISTERS) for c in ("x", "y"))
            alike = (x == y).mean(axis=1)
            keep = (alike - COLLISION) / (1 - COLLISION) >= how.least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def confirmed(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, how: Measure, room: scratch.Room) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are as similar as asked."""
    small = sketch.select("node", "n_shingles", "registers")
    sized = pairs.join(small.toDF("a", "na", "x"), "a").join(small.toDF("b", "nb", "y"), "b").filter(f"100 * least(na, nb) >= {how.percent} * greatest(na, nb)")
    likely = room.stage(sized.select("a", "b", "x", "y").mapInArrow(lambda it: _likely(it, how), "a long, b long").distinct(), "likely")
    both = likely.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("sum")).filter(f"100 * common >= {how.percent} * (sum - common)").select("a", "b").distinct()


def _compared(table: pa.Table, how: Measure) -> pa.Table:
    """Links between the documents of two blocks, or within one; ``side`` is 0 or 1, or 2 for both.

    Shingles that both sides have become columns of 0/1 matrices, whose product has the sizes of all intersections.
    """
    side = table.column("side").to_numpy()
    sets = table.column("hashes").combine_chunks()
    lengths = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return PAIRS.empty_table()
    place = [np.full(len(lengths), -1), np.full(len(lengths), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    used = np.ones(code.max() + 1, bool)
    for p in place:
        used &= np.bincount(code[p[owner] >= 0], minlength=len(used)) > 0
    column = np.cumsum(used) - 1
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(used.sum()), COLUMNS):
        here = used[code] & (column[code] >= at) & (column[code] < at + COLUMNS)
        both = []
        for p, rows in zip(place, (left, right), strict=True):
            mine = here & (p[owner] >= 0)
            m = np.zeros((len(rows), COLUMNS), np.float32)
            m[p[owner[mine]], column[code[mine]] - at] = 1
            both.append(m)
        common += (both[0] @ both[1].T).astype(np.int64)
    node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
    union = lengths[left][:, None] + lengths[right][None, :] - common
    x, y = np.nonzero((100 * common >= how.percent * union) & (part[left][:, None] != part[right][None, :]))
    return pa.table([node[left[x]], node[right[y]]], PAIRS)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of how many of its n shingles, in an order that all share, a set must show one to any set as similar as asked.

    Such a pair has at least percent * n / 100 shingles in common, so that those cannot all lie behind the prefix.
    """
    return n - (n * percent + 99) // 100 + 1


def _prefixes(batches: Iterator[pa.RecordBatch], how: Measure, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, shingles = [], []
        for node, own in zip(batch.column("node").to_pylist(), batch.column("hashes"), strict=True):
            values = own.values.to_numpy()
            order = np.lexsort((values, counts[values % COUNTERS]))
            first = values[order[: prefix_length(len(values), how.percent)]]
            nodes.append(np.full(len(first), node, np.int64))
            shingles.append(first)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(shingles))], ["node", "shingle"])


def _shared_prefixes(rest: DataFrame, sets: DataFrame, how: Measure, room: scratch.Room) -> DataFrame:
    """``(shingle, first, node, n_shingles, part)``: documents of ``rest`` by the rare shingles that they share with one of another part; first is the least of them."""
    slots = sets.select(F.explode("hashes").alias("h")).select(F.pmod("h", F.lit(COUNTERS)).alias("slot"))
    counts = np.zeros(COUNTERS, np.int64)
    seen = slots.groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # at most COUNTERS rows
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    sent = rest.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
    found = room.stage(sets.mapInArrow(lambda it: _prefixes(it, how, sent.value), "node long, shingle long"), "prefixes").join(rest.select("node", "n_shingles", "part"), "node")
    found = room.stage(found, "prefix-parts")
    shared = found.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("first")).filter("lo < hi").select("shingle", "first")
    return room.stage(found.join(room.stage(shared, "prefix-groups"), "shingle"), "shared-prefixes")


def _reached(prefixes: DataFrame, placed: DataFrame, how: Measure, room: scratch.Room) -> DataFrame:
    """``(node, other)``: the blocks in which a document of another part, and of a size that fits, has one of the node's prefix shingles.

    Both documents of any link reach each other's block, and a set is sent to no other blocks.
    """
    rows = room.stage(prefixes.select("shingle", "node", "n_shingles", "part").join(placed.select("node", "own").distinct(), "node"), "placed-prefixes")
    there = rows.groupBy("shingle", F.col("own").alias("other")).agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    met = rows.join(room.stage(there, "shingle-blocks"), "shingle").filter(f"(lo <> part OR hi <> part) AND 100 * n_shingles >= {how.percent} * least AND 100 * most >= {how.percent} * n_shingles")
    return room.stage(met.select("node", "other").distinct(), "reached")


def _within_families(rest: DataFrame, sets: DataFrame, how: Measure, room: scratch.Room) -> DataFrame:
    """Links between documents of ``rest(node, n_shingles, part)``, which are not yet connected."""
    sets = room.stage(sets.join(rest.select("node"), "node", "left_semi"), "open-sets")
    prefixes = _shared_prefixes(rest, sets, how, room)
    family = components(prefixes.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = rest.join(family, "node", "left").withColumn("family", F.coalesce("component", "node")).drop("component")
    nodes = room.stage(nodes, "families")
    size = F.sum("n_shingles")
    count = F.greatest(F.least(F.ceil(size / SPREAD), F.lit(BLOCKS)), F.ceil(size / BLOCK), F.ceil(F.count("*") / ROWS), F.lit(1)).cast("int")
    blocks = room.stage(nodes.groupBy("family").agg(count.alias("blocks"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("family", "blocks"), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = room.stage(nodes.join(blocks, "family").withColumn("own", own), "placed")
    cut = placed.join(_reached(prefixes, placed, how, room), "node")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cut = cut.select("node", "part", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"))
    return cut.join(sets, "node").groupBy("family", "x", "y").applyInArrow(lambda t: _compared(t, how), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, how: Measure = Measure()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``."""
    with scratch.Room(docs.sparkSession) as room:
        return scratch.stage(_near_duplicates(docs, how, room), "near-duplicates")


def _near_duplicates(docs: DataFrame, how: Measure, room: scratch.Room) -> DataFrame:
    scratch.send_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = room.stage(sketches(docs, how), "sketches")
    named = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same_set = ["set_one", "set_two", "n_shingles"]
    classes = room.stage(named.groupBy(*same_set).agg(F.min("doc_id").alias("rep")), "classes")
    members = room.stage(named.select("doc_id", *same_set).join(classes, same_set).select("doc_id", "n_shingles", "rep"), "members")
    links = _same_id(members)

    reps = members.filter("doc_id = rep").select("doc_id").distinct()
    sketch = room.stage(named.join(reps, "doc_id", "left_semi").withColumnRenamed("doc_id", "node"), "rep-sketches")
    rows = sketch.select("node", F.explode("bands").alias("key"))
    shared = room.stage(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", "n"), "shared-keys")
    groups = room.stage(rows.join(shared, "key"), "groups")
    met = room.stage(groups.groupBy("node").agg(F.sum("n").alias("met")), "met")
    sketch = room.stage(sketch.drop("bands", "set_one", "set_two").join(met, "node"), "met-sketches")
    bits = room.stage(membership.bitmap(met, "node"), "met-bits")
    likely = membership.marked(docs.withColumnRenamed("doc_id", "node"), "node", bits, "maybe").filter("maybe").select("node", "text")
    sets = room.stage(likely.mapInArrow(lambda it: _sets(it, how), "node long, hashes array<long>"), "sets")

    groups = room.stage(groups.join(sketch.select("node", "n_shingles", "met"), "node").distinct(), "sized-groups")
    leaders = room.stage(groups.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("less"))).alias("m")).select("key", (-F.col("m.less")).alias("leader"), F.col("m.met").alias("rank")), "leaders")
    stars = groups.join(leaders, "key").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("shared"), F.max("rank").alias("rank"))
    best = stars.groupBy("node").agg(F.max(F.struct("shared", "rank", (-F.col("leader")).alias("less"))).alias("m"))
    tried = room.stage(best.select(F.least("node", -F.col("m.less")).alias("a"), F.greatest("node", -F.col("m.less")).alias("b")).distinct(), "stars")
    links = room.stage(links.unionByName(confirmed(tried, sketch, sets, how, room)), "confirmed")

    parts = components(links)
    open_rows = room.stage(groups.join(parts, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("part")), "parts-of-groups")
    open_keys = open_rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    rest = room.stage(open_rows.join(room.stage(open_keys, "open-keys"), "key").select("node", "n_shingles", "part").distinct(), "open")
    links = room.stage(links.unionByName(_within_families(rest, sets, how, room)), "all-links")
    parts = components(links)

    found = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = every.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(members: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi").select("doc_id", "a")
    return members.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def kept_documents(docs: DataFrame, how: Measure = FIVE_WORDS) -> DataFrame:
    """``docs`` with one document of each component, and those without an id."""
    gone = scratch.stage(near_duplicates(docs, how).filter("NOT kept").select(F.col("doc_id").alias("gone_")).distinct(), "gone")
    return membership.without(docs, F.col("doc_id").cast("long"), gone)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(scratch.table(spark, sf_dir, "documents"))
