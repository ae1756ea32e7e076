r"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame and SQL functions only).

Sources in code point order, null last, weigh 5, 2, 1 and so on in turn. Together they get as many words as
the corpus has; no source gets over three times its own words, and what it can't take is shared by weight
among the others. A source's target is made of complete epochs, then of a fraction: documents in the order
of -ln(u) / weight, u a hash of the doc_id and the weight a measure of quality, until their words, summed up
in that order, come nearest to what is left.

The keys of a source are cut into ranges of about the square root of all rows. Words are summed by
range, then ranges by source, so no task gets a whole source however large its share.

Defined results: size is the number of `[^\x20\x09-\x0D]+`, 0 for a null or empty text; texts count whole, however
long; a source without words has target 0; rows that are alike in doc_id, text and source may swap places, which gives
the same rows; an empty table gives an empty result; ``mixed_documents`` keeps all columns of its input, of any names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 6
#: Characters that prose has few of.
SYMBOLS = "#$%&*|!<>{}=^~_@/\\"


def words():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight():
    """From 0.25 to 1: less by three times the share of symbols among the characters."""
    n = F.length("text")
    share = (n - F.length(F.translate("text", SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - share * 3), F.lit(0.25))


def exponential_key(seed: int = SEED):
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) + 0.5) / float(2**53)
    return -F.log(u) / F.col("weight")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources(source, source_size)``, a row each, with target.

    By rising size for their weight, a source is at its limit if its share of what is left among it
    and all later ones would exceed the limit; the others share what is left by weight.
    """
    by_name = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("turn") == k, F.lit(float(w))).otherwise(weight)
    every = W.partitionBy(F.lit(1))
    rising = every.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    known = (
        sources.withColumn("turn", turn).withColumn("share", weight).withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("share"))
        .withColumn("words_left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(rising), zero))
        .withColumn("shares_left", F.sum("share").over(every) - F.coalesce(F.sum("share").over(rising), zero))
        .withColumn("each", F.col("words_left") / F.col("shares_left"))
        .withColumn("full", F.col("each") * F.col("share") >= F.col("limit"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", "source", "each"))).over(every)["each"])
    )
    return known.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("share")).alias("target"))


ORDER = ["key", "doc_id", "size", "content"]


def placed(records: DataFrame) -> DataFrame:
    """``records(doc_id, source, size, weight, content)`` with key, source_size, target, epochs and extra.

    ``extra`` says whether a row is in the fraction: within a source, all rows up to one in ``ORDER`` are.
    """
    sources = records.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = scratch.stage(sources, "sources")
    rows = sources.agg(F.sum("rows")).first()[0] or 0
    ranges = max(1, math.isqrt(rows))
    aims = scratch.stage(targets(sources.select("source", "source_size")), "targets")
    key = F.col("key")
    keyed = records.withColumn("key", exponential_key()).withColumn("range", F.floor(key / (key + 1) * ranges).cast("long"))
    keyed = keyed.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("named", F.col("source").isNotNull())
    group = ["named", "name", "range"]
    before = W.partitionBy("named", "name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ahead = keyed.groupBy(*group).agg(F.sum("size").alias("words")).select(*group, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    within = W.partitionBy(*group).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    ordered = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ahead, group)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNotNull().alias("named"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("int")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        ordered.join(aims, ["named", "name"]).withColumn("epochs", epochs)
        .withColumn("extra", (F.col("epochs") < MOST) & (F.col("ahead") + F.col("before") + F.col("size") / 2 <= left))
        .drop("name", "named", "range", "before", "ahead")
    )


def taken(records: DataFrame) -> DataFrame:
    """``records(doc_id, source, size, weight, content)`` with source_size, target, copies and taken."""
    copies = F.col("epochs") + F.col("extra").cast("int")
    return placed(records).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("key", "epochs", "extra")


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words().alias("size"), quality_weight().alias("weight"), F.xxhash64("text").alias("content"))


#: Sources whose cuts are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def cuts(records: DataFrame) -> DataFrame:
    """``(source_, epochs, cut, alike, among)``, a row for each source.

    ``cut`` is the last row of the fraction, null if there is none; of ``alike`` rows that equal it, ``among`` are in.
    """
    rows = scratch.stage(placed(records).select("source", "epochs", "extra", F.struct(*ORDER).alias("at")), "placed")
    last = rows.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("extra"), F.col("at"))).alias("cut"))
    last = scratch.stage(last.withColumnRenamed("source", "source_"), "last")
    equal = rows.join(last, F.col("source").eqNullSafe(F.col("source_")) & (F.col("at") == F.col("cut"))).groupBy("source").agg(F.count("*").alias("alike"), F.count_if("extra").alias("among"))
    equal = equal.withColumnRenamed("source", "name")
    return last.join(equal, F.col("source_").eqNullSafe(F.col("name")), "left").drop("name")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Texts are not shuffled: in each source one row cuts off the fraction, and rows are told by comparing with it. Only of
    rows that equal that one in all but further columns, and of which a part is taken, each gets a number.
    """
    records = scratch.stage(measured(docs), "records")
    of = scratch.stage(cuts(records), "cuts")
    if of.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").alias("own"), words().alias("size"), quality_weight().alias("weight"), F.xxhash64("text").alias("content"))
    rows = rows.select("row", "own", F.struct(exponential_key().alias("key"), "doc_id", "size", "content").alias("at"))
    told = rows.join(of, F.col("own").eqNullSafe(F.col("source_")))
    partly = F.coalesce((F.col("at") == F.col("cut")) & (F.col("among") < F.col("alike")), F.lit(False))
    extra = F.coalesce(F.col("at") <= F.col("cut"), F.lit(False)).cast("int")
    times = told.filter(~partly).select("row", (F.col("epochs") + extra).alias("times"))
    if of.filter("among < alike").limit(1).count():
        number = F.row_number().over(W.partitionBy("own").orderBy(F.lit(1)))
        some = told.filter(partly).select("row", (F.col("epochs") + (number <= F.col("among")).cast("int")).alias("times"))
        times = times.unionByName(some)
    return times.filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = scratch.stage(measured(scratch.table(spark, sf_dir, "documents")), "records")
    return taken(records).select("doc_id", "size", "source_size", "target", "taken", "source", "weight", "copies")
