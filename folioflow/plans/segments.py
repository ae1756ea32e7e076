"""Segments in order, their links, review rules, queues and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.functions.text import short_hash
from folioflow.plans.audits import WORDS_SQL, all_sorted, size_band, word_count
from folioflow.scratch import table

KEY_SQL = "left(sha256(concat_ws('|', 'run', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 24)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, segment_key, role)``: turns as segments of a work."""
    key = short_hash(F.concat_ws("|", F.lit("run"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), 24)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("segment_key"), "role")


@query(
    "segment_links",
    f"""
    SELECT conv_id, segment_key, CAST(row_number() OVER w AS INTEGER) AS segment_order, coalesce(lead(segment_key) OVER w, 'end-of-work') AS next_segment, coalesce(lead(turn) OVER w, -1) AS end_exclusive
    FROM (SELECT *, {KEY_SQL} AS segment_key FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    """,
)
def segment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment ends where the next one starts."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return segments(spark, sf_dir).select(
        "conv_id", "segment_key", F.row_number().over(w).alias("segment_order"), F.coalesce(F.lead("segment_key").over(w), F.lit("end-of-work")).alias("next_segment"), F.coalesce(F.lead("turn").over(w), F.lit(-1)).alias("end_exclusive")
    )


@query(
    "continuity_invariants",
    f"""
    WITH s AS (SELECT *, {KEY_SQL} AS segment_key FROM conversations), n AS (SELECT conv_id, turn, role, segment_key, lead(segment_key) OVER (PARTITION BY conv_id ORDER BY turn) AS next_key FROM s)
    SELECT n.segment_key, s.conv_id = n.conv_id AND s.turn = n.turn + 1 AND s.segment_key <> n.segment_key AS continuous, s.role <> n.role AS alternates FROM n JOIN s ON n.next_key = s.segment_key
    """,
)
def continuity_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a segment's successor belongs to its work and follows at once."""
    now = segments(spark, sf_dir).withColumn("next_key", F.lead("segment_key").over(W.partitionBy("conv_id").orderBy("turn")))
    after = segments(spark, sf_dir).toDF("work", "at", "key", "speaker")
    rows = now.join(after, F.col("next_key") == F.col("key"))
    ok = (F.col("work") == F.col("conv_id")) & (F.col("at") == F.col("turn") + 1) & (F.col("key") != F.col("segment_key"))
    return rows.select("segment_key", ok.alias("continuous"), (F.col("speaker") != F.col("role")).alias("alternates"))


REASONS_SQL = f"""
    SELECT doc_id, source, list_sort(list_filter([CASE WHEN w > 1200 THEN 'oversized' END, CASE WHEN w < 25 THEN 'undersized' END, CASE WHEN l.doc_id IS NULL THEN 'no-decision' END,
      CASE WHEN quality = 0 THEN 'structural' END, CASE WHEN toxic = 1 THEN 'boundary' END, CASE WHEN lang <> 'en' THEN 'metadata' END], lambda r: r IS NOT NULL)) AS reasons
    FROM (SELECT doc_id, source, lang, {WORDS_SQL} AS w FROM documents) d LEFT JOIN labels l USING (doc_id)
"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, reasons)``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", word_count().alias("w"))
    rows = docs.join(table(spark, sf_dir, "labels").withColumn("decided", F.lit(True)), "doc_id", "left")
    rules = [("oversized", F.col("w") > 1200), ("undersized", F.col("w") < 25), ("no-decision", F.col("decided").isNull()), ("structural", F.col("quality") == 0), ("boundary", F.col("toxic") == 1), ("metadata", F.col("lang") != "en")]
    found = F.array(*(F.when(rule, name) for name, rule in rules))
    return rows.select("doc_id", "source", F.array_sort(F.filter(found, lambda r: r.isNotNull())).alias("reasons"))


@query("review_reasons", REASONS_SQL)
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir)


#: Reasons by priority, the lowest first, and what they ask for.
DISPOSITIONS = (("structural", "structural-review", 0), ("boundary", "boundary-review", 1), ("oversized", "size-review", 2), ("undersized", "size-review", 3))

TRIAGE_SQL = f"""
    SELECT doc_id, source, CASE WHEN list_contains(reasons, 'structural') THEN 'structural-review' WHEN list_contains(reasons, 'boundary') THEN 'boundary-review'
      WHEN list_contains(reasons, 'oversized') OR list_contains(reasons, 'undersized') THEN 'size-review' ELSE 'defer' END AS disposition,
      CASE WHEN list_contains(reasons, 'structural') THEN 0 WHEN list_contains(reasons, 'boundary') THEN 1 WHEN list_contains(reasons, 'oversized') THEN 2 WHEN list_contains(reasons, 'undersized') THEN 3 ELSE 4 END AS priority
    FROM ({REASONS_SQL}) WHERE len(reasons) > 0
"""


@query("triage", TRIAGE_SQL)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a section's reasons ask for, the weightiest first; those of metadata only are deferred."""
    what, priority = F.lit("defer"), F.lit(4)
    for reason, disposition, rank in reversed(DISPOSITIONS):
        has = F.array_contains("reasons", reason)
        what, priority = F.when(has, disposition).otherwise(what), F.when(has, rank).otherwise(priority)
    return reasons(spark, sf_dir).filter(F.size("reasons") > 0).select("doc_id", "source", what.alias("disposition"), priority.alias("priority"))


@query(
    "batches",
    f"""
    SELECT doc_id, printf('p%d-%s-batch-%02d', priority, source, CAST(ceil(row_number() OVER (PARTITION BY priority, source ORDER BY doc_id) / 25.0) AS INTEGER)) AS batch
    FROM ({TRIAGE_SQL}) WHERE disposition <> 'defer'
    """,
)
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 within priority and book."""
    number = F.ceil(F.row_number().over(W.partitionBy("priority", "source").orderBy("doc_id")) / 25).cast("int")
    name = F.format_string("p%d-%s-batch-%02d", F.col("priority"), F.col("source"), number)
    return triage(spark, sf_dir).filter("disposition <> 'defer'").select("doc_id", name.alias("batch"))


COVERAGE_SQL = """
    SELECT p_partkey, CASE WHEN n = 0 THEN 'missing' WHEN split > 0 THEN 'split' WHEN review > 0 THEN 'review' WHEN n > 1 THEN 'multiple' ELSE 'covered' END AS status FROM (
      SELECT p_partkey, count(l_partkey) AS n, count(*) FILTER (WHERE l_quantity > 45) AS split, count(*) FILTER (WHERE l_returnflag = 'R') AS review FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 45).alias("split"), F.count_if(F.col("l_returnflag") == "R").alias("review")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left").fillna(0)
    status = F.when(F.col("n") == 0, "missing").when(F.col("split") > 0, "split").when(F.col("review") > 0, "review").when(F.col("n") > 1, "multiple").otherwise("covered")
    return rows.select("p_partkey", status.alias("status"))


@query("coverage_status", COVERAGE_SQL)
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir)


#: Counts from which on a book is reconstructed as a whole.
FULL = {"split": 25, "review": 10, "missing": 20}


@query(
    "strategy",
    f"""
    SELECT source, CASE WHEN split >= 25 OR review >= 10 OR missing >= 20 THEN 'full-staging-reconstruction' WHEN split + review + missing > 0 THEN 'targeted-staging-reconstruction' ELSE 'metadata-alignment' END AS strategy FROM (
      SELECT source, count(*) FILTER (WHERE list_contains(reasons, 'oversized')) AS split, count(*) FILTER (WHERE list_contains(reasons, 'boundary')) AS review,
             count(*) FILTER (WHERE list_contains(reasons, 'no-decision')) AS missing FROM ({REASONS_SQL}) GROUP BY source)
    """,
)
def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reasons(spark, sf_dir).groupBy("source").agg(*(F.count_if(F.array_contains("reasons", r)).alias(n) for r, n in (("oversized", "split"), ("boundary", "review"), ("no-decision", "missing"))))
    split, review, missing = F.col("split"), F.col("review"), F.col("missing")
    full = (split >= FULL["split"]) | (review >= FULL["review"]) | (missing >= FULL["missing"])
    plan = F.when(full, "full-staging-reconstruction").when(split + review + missing > 0, "targeted-staging-reconstruction").otherwise("metadata-alignment")
    return counts.select("source", plan.alias("strategy"))


@query(
    "band_counts",
    f"""
    SELECT source, count(*) FILTER (WHERE band = 'brief') AS brief, count(*) FILTER (WHERE band = 'standard') AS standard, count(*) FILTER (WHERE band IN ('long', 'oversized')) AS large FROM (
      SELECT source, CASE WHEN w <= 0 THEN 'unknown' WHEN w <= 450 THEN 'brief' WHEN w <= 1200 THEN 'standard' WHEN w <= 2500 THEN 'long' ELSE 'oversized' END AS band FROM (SELECT source, {WORDS_SQL} AS w FROM documents)) GROUP BY source
    """,
)
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", size_band(word_count()).alias("band"))
    return rows.groupBy("source").agg(F.count_if(F.col("band") == "brief").alias("brief"), F.count_if(F.col("band") == "standard").alias("standard"), F.count_if(F.col("band").isin("long", "oversized")).alias("large"))


@query(
    "book_index",
    "SELECT r_name AS part, n_name AS chapter, list_sort(list(s_suppkey)) AS sections FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
)
def book_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections by part and chapter; ``reading_index`` numbers sections, a row each."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy(F.col("r_name").alias("part"), F.col("n_name").alias("chapter")).agg(all_sorted("s_suppkey").alias("sections"))


TREE_SQL = "t AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CASE WHEN turn > 0 THEN CAST(conv_id * 1000 + floor((turn - 1) / 2) AS BIGINT) END AS parent FROM conversations)"


@query(
    "descendants",
    f"WITH RECURSIVE {TREE_SQL}, r AS (SELECT id AS root, id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT root, t.id, depth + 1 FROM r JOIN t ON t.parent = r.id) SELECT root, id, depth FROM r",
)
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes below each root of a forest (turn n hangs below turn (n - 1) / 2)."""
    turns = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, (F.col("conv_id") * 1000 + F.floor((F.col("turn") - 1) / 2)).cast("long"))
    return below(turns.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), parent.alias("parent")))


def below(tree: DataFrame) -> DataFrame:
    """``tree(id, parent)`` -> ``(root, id, depth)``, by a recursive query."""
    return tree.sparkSession.sql(
        "WITH RECURSIVE r(root, id, depth) AS (SELECT id, id, 0 FROM {tree} WHERE parent IS NULL UNION ALL SELECT r.root, t.id, r.depth + 1 FROM r JOIN {tree} t ON t.parent = r.id) SELECT root, id, depth FROM r",
        tree=tree,
    )
