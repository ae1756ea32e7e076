"""Data-quality checks, reconciliation and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.catalog import query
from folioflow.operators.lifecycle import event_key, drift, folded_hash, reconciled
from folioflow.operators.tables import check_rows, guarded_update
from folioflow.scratch import table


@query(
    "orphans",
    """
    SELECT 'document-without-label' AS check_key, count(*) AS rows FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'order-without-line', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    """,
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit("document-without-label").alias("check_key"), "rows").unionByName(
        orders.join(lines, "o_orderkey", "left_anti").agg(F.count("*").alias("rows")).select(F.lit("order-without-line").alias("check_key"), "rows")
    )


@query("anti_not_exists", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("semi_exists", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 100000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@query("residual_mismatch", "SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE (lang = 'en') <> (quality = 1)")
def residual_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.filter((F.col("lang") == "en") != (F.col("quality") == 1)).select("doc_id", "lang", "quality")


@query(
    "out_of_range",
    "SELECT d.doc_id, d.lang, n_chars FROM documents d JOIN (SELECT lang, max(n_chars) AS most FROM documents x JOIN labels l ON x.doc_id = l.doc_id GROUP BY lang) m ON m.lang = d.lang WHERE n_chars > most",
)
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes beyond the largest of any labelled document of the kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    most = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("lang").agg(F.max("n_chars").alias("most"))
    return docs.join(most, "lang").filter("n_chars > most").select("doc_id", "lang", "n_chars")


@query(
    "dependency_snapshot",
    """
    SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
           (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders,
           (SELECT count(DISTINCT o_orderpriority) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS priorities FROM nation
    """,
)
def dependency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependents of each parent, counted once for each kind and joined."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = [
        customers.groupBy("n_nationkey").agg(F.count("*").alias("customers")),
        table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers")),
        orders.groupBy("n_nationkey").agg(F.count("*").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities")),
    ]
    out = table(spark, sf_dir, "nation").select("n_nationkey")
    for c in counts:
        out = out.join(c, "n_nationkey", "left")
    return out.fillna(0)


@query("tuple_uniqueness", "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS triples FROM lineitem")
def tuple_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("rows"), F.count_distinct(F.struct("l_orderkey", "l_linenumber")).alias("keys"), F.count_distinct(F.struct("l_orderkey", "l_partkey", "l_suppkey")).alias("triples")
    )


@query(
    "contiguity",
    "SELECT conv_id, count(*) AS turns, min(turn) = (SELECT min(turn) FROM conversations) AND max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id",
)
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    first = turns.agg(F.min("turn").alias("first"))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("distinct"))
    whole = (F.col("lo") == F.col("first")) & (F.col("hi") - F.col("lo") + 1 == F.col("turns")) & (F.col("distinct") == F.col("turns"))
    return rows.join(F.broadcast(first)).select("conv_id", "turns", whole.alias("contiguous"))  # one row


CHECKS_SQL = """
    SELECT * , expected = actual AS passed FROM (
      SELECT 'blank-text' AS check_key, 'blocking' AS severity, CAST(0 AS BIGINT) AS expected, (SELECT count(*) FROM documents WHERE trim(text) = '') AS actual
      UNION ALL SELECT 'missing-source', 'blocking', 0, (SELECT count(*) FROM documents WHERE source IS NULL)
      UNION ALL SELECT 'duplicate-id', 'blocking', 0, (SELECT count(*) - count(DISTINCT doc_id) FROM documents)
      UNION ALL SELECT 'negative-size', 'blocking', 0, (SELECT count(*) FROM documents WHERE n_chars < 0)
      UNION ALL SELECT 'size-differs', 'warning', 0, (SELECT count(*) FROM documents WHERE n_chars <> length(text))
      UNION ALL SELECT 'oversized', 'warning', 0, (SELECT count(*) FROM documents WHERE n_chars > 10000)
      UNION ALL SELECT 'languages', 'blocking', 4, (SELECT count(DISTINCT lang) FROM documents))
"""


def document_checks(docs: DataFrame) -> DataFrame:
    """The check relation of sections, from one scan."""
    return check_rows(docs, [
        ("blank-text", "blocking", F.count_if(F.trim("text") == ""), 0), ("missing-source", "blocking", F.count_if(F.col("source").isNull()), 0),
        ("duplicate-id", "blocking", F.count("doc_id") - F.count_distinct("doc_id"), 0), ("negative-size", "blocking", F.count_if(F.col("n_chars") < 0), 0),
        ("size-differs", "warning", F.count_if(F.col("n_chars") != F.length("text")), 0), ("oversized", "warning", F.count_if(F.col("n_chars") > 10000), 0),
        ("languages", "blocking", F.count_distinct("lang"), 4),
    ])


@query("check_suite", CHECKS_SQL)
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_checks(table(spark, sf_dir, "documents"))


@query("gate_status", f"SELECT coalesce(bool_and(CASE WHEN severity = 'blocking' THEN passed ELSE true END), false) AS open, count(*) FILTER (WHERE NOT passed) AS failed FROM ({CHECKS_SQL})")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open if no blocking check fails; closed without checks."""
    blocking = F.bool_and(F.when(F.col("severity") == "blocking", F.col("passed")).otherwise(True))
    return document_checks(table(spark, sf_dir, "documents")).agg(F.coalesce(blocking, F.lit(False)).alias("open"), F.count_if(~F.col("passed")).alias("failed"))


@query(
    "event_keys",
    """
    SELECT event_id, sha256(concat('event-v1', chr(10), 'user=', length(CAST(user_id AS VARCHAR)), ':', user_id, chr(10), 'type=', length(event_type), ':', event_type)) AS event_key FROM events
    """,
)
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", event_key("event-v1", [("user", F.col("user_id")), ("type", F.col("event_type"))]).alias("event_key"))


def _folded(of: str, inner: str, by: int) -> str:
    return f"SELECT lang, {of} // {by} AS part, sha256(string_agg(h, chr(10) ORDER BY {of})) AS h FROM ({inner}) GROUP BY lang, {of} // {by}"


IDS_SQL = "SELECT lang, doc_id, CAST(doc_id AS VARCHAR) AS h FROM documents"


@query("target_set_hash", f"SELECT lang, sha256(string_agg(h, chr(10) ORDER BY part)) AS set_hash FROM ({_folded('part', _folded('doc_id', IDS_SQL, 1000), 1000)}) GROUP BY lang")
def target_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of all ids of a language: of a thousand ids at a time, then of a thousand such hashes, so that no group is large."""
    return folded_hash(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query(
    "guarded_update",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'reviewed' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def q_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return guarded_update(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), targets, ["o_orderkey"], "o_orderstatus", "O", "reviewed")


@query(
    "drift",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN n_chars <> length(text) THEN 'content-changed' WHEN quality = 0 AND toxic = 1 THEN 'conflict'
      WHEN quality = 1 AND toxic = 0 THEN 'applied' ELSE 'ready' END AS outcome FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def q_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "found")
    rows = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("found"), "left")
    changed = F.col("n_chars") != F.length("text")
    rules = [("missing", F.col("found").isNull()), ("content-changed", changed), ("conflict", (F.col("quality") == 0) & (F.col("toxic") == 1)), ("applied", (F.col("quality") == 1) & (F.col("toxic") == 0))]
    return rows.select("doc_id", drift(rules, "ready").alias("outcome"))


@query(
    "reconcile",
    """
    SELECT lang, count(*) AS targets, CASE WHEN bool_and(toxic = 0) THEN 'all-applied' WHEN bool_and(toxic = 1) THEN 'all-ready' WHEN count(toxic) < count(*) THEN 'inconsistent' ELSE 'partial' END AS outcome
    FROM (SELECT lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang
    """,
)
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("targets"), reconciled(F.col("toxic") == 0, F.col("toxic") == 1).alias("outcome"))


@query(
    "precedence_resolution",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), b.item, d.lang) AS resolved FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT item_id, 'item' AS item FROM benchmark) b ON b.item_id = d.doc_id",
)
def precedence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered before manual before original."""
    recovered = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("recovered"))
    manual = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("item").alias("manual"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(recovered, "doc_id", "left").join(manual, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("recovered", "manual", "lang").alias("resolved"))
