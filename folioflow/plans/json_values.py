"""JSON of turns and events: values at any depth, forbidden and missing keys, tokens of locators, canonical hashes, audit events.

A turn's document has its role and a body with its text, left out for systems, and its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.catalog import query
from folioflow.operators import json_walk
from folioflow.operators.lifecycle import contract_violations, reviewed_event_key
from folioflow.scratch import table

TURNS = r"t AS (SELECT conv_id * 1000 + turn AS id, turn, role, text, regexp_extract_all(text, '[a-z]+') AS ws FROM conversations)"
VALUES = f"""{TURNS}, v AS (
  SELECT id, '$' AS path, NULL AS name, 'object' AS kind, NULL AS text FROM t UNION ALL SELECT id, '$.role', 'role', 'string', role FROM t UNION ALL SELECT id, '$.body', 'body', 'object', NULL FROM t
  UNION ALL SELECT id, '$.body.text', 'text', 'string', text FROM t WHERE role <> 'system' UNION ALL SELECT id, '$.body.words', 'words', 'array', NULL FROM t
  UNION ALL SELECT id, '$.body.words[' || i || ']', NULL, 'string', ws[i + 1] FROM (SELECT id, ws, unnest(range(len(ws))) AS i FROM t))"""


def turn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    body = F.struct(F.regexp_extract_all("text", F.lit("[a-z]+"), 0).alias("words"), F.when(F.col("role") != "system", F.col("text")).alias("text"))
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.to_json(F.struct("role", body.alias("body"))).alias("doc"))
    return json_walk.walk(docs, "id", "doc")


@query("json_values", f"WITH {VALUES} SELECT id, path, kind, md5(coalesce(text, '')) AS text_md5 FROM v")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_values(spark, sf_dir).select("id", "path", "kind", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("forbidden_keys", f"WITH {VALUES} SELECT id, path FROM v WHERE name = 'text'")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where records that are made public show a text."""
    return json_walk.forbidden(turn_values(spark, sf_dir), "id", ["text", "content", "excerpt"])


@query("closed_fields", f"WITH {TURNS} SELECT id, 'note' AS name, 'missing' AS side FROM t UNION ALL SELECT id, 'text', 'missing' FROM t WHERE role = 'system' UNION ALL SELECT id, 'words', 'unexpected' FROM t")
def closed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that don't have just a text and a note."""
    return json_walk.open_world(turn_values(spark, sf_dir), "id", "$.body", ["note", "text"])


@query(
    "json_locators",
    f"""WITH {TURNS} SELECT id, unnest(['start.type=' || role, 'start.value=' || turn, 'lines[0]=' || len(ws)]) AS token FROM t
    UNION ALL SELECT id, 'end.word=' || ws[1] FROM t WHERE len(ws) > 0""",
)
def json_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What locators with pages, types and lists say besides pages."""
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), 0)
    start = F.struct(F.col("role").alias("type"), F.col("turn").alias("value"), F.lit(3).alias("page"))
    end = F.struct(F.get(words, 0).alias("word"), F.struct(F.lit("pdf_page").alias("type"), F.col("turn").alias("value")).alias("at"))
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.to_json(F.struct(start.alias("start"), end.alias("end"), F.array(F.size(words)).alias("lines"))).alias("doc"))
    return json_walk.locator_tokens(json_walk.walk(docs, "id", "doc"), "id")


@query("canonical_hash", "SELECT event_id, sha256('{\"a\":\"' || event_type || '\",\"k\":[' || CAST(floor(value) AS BIGINT) || ',{\"b\":null,\"c\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}]}') AS canonical FROM events")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents that were written in another order, with spaces and with decimals."""
    text = F.format_string('{"k": [%d.0, {"c" : %se0, "b":null}],\n "a": "%s"}', F.floor("value"), F.get_json_object("props", "$.k"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", json_walk.canonical_hash(text).alias("canonical"))


#: Fixed values of audit events.
PACKAGE, LABEL = "reading-segment-reviewed-boundary-execution", "sha256-v1-length-delimited-reviewed-boundary-event-key"
AUDITED = f"""a AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'status-rollback' ELSE 'status-advanced' END AS action, 'run-' || year(o_orderdate) AS run_id, 'd' || o_orderkey AS decision_id, o_custkey AS book_id, left(sha256(CAST(o_orderkey AS VARCHAR)), 24) AS segment_key,
         o_orderpriority AS priority FROM orders),
m AS (SELECT *, '{LABEL}' || '|package_id=' || {len(PACKAGE)} || ':{PACKAGE}' || '|event_action=' || length(action) || ':' || action || '|run_id=' || length(run_id) || ':' || run_id || '|decision_id=' || length(decision_id) || ':' || decision_id
         || '|book_id=' || length(CAST(book_id AS VARCHAR)) || ':' || book_id || '|segment_key=' || length(segment_key) || ':' || segment_key || '|event_version=1:1' AS material FROM a)"""


@query(
    "event_contract",
    f"""WITH {AUDITED} SELECT o_orderkey, sha256(material) AS event_key,
      CASE priority WHEN '1-URGENT' THEN 'target_table' WHEN '2-HIGH' THEN 'statuses' WHEN '3-MEDIUM' THEN 'event_key' WHEN '5-LOW' THEN 'package_hash,target_identity' ELSE '' END AS violations FROM m""",
)
def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed keys of audit events, and which parts of the contract an event breaks; some payloads are tampered with."""
    priority = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", priority.alias("priority"), F.lit(PACKAGE).alias("package_id"), F.lit(1).alias("event_version"), F.when(F.col("o_orderstatus") == "O", "status-rollback").otherwise("status-advanced").alias("event_action"),
        F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"), F.concat(F.lit("d"), "o_orderkey").alias("decision_id"), F.col("o_custkey").alias("book_id"), F.left(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(24)).alias("segment_key"),
    )
    rows = rows.withColumn("made_key", reviewed_event_key())
    rows = rows.withColumn("event_key", F.when(F.col("priority") == "3-MEDIUM", F.upper("made_key")).otherwise(F.col("made_key")))
    forward = (F.col("event_action") == "status-advanced") != (F.col("priority") == "2-HIGH")
    low = F.col("priority") == "5-LOW"
    identity = F.struct(F.col("run_id"), F.when(~low, F.col("book_id")).alias("book_id"), F.col("segment_key"))
    details = F.struct(
        "package_id", F.lit("1.0.0").alias("package_version"), "event_version", "event_action", "decision_id", "run_id", "book_id", "segment_key",
        F.when(forward, "boundary-review").otherwise("content-review").alias("previous_approval_status"), F.when(forward, "content-review").otherwise("boundary-review").alias("resulting_approval_status"),
        F.when(F.col("priority") == "1-URGENT", "reading_segments").otherwise("content_staging.reading_segments").alias("target_table"), identity.alias("target_identity"),
        F.sha2("run_id", 256).alias("authority_manifest_hash"), F.when(low, "x").otherwise(F.sha2("decision_id", 256)).alias("package_hash"),
    )
    rows = rows.withColumn("event_type", F.concat(F.lit("reading-segment-reviewed-boundary."), "event_action")).withColumn("details", F.to_json(details))
    return rows.select("o_orderkey", F.col("made_key").alias("event_key"), contract_violations().alias("violations"))
