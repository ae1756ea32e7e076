"""Structure maps: trees, locators, intervals and the cascade of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.catalog import query
from folioflow.functions.locators import anchor_signature, anchor_tokens, semantic_locator, structural_interval
from folioflow.operators.cascade import cascade
from folioflow.scratch import table

#: Types of nodes, and fields that a structure map must not have.
NODE_TYPES = ("front_matter", "division", "chapter", "group", "section", "back_matter")
FULL_TEXT = ("content", "raw_text", "full_text", "excerpt")


def tree_errors(nodes: DataFrame) -> DataFrame:
    """``nodes(work, ord, id, parent, type)`` -> errors of each work by kind, and its chapters and divisions.

    ``misordered`` is 1 unless the order numbers of a work are 1 to n, each once. A blank id is missing; a null type is invalid.
    """
    ids = nodes.select("work", F.col("id").alias("parent")).distinct().withColumn("known", F.lit(True))
    rows = nodes.join(ids, ["work", "parent"], "left")
    named = F.when(F.trim(F.col("id").cast("string")) != "", F.col("id"))
    gapless = (F.count_distinct("ord") == F.count("*")) & (F.min("ord") == 1) & (F.max("ord") == F.count("*"))
    return rows.groupBy("work").agg(
        F.count_if(named.isNull()).alias("missing_id"), (F.count(named) - F.count_distinct(named)).alias("duplicate_id"), F.when(gapless, 0).otherwise(1).alias("misordered"),
        F.count_if(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))).alias("invalid_type"), F.count_if(F.col("parent").isNotNull() & F.col("known").isNull()).alias("missing_parent"),
        F.count_if(F.col("type") == "chapter").alias("chapters"), F.count_if(F.col("type") == "division").alias("divisions"), F.lit(len(set(FULL_TEXT) & set(nodes.columns))).alias("full_text_fields"),
    )


@query(
    "tree_validation",
    """
    WITH t AS (SELECT conv_id AS work, turn + 1 AS ord, conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, CASE role WHEN 'user' THEN 'chapter' WHEN 'assistant' THEN 'section' ELSE role END AS type FROM conversations)
    SELECT work, count(*) FILTER (WHERE id IS NULL) AS missing_id, count(id) - count(DISTINCT id) AS duplicate_id, CASE WHEN count(DISTINCT ord) = count(*) AND min(ord) = 1 AND max(ord) = count(*) THEN 0 ELSE 1 END AS misordered,
      count(*) FILTER (WHERE type IS NULL OR type NOT IN ('front_matter', 'division', 'chapter', 'group', 'section', 'back_matter')) AS invalid_type,
      count(*) FILTER (WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t p WHERE p.work = t.work AND p.id = t.parent)) AS missing_parent,
      count(*) FILTER (WHERE type = 'chapter') AS chapters, count(*) FILTER (WHERE type = 'division') AS divisions, 0 AS full_text_fields FROM t GROUP BY work
    """,
)
def tree_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nodes, each below the one before; turns of the system have no type of a node."""
    kind = F.when(F.col("role") == "user", "chapter").when(F.col("role") == "assistant", "section").otherwise(F.col("role"))
    node = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), (F.col("turn") + 1).alias("ord"), node.alias("id"), F.when(F.col("turn") > 0, node - 1).alias("parent"), kind.alias("type"))
    return tree_errors(rows)


@query(
    "anchor_signatures",
    """
    WITH p AS (SELECT event_id, event_type AS t, CAST(user_id AS VARCHAR) AS v, json_extract_string(props, '$.k') AS k FROM events),
    a AS (SELECT event_id, list_sort(list_filter(CASE WHEN t = 'page' THEN [] ELSE ['locator.type=' || t, 'type=' || t, 'value=' || v, 'start.line=' || k, 'marks[0]=' || t, 'marks[1]=' || k] END, lambda x: x IS NOT NULL)) AS tokens FROM p)
    SELECT event_id, tokens, CASE WHEN len(tokens) > 0 THEN left(sha256(CAST(to_json(tokens) AS VARCHAR)), 24) END AS signature FROM a
    """,
)
def anchor_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested locators, made of events, flattened; pages and generic keys don't count."""
    k = F.get_json_object("props", "$.k")
    start = F.struct(k.alias("line"), F.col("event_id").alias("page"), F.lit("toc").alias("basis"))
    locator = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("value"), F.col("event_id").alias("printed_page"), start.alias("start"), F.array("event_type", k).alias("marks"))
    rows = table(spark, sf_dir, "events").select("event_id", locator.alias("locator"))
    tokens = rows.select("event_id", anchor_tokens(F.col("locator"), rows.schema["locator"].dataType).alias("tokens"))
    return tokens.withColumn("signature", anchor_signature(F.col("tokens")))


@query(
    "semantic_locators",
    """
    WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'page' ELSE event_type END AS type, CASE WHEN value > 1 THEN json_extract_string(props, '$.k') END AS v FROM events)
    SELECT event_id, type <> 'page' AND v IS NOT NULL AS available, CASE WHEN type <> 'page' AND v IS NOT NULL THEN '{"type":"' || type || '","value":"' || v || '"}' END AS normalized FROM e
    """,
)
def semantic_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "page").otherwise(F.col("event_type"))
    found = semantic_locator(kind, F.when(F.col("value") > 1, F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").select("event_id", found.alias("found")).select("event_id", "found.*")


@query(
    "structural_intervals",
    r"""
    WITH l AS (SELECT turn, conv_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(CASE WHEN role = 'user' THEN '• ' ELSE '' END || s, '\s+', ' ', 'g'))), lambda s: s <> '') AS kept FROM conversations)
    SELECT conv_id, turn, len(kept) = 0 OR starts_with(kept[1], '•') AND len(list_filter(kept, lambda s: regexp_matches(s, '^\d+\s*[.\-–—)]') OR regexp_matches(s, '^[“"]'))) = 0 AS structural FROM l
    """,
)
def structural_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of turns as lines; those of users get a bullet."""
    lines = F.split(F.regexp_replace("text", "([.!?]) ", "$1\n"), "\n")
    marked = F.transform(lines, lambda s: F.concat(F.when(F.col("role") == "user", "• ").otherwise(""), s))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", structural_interval(marked).alias("structural"))


def sections_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as sections, whose market segment stands for their kind; regions, nations and suppliers as nodes."""
    none, name = F.lit(None).cast("string"), F.regexp_replace("c_name", "Customer", "Supplier")
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "part_intro").when(F.col("c_mktsegment") == "BUILDING", "chapter_intro").when(F.col("c_mktsegment") != "MACHINERY", "content")
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    homes = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    rows = table(spark, sf_dir, "customer").join(homes, "c_nationkey").select(
        F.col("c_custkey").alias("row_id"), kind.alias("kind"), F.col("r_name").alias("part_title"), F.when(F.col("c_acctbal") < 8000, name).alias("section_title"), F.col("r_name").alias("record_title"),
        F.when(F.col("c_acctbal") > 0, key("n", "c_nationkey")).alias("chapter_id"), F.col("c_acctbal").cast("int").alias("words"),
    )
    nodes = regions.select(key("r", "r_regionkey").alias("id"), F.lit("division").alias("type"), F.col("r_name").alias("title"), none.alias("chapter_id"), F.col("r_regionkey").cast("long").alias("ord"))
    nodes = nodes.unionByName(nations.select(key("n", "n_nationkey").alias("id"), F.lit("chapter").alias("type"), F.col("n_name").alias("title"), none.alias("chapter_id"), F.col("n_nationkey").cast("long").alias("ord")))
    parts = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), F.lit("section").alias("type"), F.col("s_name").alias("title"), key("n", "s_nationkey").alias("chapter_id"), F.col("s_suppkey").alias("ord"))
    return rows, nodes.unionByName(parts)


@query("structure_cascade")
def structure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which node each section belongs to, how surely, and what to do with it."""
    return cascade(*sections_and_nodes(spark, sf_dir))
