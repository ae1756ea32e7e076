"""Rules, outcomes and summaries of editorial decisions.

``orders`` stand for decisions: the customer is the item, o_orderpriority the outcome, o_orderstatus the status, and
the order's lines what was found (the supplier modulo 7 as the kind of an event). Each rule is a chain of conditions of which the first that holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.operators.lifecycle import drift
from folioflow.plans.audits import all_sorted
from folioflow.plans.segments import REASONS_SQL, reasons
from folioflow.scratch import table


def looked_up(key: Column, values: dict[str, str], otherwise: str | None = None) -> Column:
    """A small fixed map as an expression."""
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def map_sql(key: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{otherwise}' END"


#: What a reviewed outcome makes a decision ready for.
READINESS = {
    "confirm-successor-start": "status-only-candidate",
    "retain-intro-segment": "status-only-candidate",
    "adjust-successor-start": "locator-mutation-contract-required",
    "exclude-structural-heading": "merge-contract-required",
    "unresolved": "unresolved-not-eligible",
}
#: How reading progress outlives an action.
STRATEGIES = {
    "keep": "retain-current-section-until-cutover",
    "relabel-review": "retain-current-section-id-if-boundary-unchanged",
    "reclassify": "retain-current-section-id-if-boundary-unchanged",
    "split": "map-current-progress-to-first-unread-successor",
    "review": "block-migration",
}
OUTCOME_OF = {"1-URGENT": "confirm-successor-start", "2-HIGH": "retain-intro-segment", "3-MEDIUM": "adjust-successor-start", "4-NOT SPECIFIED": "exclude-structural-heading"}
ACTION_OF = {"1-URGENT": "keep", "2-HIGH": "relabel-review", "3-MEDIUM": "reclassify", "4-NOT SPECIFIED": "split"}
OUTCOME_SQL, ACTION_SQL = map_sql("o_orderpriority", OUTCOME_OF, "unresolved"), map_sql("o_orderpriority", ACTION_OF, "review")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({"outcome": looked_up(F.col("o_orderpriority"), OUTCOME_OF, "unresolved"), "action": looked_up(F.col("o_orderpriority"), ACTION_OF, "review")})


@query("readiness", f"SELECT o_orderkey, {map_sql(f'({OUTCOME_SQL})', READINESS, 'none')} AS readiness FROM orders")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("o_orderkey", looked_up(F.col("outcome"), READINESS, "none").alias("readiness"))


@query(
    "progress_strategy",
    f"SELECT o_orderkey, action, {map_sql('action', STRATEGIES, 'none')} AS progress_strategy, NOT (action = 'keep' AND o_orderstatus IN ('F', 'O')) AS manual_review FROM (SELECT *, {ACTION_SQL} AS action FROM orders)",
)
def progress_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only kept records of sure confidence need no review."""
    manual = ~((F.col("action") == "keep") & F.col("o_orderstatus").isin("F", "O"))
    return decisions(spark, sf_dir).select("o_orderkey", "action", looked_up(F.col("action"), STRATEGIES, "none").alias("progress_strategy"), manual.alias("manual_review"))


@query(
    "proposals",
    """
    WITH k AS (SELECT o_custkey AS node, count(*) AS children, bool_or(o_orderpriority = '1-URGENT') AS intro FROM orders GROUP BY 1)
    SELECT c_custkey AS node, coalesce(children, 0) AS children, CASE WHEN children IS NULL THEN 'leaf-node' WHEN intro THEN 'container-intro-review' ELSE 'none' END AS proposal FROM customer LEFT JOIN k ON node = c_custkey
    """,
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf is proposed, and a container with an introduction; children are counted once and joined."""
    of = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("children"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("intro"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(of, "node", "left")
    kind = F.when(F.col("children").isNull(), "leaf-node").when(F.col("intro"), "container-intro-review").otherwise("none")
    return rows.select("node", F.coalesce("children", F.lit(0)).alias("children"), kind.alias("proposal"))


#: Reasons of segment proposals.
SEGMENT_REASONS = (
    "container-intro-boundary", "missing-start-locator", "same-page-successor-boundary", "split-required-by-reconstruction-plan",
    "manual-reconstruction-review", "legacy-word-count-oversized", "no-legacy-word-count-estimate",
)
FLAGS_SQL = """
    f AS (SELECT l_orderkey AS work, l_linenumber AS ord, l_returnflag = 'R' AS intro, CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 4 END AS page, l_suppkey % 7 = 4 AS split, l_linestatus = 'O' AS manual,
                 CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_quantity AS DOUBLE) * 60 END AS words,
                 row(l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS tie FROM lineitem),
    n AS (SELECT *, lead(page) OVER w AS next_page FROM f WINDOW w AS (PARTITION BY work ORDER BY ord, tie)),
    r AS (SELECT work, ord, list_sort(list_filter([CASE WHEN intro THEN 'container-intro-boundary' END, CASE WHEN page IS NULL THEN 'missing-start-locator' END, CASE WHEN page = next_page THEN 'same-page-successor-boundary' END,
      CASE WHEN split THEN 'split-required-by-reconstruction-plan' END, CASE WHEN manual THEN 'manual-reconstruction-review' END, CASE WHEN words > 2500 THEN 'legacy-word-count-oversized' END,
      CASE WHEN words IS NULL THEN 'no-legacy-word-count-estimate' END], lambda x: x IS NOT NULL)) AS reasons FROM n)
"""


def segment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(work, ord, reasons)``: a segment's reasons for review, sorted."""
    page = F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey") % 4)
    words = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity").cast("double") * 60)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("ord"), "l_returnflag", "l_suppkey", "l_linestatus", page.alias("page"), words.alias("words"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").alias("tie"))
    rows = rows.withColumn("next_page", F.lead("page").over(W.partitionBy("work").orderBy("ord", "tie")))
    holds = (
        F.col("l_returnflag") == "R", F.col("page").isNull(), F.col("page") == F.col("next_page"), F.col("l_suppkey") % 7 == 4,
        F.col("l_linestatus") == "O", F.col("words") > 2500, F.col("words").isNull(),
    )
    found = F.array(*(F.when(h, name) for h, name in zip(holds, SEGMENT_REASONS, strict=True)))
    return rows.select("work", "ord", F.array_sort(F.filter(found, lambda r: r.isNotNull())).alias("reasons"))


@query("segment_reasons", f"WITH {FLAGS_SQL} SELECT * FROM r")
def q_segment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_reasons(spark, sf_dir)


@query(
    "resolution_paths",
    f"""
    WITH {FLAGS_SQL} SELECT work, ord, CASE WHEN list_has_any(reasons, ['split-required-by-reconstruction-plan', 'manual-reconstruction-review']) THEN 'structural-review-required'
      WHEN list_has_any(reasons, ['container-intro-boundary', 'missing-start-locator']) THEN 'source-inspection-required' WHEN list_contains(reasons, 'same-page-successor-boundary') THEN CASE WHEN len(reasons) = 1 THEN 'mechanical-anchor-candidate' ELSE 'source-inspection-required' END
      WHEN list_contains(reasons, 'legacy-word-count-oversized') THEN 'delivery-size-review-required' ELSE 'source-inspection-required' END AS path,
      CASE WHEN list_contains(reasons, 'container-intro-boundary') AND list_contains(reasons, 'same-page-successor-boundary') THEN 'container-intro-same-page' WHEN list_contains(reasons, 'container-intro-boundary') THEN 'container-intro-only'
      WHEN list_contains(reasons, 'same-page-successor-boundary') THEN 'same-page-no-semantic-anchor' ELSE 'other-source-inspection' END AS lane FROM r WHERE len(reasons) > 0
    """,
)
def resolution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a segment needs, and the lane of its inspection; a page boundary alone can be resolved by distinct anchors."""
    has = lambda *names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    intro, same = has("container-intro-boundary"), has("same-page-successor-boundary")
    path = (
        F.when(has("split-required-by-reconstruction-plan", "manual-reconstruction-review"), "structural-review-required").when(has("container-intro-boundary", "missing-start-locator"), "source-inspection-required")
        .when(same & (F.size("reasons") == 1), "mechanical-anchor-candidate").when(same, "source-inspection-required").when(has("legacy-word-count-oversized"), "delivery-size-review-required").otherwise("source-inspection-required")
    )
    lane = F.when(intro & same, "container-intro-same-page").when(intro, "container-intro-only").when(same, "same-page-no-semantic-anchor").otherwise("other-source-inspection")
    return segment_reasons(spark, sf_dir).filter(F.size("reasons") > 0).select("work", "ord", path.alias("path"), lane.alias("lane"))


@query(
    "unknown_reasons",
    f"SELECT doc_id, list_filter(reasons, lambda x: x NOT IN ('oversized', 'undersized', 'structural')) AS unknown, list_has_any(reasons, ['boundary']) AS forbidden, len(list_filter(reasons, lambda x: x NOT IN ('oversized', 'metadata'))) = 0 AS only_known FROM ({REASONS_SQL})",
)
def unknown_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference, overlap and subset of a section's reasons."""
    of = lambda *names: F.array(*map(F.lit, names))
    return reasons(spark, sf_dir).select(
        "doc_id", F.array_except("reasons", of("oversized", "undersized", "structural")).alias("unknown"), F.arrays_overlap("reasons", of("boundary")).alias("forbidden"),
        (F.size(F.array_except("reasons", of("oversized", "metadata"))) == 0).alias("only_known"),
    )


#: Outcomes of a target against its expected row, the first that holds.
TARGET_OUTCOMES = (
    "IDENTITY_MISSING", "AUDIT_IDENTITY_INVALID", "AUDIT_EVENT_CONFLICT", "INSUFFICIENT_BASELINE", "STORED_CONTENT_DIGEST_MISMATCH",
    "CONTENT_DRIFT", "BOUNDARY_DRIFT", "STATUS_ALREADY_APPLIED", "STATUS_UNEXPECTED",
)
TARGET_SQL = """
    e AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_suppkey % 7 = 0 AND l_returnflag = 'A') AS invalid, count(*) FILTER (WHERE l_suppkey % 7 = 1 AND l_linestatus = 'F' AND l_quantity > 40) AS conflict,
                 count(*) FILTER (WHERE l_linenumber = 1) AS stored, count(*) FILTER (WHERE l_discount > 0.09) AS words, count(*) AS n FROM lineitem GROUP BY 1)
"""


@query(
    "target_outcomes",
    f"""
    WITH {TARGET_SQL} SELECT o_orderkey, CASE WHEN k IS NULL THEN 'IDENTITY_MISSING' WHEN invalid > 0 THEN 'AUDIT_IDENTITY_INVALID' WHEN conflict > 0 THEN 'AUDIT_EVENT_CONFLICT' WHEN o_custkey % 11 = 0 THEN 'INSUFFICIENT_BASELINE'
      WHEN stored <> 1 THEN 'STORED_CONTENT_DIGEST_MISMATCH' WHEN words > 1 THEN 'CONTENT_DRIFT' WHEN n > 6 THEN 'BOUNDARY_DRIFT' WHEN o_orderstatus = 'F' THEN 'STATUS_ALREADY_APPLIED' WHEN o_orderstatus <> 'O' THEN 'STATUS_UNEXPECTED' ELSE 'MATCH' END AS outcome
    FROM orders LEFT JOIN e ON k = o_orderkey
    """,
)
def target_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten outcomes of a target; its audit events are counted once and joined."""
    events = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_if((F.col("l_suppkey") % 7 == 0) & (F.col("l_returnflag") == "A")).alias("invalid"), F.count_if((F.col("l_suppkey") % 7 == 1) & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)).alias("conflict"),
        F.count_if(F.col("l_linenumber") == 1).alias("stored"), F.count_if(F.col("l_discount") > 0.09).alias("words"), F.count("*").alias("n"),
    )
    holds = (
        F.col("k").isNull(), F.col("invalid") > 0, F.col("conflict") > 0, F.col("o_custkey") % 11 == 0, F.col("stored") != 1,
        F.col("words") > 1, F.col("n") > 6, F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "O",
    )
    rows = table(spark, sf_dir, "orders").join(events, F.col("k") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", drift(list(zip(TARGET_OUTCOMES, holds, strict=True)), "MATCH").alias("outcome"))


#: Outcomes of a target's audit events and its status, the first that holds.
AUDIT_OUTCOMES = (
    "INVALID_EVENT_IDENTITY", "INVALID_EVENT_PAYLOAD", "DUPLICATE_SEMANTIC_EVENT", "CONFLICTING_APPLICATION_EVENT", "APPLICATION_AND_ROLLBACK_EXIST",
    "UNEXPECTED_ROLLBACK_EVENT", "APPLICATION_EVENT_STATUS_NOT_APPLIED", "APPLIED_STATUS_EVENT_ABSENT", "MATCHING_APPLICATION_EVENT",
)


@query(
    "audit_outcomes",
    """
    WITH e AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_partkey % 37 = 0) AS identity, count(*) FILTER (WHERE l_partkey % 41 = 0) AS payload, count(*) FILTER (WHERE l_suppkey % 7 = 2) AS apps, count(*) FILTER (WHERE l_suppkey % 7 = 3) AS rolls,
      count(*) FILTER (WHERE l_suppkey % 7 = 2 AND l_quantity > 45) AS conflict FROM lineitem GROUP BY 1),
    t AS (SELECT o_orderkey, o_orderstatus = 'F' AS applied, coalesce(identity, 0) AS identity, coalesce(payload, 0) AS payload, coalesce(apps, 0) AS apps, coalesce(rolls, 0) AS rolls, coalesce(conflict, 0) AS conflict FROM orders LEFT JOIN e ON k = o_orderkey)
    SELECT o_orderkey, CASE WHEN identity > 0 THEN 'INVALID_EVENT_IDENTITY' WHEN payload > 0 THEN 'INVALID_EVENT_PAYLOAD' WHEN apps > 1 OR rolls > 1 THEN 'DUPLICATE_SEMANTIC_EVENT' WHEN conflict > 0 THEN 'CONFLICTING_APPLICATION_EVENT'
      WHEN apps > 0 AND rolls > 0 THEN 'APPLICATION_AND_ROLLBACK_EXIST' WHEN rolls > 0 THEN 'UNEXPECTED_ROLLBACK_EVENT' WHEN apps > 0 AND NOT applied THEN 'APPLICATION_EVENT_STATUS_NOT_APPLIED' WHEN apps = 0 AND applied THEN 'APPLIED_STATUS_EVENT_ABSENT'
      WHEN apps > 0 THEN 'MATCHING_APPLICATION_EVENT' ELSE 'NO_APPLICATION_EVENT' END AS outcome FROM t
    """,
)
def audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten outcomes of a target's events, counted by kind in one pass."""
    app = F.col("l_suppkey") % 7 == 2
    events = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_partkey") % 37 == 0).alias("identity"), F.count_if(F.col("l_partkey") % 41 == 0).alias("payload"), F.count_if(app).alias("apps"),
        F.count_if(F.col("l_suppkey") % 7 == 3).alias("rolls"), F.count_if(app & (F.col("l_quantity") > 45)).alias("conflict"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("applied")).join(events, "o_orderkey", "left").fillna(0)
    apps, rolls = F.col("apps"), F.col("rolls")
    holds = (F.col("identity") > 0, F.col("payload") > 0, (apps > 1) | (rolls > 1), F.col("conflict") > 0, (apps > 0) & (rolls > 0), rolls > 0, (apps > 0) & ~F.col("applied"), (apps == 0) & F.col("applied"), apps > 0)
    return rows.select("o_orderkey", drift(list(zip(AUDIT_OUTCOMES, holds, strict=True)), "NO_APPLICATION_EVENT").alias("outcome"))


@query(
    "review_outcomes",
    """
    SELECT o_orderkey, CASE WHEN NOT allowed THEN 'unresolved' WHEN prose = 0 THEN 'exclude-structural-heading' ELSE 'retain-intro-segment' END AS outcome,
           CASE WHEN NOT allowed THEN 'none' WHEN toc = 0 AND strength <= 1 AND pages <= 2 THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT o_orderkey, o_custkey % 13 <> 0 AS allowed, o_custkey % 3 AS prose, o_custkey % 2 AS toc, o_custkey % 4 AS strength, o_custkey % 5 AS pages FROM orders)
    """,
)
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without prose a heading is left out, else kept; what the options don't allow is unresolved."""
    key = F.col("o_custkey")
    allowed = key % 13 != 0
    outcome = F.when(~allowed, "unresolved").when(key % 3 == 0, "exclude-structural-heading").otherwise("retain-intro-segment")
    sure = F.when(~allowed, "none").when((key % 2 == 0) & (key % 4 <= 1) & (key % 5 <= 2), "high").otherwise("medium")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"), sure.alias("confidence"))


@query(
    "decision_totals",
    f"""
    SELECT o_orderstatus AS status, count(*) AS decisions, count(*) FILTER (WHERE outcome = 'unresolved') AS unresolved, count(*) FILTER (WHERE outcome <> 'unresolved') AS resolved, bool_or(outcome = 'adjust-successor-start') AS any_adjusted,
           list_sort(list(DISTINCT outcome)) AS outcomes, sum(CASE WHEN o_totalprice > 400000 THEN o_custkey END)::BIGINT IS NULL AS none_large FROM (SELECT *, {OUTCOME_SQL} AS outcome FROM orders) GROUP BY 1
    """,
)
def decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By status: counts, any adjusted, the sorted set of outcomes, and a sum that is null without a row."""
    open_ = F.col("outcome") == "unresolved"
    return decisions(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("decisions"), F.count_if(open_).alias("unresolved"), F.count_if(~open_).alias("resolved"), F.bool_or(F.col("outcome") == "adjust-successor-start").alias("any_adjusted"),
        F.array_sort(F.collect_set("outcome")).alias("outcomes"), F.sum(F.when(F.col("o_totalprice") > 400000, F.col("o_custkey"))).isNull().alias("none_large"),
    )


@query(
    "packet_progress",
    """
    WITH p AS (SELECT o_custkey AS packet, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS reviewed, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS unresolved,
      count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS now_reviewed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 1) AS now_unresolved FROM orders GROUP BY 1),
    n AS (SELECT packet, total, pending - now_reviewed - now_unresolved AS pending, reviewed + now_reviewed AS reviewed, unresolved + now_unresolved AS unresolved FROM p)
    SELECT *, pending + reviewed + unresolved = total AS balanced, CASE WHEN pending > 0 THEN 'in-progress' WHEN unresolved > 0 THEN 'completed-with-unresolved' ELSE 'completed' END AS status FROM n
    """,
)
def packet_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New decisions move items from pending to reviewed or unresolved; the balance must hold."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    open_ = status == "O"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("packet")).agg(
        F.count("*").alias("total"), F.count_if(open_ & (key % 3 > 1)).alias("pending"), F.count_if((status == "F") | open_ & (key % 3 == 0)).alias("reviewed"), F.count_if(~status.isin("O", "F") | open_ & (key % 3 == 1)).alias("unresolved")
    )
    state = F.when(F.col("pending") > 0, "in-progress").when(F.col("unresolved") > 0, "completed-with-unresolved").otherwise("completed")
    return counts.withColumn("balanced", F.col("pending") + F.col("reviewed") + F.col("unresolved") == F.col("total")).withColumn("status", state)


@query(
    "under_split",
    "SELECT o_orderkey, count(l_orderkey) AS successors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(l_orderkey) < 2",
)
def under_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split records with fewer than two successors; those without any count too."""
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("successors"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").join(found, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("successors", F.lit(0)).alias("successors")).filter("successors < 2")


@query(
    "blockers",
    f"""
    SELECT source, list_filter([CASE WHEN n_boundary > 0 THEN 'unmatched-records' END, CASE WHEN n_split > 0 THEN 'unverified-splits' END, CASE WHEN n_missing > 0 THEN 'missing-units' END, CASE WHEN n_small > 3 THEN 'many-to-one' END, 'rights-unresolved'], lambda x: x IS NOT NULL) AS blockers
    FROM (SELECT source, count(*) FILTER (WHERE list_contains(reasons, 'boundary')) AS n_boundary, count(*) FILTER (WHERE list_contains(reasons, 'oversized')) AS n_split, count(*) FILTER (WHERE list_contains(reasons, 'no-decision')) AS n_missing,
      count(*) FILTER (WHERE list_contains(reasons, 'undersized')) AS n_small FROM ({REASONS_SQL}) GROUP BY source)
    """,
)
def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose condition holds, in a fixed order, and one that always does."""
    n = lambda reason: F.count_if(F.array_contains("reasons", reason))
    found = F.array(F.when(n("boundary") > 0, "unmatched-records"), F.when(n("oversized") > 0, "unverified-splits"), F.when(n("no-decision") > 0, "missing-units"), F.when(n("undersized") > 3, "many-to-one"), F.lit("rights-unresolved"))
    return reasons(spark, sf_dir).groupBy("source").agg(F.filter(found, lambda x: x.isNotNull()).alias("blockers"))


@query(
    "eligible_partition",
    """
    WITH m AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS conflicts, list(DISTINCT l_suppkey % 7) AS have FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN k IS NULL THEN 'excluded-missing' WHEN conflicts > 0 THEN 'excluded-conflict' WHEN NOT list_contains(have, 1) THEN 'excluded-incomplete' ELSE 'eligible' END AS part FROM orders LEFT JOIN m ON k = o_orderkey
    """,
)
def eligible_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision in one part: without evidence, in conflict, without a required authority, or eligible."""
    of = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("conflicts"), F.bool_or(F.col("l_suppkey") % 7 == 1).alias("has"))
    part = F.when(F.col("k").isNull(), "excluded-missing").when(F.col("conflicts") > 0, "excluded-conflict").when(~F.col("has"), "excluded-incomplete").otherwise("eligible")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(of, F.col("k") == F.col("o_orderkey"), "left").select("o_orderkey", part.alias("part"))


@query(
    "lookups",
    """
    WITH a AS (SELECT l_orderkey AS k, max(l_partkey) AS by_id FROM lineitem WHERE l_linenumber = 4 GROUP BY 1), b AS (SELECT o_custkey AS c, min(o_orderkey) AS by_key FROM orders GROUP BY 1), v AS (SELECT * FROM (VALUES ('1-URGENT', 2), ('3-MEDIUM', 1)) AS t(priority, pick))
    SELECT o_orderkey, coalesce(by_id, by_key) AS found, coalesce(pick, 0) AS pick, CASE coalesce(pick, 0) WHEN 0 THEN 'a' WHEN 1 THEN 'b' END IS NULL AS out_of_bounds, nullif(o_custkey % 9, 4) IS NOT DISTINCT FROM NULL AS no_priority, by_id IS DISTINCT FROM by_key AS differs
    FROM orders LEFT JOIN a ON k = o_orderkey LEFT JOIN b ON c = o_custkey LEFT JOIN v ON priority = o_orderpriority
    """,
)
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key looked up by id or else by another key; an override from literal values or else 0, checked against the candidates."""
    by_id = table(spark, sf_dir, "lineitem").filter("l_linenumber = 4").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_partkey").alias("by_id"))
    by_key = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("by_key"))
    literal = spark.sql("SELECT * FROM VALUES ('1-URGENT', 2), ('3-MEDIUM', 1) AS t(o_orderpriority, pick)")
    rows = table(spark, sf_dir, "orders").join(by_id, "o_orderkey", "left").join(by_key, "o_custkey", "left").join(F.broadcast(literal), "o_orderpriority", "left")  # two rows
    pick = F.coalesce("pick", F.lit(0))
    beyond = F.try_element_at(F.array(F.lit("a"), F.lit("b")), pick + 1).isNull()
    return rows.select("o_orderkey", F.coalesce("by_id", "by_key").alias("found"), pick.alias("pick"), beyond.alias("out_of_bounds"), F.nullif(F.col("o_custkey") % 9, F.lit(4)).eqNullSafe(F.lit(None)).alias("no_priority"), (~F.col("by_id").eqNullSafe(F.col("by_key"))).alias("differs"))


@query(
    "decisions_by_key",
    "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(first_status, 'none') AS first_status, coalesce(members, []) AS members, coalesce(first, -1) AS first, coalesce(last, -1) AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS first_status, list(o_orderkey ORDER BY o_orderkey) AS members, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def decisions_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of each key in order, the first and the last (-1 without any), and the first status; keys without any stay."""
    known = F.when(F.col("o_orderstatus").isNotNull(), F.col("o_orderkey"))
    of = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.min_by("o_orderstatus", known).alias("first_status"), all_sorted("o_orderkey").alias("members"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(of, "c_custkey", "left")
    members = F.coalesce("members", F.array().cast("array<bigint>"))
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_status", F.lit("none")).alias("first_status"), members.alias("members"), F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))


@query(
    "parent_orphans",
    "SELECT c.conv_id, c.turn FROM conversations c WHERE c.turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)",
)
def parent_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose parent, the turn before, is not in the same tree."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    parents = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
    return turns.filter("turn > 0").join(parents, ["conv_id", "turn"], "left_anti")


@query(
    "overlap_guard",
    "SELECT count(*) AS overlapping, count(*) = 0 AS disjoint FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def overlap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether new decisions touch what old ones decided."""
    orders = table(spark, sf_dir, "orders")
    both = orders.filter("o_orderstatus = 'O'").select("o_custkey").distinct().join(orders.filter("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_semi")
    return both.agg(F.count("*").alias("overlapping"), (F.count("*") == 0).alias("disjoint"))


@query(
    "predicates",
    """
    SELECT o_orderkey, starts_with(o_orderpriority, '1-') AS prefixed, nullif(o_custkey % 9, 4) IS NULL AS unset, coalesce(nullif(trim(o_orderstatus), 'P'), 'content') AS kind, o_custkey BETWEEN 20 AND 400 AS in_bounds,
           coalesce(CASE WHEN o_custkey % 4 = 0 THEN o_custkey END, CASE WHEN o_custkey % 3 = 0 THEN o_custkey * 2 END, 0) AS page,
           CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS severity_rank FROM orders
    """,
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, parameter that may be null, default kind, page bounds, the first page among several locators, and a rank of names."""
    key = F.col("o_custkey")
    page = F.coalesce(F.when(key % 4 == 0, key), F.when(key % 3 == 0, key * 2), F.lit(0))
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(9)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").startswith("1-").alias("prefixed"), F.nullif(F.col("o_custkey") % 9, F.lit(4)).eqNullSafe(F.lit(None)).alias("unset"),
        F.coalesce(F.nullif(F.trim("o_orderstatus"), F.lit("P")), F.lit("content")).alias("kind"), key.between(20, 400).alias("in_bounds"), page.alias("page"), rank.alias("severity_rank"),
    )


@query(
    "progress_labels",
    """
    WITH p AS (SELECT user_id, event_type AS book, max(event_id % 50) AS current_section, CAST(sum(round(value * 60)) AS BIGINT) AS seconds FROM events GROUP BY 1, 2)
    SELECT user_id, book, CAST(floor((current_section - 1) / 50 * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN ceil(seconds / 200) < 1 THEN '< 1 min' ELSE concat(CAST(ceil(seconds / 200) AS BIGINT), ' min') END AS label,
           CASE WHEN current_section >= 49 THEN 'book-complete' WHEN seconds >= 900 THEN 'daily-goal-complete' ELSE 'reading' END AS phase FROM p
    """,
)
def progress_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of sections read, a reading time at 200 words a minute, and the phase: a complete book before a reached goal."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("book")).agg(F.max(F.col("event_id") % 50).alias("current"), F.sum(F.round(F.col("value") * 60)).cast("long").alias("seconds"))
    minutes = F.ceil(F.col("seconds") / 200)
    label = F.when(minutes < 1, "< 1 min").otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    phase = F.when(F.col("current") >= 49, "book-complete").when(F.col("seconds") >= 900, "daily-goal-complete").otherwise("reading")
    return rows.select("user_id", "book", F.floor((F.col("current") - 1) / 50 * 100 + 0.5).alias("percent"), label.alias("label"), phase.alias("phase"))


@query(
    "book_summary",
    """
    SELECT c_nationkey AS book, count(*) AS orders, count(DISTINCT c_custkey) AS records, count(*) FILTER (WHERE o_orderstatus = 'F') AS exact, count(*) FILTER (WHERE o_orderstatus = 'O') AS chapter, count(*) FILTER (WHERE o_orderstatus = 'P') AS weak,
           count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS split, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS review, min(o_orderkey) AS first, max(o_orderkey) AS last, max(o_custkey) AS top, bool_or(o_orderpriority = '2-HIGH') AS relabelled
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
    """,
)
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven figures of each book in one pass."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("book")).agg(
        F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("records"), F.count_if(status == "F").alias("exact"), F.count_if(status == "O").alias("chapter"), F.count_if(status == "P").alias("weak"),
        F.count_if(priority == "1-URGENT").alias("split"), F.count_if(priority == "5-LOW").alias("review"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.max("o_custkey").alias("top"), F.bool_or(priority == "2-HIGH").alias("relabelled"),
    )


@query("category_counts", "SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))
