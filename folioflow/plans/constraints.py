"""Declared checks of reading tables, evidence of checks, and evidence for decisions.

Checks see reading tables as they come: every event is a session, every reader's furthest place is progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.catalog import query
from folioflow.operators import constraints as c
from folioflow.plans.reading import EVENTS, SECTIONS, events, sections
from folioflow.scratch import table

RAW = f"""{SECTIONS}, {EVENTS}, lim AS (SELECT book_id, max(sec_position) AS most FROM sec GROUP BY 1),
p AS (SELECT user_id, book_id, max(section_id % 1000) AS current_section FROM ev GROUP BY 1, 2),
m AS (SELECT l_orderkey AS section, l_linenumber AS successor, CASE l_returnflag WHEN 'N' THEN 'approved' WHEN 'A' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN l_linestatus = 'O' THEN 'one-to-many' ELSE 'one-to-one' END AS kind, l_shipdate AS shipped FROM lineitem)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    known, read = sections(spark, sf_dir), events(spark, sf_dir)
    flag = F.col("l_returnflag")
    mapping = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("successor"), F.when(flag == "N", "approved").when(flag == "A", "pending").otherwise("rejected").alias("status"),
        F.when(F.col("l_linestatus") == "O", "one-to-many").otherwise("one-to-one").alias("kind"), F.col("l_shipdate").alias("shipped"),
    )
    return {
        "sections": known, "sessions": read, "progress": read.groupBy("user_id", "book_id").agg(F.max(F.col("section_id") % 1000).alias("current_section")),
        "limits": known.groupBy("book_id").agg(F.max("sec_position").alias("most")), "mapping": mapping, "orders": table(spark, sf_dir, "orders"),
    }


RULES = [
    c.Count("section-total", "sections"),
    c.Count("aggregate-dependencies", "progress"),
    c.Unique("duplicate-section-positions", "sections", ("book_id", "sec_position")),
    c.Reference("orphan-reading-sessions", "sessions", ("section_id",), "sections", ("section_id",)),
    c.Agrees("session-book-mismatches", "sessions", ("section_id",), "sections", ("section_id",), "book_id = o_book_id"),
    c.Agrees("progress-out-of-range", "progress", ("book_id",), "limits", ("book_id",), "current_section >= 1 AND current_section <= coalesce(o_most, 0) + 1", alone=True),
    c.Check("pending-mapping-reviews", "mapping", "status = 'approved'"),
    c.AtLeast("splits-without-successors", "mapping", ("section",), "successor", 2, "kind = 'one-to-many'"),
    c.Reference("approved-without-dependencies", "mapping", ("section",), "orders", ("o_orderkey",), "status = 'approved'"),
    c.complete("shipped-when-approved", "mapping", "status = 'approved'", ("shipped", "section", "successor")),
    c.Unique("one-approved-successor", "mapping", ("section", "successor"), "status = 'approved'", "warning"),
    c.Check("durations", "sessions", "duration_s >= 0", severity="warning"),
]


CHECKS = f"""WITH {RAW}, k(check_key, severity, expected_value, actual) AS (
  SELECT 'section-total', 'info', NULL, (SELECT count(*) FROM sec) UNION ALL SELECT 'aggregate-dependencies', 'info', NULL, (SELECT count(*) FROM p)
  UNION ALL SELECT 'duplicate-section-positions', 'blocking', '0', (SELECT count(*) FROM (SELECT 1 FROM sec GROUP BY book_id, sec_position HAVING count(*) > 1))
  UNION ALL SELECT 'orphan-reading-sessions', 'blocking', '0', (SELECT count(*) FROM ev WHERE section_id IS NOT NULL AND section_id NOT IN (SELECT section_id FROM sec))
  UNION ALL SELECT 'session-book-mismatches', 'blocking', '0', (SELECT count(*) FROM ev JOIN sec USING (section_id) WHERE ev.book_id <> sec.book_id)
  UNION ALL SELECT 'progress-out-of-range', 'blocking', '0', (SELECT count(*) FROM p LEFT JOIN lim USING (book_id) WHERE current_section < 1 OR current_section > coalesce(most, 0) + 1)
  UNION ALL SELECT 'pending-mapping-reviews', 'blocking', '0', (SELECT count(*) FROM m WHERE status <> 'approved')
  UNION ALL SELECT 'splits-without-successors', 'blocking', '0', (SELECT count(*) FROM (SELECT 1 FROM m WHERE kind = 'one-to-many' GROUP BY section HAVING count(successor) < 2))
  UNION ALL SELECT 'approved-without-dependencies', 'blocking', '0', (SELECT count(*) FROM m WHERE status = 'approved' AND section NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'shipped-when-approved', 'blocking', '0', (SELECT count(*) FROM m WHERE status = 'approved' AND (shipped IS NULL OR section IS NULL OR successor IS NULL))
  UNION ALL SELECT 'one-approved-successor', 'warning', '0', (SELECT count(*) FROM (SELECT 1 FROM m WHERE status = 'approved' GROUP BY section, successor HAVING count(*) > 1))
  UNION ALL SELECT 'durations', 'warning', '0', (SELECT count(*) FROM ev WHERE duration_s < 0)),
ch AS (SELECT check_key, severity, expected_value IS NULL OR actual = 0 AS passed, expected_value, CAST(actual AS VARCHAR) AS actual_value FROM k)"""


@query("declared_checks", f"{CHECKS} SELECT * FROM ch")
def declared_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the reading tables as check rows."""
    return c.check_rows(tables(spark, sf_dir), RULES)


@query(
    "evidence_errors",
    f"""{CHECKS}, want AS (SELECT check_key, expected_value FROM ch WHERE check_key <> 'durations' UNION ALL SELECT 'reviewed-boundaries', '74')
    SELECT check_key, 'missing' AS problem FROM want WHERE check_key NOT IN (SELECT check_key FROM ch) UNION ALL SELECT check_key, 'unexpected' FROM ch WHERE check_key NOT IN (SELECT check_key FROM want)
    UNION ALL SELECT check_key, 'not-blocking' FROM ch WHERE severity <> 'blocking' UNION ALL SELECT check_key, 'not-passed' FROM ch WHERE NOT passed
    UNION ALL SELECT check_key, 'wrong-value' FROM ch JOIN want USING (check_key) WHERE want.expected_value <> actual_value""",
)
def evidence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the exported checks as evidence."""
    rows = declared_checks(spark, sf_dir)
    expected = [(r.key, None if isinstance(r, c.Count) else "0") for r in RULES if r.key != "durations"]
    return c.evidence_errors(rows, spark.createDataFrame([*expected, ("reviewed-boundaries", "74")], "check_key string, expected_value string"))


@query(
    "candidate_evidence",
    """
    WITH x AS (SELECT l_orderkey AS d, nullif(l_discount, 0) AS score, l_returnflag = 'R' AND l_linenumber = 1 AS selected, l_linestatus = 'O' AS same FROM lineitem),
    g AS (SELECT d, count(*) AS n, count(score) AS scored, count(*) FILTER (WHERE selected) AS chosen, count(*) FILTER (WHERE same) AS same, max(score) AS strongest FROM x GROUP BY 1),
    t AS (SELECT x.d, count(*) AS ties FROM x JOIN g ON g.d = x.d AND x.score = g.strongest GROUP BY 1)
    SELECT o_orderkey AS decision_id, coalesce(n, 0) AS candidates, coalesce(chosen, 0) AS selected, CASE WHEN n IS NULL THEN 'no-candidates' WHEN scored = n THEN 'all-scores-available' WHEN scored > 0 THEN 'partial-scores-available' ELSE 'scores-unavailable' END AS availability,
           coalesce(CAST(strongest AS VARCHAR), '') AS strongest, coalesce(ties, 0) AS ties,
           CASE WHEN n IS NULL THEN 'no candidate records exist in inspected candidate sources' WHEN chosen = 0 THEN 'candidate records exist but none is adjudication-selected' WHEN coalesce(ties, 0) > 1 THEN 'candidate records include a tied strongest score'
                ELSE 'candidate evidence remains insufficient to authorize a deterministic outcome' END AS reason,
           CASE WHEN n IS NULL THEN '' WHEN n = 1 OR same = n THEN 'high' ELSE 'medium' END AS confidence
    FROM orders LEFT JOIN g ON g.d = o_orderkey LEFT JOIN t ON t.d = o_orderkey
    """,
)
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions, their lines as candidates, discounts as scores."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("decision_id"), F.nullif("l_discount", F.lit(0.0)).alias("score"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("selected"), (F.col("l_linestatus") == "O").alias("same_page")
    )
    rows = c.candidate_evidence(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id")), lines)
    return rows.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("strongest", "confidence")})
