"""Anchors in page order: pairs, blocks, lines between them, and pages.

``lineitem`` stands for anchors: an order is an item, odd line numbers are current titles and even ones successors. The place
of an anchor is its page and line; the global position of a line is page * 10000 + line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.functions.similarity import anchor_score, heading_score, part_title_score, successor_score, title_window_score
from folioflow.scratch import table

PAGE_SIZE = 10_000

ANCHORS_SQL = """
    a AS (SELECT l_orderkey AS item, l_linenumber AS id, l_linenumber % 2 = 1 AS is_current, CAST(l_partkey % 12 AS BIGINT) AS page, CAST(l_suppkey % 30 AS BIGINT) AS start_line,
                 CAST(l_suppkey % 30 + 1 + l_partkey % 4 AS BIGINT) AS end_line, round(CAST(l_discount AS DOUBLE) * 40, 6) AS score, l_returnflag = 'N' AS exact FROM lineitem)
"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item, id, is_current, page, start_line, end_line, score, exact)``."""
    start = F.col("l_suppkey") % 30
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") % 2 == 1).alias("is_current"), (F.col("l_partkey") % 12).cast("long").alias("page"),
        start.cast("long").alias("start_line"), (start + 1 + F.col("l_partkey") % 4).cast("long").alias("end_line"), F.round(F.col("l_discount").cast("double") * 40, 6).alias("score"), (F.col("l_returnflag") == "N").alias("exact"),
    )


def paired(rows: DataFrame, *keys: str) -> DataFrame:
    """Current and successor anchors of one item (and page): ``c_*`` and ``s_*`` columns."""
    left = rows.filter("is_current").select("item", *keys, *(F.col(c).alias(f"c_{c}") for c in rows.columns if c not in ("item", *keys)))
    right = rows.filter("NOT is_current").select("item", *keys, *(F.col(c).alias(f"s_{c}") for c in rows.columns if c not in ("item", *keys)))
    return left.join(right, ["item", *keys])


def _pairs(rows: DataFrame, score: Column) -> DataFrame:
    return rows.select("item", F.col("c_id").alias("current"), F.col("s_id").alias("successor"), F.round(score, 6).alias("pair_score"))


#: Bonuses of pairs on one page and on neighbouring pages, the widest gap, and the least score.
SAME_PAGE, NEXT_PAGE, PAGE_GAP, LEAST_PAIR = 0.75, 0.35, 6, 3.0


@query(
    "ordered_pairs",
    f"""
    WITH {ANCHORS_SQL}, p AS (SELECT c.item, c.id AS current, s.id AS successor, s.page - c.page AS gap, c.score + s.score AS total FROM a c JOIN a s ON c.item = s.item AND c.is_current AND NOT s.is_current
      AND s.page * 10000 + s.start_line > c.page * 10000 + c.start_line AND s.page - c.page <= {PAGE_GAP}),
    v AS (SELECT item, current, successor, round(total + CASE gap WHEN 0 THEN {SAME_PAGE} WHEN 1 THEN {NEXT_PAGE} ELSE 0 END - greatest(0, gap - 1) * 0.025, 6) AS pair_score FROM p)
    SELECT * FROM v WHERE pair_score >= {LEAST_PAIR}
    """,
)
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A successor strictly after its current title, within some pages."""
    gap = F.col("s_page") - F.col("c_page")
    later = F.col("s_page") * PAGE_SIZE + F.col("s_start_line") > F.col("c_page") * PAGE_SIZE + F.col("c_start_line")
    rows = paired(anchors(spark, sf_dir)).filter(later & (gap <= PAGE_GAP))
    bonus = F.when(gap == 0, SAME_PAGE).when(gap == 1, NEXT_PAGE).otherwise(0.0)
    return _pairs(rows, F.col("c_score") + F.col("s_score") + bonus - F.greatest(F.lit(0), gap - 1) * 0.025).filter(F.col("pair_score") >= LEAST_PAIR)


@query(
    "same_page_pairs",
    f"""
    WITH {ANCHORS_SQL} SELECT c.item, c.id AS current, s.id AS successor, round(c.score + s.score + greatest(0, 1 - abs(c.page - 5) / 24.0) - (s.start_line - c.end_line) * 0.015, 6) AS pair_score
    FROM a c JOIN a s ON c.item = s.item AND c.page = s.page AND c.is_current AND NOT s.is_current AND s.start_line >= c.end_line
    """,
)
def same_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On one page, the successor after the end of its current title; far pages (from a hint, page 5) and wide gaps count less."""
    rows = paired(anchors(spark, sf_dir), "page").filter("s_start_line >= c_end_line")
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("page") - 5) / 24)
    return _pairs(rows, F.col("c_score") + F.col("s_score") + near - (F.col("s_start_line") - F.col("c_end_line")) * 0.015)


@query(
    "forward_pairs",
    f"""
    WITH {ANCHORS_SQL}, t AS (SELECT DISTINCT page FROM a WHERE page IN (0, 1))
    SELECT c.item, c.id AS current, s.id AS successor, round(c.score + s.score - (s.page - c.page) * 0.03 - abs(c.start_line - 10) * 0.05, 6) AS pair_score
    FROM a c JOIN a s ON c.item = s.item AND c.is_current AND NOT s.is_current AND s.page BETWEEN c.page AND c.page + 3 WHERE s.page NOT IN (SELECT page FROM t)
    """,
)
def forward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors up to three pages ahead; pages of the table of contents (0 and 1) are skipped."""
    rows = paired(anchors(spark, sf_dir)).filter("s_page BETWEEN c_page AND c_page + 3 AND s_page NOT IN (0, 1)")
    return _pairs(rows, F.col("c_score") + F.col("s_score") - (F.col("s_page") - F.col("c_page")) * 0.03 - F.abs(F.col("c_start_line") - 10) * 0.05)


@query(
    "overlap_free_pairs",
    f"""
    WITH {ANCHORS_SQL}, p AS (SELECT c.item, c.id AS current, s.id AS successor, s.page - c.page AS d, c.score + s.score AS total, s.exact, s.start_line - c.end_line AS gap FROM a c JOIN a s ON c.item = s.item AND c.is_current AND NOT s.is_current AND s.page BETWEEN c.page AND c.page + 4)
    SELECT item, current, successor, round(total + CASE WHEN exact THEN 1 ELSE 0 END - d * 0.45 - CASE WHEN d = 0 THEN gap ELSE 0 END * 0.01, 6) AS pair_score FROM p WHERE d > 0 OR gap >= 0
    """,
)
def overlap_free_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No successor within its current title; an exact one counts more, a distant one less."""
    d, gap = F.col("s_page") - F.col("c_page"), F.col("s_start_line") - F.col("c_end_line")
    rows = paired(anchors(spark, sf_dir)).filter(d.between(0, 4) & ((d > 0) | (gap >= 0)))
    return _pairs(rows, F.col("c_score") + F.col("s_score") + F.col("s_exact").cast("int") - d * 0.45 - F.when(d == 0, gap).otherwise(0) * 0.01)


@query(
    "keep_best_anchor",
    f"WITH {ANCHORS_SQL} SELECT item, page, id, score FROM a QUALIFY row_number() OVER (PARTITION BY item, page ORDER BY score DESC, id) = 1",
)
def keep_best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor with the highest score of each place; the first to arrive on ties."""
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("m")
    return anchors(spark, sf_dir).groupBy("item", "page").agg(best).select("item", "page", "m.id", "m.score")


@query(
    "search_bounds",
    f"""
    WITH {ANCHORS_SQL}, h AS (SELECT item, count(DISTINCT page) AS hints, min(page) AS lo, max(page) AS hi FROM a WHERE exact GROUP BY item), i AS (SELECT DISTINCT item FROM a)
    SELECT item, CASE WHEN hints >= 2 THEN greatest(1, lo - 2) WHEN hints = 1 THEN greatest(1, lo - 4) ELSE 4 END AS lower, CASE WHEN hints >= 2 THEN least(12, hi + 2) WHEN hints = 1 THEN least(12, lo + 4) ELSE 12 END AS upper
    FROM i LEFT JOIN h USING (item)
    """,
)
def search_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to search: around the hints of an item, around a single one, or all behind the front matter."""
    page = F.when(F.col("exact"), F.col("page"))
    of = anchors(spark, sf_dir).groupBy("item").agg(F.count_distinct(page).alias("hints"), F.min(page).alias("lo"), F.max(page).alias("hi"))
    lower = F.when(F.col("hints") >= 2, F.greatest(F.lit(1), F.col("lo") - 2)).when(F.col("hints") == 1, F.greatest(F.lit(1), F.col("lo") - 4)).otherwise(4)
    upper = F.when(F.col("hints") >= 2, F.least(F.lit(12), F.col("hi") + 2)).when(F.col("hints") == 1, F.least(F.lit(12), F.col("lo") + 4)).otherwise(12)
    return of.select("item", lower.alias("lower"), upper.alias("upper"))


@query(
    "candidate_choice",
    f"""
    WITH {ANCHORS_SQL} SELECT item, id FROM (SELECT *, start_line % 3 AS toc FROM a)
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY CASE toc WHEN 0 THEN 0 ELSE 1 END, toc, score, end_line, page DESC, id) = 1
    """,
)
def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate of each item: without signals of a table of contents first, then the strongest, nearest, and last page."""
    toc = F.col("start_line") % 3
    order = F.struct((toc != 0).cast("int").alias("any"), toc.alias("toc"), "score", "end_line", (-F.col("page")).alias("page"), "id")
    return anchors(spark, sf_dir).groupBy("item").agg(F.min_by("id", order).alias("id"))


LINES = "l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, ls[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"
MAXIMUM_BLOCK = 8
NUMBERED = r"^[0-9]+[.)]"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(
    "block_segments",
    f"""
    WITH {LINES}, f AS (SELECT *, line = 0 OR regexp_matches(text, '{NUMBERED}') OR length(text) < 60 AS starts FROM l),
    b AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM f),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line) AS k FROM b)
    SELECT doc_id, CAST(min(line) AS INTEGER) AS start_line, count(*) AS lines, md5(string_agg(text, ' ' ORDER BY line)) AS block_md5 FROM c WHERE k <= {MAXIMUM_BLOCK} GROUP BY doc_id, block HAVING trim(string_agg(text, ' ' ORDER BY line)) <> ''
    """,
)
def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block goes from the first line, a numbered or a short one up to the next such line, or for some lines at most."""
    of = W.partitionBy("doc_id").orderBy("line")
    starts = (F.col("line") == 0) | F.col("text").rlike(NUMBERED) | (F.length("text") < 60)
    rows = lines(spark, sf_dir).withColumn("block", F.sum(starts.cast("int")).over(of))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "block").orderBy("line"))).filter(F.col("k") <= MAXIMUM_BLOCK)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    blocks = rows.groupBy("doc_id", "block").agg(F.min("line").alias("start_line"), F.count("*").alias("lines"), text.alias("text"))
    return blocks.filter(F.trim("text") != "").select("doc_id", "start_line", "lines", F.md5("text").alias("block_md5"))


@query(
    "between_anchors",
    f"""
    WITH {LINES}, n AS (SELECT doc_id, line, text, length(text) < 40 AS anchor FROM l), e AS (SELECT doc_id, line AS first, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM n WHERE anchor)
    SELECT e.doc_id, first, count(n.line) AS lines, CAST(coalesce(sum(length(n.text)), 0) AS BIGINT) AS characters FROM e LEFT JOIN n ON n.doc_id = e.doc_id AND n.line > first AND n.line < next WHERE next IS NOT NULL GROUP BY 1, 2
    """,
)
def between_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines strictly between an anchor (a short line) and the next, as a running anchor instead of a range join."""
    of = W.partitionBy("doc_id").orderBy("line")
    rows = lines(spark, sf_dir).withColumn("anchor", F.length("text") < 40)
    held = rows.withColumn("first", F.last(F.when(F.col("anchor"), F.col("line")), ignorenulls=True).over(of)).filter("first IS NOT NULL")
    last = F.max("first").over(W.partitionBy("doc_id"))
    inner = F.when(~F.col("anchor"), F.length("text"))
    return held.withColumn("last", last).filter("first < last").groupBy("doc_id", "first").agg(F.count(inner).alias("lines"), F.coalesce(F.sum(inner), F.lit(0)).cast("long").alias("characters"))


@query(
    "printed_pages",
    """
    WITH p AS (SELECT c_custkey AS physical, c_custkey % 700 AS printed, c_nationkey AS book FROM customer), d AS (SELECT book, printed, coalesce(min(physical) FILTER (WHERE physical > 15), min(physical)) AS direct FROM p WHERE physical % 3 = 0 GROUP BY 1, 2),
    o AS (SELECT book, CAST(round_even(median(physical - printed), 0) AS BIGINT) AS shift, max(physical) AS pages FROM p GROUP BY 1)
    SELECT p.book, p.printed, p.physical, coalesce(direct, CASE WHEN p.printed + shift BETWEEN 1 AND pages THEN p.printed + shift END) AS mapped FROM p JOIN o ON o.book = p.book LEFT JOIN d ON d.book = p.book AND d.printed = p.printed
    """,
)
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed page's physical page: where it was seen, behind the front matter if possible, else by the median offset, rounded half to even."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book"), (F.col("c_custkey") % 700).alias("printed"), F.col("c_custkey").alias("physical"))
    seen = rows.filter("physical % 3 = 0").groupBy("book", "printed").agg(F.coalesce(F.min(F.when(F.col("physical") > 15, F.col("physical"))), F.min("physical")).alias("direct"))
    shift = rows.groupBy("book").agg(F.bround(F.median(F.col("physical") - F.col("printed")), 0).cast("long").alias("shift"), F.max("physical").alias("pages"))
    guess = F.col("printed") + F.col("shift")
    joined = rows.join(shift, "book").join(seen, ["book", "printed"], "left")
    return joined.select("book", "printed", "physical", F.coalesce("direct", F.when(guess.between(1, F.col("pages")), guess)).alias("mapped"))


@query(
    "page_numbers",
    r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, len(ls) AS n, i, trim(ls[i + 1]) AS t FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d)),
    c AS (SELECT doc_id, least(i, n - 1 - i) AS edge, i, CAST(t AS INTEGER) AS number FROM e WHERE (i < 8 OR i >= n - 8) AND regexp_full_match(t, '[0-9]{1,3}') AND CAST(t AS INTEGER) >= 1)
    SELECT d.doc_id, coalesce((SELECT number FROM c WHERE c.doc_id = d.doc_id ORDER BY edge, i LIMIT 1), 0) AS printed_page, len(list_filter(ls, lambda x: regexp_matches(x, '\.{3,}'))) >= 3 OR contains(lower(array_to_string(ls, ' ')), 'contents') AS front_matter_like FROM d
    """,
)
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standalone number from 1 to 999 nearest to the edge, in the first and last eight lines (0 without one); and what looks like a table of contents."""
    n = F.size("ls")
    at = F.transform("ls", lambda t, i: F.struct(F.least(i, n - 1 - i).alias("edge"), i.alias("i"), F.trim(t).alias("t")))
    numbers = F.filter(at, lambda x: ((x["i"] < 8) | (x["i"] >= n - 8)) & x["t"].rlike(r"^[0-9]{1,3}$") & (x["t"].try_cast("int") >= 1))
    front = (F.size(F.filter("ls", lambda t: t.rlike(r"\.{3,}"))) >= 3) | F.lower("text").contains("contents")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", " ").alias("text"), F.split("text", "\n").alias("ls"))
    return docs.select("doc_id", F.coalesce(F.array_min(numbers)["t"].cast("int"), F.lit(0)).alias("printed_page"), front.alias("front_matter_like"))


@query(
    "window_scores",
    """
    SELECT item, id, round(8 * x + 5 * c + 2 * c + 1.5 * r + r + 0.4 + 0.2 - 1 - 0.03 * greatest(0, n - 8), 6) + 0 AS anchor, round(4 * x + 2 * c + r - 0.04 * (n - 1), 6) + 0 AS heading, round(x + c + c + r - 0.03 * s - 0.01 * (n - 1), 6) + 0 AS title,
           round(2 * x + c + c + r - 0.03 * s - 0.01 * (n - 1), 6) + 0 AS strict_title, round(2 * x + c + r - 0.025 * s - 0.01 * (n - 1), 6) + 0 AS successor, round(4 + x + c + (1 - d / 120.0) - 0.035 * (n - 1), 6) + 0 AS part,
           c >= 0.8 AND r >= 0.62 AND s <= 8 AS accepted
    FROM (SELECT l_orderkey AS item, l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS x, CAST(l_discount AS DOUBLE) * 10 AS c, CAST(l_tax AS DOUBLE) * 12 AS r, l_suppkey % 12 AS n, l_suppkey % 9 AS s, l_partkey % 120 AS d FROM lineitem)
    """,
)
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of windows, from given measures, and whether a title window is accepted."""
    x, c, r = F.col("l_returnflag") == "N", F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 12
    n, s, d = F.col("l_suppkey") % 12, F.col("l_suppkey") % 9, F.col("l_partkey") % 120
    scores = {
        "anchor": anchor_score(x, c, c, r, r, F.lit(0.4), F.lit(0.2), F.lit(1), n), "heading": heading_score(x, c, r, n), "title": title_window_score(x, c, c, r, s, n),
        "strict_title": title_window_score(x, c, c, r, s, n, 2), "successor": successor_score(x, c, r, s, n), "part": part_title_score(x, c, d, n),
    }
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("id"), *((F.round(v, 6) + F.lit(0.0)).alias(k) for k, v in scores.items()), ((c >= 0.8) & (r >= 0.62) & (s <= 8)).alias("accepted"))
