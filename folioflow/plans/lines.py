"""Lines of text: windows, classes, anchors and links to titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.functions.similarity import ordered_coverage, uppercase_share
from folioflow.functions.text import normalised, search_text as search_form
from folioflow.operators.coverage import covered_lines
from folioflow.operators.linkage import best_of_all, one_to_one_of_all
from folioflow.operators.outline import outline
from folioflow.scratch import stage, table

LINES_SQL = "l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, ls[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line, text)``, lines from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


WINDOW_LINES = 5


@query(
    "line_windows",
    f"""
    WITH {LINES_SQL}, n AS (SELECT *, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3, lead(text, 4) OVER w AS t4 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    s AS (SELECT *, unnest(range(1, 6)) AS n FROM n)
    SELECT doc_id, line AS first_line, CAST(n AS INTEGER) AS lines, md5(concat_ws(' ', text, CASE WHEN n > 1 THEN t1 END, CASE WHEN n > 2 THEN t2 END, CASE WHEN n > 3 THEN t3 END, CASE WHEN n > 4 THEN t4 END)) AS window_md5
    FROM s WHERE n = 1 OR n = 2 AND t1 IS NOT NULL OR n = 3 AND t2 IS NOT NULL OR n = 4 AND t3 IS NOT NULL OR n = 5 AND t4 IS NOT NULL
    """,
)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one to five lines of all sections, joined by a space."""
    after = [F.lead("text", k).over(W.partitionBy("doc_id").orderBy("line")) for k in range(1, WINDOW_LINES)]
    rows = lines(spark, sf_dir).withColumn("ts", F.filter(F.array("text", *after), lambda t: t.isNotNull()))
    spans = rows.select("doc_id", "line", "ts", F.explode(F.sequence(F.lit(1), F.size("ts"))).alias("n"))
    return spans.select("doc_id", F.col("line").alias("first_line"), F.col("n").alias("lines"), F.md5(F.array_join(F.slice("ts", 1, F.col("n")), " ")).alias("window_md5"))


COUNT_SQL = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query(
    "line_classes",
    f"""
    WITH {LINES_SQL}, c AS (SELECT doc_id, text, {COUNT_SQL} AS words, len(regexp_extract_all(text, '\\p{{Lu}}')) AS up, len(regexp_extract_all(text, '\\p{{L}}')) AS letters FROM l)
    SELECT doc_id, CASE WHEN words = 0 THEN 'blank' WHEN length(text) <= 180 AND words BETWEEN 2 AND 24 AND (regexp_matches(text, '^[0-9]+[.)]') OR (NOT regexp_matches(text, '[.!?;:,]$') AND letters > 0 AND up >= 0.45 * letters)) THEN 'heading'
      WHEN words >= 12 THEN 'prose' ELSE 'short' END AS class, count(*) AS lines FROM c GROUP BY 1, 2
    """,
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, prose and other lines by document."""
    text = F.col("text")
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    open_end = ~text.rlike("[.!?;:,]$") & (uppercase_share(text) >= 0.45)
    heading = (F.length(text) <= 180) & count.between(2, 24) & (text.rlike(r"^[0-9]+[.)]") | open_end)
    kind = F.when(count == 0, "blank").when(heading, "heading").when(count >= 12, "prose").otherwise("short")
    return lines(spark, sf_dir).groupBy("doc_id", kind.alias("class")).agg(F.count("*").alias("lines"))


@query(
    "toc_signals",
    r"""
    SELECT doc_id, len(regexp_extract_all(text, '\.{3,}')) AS leaders, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]+$'))) AS numbered,
           len(regexp_extract_all(text, '\.{3,}')) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]+$'))) >= 3 AS toc_like FROM documents
    """,
)
def toc_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaders = F.regexp_count("text", F.lit(r"\.{3,}")).cast("long")
    numbered = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]+$"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", leaders.alias("leaders"), numbered.alias("numbered"), (leaders + numbered >= 3).alias("toc_like"))


TOKENS_SQL = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def tokens(column):
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, title)``: the first 60 characters of benchmark items."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 60).alias("title"))


PAIRS_SQL = f"""
    {LINES_SQL}, t AS (SELECT item_id, {TOKENS_SQL.format('left(text, 60)')} AS expected FROM benchmark),
    d AS (SELECT doc_id, line, list_distinct({TOKENS_SQL.format('text')}) AS found FROM l),
    x AS (SELECT item_id, len(expected) AS n, len(list_distinct(expected)) AS own, u.w, u.c FROM (SELECT item_id, expected, unnest(list_transform(list_distinct(expected), lambda y: {{'w': y, 'c': len(list_filter(expected, lambda z: z = y))}})) AS u FROM t)),
    c AS (SELECT item_id, doc_id, line, n, own, sum(c) AS hits, count(*) AS common, any_value(k) AS k FROM x JOIN (SELECT doc_id, line, len(found) AS k, unnest(found) AS w FROM d) USING (w) GROUP BY item_id, doc_id, line, n, own),
    q AS (SELECT item_id, doc_id, line, round(hits / n, 6) AS covered, round(common / (own + k - common), 6) AS jaccard FROM c WHERE hits >= 0.5 * n),
    p AS (SELECT item_id, doc_id, covered, jaccard FROM q QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY covered DESC, jaccard DESC, line) = 1)
"""
#: The share of a title's words that an anchor has at least.
LEAST_COVERED = 0.5


def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, doc_id, line, covered, jaccard)``: the best line of each document that has half of a title's words."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    found = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.array_distinct(tokens(x))).alias("found"))
    title = titles(spark, sf_dir).select("item_id", tokens("title").alias("expected")).filter(F.size("expected") > 0)
    rows = covered_lines(found, title, LEAST_COVERED)
    covered, shared = F.round(F.col("hits") / F.col("n"), 6), F.round(F.col("common") / (F.col("own") + F.col("k") - F.col("common")), 6)
    best = F.max(F.struct(covered.alias("covered"), shared.alias("jaccard"), (-F.col("line")).alias("less"))).alias("m")
    return rows.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", (-F.col("m.less")).alias("line"), "m.covered", "m.jaccard")


@query("token_coverage", f"WITH {PAIRS_SQL} SELECT item_id, doc_id, covered FROM p WHERE covered >= 0.5")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_pairs(spark, sf_dir).filter("covered >= 0.5").select("item_id", "doc_id", "covered")


@query("jaccard_pairs", f"WITH {PAIRS_SQL} SELECT item_id, doc_id, jaccard FROM p WHERE jaccard >= 0.1")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_pairs(spark, sf_dir).filter("jaccard >= 0.1").select("item_id", "doc_id", "jaccard")


RANKED_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY covered DESC, jaccard DESC, doc_id) AS rank, lead(covered) OVER (PARTITION BY item_id ORDER BY covered DESC, jaccard DESC, doc_id) AS next FROM p)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("item_id").orderBy(F.desc("covered"), F.desc("jaccard"), "doc_id")
    return anchor_pairs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("covered").over(w))


@query("anchor_pairs_topk", f"WITH {PAIRS_SQL}, {RANKED_SQL} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, covered FROM r WHERE rank <= 5")
def anchor_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best anchors of each title."""
    w = W.partitionBy("item_id").orderBy(F.desc("covered"), F.desc("jaccard"), "doc_id")
    return anchor_pairs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("item_id", "doc_id", "rank", "covered")


@query("ambiguity", f"WITH {PAIRS_SQL}, {RANKED_SQL} SELECT item_id, doc_id, coalesce(round(covered - next, 6) < 0.18, false) AS ambiguous FROM r WHERE rank = 1")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose best anchor leads by little."""
    return ranked(spark, sf_dir).filter("rank = 1").select("item_id", "doc_id", F.coalesce(F.round(F.col("covered") - F.col("next"), 6) < 0.18, F.lit(False)).alias("ambiguous"))


@query("unique_max", f"WITH {PAIRS_SQL} SELECT item_id, max(covered) AS most, count(*) FILTER (WHERE covered = m) AS ties FROM (SELECT *, max(covered) OVER (PARTITION BY item_id) AS m FROM p) GROUP BY item_id")
def unique_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchors share the best score."""
    scores = anchor_pairs(spark, sf_dir).groupBy("item_id", "covered").agg(F.count("*").alias("ties"))
    return scores.groupBy("item_id").agg(F.max(F.struct("covered", "ties")).alias("m")).select("item_id", F.col("m.covered").alias("most"), F.col("m.ties").alias("ties"))


#: Anchors that are sent at once, about.
ANCHORS = 1 << 16


@query("ordered_anchors")
def ordered_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a title's words follow each other in its best anchors."""
    w = W.partitionBy("item_id").orderBy(F.desc("covered"), F.desc("jaccard"), "doc_id")
    best = stage(anchor_pairs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("item_id", "doc_id", "line"), "best-anchors")
    parts, named = max(1, -(-best.count() // ANCHORS)), best.join(titles(spark, sf_dir), "item_id")
    text = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    # anchors are five for each title, and a bounded part of them is sent to the texts
    every = [text.join(F.broadcast(named.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)), "doc_id") for k in range(parts)]
    rows = reduce(DataFrame.unionByName, every).withColumn("text", F.get("lines", F.col("line"))).filter("text IS NOT NULL")
    return rows.select("item_id", "doc_id", F.round(ordered_coverage(tokens("title"), tokens("text")), 6).alias("ordered"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All titles and all openings, in one block; neither has labels or divisions."""
    none = F.lit(None).cast("string")
    left = titles(spark, sf_dir).select(F.lit(0).alias("block"), F.col("item_id").alias("a"), F.col("title").alias("a_title"), none.alias("a_label"), none.alias("a_part"))
    right = table(spark, sf_dir, "documents").select(F.lit(0).alias("block"), F.col("doc_id").alias("b"), F.substring("text", 1, 60).alias("b_title"), F.col("doc_id").alias("ord"), none.alias("b_label"), none.alias("b_part"))
    return left, right


@query("best_node_match")
def best_node_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar opening of each title."""
    left, right = _sides(spark, sf_dir)
    return best_of_all(left.drop("a_label", "a_part"), right.drop("b_label", "b_part"), "block").select("a", "b", "score")


@query("chapter_match")
def chapter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and openings one to one, by the weighted score of chapters."""
    return one_to_one_of_all(*_sides(spark, sf_dir), "block").select("a", "b", "score")


@query("toc_parse")
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of each page: its main heading as a chapter, its list items as entries; pages have no numbers, hence 0."""
    text = F.regexp_replace("html", "(?s)<(script|style).*?</\\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<h1[^>]*>([^<]+)", "\nCapítulo I – $1 0\n"), "(?s)<li[^>]*>\\s*(?:<[^>]+>)*([^<]+)", "\n$1 .... 0\n")
    text = F.regexp_replace(text, "<[^>]+>", "\n")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(text, r"\n+")).alias("line", "text"))
    return outline(pages.filter(F.trim("text") != ""))


@query("search_text")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items normalised for anchor search."""
    return table(spark, sf_dir, "benchmark").select("item_id", normalised(search_form, "text").alias("normalised"))
