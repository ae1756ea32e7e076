"""Structure and content audits of ordered sections.

``documents`` stand for sections: source is the book, doc_id the position, lang tells the kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioflow.catalog import query
from folioflow.functions.text import blank_to_null, fingerprint, words
from folioflow.scratch import table

WORDS_SQL = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


def word_count():
    return F.size(words("text")).cast("long")


def all_sorted(column: str) -> Column:
    """All values of a group in ascending order, nulls last."""
    return F.concat(F.sort_array(F.collect_list(column)), F.array_repeat(F.lit(None), F.count_if(F.col(column).isNull()).cast("int")))


@query(
    "inventory_by_source",
    f"""
    SELECT source, count(*) AS sections, min(doc_id) AS first_position, max(doc_id) AS last_position,
           count(DISTINCT lang) FILTER (WHERE n_chars > 500) AS long_langs, count(*) FILTER (WHERE lang = 'en') AS content_sections,
           CAST(coalesce(sum({WORDS_SQL}) FILTER (WHERE lang = 'en'), 0) AS BIGINT) AS content_words
    FROM documents GROUP BY source
    """,
)
def inventory_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("sections"), F.min("doc_id").alias("first_position"), F.max("doc_id").alias("last_position"),
        F.count_distinct(F.when(F.col("n_chars") > 500, F.col("lang"))).alias("long_langs"), F.count_if(F.col("lang") == "en").alias("content_sections"),
        F.coalesce(F.sum(F.when(F.col("lang") == "en", word_count())), F.lit(0)).alias("content_words"),
    )


@query(
    "duplicate_positions",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that several rows of one parent hold."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("l_partkey")).alias("parts")).filter("copies > 1")


@query(
    "position_gaps",
    """
    SELECT l_orderkey, previous, l_linenumber AS position, l_linenumber - previous - 1 AS missing FROM (
      SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous
      FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber - previous > 1
    """,
)
def position_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    previous = F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    gap = F.col("l_linenumber") - F.col("previous")
    return distinct.withColumn("previous", previous).filter(gap > 1).select("l_orderkey", "previous", F.col("l_linenumber").alias("position"), (gap - 1).alias("missing"))


@query(
    "size_distribution",
    """
    SELECT lang, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75,
           max(n_chars) AS most, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS deviation FROM documents GROUP BY lang
    """,
)
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "n_chars"
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.min(n).alias("least"), F.expr("percentile(n_chars, 0.25)").alias("p25"), F.expr("percentile(n_chars, 0.5)").alias("median"), F.expr("percentile(n_chars, 0.75)").alias("p75"),
        F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_pop(n), 4).alias("deviation"),
    )


@query(
    "common_sizes",
    """
    SELECT lang, n_chars, count(*) AS sections, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share
    FROM documents GROUP BY lang, n_chars QUALIFY count(*) >= 2
    """,
)
def common_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that sections of a kind share, with their share of the kind."""
    sizes = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("sections"))
    share = F.round(F.lit(100.0) * F.col("sections") / F.sum("sections").over(W.partitionBy("lang")), 6)
    return sizes.withColumn("share", share).filter("sections >= 2")


@query("size_outliers", f"SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS words FROM documents WHERE {WORDS_SQL} < 25 OR {WORDS_SQL} > 1200")
def size_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words")).filter("words < 25 OR words > 1200")


@query(
    "weak_metadata",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing-label' WHEN nullif(trim(split_part(text, chr(10), 1)), '') IS NULL THEN 'blank-title'
      WHEN lang <> 'en' AND quality = 0 THEN 'weak-kind' ELSE 'toxic-label' END AS issue
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.doc_id IS NULL OR nullif(trim(split_part(text, chr(10), 1)), '') IS NULL OR (lang <> 'en' AND quality = 0) OR toxic = 1
    """,
)
def weak_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issue of each section that has any."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    docs = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    title = blank_to_null(F.split_part("text", F.lit("\n"), F.lit(1)))
    issue = (
        F.when(F.col("labelled").isNull(), "missing-label").when(title.isNull(), "blank-title")
        .when((F.col("lang") != "en") & (F.col("quality") == 0), "weak-kind").when(F.col("toxic") == 1, "toxic-label")
    )
    return docs.select("doc_id", issue.alias("issue")).filter("issue IS NOT NULL")


@query(
    "paragraph_diagnostics",
    r"""
    SELECT source, count(*) FILTER (WHERE instr(text, chr(10) || chr(10)) > 0) AS double_breaks,
           count(*) FILTER (WHERE length(text) > 3000 AND instr(text, chr(10)) = 0) AS long_unbroken,
           count(*) FILTER (WHERE regexp_matches(text, '[^\n]\n[^\n]')) AS single_breaks,
           round(avg(greatest(1, len(string_split_regex(text, '\n+')))), 6) AS mean_blocks
    FROM documents GROUP BY source
    """,
)
def paragraph_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count_if(F.instr(text, "\n\n") > 0).alias("double_breaks"), F.count_if((F.length(text) > 3000) & (F.instr(text, "\n") == 0)).alias("long_unbroken"),
        F.count_if(text.rlike(r"[^\n]\n[^\n]")).alias("single_breaks"), F.round(F.avg(F.greatest(F.lit(1), F.size(F.split(text, r"\n+")))), 6).alias("mean_blocks"),
    )


CONTENT = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"


@query(
    "duplicate_content",
    f"SELECT md5({CONTENT}) AS content_md5, lang, count(*) AS copies, list_sort(list(doc_id)) AS doc_ids, min(doc_id) AS first_doc, min(left({CONTENT}, 80)) AS preview FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several sections have, with all of those; ``duplicate_members`` has them a row each."""
    start = F.left(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")), F.lit(80))
    rows = table(spark, sf_dir, "documents").groupBy(fingerprint("text").alias("content_md5"), "lang")
    return rows.agg(F.count("*").alias("copies"), all_sorted("doc_id").alias("doc_ids"), F.min("doc_id").alias("first_doc"), F.min(start).alias("preview")).filter("copies > 1")


@query(
    "duplicate_members",
    f"SELECT doc_id, lang, content_md5, first_doc FROM (SELECT doc_id, lang, md5({CONTENT}) AS content_md5, min(doc_id) OVER w AS first_doc, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY lang, md5({CONTENT}))) WHERE n > 1",
)
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section whose content others have too, a row each; a group of any size is joined with its one row of ``duplicate_content``."""
    groups = duplicate_content(spark, sf_dir).select("content_md5", F.col("lang").alias("of"), "first_doc")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", fingerprint("text").alias("content_md5"))
    return rows.join(groups.withColumnRenamed("content_md5", "md5"), (F.col("content_md5") == F.col("md5")) & F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", "content_md5", "first_doc")


@query(
    "repeated_openings",
    r"""
    SELECT left(o, 120) AS opening, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS o FROM documents)
    WHERE length(o) >= 120 GROUP BY 1 HAVING count(*) > 1
    """,
)
def repeated_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", whole.alias("o")).filter(F.length("o") >= 120)
    return rows.groupBy(F.substring("o", 1, 120).alias("opening")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(
    "structure_map",
    "SELECT source, lang, min(doc_id) AS first_position, max(doc_id) AS last_position, count(*) AS sections FROM documents GROUP BY source, lang",
)
def structure_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and chapters by their first position."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang")
    return rows.agg(F.min("doc_id").alias("first_position"), F.max("doc_id").alias("last_position"), F.count("*").alias("sections"))


@query(
    "extraction_qa",
    r"""
    SELECT source, count(*) AS pages, count(*) FILTER (WHERE trim(text) = '') AS empty_pages, CAST(sum(length(text)) AS BIGINT) AS characters,
           round(100.0 * count(*) FILTER (WHERE length(text) >= 200) / count(*), 4) AS coverage,
           CAST(sum(len(regexp_extract_all(text, '[a-z]-\n[a-z]'))) AS BIGINT) AS hyphenated, count(*) FILTER (WHERE length(text) >= 200) < 0.8 * count(*) AS needs_ocr
    FROM documents GROUP BY source
    """,
)
def extraction_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of extracted text by book, in one pass."""
    full = F.count_if(F.length("text") >= 200)
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.trim("text") == "").alias("empty_pages"), F.sum(F.length("text")).alias("characters"),
        F.round(F.lit(100.0) * full / F.count("*"), 4).alias("coverage"), F.sum(F.regexp_count("text", F.lit(r"[a-z]-\n[a-z]"))).alias("hyphenated"),
        (full < 0.8 * F.count("*")).alias("needs_ocr"),
    )


@query(
    "edge_lines",
    r"""
    WITH l AS (SELECT doc_id, unnest(list_distinct(list_concat(ls[1:3], ls[-3:]))) AS line FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents))
    SELECT line, count(*) AS pages FROM l WHERE length(line) BETWEEN 3 AND 90 GROUP BY line HAVING count(*) >= 5
    """,
)
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short first and last lines that pages share."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edges = F.array_distinct(F.concat(F.slice("ls", 1, 3), F.slice("ls", F.greatest(F.size("ls") - 2, F.lit(1)), 3)))
    rows = table(spark, sf_dir, "documents").select(lines.alias("ls")).select(F.explode(edges).alias("line")).filter(F.length("line").between(3, 90))
    return rows.groupBy("line").agg(F.count("*").alias("pages")).filter("pages >= 5")


@query(
    "size_bands",
    f"""
    SELECT CASE WHEN w <= 0 OR w IS NULL THEN 'unknown' WHEN w <= 450 THEN 'brief' WHEN w <= 1200 THEN 'standard' WHEN w <= 2500 THEN 'long' ELSE 'oversized' END AS band, count(*) AS sections
    FROM (SELECT {WORDS_SQL} AS w FROM documents) GROUP BY 1
    """,
)
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(size_band(word_count()).alias("band")).agg(F.count("*").alias("sections"))


def size_band(count):
    """Bands of word counts; unknown without any."""
    return F.when(count.isNull() | (count <= 0), "unknown").when(count <= 450, "brief").when(count <= 1200, "standard").when(count <= 2500, "long").otherwise("oversized")


@query(
    "structure_export",
    r"""
    SELECT doc_id, length(text) AS characters, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, len(string_split_regex(text, '\n\n+'))) END AS blocks,
           md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS content_md5 FROM documents
    """,
)
def structure_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.when(F.trim("text") == "", 0).otherwise(F.greatest(F.lit(1), F.size(F.split("text", r"\n\n+")))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("characters"), blocks.alias("blocks"), fingerprint("text").alias("content_md5"))
