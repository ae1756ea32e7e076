"""Current sections and the nodes of a structure: from the nearest kind of match to the last resort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.operators.linkage import best_of_all

#: Words from which on a section is too large, the score of a whole chapter, and nodes that stand by themselves.
OVERSIZED, WHOLE_CHAPTER = 1200, 0.6
STANDALONE = ("front_matter", "back_matter", "division")


def cascade(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows(row_id, kind, part_title, section_title, record_title, chapter_id, words)`` and ``nodes(id, type, title, chapter_id, ord)``.

    Introductions of parts look among divisions, contents among what is below their chapter, or among standalone nodes if they
    have none; introductions of chapters, and contents without a match, take their chapter. As a row looks in one of these
    places only, all titles are compared in one search by blocks. A row of no kind is content; an empty title gives way to the record's.
    Returns ``(row_id, node_id, node_type, confidence, score, action)``, one row for each of ``rows``.
    """
    kind = F.coalesce("kind", F.lit("content"))
    title = F.coalesce(F.nullif(F.when(kind == "part_intro", F.col("part_title")).otherwise(F.col("section_title")), F.lit("")), F.col("record_title"))
    below = F.concat(F.lit("below "), F.col("chapter_id").cast("string"))
    place = F.when(kind == "part_intro", "divisions").when(kind == "content", F.coalesce(below, F.lit("standalone")))
    left = rows.select(place.alias("block"), F.col("row_id").alias("a"), title.alias("a_title")).filter("block IS NOT NULL AND a_title IS NOT NULL")
    places = F.array_compact(F.array(F.when(F.col("type") == "division", "divisions"), F.when(F.col("type").isin(*STANDALONE), "standalone"), below))
    right = nodes.select(F.explode(places).alias("block"), F.col("id").alias("b"), F.col("title").alias("b_title"), "ord")
    found = best_of_all(left, right, "block").select(F.col("a").alias("row_id"), F.col("b").alias("found"), F.col("score").alias("likeness"))

    parents = nodes.filter("chapter_id IS NOT NULL").select("chapter_id").distinct().withColumn("has_parts", F.lit(True))
    every = rows.withColumn("kind", kind).join(found, "row_id", "left").join(parents, "chapter_id", "left")
    matched, exact, large = F.col("found").isNotNull(), F.col("likeness") == 1.0, F.coalesce(F.col("words") > OVERSIZED, F.lit(False))
    chapter = F.col("chapter_id").isNotNull()
    intro, whole = (F.col("kind") == "chapter_intro") & chapter, (F.col("kind") == "content") & chapter & ~matched
    node = F.coalesce("found", F.when(intro | whole, F.col("chapter_id")))
    confidence = F.when(matched, F.when(exact, "exact").otherwise("fuzzy")).when(intro, "chapter").when(whole, "chapter-aggregate").otherwise("unmatched")
    score = F.when(matched, F.col("likeness")).when(intro, 1.0).when(whole, WHOLE_CHAPTER).otherwise(0.0)
    action = (
        F.when(matched & (F.col("kind") == "part_intro"), "keep").when(matched & chapter, F.when(exact, "keep").otherwise("relabel-review")).when(matched, "reclassify")
        .when(intro, "keep").when(whole & (F.col("has_parts").isNotNull() | large), "split").otherwise("review")
    )
    named = every.select("row_id", node.alias("node_id"), confidence.alias("confidence"), F.round(score, 4).alias("score"), action.alias("action"), large.alias("large"))
    out = named.join(nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type")), "node_id", "left")
    return out.select("row_id", "node_id", "node_type", "confidence", "score", F.when(F.col("large") & F.col("node_type").isin("chapter", "division"), "split").otherwise(F.col("action")).alias("action"))
