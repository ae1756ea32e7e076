"""Where titles begin in works of many pages, from text to ordered pairs.

A page is cut into blocks at numbered and heading-like lines. For each title and work the best blocks are found as a rank
join: what words tell of a title and a block bounds its score from below and from above; those that can't be
among the best are left out, and only the rest are scored by matching blocks of words and characters, for which there is
no built-in function. Blocks without a common word are looked at only for titles and works whose last place they could
take. Pairs of a current title and its successor are made from the best blocks of both, without those that can't reach
the least score of a pair.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow import scratch
from folioflow.functions.matching import Second
from folioflow.functions.similarity import anchor_score
from folioflow.functions.text import normalised, search_text, telling, telling_words

#: Fixed patterns: a numbered paragraph, and a row of dots as in tables of contents.
NUMBERED = r"^\s*(\d{1,4}[a-zA-Z]?)\s*[.)\-–—]\s+"
LEADER = r"\.{4,}"


@dataclass(frozen=True)
class Rules:
    """Fixed values of discovery."""

    block_lines: int = 14
    candidates: int = 12
    pairs: int = 5
    least_coverage: float = 0.2
    least_sequence: float = 0.12
    least_score: float = 0.8
    least_pair: float = 2.0
    ambiguous_gap: float = 0.45
    page_gap: int = 45
    front_pages: int = 15
    front_penalty: float = 5.0
    same_page: float = 1.25
    next_page: float = 0.75
    numbered: float = 0.75
    heading: float = 0.35


#: Scores that differ by less than this are not told apart by bounds.
MARGIN = 1e-5
BLOCK = ["work", "page", "start_line"]


def is_heading(line: Column) -> Column:
    """2 to 24 words in at most 180 characters: numbered, or without a mark at the end and with capitals."""
    said = F.trim(line)
    words = F.filter(F.split(said, r"\s+"), lambda w: w != "")
    letters, capitals = F.regexp_count(said, F.lit(r"\p{L}")), F.regexp_count(said, F.lit(r"\p{Lu}"))
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))
    open_end = ~said.rlike("[.;,:]$") & (letters > 0) & ((capitals >= 0.45 * letters) | titled)
    return (F.length(said) <= 180) & F.size(words).between(2, 24) & (said.rlike(NUMBERED) | open_end)


def blocks(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pages(work, page, text)`` -> a row for each block with words, with its normalised text and significant words.

    A page is one row from its text to its blocks, so nothing is shuffled.
    """
    lines = pages.select("work", "page", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = lines.withColumn("flags", F.transform("lines", lambda x: F.struct(x.rlike(NUMBERED).alias("numbered"), is_heading(x).alias("heading"))))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    lines = lines.withColumn("starts", F.filter(places, lambda i: (i == 0) | F.get("flags", i)["numbered"] | F.get("flags", i)["heading"]))
    leaders = F.size(F.filter("lines", lambda x: x.rlike(LEADER)))
    contents = F.lower(F.array_join("lines", " ")).rlike("sum[aá]rio|[ií]ndice")
    lines = lines.withColumn("front", (F.col("page") <= rules.front_pages) & (contents | (leaders >= 3)))

    def cut(start: Column, k: Column) -> Column:
        end = F.least(start + rules.block_lines, F.coalesce(F.get("starts", k + 1), F.size("lines")), F.size("lines"))
        return F.struct(start.alias("start_line"), end.alias("end_line"), F.get("flags", start).alias("flag"), F.array_join(F.slice("lines", start + 1, end - start), " ").alias("text"))

    rows = lines.select("work", "page", "front", F.inline(F.transform("starts", cut)))
    kind = F.when(F.col("flag.numbered"), "numbered-paragraph").when(F.col("flag.heading"), "heading-like").otherwise("page-opening")
    rows = rows.withColumn("kind", kind).withColumn("norm", normalised(search_text, "text")).filter("norm <> ''")
    return rows.select(*BLOCK, "end_line", "kind", "front", "norm", telling(F.split("norm", " ")).alias("words"))


def named(titles: DataFrame) -> DataFrame:
    """``titles(id, work, title)`` with what is looked for: normalised text, significant words, and the words that count."""
    rows = titles.select("id", "work", normalised(search_text, "title").alias("t_norm")).filter("t_norm <> ''")
    every = F.split("t_norm", " ")
    rows = rows.withColumn("t_words", telling(every)).withColumn("plainly", F.size("t_words") == 0)
    # a title of stop words only is looked for by all its words
    rows = rows.withColumn("expected", F.when(F.col("plainly"), every).otherwise(F.col("t_words"))).withColumn("long", F.filter("t_words", lambda w: F.length(w) >= 6))
    # a text that holds the title has all its words but the first and the last, which may be parts of words
    inner = F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0)))
    return rows.withColumn("inner", F.array_intersect("expected", inner))


def _met(title: DataFrame, block: DataFrame) -> DataFrame:
    """``(id, work, page, start_line)`` of titles and blocks with common words, and how many of each kind are found."""
    count = lambda words: F.size(F.filter(words, lambda w: w == F.col("word")))
    asked = title.withColumn("word", F.explode(F.array_distinct("expected")))
    asked = asked.select("id", "work", "plainly", "word", count("expected").alias("c"), count("long").alias("l"), count("t_words").alias("t"), F.array_contains("inner", F.col("word")).cast("int").alias("i"))
    said = block.select(*BLOCK, F.lit(False).alias("plainly"), F.explode(F.array_distinct("words")).alias("word"))
    every = block.join(title.filter("plainly").select("work").distinct(), "work", "left_semi")
    plain = every.select(*BLOCK, F.lit(True).alias("plainly"), F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    return asked.join(said.unionByName(plain), ["work", "plainly", "word"]).groupBy("id", *BLOCK).agg(*(F.sum(c).alias(c) for c in "clti"))


def _bounded(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Pairs with shares, bonuses, and the least and most that their score can be, from numbers alone."""
    rows = pairs.withColumn("covered", F.col("c") / F.col("n_expected"))
    rows = rows.withColumn("distinctive", F.when(F.col("n_long") > 0, F.col("l") / F.col("n_long")).otherwise(F.col("covered")))
    bonus = F.when(F.col("kind") == "numbered-paragraph", rules.numbered).when(F.col("kind") == "heading-like", rules.heading).otherwise(0.0)
    penalty = F.when(F.col("front"), rules.front_penalty).otherwise(0.0)
    zero = F.lit(0.0)
    known = anchor_score(F.col("exact"), F.col("covered"), F.col("distinctive"), zero, zero, bonus, zero, penalty, F.col("end_line") - F.col("start_line"))
    # of two lists at most the common elements match, counted once for each of the first
    ordered = F.when((F.col("n_words") > 0) & ~F.col("plainly"), 2 * F.col("t") / (F.col("n_title") + F.col("n_words"))).otherwise(0.0)
    size = F.col("t_size")
    seen = F.least("size", F.greatest(F.lit(500), 5 * size))
    return rows.withColumn("known", known).withColumn("most", known + 1.5 * ordered + 2 * F.least(size, seen) / (size + seen))


def _ratios(titles: Iterable[str], texts: Iterable[str]) -> list[tuple[float, float]]:
    """``ordered_ratio`` and ``sequence_ratio`` of titles and texts. What is known of a text serves all titles that follow for it."""
    out, words, seconds, last = [], {}, {}, None
    for title, text in zip(titles, texts, strict=True):
        if text != last:
            seconds, last = {}, text
        if title not in words:
            words[title] = telling_words(title)
        own, size = words[title], max(500, 5 * len(title))
        if "words" not in seconds:
            seconds["words"] = Second(telling_words(text))
        if size not in seconds:
            seconds[size] = Second(text[:size])
        said = seconds["words"]
        out.append((said.ratio(own) if own and said.b else 0.0, seconds[size].ratio(title) if title and text else 0.0))
    return out


def _scored(pairs: DataFrame, rules: Rules) -> DataFrame:
    """The score of each pair and what it is made of; without those that are no candidates."""

    def compared(titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_ratios(titles, texts), columns=["ordered", "sequence"], dtype="float64")

    rows = pairs.withColumn("ratios", F.pandas_udf(compared, "ordered double, sequence double")("t_norm", "norm")).select("*", "ratios.*").drop("ratios")
    rows = rows.filter(F.col("exact") | (F.col("covered") >= rules.least_coverage) | (F.col("sequence") >= rules.least_sequence))
    score = F.col("known") + 1.5 * F.col("ordered") + F.col("sequence")
    kept = rows.withColumn("score", score).filter(F.col("score") >= rules.least_score)
    return kept.select("id", *BLOCK, "end_line", "kind", "front", "exact", *(F.round(c, 6).alias(c) for c in ("covered", "distinctive", "ordered", "sequence", "score")))


def _best(scored: DataFrame, rules: Rules) -> DataFrame:
    order = W.partitionBy("id", "work").orderBy(F.desc("score"), "page", "start_line")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.candidates)


def candidates(titles: DataFrame, pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The best blocks of each of ``titles(id, work, title)`` in its work: by score, then page and line, with their rank.

    Texts count whole. Null and blank titles and pages give nothing; repeated titles have one id, repeated pages one number.
    """
    with scratch.Room(pages.sparkSession) as room:
        return scratch.stage(_candidates(titles, pages, rules, room), "anchor-candidates")


def _candidates(titles: DataFrame, pages: DataFrame, rules: Rules, room: scratch.Room) -> DataFrame:
    block, title = room.stage(blocks(pages, rules), "blocks"), room.stage(named(titles), "titles")
    block_numbers = block.select(*BLOCK, "end_line", "kind", "front", F.size("words").alias("n_words"), F.length("norm").alias("size"))
    title_numbers = title.select("id", "work", "plainly", F.size("expected").alias("n_expected"), F.size("long").alias("n_long"), F.size("t_words").alias("n_title"), F.size("inner").alias("n_inner"), F.length("t_norm").alias("t_size"))
    texts, asked = block.select(*BLOCK, "norm"), title.select("id", "work", "t_norm")

    met = room.stage(_met(title, block), "met")
    pairs = met.join(block_numbers, BLOCK).join(title_numbers, ["id", "work"])
    whole = pairs.filter("i = n_inner").select("id", *BLOCK).join(asked, ["id", "work"]).join(texts, BLOCK).filter(F.contains("norm", "t_norm"))
    holds = room.stage(whole.select("id", *BLOCK, F.lit(True).alias("exact")), "exact")
    pairs = pairs.join(holds, ["id", *BLOCK], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    bounded = room.stage(_bounded(pairs, rules).filter(F.col("most") >= rules.least_score - MARGIN), "bounded")

    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def wide(rows: DataFrame) -> DataFrame:
        """With texts; pairs of a block follow each other."""
        return rows.join(asked, ["id", "work"]).repartition(tasks, *BLOCK).sortWithinPartitions(*BLOCK).join(texts, BLOCK)

    place = F.row_number().over(W.partitionBy("id", "work").orderBy(F.desc("most"), "page", "start_line"))
    ranked = bounded.withColumn("place", place)
    first = room.stage(_scored(wide(ranked.filter(F.col("place") <= rules.candidates)), rules), "first")
    least = room.stage(_last(first, rules), "least")
    rest = ranked.filter(F.col("place") > rules.candidates).join(least, ["id", "work"], "left").filter(F.col("lowest").isNull() | (F.col("most") >= F.col("lowest") - MARGIN))
    second = room.stage(first.unionByName(_scored(wide(rest), rules)), "second")

    # without a common word a block has its characters and its kind, and may hold the whole title within a word
    least = room.stage(_last(second, rules), "least-of-all")
    open_titles = title_numbers.join(least, ["id", "work"], "left").filter("n_inner = 0 OR lowest IS NULL" + f" OR lowest <= {1 + rules.numbered + MARGIN}")
    others = open_titles.join(block_numbers, "work").join(met.select("id", *BLOCK), ["id", *BLOCK], "left_anti")
    others = others.withColumns({c: F.lit(0) for c in "clt"}).withColumn("exact", F.lit(False))
    others = _bounded(others, rules).filter((F.col("n_inner") == 0) | (F.col("most") >= F.greatest(F.coalesce("lowest", F.lit(0.0)), F.lit(rules.least_score)) - MARGIN))
    held = F.contains("norm", "t_norm")
    others = wide(others).withColumn("known", F.col("known") + 8 * held.cast("int")).withColumn("most", F.col("most") + 8 * held.cast("int")).withColumn("exact", held)
    others = others.filter(F.col("most") >= F.greatest(F.coalesce("lowest", F.lit(0.0)), F.lit(rules.least_score)) - MARGIN)
    return _best(second.unionByName(_scored(others, rules)), rules)


def _last(scored: DataFrame, rules: Rules) -> DataFrame:
    """``(id, work, lowest)``: the score of the last place, where all places are taken."""
    return _best(scored, rules).filter(F.col("rank") == rules.candidates).select("id", "work", F.col("score").alias("lowest"))


def pairs(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The best pairs of each item and work from ``found(item, successor, work, page, start_line, rank, score, exact)``.

    A successor lies strictly behind its current title and within some pages. ``ambiguous`` tells whether the second best is close.
    """
    kept = ["page", "start_line", "rank", "score"]
    one = found.filter("NOT successor").select("item", "work", *(F.col(c).alias(f"c_{c}") for c in kept))
    two = found.filter("successor").select("item", "work", *(F.col(c).alias(f"s_{c}") for c in kept))
    most = two.groupBy("item", "work").agg(F.max("s_score").alias("most"))
    one = one.join(most, ["item", "work"]).filter(F.col("c_score") + F.col("most") + rules.same_page >= rules.least_pair).drop("most")
    gap = F.col("s_page") - F.col("c_page")
    later = (gap > 0) | ((gap == 0) & (F.col("s_start_line") > F.col("c_start_line")))
    bonus = F.when(gap == 0, rules.same_page).when(gap == 1, rules.next_page).otherwise(0.0)
    score = F.col("c_score") + F.col("s_score") + bonus - F.greatest(F.lit(0), gap - 1) * 0.025
    rows = one.join(two, ["item", "work"]).filter(later & (gap <= rules.page_gap)).withColumn("pair", score).filter(F.col("pair") >= rules.least_pair)
    rows = rows.withColumn("gap", gap).withColumn("pair_score", F.round("pair", 6))
    order = W.partitionBy("item", "work").orderBy(F.desc("pair_score"), "gap", "c_page", "c_start_line", "s_rank")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("pair_score").over(order))
    close = (F.col("place") == 1) & F.coalesce(F.round(F.col("pair_score") - F.col("next"), 6) < rules.ambiguous_gap, F.lit(False))
    return ranked.filter(F.col("place") <= rules.pairs).select(
        "item", "work", "place", "c_page", "c_start_line", "s_page", "s_start_line", "gap", "pair_score", close.alias("ambiguous")
    )
