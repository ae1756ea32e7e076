"""Trees, locators, intervals, the cascade, and contracts of files."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions.locators import anchor_signature, anchor_tokens, semantic_locator, structural_interval
from folioflow.functions.similarity import title_likeness
from folioflow.operators.cascade import cascade
from folioflow.operators.tables import load_in_order
from folioflow.plans.structure import sections_and_nodes, tree_errors
from folioflow.sources import files


def test_tree_errors(spark):
    rows = [(1, 1, "a", None, "division"), (1, 2, "b", "a", "chapter"), (2, 1, "a", "b", "verse"), (2, 3, "a", None, "chapter"), (2, 3, " ", None, None)]
    got = {r.work: r.asDict() for r in tree_errors(spark.createDataFrame(rows, "work int, ord int, id string, parent string, type string").withColumn("content", F.lit(""))).collect()}
    assert got[1] == {"work": 1, "missing_id": 0, "duplicate_id": 0, "misordered": 0, "invalid_type": 0, "missing_parent": 0, "chapters": 1, "divisions": 1, "full_text_fields": 1}
    assert got[2] == {"work": 2, "missing_id": 1, "duplicate_id": 1, "misordered": 1, "invalid_type": 2, "missing_parent": 1, "chapters": 1, "divisions": 0, "full_text_fields": 1}


def test_locators(spark):
    schema = "id int, l struct<type: string, value: string, page: int, basis: string, marks: array<struct<type: string, value: string>>, at: struct<line: int, ok: boolean>>"
    rows = [(1, ("verse", " 3 ", 7, "x", [("page", "2"), ("mark", "é"), None, (None, "z")], (5, True))), (2, ("page", "3", 7, "x", [], None)), (3, None), (4, ("verse", " ", 1, None, None, (None, None)))]
    df = spark.createDataFrame(rows, schema)
    tokens = df.select("id", anchor_tokens(F.col("l"), df.schema["l"].dataType).alias("t"))
    got = {r.id: (r.t, r.s) for r in tokens.withColumn("s", anchor_signature(F.col("t"))).collect()}
    assert got[1][0] == sorted(["locator.type=verse", "type=verse", "value=3", "marks[1].type=mark", "marks[1].value=é", "marks[3].value=z", "at.line=5", "at.ok=true"]) and len(got[1][1]) == 24
    assert got[2] == got[3] == ([], None) and got[4][0] == ["type=verse"]
    pairs = [("verse", "1"), ("page", "1"), (" ", "1"), (None, "1"), ("verse", " "), ("verse", None)]
    found = spark.createDataFrame(pairs, "t string, v string").select(semantic_locator(F.col("t"), F.col("v")).alias("x")).select("x.*").collect()
    assert [r.available for r in found] == [True] + [False] * 5
    assert [r.normalized for r in found] == ['{"type":"verse","value":"1"}'] + [None] * 5


def test_structural_interval(spark):
    cases = [([], True), (["", "  "], True), ([" • A", "b"], True), (["A", "• b"], False), (["• A", "1. b"], False), (["• A", " 12 – b"], False), (["• A", "“b"], False), (["• A", '"b'], False), (["• A", "12 b"], True)]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x array<string>")
    assert [r[0] for r in rows.orderBy("k").select(structural_interval(F.col("x"))).collect()] == [y for _, y in cases]


def expected_match(row, nodes, by_chapter):
    def best(title, among):
        found = [(-round(title_likeness(title, n.title), 6), n.ord, n.id, n) for n in among] if title and title.strip() else []
        score, _, _, n = min(found, default=(0, 0, "", None))
        return (n, -score) if -score >= 0.82 else (None, 0.0)

    kind, chapter = row.kind or "content", row.chapter_id
    divisions = [n for n in nodes.values() if n.type == "division"]
    node, score, confidence, action = None, 0.0, "unmatched", "review"
    if kind == "part_intro":
        node, score = best(row.part_title or row.record_title, divisions)
        action = "keep" if node else action
    elif kind == "chapter_intro" and chapter:
        node, score, confidence, action = nodes[chapter], 1.0, "chapter", "keep"
    elif kind == "content":
        title = row.section_title or row.record_title
        node, score = best(title, by_chapter.get(chapter, []) if chapter else divisions + [n for n in nodes.values() if n.type in ("front_matter", "back_matter")])
        if node:
            action = ("keep" if score == 1 else "relabel-review") if chapter else "reclassify"
        elif chapter:
            node, score, confidence = nodes[chapter], 0.6, "chapter-aggregate"
            action = "split" if by_chapter.get(chapter) or (row.words or 0) > 1200 else "review"
    if node and confidence == "unmatched":
        confidence = "exact" if score == 1 else "fuzzy"
    if node and (row.words or 0) > 1200 and node.type in ("chapter", "division"):
        action = "split"
    return node and node.id, node and node.type, confidence, round(score, 4), action


def test_cascade(spark, data):
    rows, nodes = sections_and_nodes(spark, data)
    extra = [(-1, None, None, "Prefácio", None, None, 10), (-2, "part_intro", " ", None, "Asía", None, None), (-3, "content", None, None, None, "x1", 10), (-4, "content", None, "Nada", None, "x1", 1300), (-5, "note", None, "Prefacio", None, None, 1)]
    more = [("f1", "front_matter", "Prefacio", None, 0), ("x1", "chapter", "Sem partes", None, 1), ("g1", "group", None, "n0", 2)]
    rows, nodes = rows.unionByName(spark.createDataFrame(extra, rows.schema)), nodes.unionByName(spark.createDataFrame(more, nodes.schema))
    known = {n.id: n for n in nodes.collect()}
    by_chapter = {}
    for n in known.values():
        by_chapter.setdefault(n.chapter_id, []).append(n)
    by_chapter.pop(None)
    want = {r.row_id: expected_match(r, known, by_chapter) for r in rows.collect()}
    assert {r.row_id: tuple(r)[1:] for r in cascade(rows, nodes).collect()} == want
    assert {w[2] for w in want.values()} == {"exact", "fuzzy", "chapter", "chapter-aggregate", "unmatched"}
    assert {w[4] for w in want.values()} == {"keep", "relabel-review", "reclassify", "split", "review"}
    assert cascade(rows.limit(0), nodes.limit(0)).count() == 0


def test_snapshot(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes('﻿book_id,title\n1,"a\nb"\n\n2,c\n'.encode())
    rows, snapshot = files.read_snapshot(spark, str(path), ["book_id", "title"])
    assert sorted(map(tuple, rows.collect())) == [("1", "a\nb"), ("2", "c")]
    assert (snapshot.first().row_count, len(snapshot.first().sha256)) == (2, 64)
    with pytest.raises(ValueError, match="kind"):
        files.read_snapshot(spark, str(path), ["title", "kind"])
    path.write_text("book_id,title\n")
    with pytest.raises(ValueError, match="no data"):
        files.read_snapshot(spark, str(path), ["book_id"])


def test_check_json(spark, tmp_path, monkeypatch):
    for name, text in (("good", '{"a": {"b": 1}, "c": {"b": "\\"b\\":"}}'), ("twice", '{"x": [{"a": 1, "\\u0061": 2}]}'), ("bad", '{"a": '), ("large", " " * 200 + "1")):
        (tmp_path / f"{name}.json").write_text(text)
    monkeypatch.setattr(files, "JSON_BYTES", 100)
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in files.check_json(spark, str(tmp_path)).collect()}
    assert got == {"good.json": None, "twice.json": "duplicate key", "bad.json": "malformed", "large.json": "too large"}


def test_summary_and_ordered_load(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 2), ("a", None)], "work string, chapters int")
    files.write_summary(rows, str(tmp_path / "md"), "Maps", ["work"])
    parts = sorted((tmp_path / "md").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == ["# Maps", "", "| work | chapters |", "| --- | ---: |", "| a |  |", "| b\\|c | 2 |"]
    for _ in range(2):
        load_in_order(spark.range(100).orderBy(F.desc("id")), str(tmp_path / "t"), ["id"])
    stored = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in stored) == 200 and all(r.b - r.a + 1 == r.n for r in stored)
