import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.similarity import title_likeness
from folioflow.operators import lifecycle, linkage, tables
from folioflow.plans.checks import document_checks
from folioflow.sources import files
from folioflow.streaming.progress import daily_minutes, event_stream, furthest


def test_writes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, tables.latest(old.unionByName(new), ["k"], "v").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    once = tables.insert_new(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.insert_new(once, new, ["k"]).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    rows = spark.createDataFrame([("a", "open"), ("b", "done")], "k string, s string")
    assert sorted(map(tuple, tables.guarded_update(rows, rows, ["k"], "s", "open", "shut").collect())) == [("a", "shut"), ("b", "done")]
    assert {(r.k, r.side) for r in tables.missing_and_unexpected(old, new, "k").collect()} == {("a", "missing"), ("c", "unexpected")}


@pytest.mark.parametrize(
    ("row", "key"),
    [((5, " ", "en", "s", 1), "blank-text"), ((5, "x", "en", None, 1), "missing-source"), ((1, "x", "en", "s", 1), "duplicate-id"), ((5, "x", "en", "s", -1), "negative-size"), ((5, "x", "nl", "s", 1), "languages")],
)
def test_one_violation_fails_one_check(spark, row, key):
    good = [(k, "x", lang, "s", 1) for k, lang in enumerate(("en", "de", "fr", "es"), 1)]
    checks = document_checks(spark.createDataFrame([*good, row], "doc_id long, text string, lang string, source string, n_chars long"))
    assert key in [r.check_key for r in checks.filter("NOT passed AND severity = 'blocking'").collect()]
    assert checks.filter("NOT passed AND severity = 'blocking'").count() == 1
    with pytest.raises(ValueError, match=key):
        tables.replace_snapshot(checks, checks, "")


def test_lifecycle(spark):
    row = spark.range(1)
    key = lambda a, b: row.select(lifecycle.event_key("v1", [("a", F.lit(a)), ("b", F.lit(b))])).first()[0]
    assert key("x", "yz") != key("xy", "z")
    states = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, False), (3, False)], "g int, done boolean").groupBy("g").agg(lifecycle.run_state(F.col("done"), 2).alias("s"))
    assert {r.g: r.s for r in states.collect()} == {1: "complete-repeat", 2: "partial", 3: "first-run"}
    roles = row.select(lifecycle.authorised(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")), F.lit(True)), lifecycle.authorised(F.array(F.lit("c")), F.array(F.lit("a")))).first()
    assert list(roles) == [True, False]
    opened = row.select(lifecycle.window_open(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))).first()[0]
    assert opened is True
    sets = spark.createDataFrame([("b",), ("a",)], "k string")
    assert sets.agg(lifecycle.set_hash("k")).first() == sets.orderBy("k").agg(lifecycle.set_hash("k")).first()


def test_linkage(spark):
    left = spark.createDataFrame([(0, 1, "Da criação do mundo"), (0, 2, "Da lei natural")], "block int, a int, a_title string")
    right = spark.createDataFrame([(0, 10, "Da criacao do mundo", 2), (0, 11, "Da criação do mundo", 1), (1, 12, "Da lei natural", 0)], "block int, b int, b_title string, ord int")
    pairs = linkage.scored_pairs(left, right, "block")
    assert [(r.a, r.b) for r in linkage.best_match(pairs).collect()] == [(1, 11)]
    assert [(r.a, r.b) for r in linkage.one_to_one(pairs, "block").collect()] == [(1, 11)]


def test_linkage_sees_all_pairs(spark):
    """Pairs that share no word, or only a folded or short one; assignment as a greedy pass over all pairs; weights of chapters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    some = lambda n: [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(n)]
    x, y = ["Da criação", "Lei I", "xxabcdefgh", None, "", "Q" * 70, *some(40)], ["Da criacao", "Mundo I", "yyabcdefgh", None, "Capítulo", "q" * 69, *some(60)]
    left = spark.createDataFrame([(0, k, t) for k, t in enumerate(x)], "block int, a int, a_title string")
    right = spark.createDataFrame([(0, k, t, -k) for k, t in enumerate(y)], "block int, b int, b_title string, ord int")
    for weighted in (False, True):
        if weighted:
            left, right = left.withColumns({"a_label": F.lit("I"), "a_part": F.when(F.col("a") % 2 == 0, "p")}), right.withColumns({"b_label": F.when(F.col("b") % 3 == 0, "I"), "b_part": F.lit(None).cast("string")})
        every = []
        for a, s in enumerate(x):
            for b, t in enumerate(y):
                title, label = title_likeness(s, t), float(b % 3 == 0)
                every.append((-round(0.72 * title + 0.18 * label + 0.1 * (a % 2) if weighted else title, 6), -title, -label * weighted, a, -b, b))
        taken_a, taken_b, best, greedy = set(), set(), {}, set()
        for p in sorted(p for p in every if -p[0] >= 0.4):
            best.setdefault(p[3], p[5])
            if p[3] not in taken_a and p[5] not in taken_b:
                taken_a.add(p[3])
                taken_b.add(p[5])
                greedy.add((p[3], p[5]))
        pairs = linkage.scored_pairs(left, right, "block", 0.4)
        assert {(r.a, r.b): r.score for r in pairs.collect()} == {(p[3], p[5]): -p[0] for p in every if -p[0] >= 0.4}
        assert {(r.a, r.b) for r in linkage.one_to_one(pairs, "block", 0.4).collect()} == greedy
        assert {(r.a, r.b) for r in linkage.one_to_one_of_all(left, right, "block", 0.4).collect()} == greedy
        if not weighted:
            assert {r.a: r.b for r in linkage.best_of_all(left, right, "block", 0.4).collect()} == best and (best[0], best[2]) == (0, 2)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,\"b\"\nc", ["x", "y"], None)], "t string, l array<string>, n int")
    files.write_csv(rows, str(tmp_path / "c"), ["t", "l", "n"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "t string, l string, n int").collect()] == [("a,\"b\"\nc", "x|y", None)]
    (tmp_path / "bad.csv").write_text("t,n\na,b\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, str(tmp_path / "bad.csv"), "t string, n int").collect()
    assert files.read_loose_csv(spark, str(tmp_path / "bad.csv"), ["n"]).first().n == 0
    (tmp_path / "d.json").write_text('{"version": 1, "items": [{"id": 1}, {"id": 2}]}')
    assert files.read_json_records(spark, str(tmp_path / "d.json"), "items").count() == 2
    assert spark.range(1).select(files.records_of(F.lit('[{"id": 7}]'), "id int")).first().id == 7
    nested = spark.range(1).select(F.struct(F.lit(1).alias("content")).alias("s"), F.lit("x").alias("content"))
    with pytest.raises(ValueError, match="s.content"):
        files.public_columns(nested, ["content"])
    assert files.leaks(spark.createDataFrame([("password=1",), ("fine",)], "t string")).count() == 1


def test_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    for name, rows, mode in (("minutes", daily_minutes(event_stream(spark, str(tmp_path / "in"))), "update"), ("furthest", furthest(event_stream(spark, str(tmp_path / "in"))), "update")):
        q = rows.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("furthest").groupBy("user_id", "book").agg(F.max("current_section")).count() == events.select("user_id", "event_type").distinct().count()
    assert spark.table("minutes").count() > 0
