"""Completions against a replay one by one, estimates against their definition, versions against two writers."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.operators import reader, versions
from folioflow.operators.progress import complete_sections, completion_estimate, folded, judged, merged, reader_state, words_per_day

PROGRESS = "user_id long, book_id long, current_section long, last_read_at timestamp, completed_at timestamp"
SECTIONS = "section_id long, book_id long, sec_position long, word_count long"
SESSIONS = "user_id long, book_id long, section_id long, read_at date, duration_s long"
EVENTS = "event_id long, at timestamp, caller long, user_id long, book_id long, section_id long, duration_s long, read_date date"


def made(seed):
    rng = random.Random(seed)
    sections = [(100 * b + k, b, pos, rng.choice([0, 10, 250, 999])) for b in range(4) for k, pos in enumerate(sorted(rng.sample(range(1, 12), rng.randint(1, 6))))]
    start = dt.datetime(2024, 1, 10)
    progress = [(u, b, rng.randint(1, 5), None, rng.choice([None, start])) for u in range(6) for b in range(4) if rng.random() < 0.7]
    stored = [(rng.randrange(6), rng.randrange(4), rng.choice(sections)[0], dt.date(2024, 1, rng.randint(8, 20)), rng.choice([None, 40, 600])) for _ in range(40)]
    events = []
    for k in range(300):
        at = start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 9) // 7 * 7)
        user = rng.randrange(6)
        events.append((k, at, rng.choice([None, None, user, user, user + 1]), user, rng.randrange(4), rng.choice(sections)[0] if rng.random() < 0.9 else 999, rng.choice([None, 0, -1, 30, 61, 600, 3599]), at.date() - dt.timedelta(days=rng.randint(0, 1))))
    return sections, progress, stored, events


def replay(sections, progress, stored, events):
    """Each event as one transaction, in order."""
    where = {s: (b, pos) for s, b, pos, _ in sections}
    state = {(u, b): [c, last, done] for u, b, c, last, done in progress}
    seconds = defaultdict(int)
    for u, _, _, day, s in stored:
        seconds[u, day] += s or 0
    outcomes, added = [], []
    for k, at, caller, u, b, section, s, day in sorted(events, key=lambda e: (e[1], e[0])):
        own, pos = where.get(section, (None, None))
        why = (
            "unauthorised" if caller is not None and caller != u else "negative_duration" if s is not None and s < 0
            else "section_of_other_book" if own != b else "no_progress" if (u, b) not in state else "accepted"
        )
        if why != "accepted":
            outcomes.append((k, why, None, None, None))
            continue
        added.append((u, b, section, day, s or None))
        seconds[u, day] += s or 0
        ends = not any(x == b and p > pos for _, x, p, _ in sections)
        row = state[u, b]
        row[0], row[1], row[2] = max(row[0], pos + 1), at, (row[2] or at) if ends else row[2]
        outcomes.append((k, why, row[0], ends, math.floor((seconds[u, day] * 10 + 30) / 60) / 10))
    return outcomes, [(u, b, *row) for (u, b), row in state.items()], added


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("seed", [1, 2])
def test_completions_equal_a_replay(spark, seed):
    sections, progress, stored, events = made(seed)
    known, before = spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(progress, PROGRESS)
    random.Random(seed).shuffle(events)
    want = replay(sections, progress, stored, events)
    got = complete_sections(before, known, spark.createDataFrame(stored, SESSIONS), spark.createDataFrame(events, EVENTS).repartition(5))
    assert by_text(got.outcomes.collect()) == by_text(want[0])
    assert by_text(got.progress.collect()) == by_text(want[1])
    assert by_text(got.sessions.collect()) == by_text(want[2])


def test_folds_of_any_parts_are_one(spark):
    """Batches by chance, applied in any order, leave the same progress."""
    sections, progress, _, events = made(3)
    known, after = spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(progress, PROGRESS)
    rows = judged(after, known, spark.createDataFrame(events, EVENTS)).filter("outcome = 'accepted'")
    whole = by_text(merged(after, folded(rows)).collect())
    open_book = after.withColumn("completed_at", F.lit(None).cast("timestamp"))
    parts = [rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in (2, 0, 1)]
    for part in parts:
        after = merged(after, folded(part))
    stays = {r[:2] for r in progress if r[4]}
    assert [r for r in by_text(after.collect()) if r[:2] in stays] == [r for r in whole if r[:2] in stays]
    assert [r[:4] for r in by_text(after.collect())] == [r[:4] for r in whole]
    assert merged(open_book, folded(rows.limit(0))).filter("completed_at IS NOT NULL").count() == 0


def test_nothing_to_apply(spark):
    sections, progress, stored, events = made(4)
    got = complete_sections(spark.createDataFrame([], PROGRESS), spark.createDataFrame([], SECTIONS), spark.createDataFrame([], SESSIONS), spark.createDataFrame(events, EVENTS))
    assert got.progress.count() == got.sessions.count() == 0 and {r.outcome for r in got.outcomes.collect()} == {"unauthorised", "negative_duration", "section_of_other_book"}
    same = complete_sections(spark.createDataFrame(progress, PROGRESS), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(stored, SESSIONS), spark.createDataFrame([], EVENTS))
    assert by_text(same.progress.collect()) == by_text(progress) and same.outcomes.count() == 0


def test_estimate_equals_its_definition(spark):
    """Read again on a day, several books, a session just seven days ago, a position beyond the last and one in a gap."""
    as_of = dt.date(2024, 1, 20)
    sections = [(1, 1, 1, 100), (2, 1, 2, 50), (3, 1, 5, 1000), (4, 2, 1, 70), (5, 3, 1, 0)]
    progress = [(1, 1, 2, None, None), (2, 1, 3, None, None), (3, 1, 6, None, None), (1, 2, 1, None, None), (4, 1, None, None, None), (5, 3, 1, None, None)]
    days = [dt.date(2024, 1, 19), dt.date(2024, 1, 13), dt.date(2024, 1, 12)]
    sessions = [(1, 1, 1, days[0], 9), (1, 1, 1, days[0], 9), (1, 1, 2, days[0], 9), (1, 1, 2, days[1], None), (1, 1, 3, days[2], 9), (1, 2, 4, days[0], 9), (5, 3, 5, days[0], 1)]
    got = completion_estimate(spark.createDataFrame(progress, PROGRESS), spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(sections, SECTIONS), str(as_of))
    want = []
    for u, b, current, *_ in progress:
        rest = sum(w for _, x, p, w in sections if x == b and p >= (current or 1))
        recent = [(d, s) for x, y, s, d, _ in sessions if (x, y) == (u, b) and d >= as_of - dt.timedelta(days=7)]
        pace = sum(w for d, s in recent for k, _, _, w in sections if k == s) / len({d for d, _ in recent}) if recent else 2000.0
        n = math.ceil(rest / pace) if pace else None
        want.append((u, b, rest, pace, n, n if n is None else as_of + dt.timedelta(days=n), math.ceil(rest / 200)))
    assert by_text(got.collect()) == by_text(want)
    assert {(r.user_id, r.per_day) for r in words_per_day(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(sections, SECTIONS), str(as_of)).collect()} == {(1, 150.0), (1, 70.0), (5, 0.0)}


def test_reader_state(spark):
    day = dt.date(2024, 1, 20)
    progress = spark.createDataFrame([(1, 1, 2, None, None), (2, 1, 2, None, dt.datetime(2024, 1, 1)), (3, 1, 1, None, None)], PROGRESS)
    progress = progress.withColumn("pace_mode", F.when(F.col("user_id") == 3, "deadline").otherwise("minutes")).withColumn("pace_minutes", F.when(F.col("user_id") != 2, 2).cast("long")).withColumn("pace_deadline", F.lit(day))
    sessions = spark.createDataFrame([(1, 1, 1, day, 100), (1, 2, 1, day, 20), (3, 1, 1, day, 9999), (2, 1, 1, day, None)], SESSIONS)
    got = {r.user_id: (r.minutes_read_on_date, r.daily_goal_reached, r.book_completed) for r in reader_state(progress, sessions, "2024-01-20").collect()}
    assert got == {1: (2.0, True, False), 2: (0.0, False, True), 3: (166.7, False, False)}


def test_reader_labels(spark):
    c, no = F.lit, F.lit(None)
    day = c("2024-01-20").cast("date")
    row = spark.range(1).select(
        reader.percent(c(4), c(8)), reader.percent(no, c(8)), reader.percent(c(2), c(0)), reader.reading_time(c(0)), reader.reading_time(c(1)), reader.reading_time(c(201)),
        reader.reaches_goal(c("minutes"), c(2), c(1.5), c(30), c(False)), reader.reaches_goal(c("minutes"), c(2), c(1.5), c(30), c(True)), reader.reaches_goal(c("minutes"), c(0), c(9.0), c(0), no), reader.reaches_goal(no, c(1), c(9.0), c(0), no),
        reader.phase(c(True), c(True), c(False)), reader.phase(c(False), c(True), no), reader.phase(c(False), c(True), c(True)),
        reader.finish_date(c(1), c(9), c("minutes"), c(5), no, day), reader.finish_date(c(10), c(9), c("minutes"), c(5), no, day), reader.finish_date(c(1), c(9), c("deadline"), no, day, day), reader.finish_date(c(1), c(9), c("deadline"), no, no, day),
        reader.item_state(c(3), c(3), c(9), c(True)), reader.item_state(c(3), c(4), c(4), c(False)), reader.item_state(c(5), c(4), c(4), no), reader.item_state(c(5), c(4), c(4), c(True)),
    ).first()
    date = dt.date
    assert tuple(row) == (
        38, 0, 0, "< 1 min", "1 min", "2 min", True, False, False, False, "book-complete", "daily-goal-complete", "reading",
        date(2024, 1, 25), None, date(2024, 1, 20), date(2024, 1, 23), "current", "read", "unread", "read",
    )


def test_index_numbers_as_first_seen(spark):
    kinds = "book_id long, section_id long, sec_position long, part_title string, chapter_label string, chapter_title string, section_title string, title string, kind string"
    rows = [
        (1, 7, 1, "Z", None, "zwei", None, None, "chapter_intro"), (1, 6, 2, "", "I", "one", "", "t", "content"), (1, 5, 3, "Z", "", None, "s", "t", "part_intro"), (1, 4, 4, None, "I", "two", None, "", "part_intro"),
        (1, 3, 5, "Z", None, "zwei", None, None, "content"), (1, 2, 6, "A", None, "", None, None, "chapter_intro"),
    ]
    got = [tuple(r)[2:] for r in reader.book_index(spark.createDataFrame(rows, kinds)).orderBy("sec_position").collect()]
    assert got == [
        (1, "part-1", "Z", "part-1-chapter-1", "", "zwei", "zwei"), (2, "part-2", "Conteúdo", "part-2-chapter-1", "I", "one", "t"), (3, "part-1", "Z", "part-1-chapter-2", "", "Trechos", "s"),
        (4, "part-2", "Conteúdo", "part-2-chapter-1", "I", "one", "Abertura da parte"), (5, "part-1", "Z", "part-1-chapter-1", "", "zwei", "Trecho 5"), (6, "part-3", "A", "part-3-chapter-1", "", "Trechos", "Abertura do capítulo"),
    ]


# versions


@pytest.fixture
def store(spark, tmp_path):
    out = versions.Store(spark, f"file://{tmp_path}/store")
    out.commit(versions.Version(), {("t", ""): spark.createDataFrame([(k, "open" if k < 6 else "shut") for k in range(9)], "id long, s string")})
    return out


def folders(store):
    return {f.getPath().getName() for f in store.files.listStatus(store._path("folioflow"))}


def apply(store, run="r", ids=(1, 2, 3), checks=(), hash_of=None):
    targets = store.spark.createDataFrame([(k,) for k in ids], "id long")
    return versions.apply_reviewed(store, run, "t", "id", targets, hash_of or versions.target_hash(targets, "id"), "s", "open", "done", list(checks))


def test_all_or_nothing(store):
    after = apply(store)
    assert {r.id: r.s for r in store.read(after, "t").collect()} == {k: "done" if k in (1, 2, 3) else "open" if k < 6 else "shut" for k in range(9)}
    events = store.read(after, "events").collect()
    assert {(r.run_id, r.event_type, r.target) for r in events} == {("r", "s-done", str(k)) for k in (1, 2, 3)} and len({r.event_key for r in events}) == 3
    assert store.current() == after == apply(store) and after.number == 2  # a repeat changes nothing


@pytest.mark.parametrize("how", ["targets", "status", "check"])
def test_refused_leaves_everything(store, how):
    before, own = store.current(), folders(store)
    with pytest.raises(versions.Refused):
        if how == "targets":
            apply(store, hash_of="0" * 64)
        elif how == "status":
            apply(store, ids=(1, 7))
        else:
            apply(store, checks=[("none-done", "blocking", F.count_if(F.col("s") == "done"), 0)])
    assert store.current() == before and folders(store) == own
    assert apply(store, checks=[("none-done", "note", F.count_if(F.col("s") == "done"), 0)]).number == 2


def test_one_of_two_writers_loses_whole(store):
    base = store.current()
    one = store.spark.createDataFrame([(1, "one")], "id long, s string")
    won = store.commit(base, {("t", ""): one})
    own = folders(store)
    with pytest.raises(versions.Lost):
        store.commit(base, {("t", ""): one, ("u", ""): one})
    assert store.current() == won and folders(store) == own and "u" not in store.current().tables
    assert store.read(base, "t").count() == 9  # who reads the old version still can


def test_recompute_of_one_run(store):
    spark = store.spark
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    with pytest.raises(versions.Refused):
        versions.recompute(store, "a", "snap", rows(1), "taken", lambda n: {"n": n})
    store.commit(store.commit(store.current(), {}, "a"), {}, "b")
    versions.recompute(store, "a", "snap", rows(1, 2), "taken", lambda n: {"n": n})
    kept = versions.recompute(store, "b", "snap", rows(3), "taken", lambda n: {"n": n}).tables["snap"]["b"]
    last = versions.recompute(store, "a", "snap", rows(4), "taken", lambda n: {"n": n})
    assert sorted((r.run_id, r.v) for r in store.read(last, "snap").collect()) == [("a", 4), ("b", 3)] and last.tables["snap"]["b"] == kept
    assert {(r.run_id, r.payload) for r in store.read(last, "events").collect()} == {("a", '{"n": 1}'), ("b", '{"n": 1}')}


def test_target_hash_is_of_the_sorted_keys(spark):
    import hashlib

    assert versions.target_hash(spark.createDataFrame([("b",), ("a",), ("ä",)], "k string"), "k") == hashlib.sha256("a\nb\nä".encode()).hexdigest()
