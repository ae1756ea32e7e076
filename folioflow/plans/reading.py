"""Readers of conversations: a conversation is a book, a turn is a section, an event ends a section.

``events`` has the reader, the time, the book (tens of ``props.k``), the section (units of ``value``) and the seconds
read; errors come in another reader's name and views in nobody's. Readers who once clicked or bought something in a book have progress in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.catalog import query
from folioflow.operators import reader, versions
from folioflow.operators.progress import ACCEPTED, Completions, complete_sections, completion_estimate, minutes, reader_state, words_remaining
from folioflow.scratch import fresh, stage, table

AS_OF, HALF = "2024-01-20", "2024-01-16"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

SECTIONS = r"""sec AS (
  SELECT conv_id * 1000 + turn AS section_id, conv_id AS book_id, turn + 1 AS sec_position, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS word_count, role, text FROM conversations)"""
EVENTS = """ev AS (
  SELECT event_id, ts, CASE event_type WHEN 'error' THEN user_id + 1 WHEN 'view' THEN NULL ELSE user_id END AS caller, user_id, event_type, value, k // 10 AS book_id, k // 10 * 1000 + CAST(floor(value) AS BIGINT) % 10 AS section_id,
         CAST(floor(value * 60) AS BIGINT) - 30 AS duration_s, CAST(ts AS DATE) AS read_date FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
JUDGED = """pr AS (SELECT DISTINCT user_id, book_id FROM ev WHERE event_type IN ('click', 'purchase')), lst AS (SELECT book_id, max(sec_position) AS last FROM sec GROUP BY 1),
j AS (
  SELECT ev.*, sec_position, sec_position >= last AS ends_book,
         CASE WHEN caller <> ev.user_id THEN 'unauthorised' WHEN duration_s < 0 THEN 'negative_duration' WHEN sec_position IS NULL THEN 'section_of_other_book' WHEN pr.user_id IS NULL THEN 'no_progress' ELSE 'accepted' END AS outcome
  FROM ev LEFT JOIN sec ON sec.section_id = ev.section_id AND sec.book_id = ev.book_id LEFT JOIN lst ON lst.book_id = ev.book_id LEFT JOIN pr ON pr.user_id = ev.user_id AND pr.book_id = ev.book_id),
ok AS (SELECT * FROM j WHERE outcome = 'accepted'),
ses AS (SELECT user_id, book_id, section_id, read_date AS read_at, nullif(duration_s, 0) AS duration_s FROM ok),
now AS (
  SELECT pr.user_id, pr.book_id, greatest(1, coalesce(max(sec_position + 1), 1)) AS current_section, max(ts) AS last_read_at, min(ts) FILTER (WHERE ends_book) AS completed_at
  FROM pr LEFT JOIN ok ON ok.user_id = pr.user_id AND ok.book_id = pr.book_id GROUP BY 1, 2)"""
READING = f"WITH {SECTIONS}, {EVENTS}, {JUDGED}"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("sec_position"), words.alias("word_count"), "role", "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    book = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    caller = F.when(kind == "error", user + 1).when(kind == "view", None).otherwise(user)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("at"), caller.alias("caller"), "user_id", "event_type", "value", book.alias("book_id"), (book * 1000 + F.floor("value") % 10).alias("section_id"),
        (F.floor(F.col("value") * 60) - 30).alias("duration_s"), F.to_date("ts").alias("read_date"),
    )


def opened(rows: DataFrame) -> DataFrame:
    """Progress before anything is read."""
    kinds = dict(rows.dtypes)
    known = rows.filter(F.col("event_type").isin("click", "purchase")).select("user_id", "book_id").distinct()
    return known.select("user_id", "book_id", F.lit(1).cast("long").alias("current_section"), F.lit(None).cast(kinds["at"]).alias("last_read_at"), F.lit(None).cast(kinds["at"]).alias("completed_at"))


def applied(spark: SparkSession, sf_dir: str) -> tuple[Completions, DataFrame]:
    """All events in two batches, the second on what the first has left; and the sessions of both."""
    rows, known = events(spark, sf_dir), sections(spark, sf_dir)
    none = rows.limit(0).select("user_id", "book_id", "section_id", F.col("read_date").alias("read_at"), "duration_s")
    first = complete_sections(opened(rows), known, none, rows.filter(F.col("read_date") < HALF))
    progress, stored = stage(first.progress, "progress"), stage(first.sessions, "sessions")
    second = complete_sections(progress, known, stored, rows.filter(F.col("read_date") >= HALF))
    return second, stored.unionByName(second.sessions)


@query(
    "completion_outcomes",
    f"""{READING}, r AS (
      SELECT *, greatest(1, max(sec_position + 1) OVER (PARTITION BY user_id, book_id ORDER BY ts, event_id)) AS next_position,
             coalesce(CAST((10 * sum(nullif(duration_s, 0)) OVER (PARTITION BY user_id, read_date ORDER BY ts, event_id) + 30) // 60 AS DOUBLE) / 10, 0) AS minutes_read_on_date FROM ok)
    SELECT j.event_id, j.outcome, CAST(r.next_position AS VARCHAR) AS next_position, CAST(r.ends_book AS VARCHAR) AS book_completed, CAST(r.minutes_read_on_date AS VARCHAR) AS minutes_read_on_date FROM j LEFT JOIN r USING (event_id) WHERE j.read_date >= DATE '{HALF}'""",
)
def completion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader of the second batch is told, rejected events with their reason."""
    return applied(spark, sf_dir)[0].outcomes.select("event_id", "outcome", *(F.col(c).cast("string") for c in ("next_position", "book_completed", "minutes_read_on_date")))


@query(
    "complete_transition",
    f"{READING} SELECT user_id, book_id, CAST(current_section AS BIGINT) AS current_section, strftime(last_read_at, '%Y-%m-%d %H:%M:%S.%f') AS last_read_at, strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at FROM now",
)
def complete_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress after both batches: one beyond the furthest section, with the first completion."""
    after = applied(spark, sf_dir)[0].progress
    return after.withColumns({c: F.date_format(c, STAMP) for c in ("last_read_at", "completed_at")})


ESTIMATE = f"""day AS (
  SELECT s.user_id, s.book_id, s.read_at, sum(d.word_count) AS words
  FROM ses s JOIN (SELECT DISTINCT ses.user_id, ses.book_id, ses.read_at, ses.section_id, sec.word_count FROM ses JOIN sec ON sec.section_id = ses.section_id WHERE read_at >= DATE '{AS_OF}' - 7) d
    ON d.user_id = s.user_id AND d.book_id = s.book_id AND d.read_at = s.read_at AND d.section_id = s.section_id
  WHERE s.read_at >= DATE '{AS_OF}' - 7 GROUP BY 1, 2, 3),
pace AS (SELECT user_id, book_id, sum(words) / count(*) AS per_day FROM day GROUP BY 1, 2),
rest AS (SELECT now.user_id, now.book_id, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS left_ FROM now LEFT JOIN sec ON sec.book_id = now.book_id AND sec_position >= coalesce(current_section, 1) GROUP BY 1, 2),
est AS (SELECT rest.user_id, rest.book_id, left_, coalesce(per_day, 2000) AS per_day, CAST(ceil(left_ / nullif(coalesce(per_day, 2000), 0)) AS BIGINT) AS days FROM rest LEFT JOIN pace ON pace.user_id = rest.user_id AND pace.book_id = rest.book_id)"""


@query(
    "completion_estimate",
    f"""{READING}, {ESTIMATE}
    SELECT user_id, book_id, left_ AS words_remaining, round(per_day, 4) AS avg_words_per_day, CAST(days AS VARCHAR) AS estimated_days, CAST(CAST(DATE '{AS_OF}' + CAST(days AS INTEGER) AS DATE) AS VARCHAR) AS estimated_date,
           CAST(ceil(left_ / 200) AS BIGINT) AS minutes_remaining FROM est""",
)
def q_completion_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, read = applied(spark, sf_dir)
    rows = completion_estimate(stage(done.progress, "progress"), stage(read, "sessions"), sections(spark, sf_dir), AS_OF)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("estimated_days", "estimated_date")}).withColumn("avg_words_per_day", F.round("avg_words_per_day", 4))


PACE = f"""pc AS (
  SELECT user_id, book_id, arg_min(CASE WHEN event_type IN ('click', 'view') THEN 'minutes' ELSE 'deadline' END, event_id) AS pace_mode, arg_min(CASE WHEN value < 400 THEN CAST(floor(value) AS BIGINT) ELSE -1 END, event_id) AS floor_,
         arg_min(read_date, event_id) AS first_date FROM ev GROUP BY 1, 2),
paced AS (SELECT now.*, pace_mode, nullif(floor_, -1) AS pace_minutes, CASE WHEN pace_mode = 'deadline' THEN first_date + 60 END AS pace_deadline FROM now JOIN pc USING (user_id, book_id)),
today AS (SELECT user_id, CAST((10 * sum(duration_s) + 30) // 60 AS DOUBLE) / 10 AS minutes FROM ses WHERE read_at = DATE '{AS_OF}' GROUP BY 1)"""


def paced(progress: DataFrame, rows: DataFrame) -> DataFrame:
    """``progress`` with the pace that the reader's first event in the book gives."""
    kind = F.when(F.col("event_type").isin("click", "view"), "minutes").otherwise("deadline")
    first = rows.groupBy("user_id", "book_id").agg(F.min(F.struct("event_id", kind.alias("mode"), F.when(F.col("value") < 400, F.floor("value")).alias("minutes"), "read_date")).alias("f"))
    pace = first.select("user_id", "book_id", F.col("f.mode").alias("pace_mode"), F.col("f.minutes").alias("pace_minutes"), F.when(F.col("f.mode") == "deadline", F.date_add("f.read_date", 60)).alias("pace_deadline"))
    return progress.join(pace, ["user_id", "book_id"])


@query(
    "reader_state",
    f"""{READING}, {PACE}
    SELECT user_id, book_id, CAST(current_section AS BIGINT) AS current_section, pace_mode, CAST(pace_minutes AS VARCHAR) AS pace_minutes, CAST(pace_deadline AS VARCHAR) AS pace_deadline, coalesce(minutes, 0) AS minutes_read_on_date,
           CASE WHEN pace_mode = 'minutes' AND pace_minutes IS NOT NULL THEN coalesce(minutes, 0) >= pace_minutes ELSE false END AS daily_goal_reached, completed_at IS NOT NULL AS book_completed
    FROM paced LEFT JOIN today USING (user_id)""",
)
def q_reader_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, read = applied(spark, sf_dir)
    state = reader_state(paced(done.progress, events(spark, sf_dir)), read, AS_OF)
    return state.withColumns({c: F.col(c).cast("string") for c in ("pace_minutes", "pace_deadline")})


@query(
    "reader_labels",
    f"""{READING}, {ESTIMATE}, {PACE}, x AS (
      SELECT p.*, coalesce(last, 0) AS total, left_, coalesce(minutes, 0) AS minutes, completed_at IS NOT NULL AND last_read_at < DATE '{AS_OF}' AS acknowledged
      FROM paced p LEFT JOIN lst ON lst.book_id = p.book_id LEFT JOIN rest ON rest.user_id = p.user_id AND rest.book_id = p.book_id LEFT JOIN today ON today.user_id = p.user_id
    ), y AS (SELECT *, NOT acknowledged AND pace_mode = 'minutes' AND coalesce(pace_minutes, 0) > 0 AND minutes * 60 + 30 >= pace_minutes * 60 AS goal FROM x)
    SELECT user_id, book_id, CASE WHEN total = 0 THEN 0 ELSE CAST(floor((current_section - 1) / total * 100 + 0.5) AS BIGINT) END AS percent,
           CASE WHEN ceil(left_ / 200) < 1 THEN '< 1 min' ELSE CAST(ceil(left_ / 200) AS BIGINT) || ' min' END AS reading_time, coalesce(goal, false) AS goal,
           CASE WHEN completed_at IS NOT NULL THEN 'book-complete' WHEN goal AND NOT acknowledged THEN 'daily-goal-complete' ELSE 'reading' END AS phase,
           CASE WHEN total = 0 OR total - current_section + 1 <= 0 THEN NULL WHEN pace_mode = 'deadline' THEN CAST(pace_deadline AS VARCHAR)
                ELSE CAST(CAST(DATE '{AS_OF}' + CAST(ceil((total - current_section + 1) / greatest(1, floor(coalesce(nullif(pace_minutes, 0), 10) * 200 / 500 + 0.5))) AS INTEGER) AS DATE) AS VARCHAR) END AS finish_date
    FROM y""",
)
def reader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent, reading time, goal, phase and finish date of each reader and book, half a minute into a session."""
    done, read = applied(spark, sf_dir)
    known = sections(spark, sf_dir)
    progress = stage(paced(done.progress, events(spark, sf_dir)), "paced")
    today = read.filter(F.col("read_at") == AS_OF).groupBy("user_id").agg(minutes(F.sum("duration_s")).alias("minutes"))
    total = known.groupBy("book_id").agg(F.max("sec_position").alias("total"))
    left = words_remaining(progress, known).withColumnRenamed("position", "current_section")
    rows = progress.join(total, "book_id", "left").join(left, ["book_id", "current_section"], "left").join(today, "user_id", "left")
    told = F.col("completed_at").isNotNull() & (F.col("last_read_at") < F.lit(AS_OF).cast("date"))
    goal = reader.reaches_goal(F.col("pace_mode"), F.col("pace_minutes"), F.col("minutes"), F.lit(30), told)
    current, all_sections = F.col("current_section"), F.col("total")
    finish = reader.finish_date(current, all_sections, F.col("pace_mode"), F.col("pace_minutes"), F.col("pace_deadline"), F.lit(AS_OF).cast("date"))
    return rows.select(
        "user_id", "book_id", reader.percent(current, all_sections).alias("percent"), reader.reading_time(F.col("remaining")).alias("reading_time"), goal.alias("goal"),
        reader.phase(F.col("completed_at").isNotNull(), goal, told).alias("phase"), finish.cast("string").alias("finish_date"),
    )


TITLED = """ti AS (
  SELECT *, CASE WHEN role = 'system' THEN NULL WHEN starts THEN '' ELSE role END AS part_title, CASE WHEN word_count < 20 THEN NULL WHEN starts THEN '' ELSE upper(w[1][1:1]) END AS chapter_label,
         CASE WHEN word_count < 60 THEN w[2] END AS chapter_title, CASE WHEN word_count > 100 THEN w[3] END AS section_title, CASE WHEN sec_position = 1 THEN 'part_intro' WHEN word_count < 40 THEN 'chapter_intro' ELSE 'content' END AS kind,
         CASE WHEN word_count > 30 THEN w[1] END AS title
  FROM (SELECT *, regexp_extract_all(text, '[a-z]+') AS w, regexp_matches(text, '^[A-C]') AS starts FROM sec))"""


def titled(rows: DataFrame) -> DataFrame:
    """Sections with names from their texts, some null and some blank."""
    found, starts, size = F.regexp_extract_all("text", F.lit("[a-z]+"), 0), F.col("text").rlike("^[A-C]"), F.col("word_count")
    word = lambda k: F.get(found, k)
    return rows.select(
        "section_id", "book_id", "sec_position", "word_count",
        F.when(F.col("role") == "system", None).when(starts, "").otherwise(F.col("role")).alias("part_title"), F.when(size < 20, None).when(starts, "").otherwise(F.upper(F.substring(word(0), 1, 1))).alias("chapter_label"),
        F.when(size < 60, word(1)).alias("chapter_title"), F.when(size > 100, word(2)).alias("section_title"),
        F.when(F.col("sec_position") == 1, "part_intro").when(size < 40, "chapter_intro").otherwise("content").alias("kind"), F.when(size > 30, word(0)).alias("title"),
    )


@query(
    "reading_index",
    f"""{READING}, {TITLED}, kx AS (
      SELECT *, coalesce(nullif(part_title, ''), 'Conteúdo') AS part, coalesce(nullif(chapter_label, ''), nullif(chapter_title, ''), 'Trechos') AS chapter FROM ti
    ), c AS (SELECT book_id, part, chapter, min(sec_position) AS first, arg_min(coalesce(chapter_label, ''), sec_position) AS chapter_name, arg_min(coalesce(nullif(chapter_title, ''), chapter), sec_position) AS chapter_heading FROM kx GROUP BY 1, 2, 3),
    p AS (SELECT *, min(first) OVER (PARTITION BY book_id, part) AS part_first, row_number() OVER (PARTITION BY book_id, part ORDER BY first) AS cn FROM c),
    q AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY part_first) AS pn FROM p)
    SELECT now.user_id, kx.book_id, section_id, sec_position, 'part-' || pn AS part_id, kx.part, 'part-' || pn || '-chapter-' || cn AS chapter_id, chapter_name, chapter_heading,
           coalesce(nullif(section_title, ''), CASE kind WHEN 'part_intro' THEN coalesce(nullif(title, ''), 'Abertura da parte') WHEN 'chapter_intro' THEN coalesce(nullif(chapter_title, ''), nullif(title, ''), 'Abertura do capítulo') END,
                    nullif(title, ''), 'Trecho ' || sec_position) AS label,
           CASE WHEN sec_position = current_section THEN 'current' WHEN completed_at IS NOT NULL OR sec_position < current_section - 1 THEN 'read' ELSE 'unread' END AS state
    FROM kx JOIN q ON q.book_id = kx.book_id AND q.part = kx.part AND q.chapter = kx.chapter JOIN now ON now.book_id = kx.book_id""",
)
def reading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each reader's books, with what is read; the reader looks at one section beyond the last that was stored."""
    index = stage(reader.book_index(titled(sections(spark, sf_dir))), "index")
    progress = applied(spark, sf_dir)[0].progress.select("user_id", "book_id", "current_section", F.col("completed_at").isNotNull().alias("done"))
    state = reader.item_state(F.col("sec_position"), F.col("current_section"), F.col("current_section") - 1, F.col("done"))
    return index.join(progress, "book_id").withColumn("state", state).drop("current_section", "done")


@query(
    "dependency_snapshot",
    f"""{READING}, s2 AS (SELECT section_id, count(*) AS n, count(DISTINCT user_id) AS users FROM ses GROUP BY 1),
    r AS (SELECT 'run-1' AS run_id UNION ALL SELECT 'run-2')
    SELECT run_id, sec.section_id, sec.book_id, sec_position, coalesce(at_, 0) AS progress_at_position_count, coalesce(done, 0) AS completed_book_progress_count, coalesce(s2.n, 0) AS reading_session_count, coalesce(users, 0) AS distinct_session_user_count
    FROM r, sec LEFT JOIN (SELECT book_id, current_section, count(*) AS at_ FROM now GROUP BY 1, 2) p ON p.book_id = sec.book_id AND p.current_section = sec.sec_position
    LEFT JOIN (SELECT book_id, count(completed_at) AS done FROM now GROUP BY 1) b ON b.book_id = sec.book_id LEFT JOIN s2 ON s2.section_id = sec.section_id
    WHERE run_id = 'run-1' OR word_count > 0""",
)
def dependency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each section, without naming a reader, kept for two runs; the first is taken twice and replaced."""
    done, read = applied(spark, sf_dir)
    rows = stage(section_dependencies(sections(spark, sf_dir), done.progress, read), "dependencies")
    store = versions.Store(spark, fresh(spark, "store"))
    start = store.commit(versions.Version(), {("runs", ""): spark.range(2).select(F.concat(F.lit("run-"), F.col("id") + 1).alias("run_id"))}, "run-1")
    store.commit(start, {}, "run-2")
    told = lambda n: {"contains_user_identifiers": False, "section_count": n}
    small = sections(spark, sf_dir).filter("word_count > 0").select("section_id")
    for run, taken in (("run-1", rows.limit(0)), ("run-2", rows.join(small, "section_id", "left_semi").select(*rows.columns)), ("run-1", rows)):
        last = versions.recompute(store, run, "snapshots", taken, "dependency-snapshot-captured", told)
    return store.read(last, "snapshots")


def section_dependencies(known: DataFrame, progress: DataFrame, read: DataFrame) -> DataFrame:
    """How many readers are at each section, have ended its book, and have read it how often."""
    at = progress.groupBy("book_id", F.col("current_section").alias("sec_position")).agg(F.count("*").alias("at_"))
    ended = progress.groupBy("book_id").agg(F.count("completed_at").alias("done"))
    seen = read.groupBy("section_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    rows = known.select("section_id", "book_id", "sec_position").join(at, ["book_id", "sec_position"], "left").join(ended, "book_id", "left").join(seen, "section_id", "left")
    counts = {"at_": "progress_at_position_count", "done": "completed_book_progress_count", "n": "reading_session_count", "users": "distinct_session_user_count"}
    return rows.select("section_id", "book_id", "sec_position", *(F.coalesce(F.col(c), F.lit(0)).alias(name) for c, name in counts.items()))


@query(
    "reviewed_application",
    f"""WITH {SECTIONS}, t AS (SELECT section_id, role, CASE WHEN role = 'assistant' AND word_count > 40 THEN 'content-review' ELSE 'boundary-review' END AS status FROM sec)
    SELECT t.section_id, status, CASE WHEN status = 'content-review' THEN sha256('run-1' || chr(10) || 'status-content-review' || chr(10) || section_id) END AS event_key,
           CASE WHEN status = 'content-review' THEN '{{"after":"content-review","before":"boundary-review","target":' || section_id || '}}' END AS payload FROM t""",
)
def reviewed_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed set of sections goes on to the next review, all with an event, once, though the run is applied twice."""
    rows = sections(spark, sf_dir).select("section_id", "role", "word_count", F.lit("boundary-review").alias("status"))
    store = versions.Store(spark, fresh(spark, "store"))
    start = store.commit(versions.Version(), {("sections", ""): rows})
    targets = stage(store.read(start, "sections").filter("role = 'assistant' AND word_count > 40"), "targets")
    reviewed = versions.target_hash(targets, "section_id")
    checks = [("unknown-status", "blocking", F.count_if(~F.col("status").isin("boundary-review", "content-review")), 0), ("rows", "blocking", F.count("*"), rows.count())]
    for _ in range(2):
        last = versions.apply_reviewed(store, "run-1", "sections", "section_id", targets, reviewed, "status", "boundary-review", "content-review", checks)
    events_ = store.read(last, "events").select(F.col("target").cast("long").alias("section_id"), "event_key", "payload")
    return store.read(last, "sections").select("section_id", "status").join(events_, "section_id", "left")
