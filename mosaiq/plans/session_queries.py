"""Queries over sessions: users of the events table are sessions, their events what a session asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.plans import views as v
from mosaiq.runtime import table
from mosaiq.streaming import sessions


def _events(spark: SparkSession, d: str) -> DataFrame:
    unit = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), unit.alias("unit"), "ts", "event_id", "event_type", "value")


def session_first_sent(spark: SparkSession, d: str) -> DataFrame:
    return sessions.first_sent(_events(spark, d)).select("session", "unit", "event_id")


def read_guard_once(spark: SparkSession, d: str) -> DataFrame:
    """Reads are events; the value times 50 stands for the lines of the file, clicks read a part."""
    reads = _events(spark, d).select("session", F.col("unit").alias("path"), (F.col("value") * 50).alias("lines"), (F.col("event_type") != "click").alias("whole"), F.lit(False).alias("stale"), "ts", "event_id")
    return sessions.read_guard(reads).select("event_id", "decision")


def card_once(spark: SparkSession, d: str) -> DataFrame:
    reads = _events(spark, d).select("session", F.col("unit").alias("path"), (F.col("value") * 50).alias("lines"), (F.col("event_type") == "view").alias("whole"), "ts", "event_id")
    return sessions.card_once(reads).select("event_id", "session", "path")


def prompt_gate(spark: SparkSession, d: str) -> DataFrame:
    return sessions.prompt_gate(v.qa(spark, d).select("qa_id", F.col("q").alias("prompt"))).select("qa_id")


def grep_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The first four symbols that each of the names in a prompt may mean, as a prompt is shown them; every current question is a prompt, ``event_id`` is its id."""
    names = sessions.grep_names(v.qa(spark, d).select(F.col("qa_id").alias("event_id"), F.col("q").alias("pattern")))
    return sessions.definitions(names, v.stored_symbols(spark, d), most=4)


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.gap_sessions(table(spark, d, "events")).select("user_id", "start", "n")


def session_start(spark: SparkSession, d: str) -> DataFrame:
    """(repo, files, lines, stale): what a session on a repository is told when it begins."""
    from mosaiq.operators import incremental
    from mosaiq.plans.corpus_queries import CUTOFF

    raw = table(spark, d, "files")
    new = incremental.snapshot(raw, "2999-01-01")
    old = incremental.snapshot(raw, CUTOFF)
    stale = incremental.stale(new, old).join(old.select("file_id", "repo"), "file_id").groupBy("repo").agg(F.count_if("stale").alias("stale"))
    rows = v.files(spark, d).where("repo IS NOT NULL").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    return rows.join(stale, "repo", "left").withColumn("stale", F.coalesce("stale", F.lit(0)))


QUERIES = {f.__name__: f for f in (session_first_sent, read_guard_once, card_once, prompt_gate, grep_definitions, gap_sessions, session_start)}

_EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS session, json_extract_string(props, '$.k') AS unit, ts, event_id, event_type, value FROM events)"
from mosaiq.plans.corpus_queries import _SNAPSHOTS  # noqa: E402

SQL = {
    "session_first_sent": v.with_(_EVENTS) + "SELECT session, unit, event_id FROM ev WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, unit ORDER BY ts, event_id) = 1",
    "read_guard_once": v.with_(_EVENTS, "r AS (SELECT *, coalesce(event_type <> 'click' AND value * 50 > 500, false) AS g FROM ev)") + "SELECT event_id, CASE WHEN g AND row_number() OVER (PARTITION BY session, unit, g ORDER BY ts, event_id) = 1 THEN 'deny' ELSE 'allow' END AS decision FROM r",
    "card_once": v.with_(_EVENTS, "r AS (SELECT *, event_type = 'view' AS whole FROM ev WHERE event_type = 'view' OR value * 50 >= 150)", "n AS (SELECT *, row_number() OVER (PARTITION BY session, unit ORDER BY ts, event_id) AS n FROM r)") + "SELECT event_id, session, unit AS path FROM n WHERE n = 1 AND NOT whole",
    "prompt_gate": v.with_(v.Q_SQL) + "SELECT qa_id FROM qa_now WHERE q IS NOT NULL AND q <> '' AND NOT starts_with(ltrim(q), '/')",
    "grep_definitions": v.with_(v.S_SQL, v.Q_SQL, f"""names AS (SELECT event_id, CAST(pos - 1 AS INT) AS pos, name, rtrim(name, '.') AS want FROM (SELECT qa_id AS event_id, unnest(ns) AS name, generate_subscripts(ns, 1) AS pos FROM (
    SELECT qa_id, list_filter(regexp_extract_all(coalesce(q, ''), '[A-Za-z_][\\p{{L}}\\p{{N}}_.]{{2,}}'), lambda n: lower(n) NOT IN ('def', 'class', 'function', 'func', 'const'))[:3] AS ns FROM qa_now))),
found AS (SELECT w.want, s.*, s.name = w.want AS exact, row_number() OVER (PARTITION BY w.want ORDER BY s.name = w.want DESC, s.file_id, s.i) AS n
  FROM (SELECT DISTINCT want FROM names WHERE want <> '') w JOIN symbols_one s ON {tx.last_part('s.name', tx.DUCK)} = {tx.last_part('w.want', tx.DUCK)} QUALIFY n <= 4)""")
  + "SELECT a.event_id, a.pos, a.name, f.n, f.file_id, f.i, f.path, f.start_line, f.end_line, f.kind, f.name AS symbol, f.exact FROM names a JOIN found f USING (want)",
    "gap_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "session_start": v.with_(v.F_SQL, _SNAPSHOTS) + """SELECT f.repo, files, lines, coalesce(stale, 0) AS stale FROM (SELECT repo, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM files_now WHERE repo IS NOT NULL GROUP BY repo) f
  LEFT JOIN (SELECT o.repo, CAST(count(*) FILTER (CASE WHEN n.file_id IS NULL THEN true WHEN n.bytes IS NOT DISTINCT FROM o.bytes AND n.mtime IS NOT DISTINCT FROM o.mtime THEN false ELSE n.sha IS DISTINCT FROM o.sha END) AS BIGINT) AS stale
    FROM old o LEFT JOIN new n ON n.file_id = o.file_id GROUP BY o.repo) s ON s.repo = f.repo""",
}
