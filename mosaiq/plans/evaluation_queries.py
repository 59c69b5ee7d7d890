"""Queries over benchmark results: paired arms, sessions, recall, renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.operators import evaluate as ev
from mosaiq.operators import search
from mosaiq.plans import views as v
from mosaiq.runtime import table

D = tx.DUCK


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return ev.graded(table(spark, d, "bench_results"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return v.qa(spark, d).where("repo IS NOT NULL").select(F.col("qa_id").alias("key"), "repo", F.col("a").alias("text"))


def paired_arm_report(spark: SparkSession, d: str) -> DataFrame:
    return ev.arm_report(_graded(spark, d).where("repo IS NOT NULL"), ["repo"])


def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.arm_report(_graded(spark, d).where("repo IS NOT NULL"), ["repo"])
    return rows.groupBy("arm").agg(F.sum("questions").alias("questions"), F.sum("wins").alias("wins"), F.sum("ties").alias("ties"), F.sum("losses").alias("losses"))


def session_report(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(_graded(spark, d).where("repo IS NOT NULL AND model IS NOT NULL"))


def valid_grades(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.judge_grades(table(spark, d, "bench_results").where("score IS NOT NULL"))
    return rows.select("result_id", F.col("total").cast("bigint").alias("total")).distinct()


def mentioned_files(spark: SparkSession, d: str) -> DataFrame:
    return ev.mentioned_files(_answers(spark, d), v.files(spark, d)).select("key", "file_id")


def mentioned_names(spark: SparkSession, d: str) -> DataFrame:
    return ev.mentioned_names(_answers(spark, d), v.symbols(spark, d)).select("key", "part")


def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """(key, wanted, found, recall): of the files each stated question's answer names, the share among those of its 30 best hits."""
    from mosaiq.plans.retrieval_queries import bm25_topk

    asked = v.questions(spark, d).select(F.col("qid").alias("key"))
    wanted = ev.mentioned_files(_answers(spark, d).join(asked, "key", "left_semi"), v.files(spark, d)).select("key", F.col("file_id").alias("item"))
    own = F.expr("CASE utype WHEN 'file' THEN CAST(substr(uid, 6) AS BIGINT) WHEN 'sym' THEN CAST(split(uid, ':')[1] AS BIGINT) END")
    got = bm25_topk(spark, d).select(F.col("qid").alias("key"), own.alias("item")).where("item IS NOT NULL")
    return ev.recall(wanted, got)


def distinctive_names(spark: SparkSession, d: str) -> DataFrame:
    return ev.distinctive(v.symbols(spark, d).where("name IS NOT NULL AND (kind <> 'section' OR kind IS NULL)").select(F.element_at(F.split("name", r"\."), -1).alias("name")).distinct())


def rename_map_apply(spark: SparkSession, d: str) -> DataFrame:
    """(key, length, sha): the questions with every distinctive name of the corpus renamed."""
    mapping = ev.rename_map(distinctive_names(spark, d))
    texts = v.qa(spark, d).select(F.col("qa_id").alias("key"), F.col("q").alias("text"))
    return ev.rename(texts, mapping).select("key", F.length("renamed").cast("bigint").alias("length"), F.expr(tx.sha16("renamed")).alias("sha"))


QUERIES = {f.__name__: f for f in (paired_arm_report, win_tie_loss, session_report, valid_grades, mentioned_files, mentioned_names, retrieval_recall, distinctive_names, rename_map_apply)}

_GRADED = """graded AS (SELECT result_id, repo, model, arm, k, cost, turns, duration_s, tokens.total AS tokens, score.total AS total, score.correctness AS correctness FROM bench_results WHERE result_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, run_at DESC NULLS LAST, repo DESC NULLS LAST, model DESC NULLS LAST, arm DESC NULLS LAST, k DESC NULLS LAST, question DESC NULLS LAST, answer DESC NULLS LAST,
    cost DESC NULLS LAST, turns DESC NULLS LAST, duration_s DESC NULLS LAST, tokens.total DESC NULLS LAST, score.total DESC NULLS LAST) = 1),
g AS (SELECT * FROM graded WHERE total IS NOT NULL AND arm IS NOT NULL AND k IS NOT NULL AND repo IS NOT NULL)"""
_PAIRED = """one AS (SELECT * FROM g QUALIFY result_id = max(result_id) OVER (PARTITION BY repo, k, arm)),
arms AS (SELECT repo, count(DISTINCT arm) AS arms FROM one GROUP BY repo),
pairs AS (SELECT o.* FROM one o JOIN arms USING (repo) QUALIFY count(*) OVER (PARTITION BY o.repo, o.k) = arms),
based AS (SELECT p.*, b.total AS base FROM pairs p LEFT JOIN pairs b ON b.repo = p.repo AND b.k = p.k AND b.arm = 'baseline'),
report AS (SELECT repo, arm, count(*) AS questions, """ + ", ".join(f"round(avg(coalesce({c}, 0)), 9) AS mean_{c}" for c in ("total", "correctness", "tokens", "cost", "turns", "duration_s")) + """,
  CAST(count(*) FILTER (total > base) AS BIGINT) AS wins, CAST(count(*) FILTER (total = base) AS BIGINT) AS ties, CAST(count(*) FILTER (total < base) AS BIGINT) AS losses FROM based GROUP BY ALL)"""
_NAMES = f"""names AS (SELECT DISTINCT string_split(name, '.')[-1] AS name FROM symbols_one WHERE name IS NOT NULL AND (kind <> 'section' OR kind IS NULL)),
cores AS (SELECT name, regexp_replace(name, '^_+|_+$', '', 'g') AS core FROM names),
special AS (SELECT name FROM cores WHERE core NOT IN ({", ".join(f"'{x}'" for x in ev.RESERVED_NAMES)}) AND lower(core) NOT IN ({", ".join(f"'{x}'" for x in ev.RESERVED_NAMES)}) AND NOT starts_with(name, '__') AND length(core) >= 4
  AND (len(list_filter(string_split(regexp_replace(core, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda p: p <> '')) >= 2 OR regexp_matches(core, '^[A-Z]') OR length(core) >= 7))"""
_RECALL = v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, search.UNITS_SQL, search.POSTINGS_SQL, v.QUESTIONS_SQL, search.search_sql(30)) + """, wanted AS (SELECT DISTINCT q.key, f.file_id AS item FROM (
    SELECT qa_id AS key, repo, unnest(regexp_extract_all(coalesce(a, ''), '[A-Za-z0-9_./-]+\\.[A-Za-z0-9]+')) AS path FROM qa_now WHERE repo IS NOT NULL AND qa_id % 100 = 0) q JOIN files_now f ON f.repo = q.repo AND f.path = q.path),
got AS (SELECT DISTINCT qid AS key, CASE utype WHEN 'file' THEN CAST(substr(uid, 6) AS BIGINT) WHEN 'sym' THEN CAST(split_part(uid, ':', 2) AS BIGINT) END AS item FROM hits WHERE utype IN ('file', 'sym'))
SELECT w.key, count(*) AS wanted, count(g.item) AS found, round(count(g.item) / count(*), 6) AS recall FROM wanted w LEFT JOIN got g ON g.key = w.key AND g.item = w.item GROUP BY w.key"""
SQL = {
    "paired_arm_report": v.with_(_GRADED, _PAIRED) + "SELECT * FROM report",
    "win_tie_loss": v.with_(_GRADED, _PAIRED) + "SELECT arm, CAST(sum(questions) AS BIGINT) AS questions, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(ties) AS BIGINT) AS ties, CAST(sum(losses) AS BIGINT) AS losses FROM report GROUP BY arm",
    "session_report": v.with_(_GRADED) + """SELECT repo, model, arm, CAST(k // 8 AS BIGINT) AS session, count(*) AS steps, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 9) AS cost, CAST(sum(turns) AS BIGINT) AS turns, round(avg(total), 9) AS score
  FROM g WHERE model IS NOT NULL GROUP BY repo, model, arm, k // 8 HAVING count(*) >= 2""",
    "valid_grades": """SELECT DISTINCT result_id, CAST(score.correctness + score.completeness + score.relevance + score.clarity + score.reasoning AS BIGINT) AS total FROM bench_results
  WHERE score.correctness BETWEEN 1 AND 20 AND score.completeness BETWEEN 1 AND 20 AND score.relevance BETWEEN 1 AND 20 AND score.clarity BETWEEN 1 AND 20 AND score.reasoning BETWEEN 1 AND 20""",
    "mentioned_files": v.with_(v.F_SQL, v.Q_SQL) + """SELECT DISTINCT q.qa_id AS key, f.file_id FROM (SELECT qa_id, repo, unnest(regexp_extract_all(coalesce(a, ''), '[A-Za-z0-9_./-]+\\.[A-Za-z0-9]+')) AS path FROM qa_now WHERE repo IS NOT NULL) q
  JOIN files_now f ON f.repo = q.repo AND f.path = q.path""",
    "mentioned_names": v.with_(v.S_SQL, v.Q_SQL) + """SELECT DISTINCT q.qa_id AS key, q.part FROM (SELECT qa_id, repo, unnest(regexp_extract_all(span, '[A-Za-z_][A-Za-z0-9_]{3,}')) AS part FROM (
    SELECT qa_id, repo, unnest(regexp_extract_all(coalesce(a, ''), '`([^`]+)`', 1)) AS span FROM qa_now WHERE repo IS NOT NULL)) q
  JOIN (SELECT DISTINCT repo, part FROM (SELECT repo, unnest(string_split(name, '.')) AS part FROM symbols_one WHERE kind <> 'section' OR kind IS NULL) WHERE length(part) > 3) k ON k.repo = q.repo AND k.part = q.part""",
    "retrieval_recall": _RECALL,
    "distinctive_names": v.with_(v.S_SQL, _NAMES) + "SELECT name FROM special",
    "rename_map_apply": v.with_(v.S_SQL, v.Q_SQL, _NAMES, """words AS (SELECT name, unnest(string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '_', chr(1) || '_' || chr(1), 'g'), chr(1))) AS w,
    generate_subscripts(string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '_', chr(1) || '_' || chr(1), 'g'), chr(1)), 1) AS k FROM special),
made AS (SELECT name, string_agg(CASE WHEN w IN ('_', '') THEN w ELSE concat(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'N' ELSE 'n' END, substr(sha1(lower(w)), 1, 6)) END, '' ORDER BY k) AS new_name FROM words GROUP BY name),
mapping AS (SELECT name, concat(new_name, repeat('_x', CAST(row_number() OVER (PARTITION BY new_name ORDER BY name) - 1 AS INT))) AS new_name FROM made),
pieces AS (SELECT qa_id AS key, unnest(regexp_extract_all(q, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS piece, generate_subscripts(regexp_extract_all(q, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) AS pos FROM qa_now WHERE q IS NOT NULL),
whole AS (SELECT key, string_agg(coalesce(m.new_name, piece), '' ORDER BY pos) AS renamed FROM pieces p LEFT JOIN mapping m ON m.name = p.piece GROUP BY key)""")
  + "SELECT qa_id AS key, length(coalesce(renamed, q)) AS length, substr(sha1(coalesce(renamed, q)), 1, 16) AS sha FROM qa_now LEFT JOIN whole ON key = qa_id",
}
