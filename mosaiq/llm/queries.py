"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.llm.broken_pairs import broken_pairs, project_pairs
from mosaiq.llm.encode import encode
from mosaiq.llm.mix_sources import mix_sources, shares, sized_documents, source_key
from mosaiq.llm.nonhand_files import nonhand_files
from mosaiq.llm.pack_items import file_containers
from mosaiq.llm.rank_scores import bench_ranks
from mosaiq.llm.repetition import repetition, repetitive
from mosaiq.llm.split_items import file_pieces
from mosaiq.runtime import limit_value, match, table


def p1_ranks(spark: SparkSession, d: str) -> DataFrame:
    return bench_ranks(table(spark, d, "bench_results"))


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return file_containers(table(spark, d, "files"), limit_value(spark, d, "container_lines", 1400))


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    """(repo, files, lines, overfull, tight): what the containers of each repository hold, how many hold too much, and whether they are at most a hundredth and one above the least number possible."""
    capacity = limit_value(spark, d, "container_lines", 1400)
    placed = p2_containers(spark, d)
    one = placed.groupBy("repo", "container").agg(F.sum("lines").alias("fill"))
    rows = one.groupBy("repo").agg(F.sum("fill").alias("lines"), F.count_if(F.col("fill") > capacity).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    files = placed.groupBy("repo").agg(F.count_distinct("file_id").alias("files"))
    tight = F.col("containers") <= F.ceil(F.col("lines") / capacity) * 1.01 + 1
    return match(rows, files, ["repo"]).select("repo", "files", "lines", "overfull", tight.alias("tight"))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, lines, whole, short, shared): of each divided file the last line covered, whether its pieces begin at line 1 without a gap, keep the limit, and share the overlap asked for."""
    limit, overlap = limit_value(spark, d, "piece_lines", 1100), limit_value(spark, d, "piece_overlap_lines", 30)
    before = F.lag("end_line").over(Window.partitionBy("file_id").orderBy("piece"))
    rows = p3_pieces(spark, d).withColumn("before", before)
    return rows.groupBy("file_id").agg(
        F.max("end_line").alias("lines"), (F.min("start_line") == 1).alias("whole"), F.bool_and(F.expr(f"end_line - start_line + 1 BETWEEN 1 AND {limit}")).alias("short"),
        F.bool_and(F.col("before").isNull() | (F.col("before") - F.col("start_line") + 1 == overlap)).alias("shared"),
    )


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limit_value(spark, d, "piece_lines", 1100), limit_value(spark, d, "piece_overlap_lines", 30)
    return file_pieces(table(spark, d, "files"), table(spark, d, "symbols"), limit, overlap)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece = 0").select("file_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = project_pairs(table(spark, d, "qa"), table(spark, d, "bench_results"))
    return broken_pairs(pairs).select("tbl", "pair_id", "defect")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return nonhand_files(table(spark, d, "files"), table(spark, d, "library_refs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_files(spark, d).select("file_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    percent = limit_value(spark, d, "mix_total_percent", 60)
    return mix_sources(sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"), percent)


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """(source, over_cap, strangers): of each source with a target and documents, how many documents come too often into the mix, and how many copies are of no document of that source."""
    mix = p7_mix(spark, d)
    caps = table(spark, d, "mix_targets").select(source_key("source").alias("source"), "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.min("max_repeats").alias("cap"))
    docs = table(spark, d, "documents").select("doc_id", source_key("source").alias("own"))
    often = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.max("copy").alias("last")).join(docs, "doc_id", "left")
    often = often.groupBy("source").agg(F.max("times").alias("most"), F.count_if(F.expr("last <> times")).alias("holes"), F.count_if(F.expr("NOT (own <=> source)")).alias("strangers"))
    rows = caps.join(docs.select(F.col("own").alias("source")).distinct(), "source").join(often, "source", "left")
    over = F.when(F.coalesce("most", F.lit(0)) > F.col("cap"), 1).otherwise(0) + F.coalesce("holes", F.lit(0))
    return rows.select("source", over.cast("bigint").alias("over_cap"), F.coalesce("strangers", F.lit(0)).alias("strangers"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_ranks": p1_ranks, "p2_containers": p2_containers, "p3_pieces": p3_pieces, "p3_found": p3_found, "p4_found": p4_found, "p5_files": p5_files,
        "p2_audit": p2_audit, "p3_audit": p3_audit, "p7_audit": p7_audit, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_repetition": p8_repetition, "p8_found": p8_found,
    }


P1_SQL = """
WITH flat AS (
  SELECT result_id, repo, CAST(score.total AS DOUBLE) AS score_total, cost, CAST(tokens.total AS DOUBLE) AS tokens_total, duration_s, loaded_at
  FROM bench_results WHERE result_id IS NOT NULL),
one AS (
  SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, repo DESC NULLS LAST,
    score_total DESC NULLS LAST, cost DESC NULLS LAST, tokens_total DESC NULLS LAST, duration_s DESC NULLS LAST) = 1),
long AS (
  SELECT repo, result_id, 'score_total' AS score, score_total AS x, 1.0::DOUBLE AS sign FROM one WHERE score_total >= 5
  UNION ALL SELECT repo, result_id, 'cost', cost, -1.0::DOUBLE FROM one WHERE cost >= 1e-12 AND NOT isinf(cost) AND NOT isnan(cost)
  UNION ALL SELECT repo, result_id, 'tokens_total', tokens_total, -1.0::DOUBLE FROM one WHERE tokens_total >= 1
  UNION ALL SELECT repo, result_id, 'duration_s', duration_s, -1.0::DOUBLE FROM one WHERE duration_s >= 1e-12 AND NOT isinf(duration_s) AND NOT isnan(duration_s)),
med AS (SELECT *, median(x) OVER (PARTITION BY repo, score) AS m FROM long),
mad AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY repo, score) AS d, avg(abs(x - m)) OVER (PARTITION BY repo, score) AS e FROM med),
val AS (
  SELECT result_id, score,
    1 / (1 + exp(-least(greatest((x - m) / CASE WHEN d > 0 THEN d * 1.4826::DOUBLE WHEN e > 0 THEN e * 1.2533::DOUBLE ELSE 1.0::DOUBLE END * sign, -30.0::DOUBLE), 30.0::DOUBLE))) AS v FROM mad),
comb AS (SELECT result_id, round(exp(sum(ln(v)) / count(*)), 9) AS combined, bool_or(score = 'score_total') AS graded FROM val GROUP BY result_id)
SELECT o.repo, o.result_id, coalesce(c.graded, false) AS graded, c.combined,
  CAST(row_number() OVER (PARTITION BY o.repo ORDER BY coalesce(c.graded, false) DESC, c.combined DESC NULLS LAST, o.result_id) AS BIGINT) AS rank
FROM one o LEFT JOIN comb c USING (result_id)
"""

P3_FOUND_SQL = """
WITH cur AS (
  SELECT file_id, lines FROM files WHERE lines IS NOT NULL AND file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, lines DESC) = 1)
SELECT file_id FROM cur WHERE lines > (SELECT max(limit_value) FROM task_limits WHERE limit_name = 'piece_lines')
"""

#: What the audits must find, from the tables alone.
_CURRENT = """cur AS (
  SELECT file_id, repo, lines FROM files WHERE lines IS NOT NULL AND file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, repo DESC NULLS LAST, lines DESC) = 1)"""
P2_AUDIT_SQL = f"WITH {_CURRENT} SELECT repo, count(*) AS files, CAST(sum(greatest(lines, 0)) AS BIGINT) AS lines, 0 AS overfull, true AS tight FROM cur GROUP BY repo"
P3_AUDIT_SQL = f"WITH {_CURRENT} SELECT file_id, lines, true AS whole, true AS short, true AS shared FROM cur WHERE lines > (SELECT max(limit_value) FROM task_limits WHERE limit_name = 'piece_lines')"
P7_AUDIT_SQL = """SELECT DISTINCT t.source, 0 AS over_cap, 0 AS strangers FROM (SELECT lower(trim(source)) AS source FROM mix_targets) t JOIN (SELECT lower(trim(source)) AS source FROM documents) d USING (source)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_ranks": P1_SQL, "p3_found": P3_FOUND_SQL, "p2_audit": P2_AUDIT_SQL, "p3_audit": P3_AUDIT_SQL, "p7_audit": P7_AUDIT_SQL}
