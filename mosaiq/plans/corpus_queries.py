"""Queries over files and texts: scanning, classifying, terms, modules, jobs, change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.operators import extract, incremental, links, modules, rules, search
from mosaiq.plans import views as v
from mosaiq.runtime import table

#: The rules that the rule queries decide by: two folders go, one ending goes, and one folder comes back.
RULES = rules.parse_rules(["# build output", "build/", "/tests", "*.lua", "**/fixture/**", "!src/**"])
CUTOFF = "2025-09-01 00:00:00"
Q, D = tx.SPARK, tx.DUCK


def file_versions(spark: SparkSession, d: str) -> DataFrame:
    return v.files(spark, d).select("file_id", "repo", "path", "lines", "bytes", "sha")


def corpus_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan_filter(v.files(spark, d)).select("file_id", "path", "language")


def glob_rules_last_match(spark: SparkSession, d: str) -> DataFrame:
    return v.files(spark, d).where("path IS NOT NULL").select("file_id", rules.decide(F.col("path"), RULES).alias("excluded"))


def language_map(spark: SparkSession, d: str) -> DataFrame:
    return v.files(spark, d).where("path IS NOT NULL").select("file_id", F.expr(rules.language_sql("path", custom={".h": "cpp"})).alias("language"))


def unknown_extensions(spark: SparkSession, d: str) -> DataFrame:
    return rules.unknown_extensions(v.files(spark, d).where("path IS NOT NULL"), least=1)


def test_files(spark: SparkSession, d: str) -> DataFrame:
    return v.files(spark, d).where("path IS NOT NULL").groupBy(F.expr(tx.is_test("path")).alias("is_test"), F.col("lang")).agg(F.count(F.lit(1)).alias("n"))


def language_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    return rows


def module_lines_top(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).where("module IS NOT NULL").groupBy("repo", "module").agg(F.sum("lines").alias("lines"))
    return rows.orderBy(F.desc("lines"), "repo", "module").limit(60)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return v.files(spark, d).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.expr("CAST(sum(bytes) div 4 AS BIGINT)").alias("tokens"),
        F.count_distinct("repo", "module").alias("modules"), F.count_if("is_code").alias("code_files"),
    )


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    return docs.select("doc_id", F.expr(f"CAST({tx.line_count('text')} AS BIGINT)").alias("lines"), F.expr(f"CAST({tx.model_tokens('text')} AS BIGINT)").alias("tokens"), F.expr(tx.sha16("text")).alias("sha"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.expr(tx.tokens("text")).alias("ts"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("ts")).alias("tokens"), F.sum(F.size(F.array_distinct("ts"))).alias("terms"))


def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    terms = search.terms(table(spark, d, "documents").select("doc_id", "text"), "text").distinct()
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    rows = v.symbols(spark, d).where("name IS NOT NULL")
    return rows.select("file_id", "i", F.expr(tx.tail("name")).alias("tail"), F.expr(tx.last_part("name")).alias("last"), F.expr(f"CAST(size({tx.name_parts('name')}) AS BIGINT)").alias("parts"), F.expr(tx.span("start_line", "end_line")).alias("span"))


def module_fold(spark: SparkSession, d: str) -> DataFrame:
    return modules.assign_modules(v.files(spark, d))


def batch_pack_jobs(spark: SparkSession, d: str) -> DataFrame:
    return modules.batches(v.files(spark, d))


def alias_batches(spark: SparkSession, d: str) -> DataFrame:
    return modules.alias_batches(v.symbols(spark, d))


def chunk_cuts(spark: SparkSession, d: str) -> DataFrame:
    return modules.chunk_cuts(v.files(spark, d), v.symbols(spark, d))


def module_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).where("module IS NOT NULL AND path IS NOT NULL").select("repo", "module", "file_id", F.coalesce("is_test", F.lit(False)).alias("t"), "path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return modules.within_budget(rows, ["repo", "module"], ["t", "path", "file_id"], "bytes", 150_000).select("repo", "module", "file_id", "full")


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).where("head IS NOT NULL").select("file_id", F.posexplode(F.split("head", "\n")).alias("pos", "line"))
    return rows.select("file_id", (F.col("pos") + 1).cast("bigint").alias("ln"), F.concat((F.col("pos") + 1).cast("string"), F.lit("|"), "line").alias("numbered"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return links.sections(extract.headings(texts))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "files")
    return incremental.changed(incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, CUTOFF)).select("file_id", "status")


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "files")
    return incremental.stale(incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, CUTOFF))


def dirty_modules(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "files")
    new, old = incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, CUTOFF)
    return incremental.dirty_modules(incremental.changed(new, old), new, old)


def qa_carry_over(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "files")
    new, old = incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, CUTOFF)
    dirty = incremental.dirty_modules(incremental.changed(new, old), new, old)
    return incremental.carry_over(v.qa(spark, d).select("qa_id", "repo", "module"), dirty, new)


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and calls that writing the cards and questions of each repository would take; prices are left to the caller."""
    f = v.files(spark, d)
    code = F.when(F.expr("coalesce(is_code, false) AND NOT coalesce(is_test, false)"), F.col("bytes")).otherwise(0)
    rows = f.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.sum(F.coalesce(code, F.lit(0))).alias("code_bytes"))
    return rows.select("repo", "files", F.expr("CAST(bround(bytes / 4D * 1.45D) AS BIGINT)").alias("card_tokens"), F.expr("CASE WHEN code_bytes > 0 THEN greatest(1, CAST(bround(code_bytes / 90000D) AS BIGINT)) ELSE 0 END").alias("question_calls"))


def folder_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).select(F.coalesce("repo", F.lit("?")).alias("repo"), F.coalesce("lang", F.lit("?")).alias("lang"), "lines")
    return rows.rollup("repo", "lang").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        file_versions, corpus_scan_filter, glob_rules_last_match, language_map, unknown_extensions, test_files, language_rollup, module_lines_top, corpus_stats, document_lines, token_stats,
        term_document_frequency, qualified_names, module_fold, batch_pack_jobs, alias_batches, chunk_cuts, module_budget, numbered_lines, markdown_sections, changed_files, stale_files,
        dirty_modules, qa_carry_over, cost_estimate, folder_cube,
    )
}

_SNAPSHOTS = f"""new AS (SELECT file_id, repo, sha, bytes, mtime, module FROM files WHERE lines IS NOT NULL AND file_id IS NOT NULL AND loaded_at < TIMESTAMP '2999-01-01'
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, repo DESC NULLS LAST, sha DESC NULLS LAST, bytes DESC NULLS LAST, mtime DESC NULLS LAST, module DESC NULLS LAST) = 1),
old AS (SELECT file_id, repo, sha, bytes, mtime, module FROM files WHERE lines IS NOT NULL AND file_id IS NOT NULL AND loaded_at < TIMESTAMP '{CUTOFF}'
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, repo DESC NULLS LAST, sha DESC NULLS LAST, bytes DESC NULLS LAST, mtime DESC NULLS LAST, module DESC NULLS LAST) = 1),
changes AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.repo, o.repo) AS repo, coalesce(n.module, o.module) AS module,
    CASE WHEN n.file_id IS NULL THEN 'deleted' WHEN o.file_id IS NULL THEN 'added' WHEN n.sha IS DISTINCT FROM o.sha THEN 'changed' END AS status
  FROM new n FULL JOIN old o ON n.file_id = o.file_id),
dirty AS (SELECT DISTINCT repo, module FROM (
    SELECT repo, module FROM changes WHERE status IN ('added', 'changed')
    UNION ALL SELECT repo, module FROM new WHERE (repo, module) NOT IN (SELECT (repo, module) FROM old WHERE repo IS NOT NULL AND module IS NOT NULL) AND repo IS NOT NULL) WHERE module IS NOT NULL)"""
_KEPT = f"""(SELECT *, {rules.language_sql('path', D)} AS language FROM files_now
  WHERE NOT regexp_matches(path, {tx.literal(rules.ignored_pattern(rules.IGNORED), D)}) AND bytes BETWEEN 1 AND {rules.MAX_BYTES})"""
_DOCS_TOKENS = f"SELECT doc_id, lang, {tx.tokens('text', D)} AS ts FROM documents"

SQL = {
    "file_versions": v.with_(v.F_SQL) + "SELECT file_id, repo, path, lines, bytes, sha FROM files_now",
    "corpus_scan_filter": v.with_(v.F_SQL) + f"SELECT file_id, path, language FROM {_KEPT} WHERE language <> '' AND (lines <= 0 OR bytes / greatest(lines, 1) <= {rules.MAX_MEAN_LINE})",
    "glob_rules_last_match": v.with_(v.F_SQL) + f"SELECT file_id, {rules.decide_sql('path', RULES)} AS excluded FROM files_now WHERE path IS NOT NULL",
    "language_map": v.with_(v.F_SQL) + f"SELECT file_id, {rules.language_sql('path', D, {'.h': 'cpp'})} AS language FROM files_now WHERE path IS NOT NULL",
    "unknown_extensions": v.with_(v.F_SQL) + f"""SELECT ext, count(*) AS n FROM (SELECT {tx.extension(tx.basename('path', D), D)} AS ext FROM files_now WHERE path IS NOT NULL AND {rules.language_sql('path', D)} = '')
  WHERE ext <> '' AND lower(ext) NOT IN ({', '.join(repr(x) for x in rules.PLAIN_TEXT)}) GROUP BY ext ORDER BY n DESC, ext LIMIT 5""",
    "test_files": v.with_(v.F_SQL) + f"SELECT {tx.is_test('path', D)} AS is_test, lang, count(*) AS n FROM files_now WHERE path IS NOT NULL GROUP BY ALL",
    "language_rollup": v.with_(v.F_SQL) + "SELECT repo, lang, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes FROM files_now GROUP BY ALL",
    "module_lines_top": v.with_(v.F_SQL) + "SELECT repo, module, CAST(sum(lines) AS BIGINT) AS lines FROM files_now WHERE module IS NOT NULL GROUP BY ALL ORDER BY lines DESC, repo NULLS FIRST, module LIMIT 60",
    "corpus_stats": v.with_(v.F_SQL) + """SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) // 4 AS BIGINT) AS tokens,
  (SELECT count(*) FROM (SELECT DISTINCT repo, module FROM files_now WHERE repo IS NOT NULL AND module IS NOT NULL)) AS modules, CAST(count(*) FILTER (is_code) AS BIGINT) AS code_files FROM files_now""",
    "document_lines": f"SELECT doc_id, CAST({tx.line_count('text')} AS BIGINT) AS lines, CAST({tx.model_tokens('text', D)} AS BIGINT) AS tokens, {tx.sha16('text', D)} AS sha FROM documents WHERE text IS NOT NULL AND text <> ''",
    "token_stats": f"SELECT lang, count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(ts))) AS BIGINT) AS terms FROM ({_DOCS_TOKENS}) GROUP BY lang",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ts)) AS term FROM ({_DOCS_TOKENS})) GROUP BY term",
    "qualified_names": v.with_(v.S_SQL) + f"SELECT file_id, i, {tx.tail('name', D)} AS tail, {tx.last_part('name', D)} AS last, CAST(len({tx.name_parts('name', D)}) AS BIGINT) AS parts, {tx.span('start_line', 'end_line')} AS span FROM symbols_one WHERE name IS NOT NULL",
    "module_fold": v.with_(v.F_SQL, modules.assign_modules_sql()) + "SELECT repo, folder, module FROM assigned",
    "batch_pack_jobs": v.with_(v.F_SQL, modules.BATCHES_SQL) + "SELECT repo, file_id, batch FROM bins",
    "chunk_cuts": v.with_(v.F_SQL, v.S_SQL, f"""long AS (SELECT file_id, lines FROM files_now WHERE lines > {modules.CHUNK_LINES} AND NOT (NOT coalesce(is_code, false) AND lines > {modules.DATA_LINES} AND coalesce(lang, '') NOT IN ('markdown', 'rst', 'text', 'asciidoc'))
  AND NOT (coalesce(is_test, false) AND coalesce(lang, '') NOT IN ('python', 'javascript', 'typescript', 'go', 'rust', 'java', 'kotlin', 'scala', 'swift', 'ruby', 'php', 'c', 'cpp', 'csharp', 'dart', 'elixir', 'lua', 'vue', 'svelte'))),
tops AS (SELECT file_id, list(DISTINCT start_line) AS starts FROM symbols_one WHERE NOT contains(coalesce(name, '.'), '.') AND start_line IS NOT NULL GROUP BY file_id),
both_ AS (SELECT l.file_id, l.lines, coalesce(t.starts, []) AS starts FROM long l LEFT JOIN tops t USING (file_id)),
cuts AS (
  SELECT file_id, lines, starts, 0 AS part, 1 AS a, CASE WHEN {modules.CHUNK_LINES} < lines THEN coalesce(list_max(list_filter(starts, lambda x: x > 1 + {modules.CHUNK_LINES // 2} AND x <= {modules.CHUNK_LINES})) - 1, {modules.CHUNK_LINES}) ELSE lines END AS b FROM both_
  UNION ALL
  SELECT file_id, lines, starts, part + 1, b + 1, CASE WHEN b + {modules.CHUNK_LINES} < lines THEN coalesce(list_max(list_filter(starts, lambda x: x > b + 1 + {modules.CHUNK_LINES // 2} AND x <= b + {modules.CHUNK_LINES})) - 1, b + {modules.CHUNK_LINES}) ELSE lines END
  FROM cuts WHERE b < lines)""") + "SELECT file_id, part, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM cuts",
    "alias_batches": v.with_(v.S_SQL) + f"SELECT file_id, i, CAST((row_number() OVER (ORDER BY file_id, i) - 1) // {modules.ALIAS_BATCH} AS BIGINT) AS batch FROM symbols_one WHERE name IS NOT NULL",
    "module_budget": v.with_(v.F_SQL) + """SELECT repo, module, file_id, sum(coalesce(bytes, 0)) OVER (PARTITION BY repo, module ORDER BY coalesce(is_test, false), path, file_id ROWS UNBOUNDED PRECEDING) < 150000 AS full
  FROM files_now WHERE module IS NOT NULL AND path IS NOT NULL""",
    "numbered_lines": v.with_(v.F_SQL) + """SELECT file_id, CAST(ln AS BIGINT) AS ln, concat(ln, '|', line) AS numbered FROM (
  SELECT file_id, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS ln FROM files_now WHERE head IS NOT NULL)""",
    "markdown_sections": """WITH ls AS (SELECT doc_id AS file_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
each_line AS (SELECT file_id, len(ls) AS lines, unnest(ls) AS l, generate_subscripts(ls, 1) AS ln FROM ls),
h AS (SELECT file_id, lines, ln, length(regexp_extract(l, '^(#{1,3})[ \\t\\n\\r\\f\\v]', 1)) AS level, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ln) - 1 AS INT) AS i FROM each_line WHERE regexp_matches(l, '^#{1,3}\\s+.+$') AND length(l) <= 300)
SELECT a.file_id, a.i, CAST(a.ln AS INT) AS start_line, CAST(coalesce(min(b.ln) FILTER (b.ln > a.ln AND b.level <= a.level) - 1, max(a.lines)) AS INT) AS end_line
FROM h a LEFT JOIN h b ON a.file_id = b.file_id GROUP BY a.file_id, a.i, a.ln""",
    "changed_files": v.with_(_SNAPSHOTS) + "SELECT file_id, status FROM changes WHERE status IS NOT NULL",
    "stale_files": v.with_(_SNAPSHOTS) + """SELECT o.file_id, CASE WHEN n.file_id IS NULL THEN true WHEN n.bytes IS NOT DISTINCT FROM o.bytes AND n.mtime IS NOT DISTINCT FROM o.mtime THEN false
  ELSE n.sha IS DISTINCT FROM o.sha END AS stale FROM old o LEFT JOIN new n ON n.file_id = o.file_id""",
    "dirty_modules": v.with_(_SNAPSHOTS) + "SELECT repo, module FROM dirty",
    "qa_carry_over": v.with_(v.Q_SQL, _SNAPSHOTS) + """SELECT qa_id, repo, module FROM qa_now q WHERE EXISTS (SELECT 1 FROM new n WHERE n.repo = q.repo AND n.module = q.module)
  AND NOT EXISTS (SELECT 1 FROM dirty x WHERE x.repo = q.repo AND x.module = q.module)""",
    "cost_estimate": v.with_(v.F_SQL) + """SELECT repo, files, CAST(round_even(bytes / 4 * 1.45::DOUBLE, 0) AS BIGINT) AS card_tokens, CAST(CASE WHEN code_bytes > 0 THEN greatest(1, round_even(code_bytes / 90000, 0)) ELSE 0 END AS BIGINT) AS question_calls
  FROM (SELECT repo, count(*) AS files, CAST(sum(coalesce(bytes, 0)) AS DOUBLE) AS bytes, CAST(sum(CASE WHEN coalesce(is_code, false) AND NOT coalesce(is_test, false) THEN coalesce(bytes, 0) ELSE 0 END) AS DOUBLE) AS code_bytes FROM files_now GROUP BY repo)""",
    "folder_cube": v.with_(v.F_SQL) + "SELECT repo, lang, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files FROM (SELECT coalesce(repo, '?') AS repo, coalesce(lang, '?') AS lang, lines FROM files_now) GROUP BY ROLLUP (repo, lang)",
}
