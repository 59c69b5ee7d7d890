"""The relations of a corpus: current files, distinct symbols, current question and answer rows, raw imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.runtime import latest


def current_files(files: DataFrame) -> DataFrame:
    """One row a file: of its rows with ``lines``, the one scanned last; its path in one spelling, a null module as the folder.

    Files without such a row are left out; equal scan times are told apart by load time, then by the values.
    """
    keep = ["repo", "path", "lang", "lines", "bytes", "sha", "is_code", "is_test", "module", "mtime", "imports", "head"]
    rows = latest(files.where("lines IS NOT NULL"), "file_id", [F.col("scanned_at"), F.col("loaded_at")], keep)
    rows = rows.withColumn("path", F.expr(tx.normal_path("path")))
    return rows.withColumn("folder", F.expr(tx.dirname("coalesce(path, '')")))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each (file_id, i): repeated rows collapse, of differing ones the greatest by value stays; a null end is the start."""
    rows = symbols.where("file_id IS NOT NULL AND i IS NOT NULL")
    best = F.max(F.struct("start_line", "end_line", "name", "kind", "sig", "repo", "path")).alias("s")
    rows = rows.groupBy("file_id", "i").agg(best).select("file_id", "i", "s.*")
    return rows.withColumn("end_line", F.coalesce("end_line", "start_line")).withColumn("path", F.expr(tx.normal_path("path")))


def current_qa(qa: DataFrame) -> DataFrame:
    """One row a qa_id, the one loaded last."""
    return latest(qa, "qa_id", [F.col("loaded_at"), F.col("created_at")], ["repo", "module", "i", "q", "a", "refs"])


def raw_imports(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, lang, imp): the distinct imports of each current file."""
    return files.select("file_id", "repo", "path", "lang", F.explode(F.array_distinct("imports")).alias("imp")).where("imp IS NOT NULL AND imp <> ''")


#: The same relations in plain SQL.
FILES_SQL = f"""files_now AS (
  SELECT file_id, repo, {tx.normal_path('path', tx.DUCK)} AS path, lang, lines, bytes, sha, is_code, is_test, module, mtime, imports, head,
    {tx.dirname("coalesce(" + tx.normal_path('path', tx.DUCK) + ", '')", tx.DUCK)} AS folder
  FROM files WHERE lines IS NOT NULL AND file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, repo DESC NULLS LAST, path DESC NULLS LAST,
    lang DESC NULLS LAST, lines DESC NULLS LAST, bytes DESC NULLS LAST, sha DESC NULLS LAST, is_code DESC NULLS LAST, is_test DESC NULLS LAST,
    module DESC NULLS LAST, mtime DESC NULLS LAST) = 1)"""
SYMBOLS_SQL = f"""symbols_one AS (
  SELECT file_id, i, start_line, coalesce(end_line, start_line) AS end_line, name, kind, sig, repo, {tx.normal_path('path', tx.DUCK)} AS path
  FROM symbols WHERE file_id IS NOT NULL AND i IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id, i ORDER BY start_line DESC NULLS LAST, symbols.end_line DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST,
    sig DESC NULLS LAST, repo DESC NULLS LAST, symbols.path DESC NULLS LAST) = 1)"""
QA_SQL = """qa_now AS (
  SELECT qa_id, repo, module, i, q, a, refs FROM qa WHERE qa_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY loaded_at DESC NULLS LAST, created_at DESC NULLS LAST, repo DESC NULLS LAST, module DESC NULLS LAST,
    i DESC NULLS LAST, q DESC NULLS LAST, a DESC NULLS LAST) = 1)"""
IMPORTS_SQL = """imports_raw AS (
  SELECT file_id, repo, path, lang, imp FROM (SELECT file_id, repo, path, lang, unnest(list_distinct(imports)) AS imp FROM files_now)
  WHERE imp IS NOT NULL AND imp <> '')"""
