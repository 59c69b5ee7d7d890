"""Queries over imports, modules and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.operators import imports, links
from mosaiq.plans import views as v

D = tx.DUCK


def import_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = imports.raw_imports(v.stored_files(spark, d))
    return rows.groupBy("repo", "imp").agg(F.count(F.lit(1)).alias("importers"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return v.edges(spark, d)


def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return imports.reverse(import_edges(spark, d))


def python_module_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of absolute Python imports alone."""
    files = v.stored_files(spark, d).where("lang = 'python'").withColumn("imports", F.expr("filter(imports, x -> NOT startswith(x, '.'))"))
    return imports.import_edges(files)


def import_degrees(spark: SparkSession, d: str) -> DataFrame:
    edges = v.edges(spark, d)
    out = edges.groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    back = edges.groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(back, "file_id", "full").select("file_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    files = v.stored_files(spark, d)
    return imports.module_dependencies(v.edges(spark, d), files.where("module IS NOT NULL").select("file_id", "repo", "module"))


def module_tests(spark: SparkSession, d: str) -> DataFrame:
    return imports.module_tests(v.edges(spark, d), v.stored_files(spark, d))


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    return v.link_graph(spark, d)


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.link_targets(v.stored_symbols(spark, d)).groupBy("repo", "tail").agg(F.count(F.lit(1)).alias("symbols"))


def member_containers(spark: SparkSession, d: str) -> DataFrame:
    return links.enclosing(v.stored_symbols(spark, d))


def symbol_identifiers(spark: SparkSession, d: str) -> DataFrame:
    body = links.bodies(v.stored_symbols(spark, d), v.stored_files(spark, d))
    return body.select("file_id", "i", F.explode(F.array_distinct(F.expr(tx.matches("body", tx.IDENTIFIER, tx.SPARK)))).alias("ident"))


QUERIES = {f.__name__: f for f in (import_statistics, import_edges, reverse_edges, python_module_edges, import_degrees, module_dependencies, module_tests, link_graph, link_targets, member_containers, symbol_identifiers)}

_PY = """parts AS (SELECT repo, file_id, path, string_split(regexp_replace(path, '([^/])\\.[^./]*$', '\\1'), '/') AS p FROM files_now WHERE lang = 'python' AND path IS NOT NULL AND path <> ''),
named AS (SELECT repo, file_id, path, CASE WHEN p[-1] = '__init__' THEN p[:-2] ELSE p END AS p FROM parts),
modules AS (SELECT repo, key, min({'path': path, 'id': file_id}).id AS dst FROM (
    SELECT repo, file_id, path, array_to_string(p[k:], '.') AS key FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM named)) GROUP BY ALL),
prefixes AS (SELECT repo, file_id AS src, imp, k, array_to_string(string_split(imp, '.')[:k], '.') AS key
  FROM (SELECT *, unnest(range(1, len(string_split(imp, '.')) + 1)) AS k FROM imports_raw WHERE lang = 'python' AND NOT starts_with(imp, '.') AND path IS NOT NULL)),
py_edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM prefixes JOIN modules USING (repo, key) QUALIFY row_number() OVER (PARTITION BY src, imp ORDER BY k DESC) = 1) WHERE src <> dst)"""
_TARGETS = f"""targets AS (SELECT * FROM (SELECT *, {tx.tail('name', D)} AS tail FROM symbols_one WHERE (kind <> 'section' OR kind IS NULL) AND name IS NOT NULL)
  WHERE length(tail) >= 3 AND NOT (starts_with(tail, '__') AND ends_with(tail, '__')))"""
_BODIES = f"""bodies AS (SELECT s.file_id, s.i, array_to_string(string_split(f.head, chr(10))[s.start_line : s.start_line + least(s.end_line - s.start_line + 1, {links.BODY_LINES}) - 1], chr(10)) AS body
  FROM symbols_one s JOIN files_now f USING (file_id) WHERE (s.kind <> 'section' OR s.kind IS NULL) AND s.start_line >= 1 AND f.head IS NOT NULL
    AND NOT coalesce(regexp_matches(f.path, '\\.(md|rst|txt)$'), false) AND s.start_line <= len(string_split(f.head, chr(10))) AND s.end_line >= s.start_line)"""
_STEM = tx.without_extension("path", D)


def _folded(path: str, rounds: int = 8) -> str:
    """A path without ``.`` and ``..`` components, for paths that climb at most ``rounds`` times."""
    out = f"regexp_replace(concat('/', {path}), '/\\.(/\\.)*(/|$)', '/', 'g')"
    for _ in range(rounds):
        out = f"regexp_replace({out}, '/([^/.][^/]*|\\.[^/.][^/]*)/\\.\\.(/|$)', '/')"
    return f"regexp_replace({out}, '^/+|/+$', '', 'g')"


_EDGES = f"""nodes AS (SELECT repo, file_id AS dst, path AS p, lang, {_STEM} AS stem, {tx.dirname('path', D)} AS dir, {tx.basename('path', D)} AS base, {tx.basename(_STEM, D)} AS name
  FROM files_now WHERE path IS NOT NULL AND path <> ''),
stems AS (SELECT DISTINCT repo, key, dst FROM (SELECT repo, stem AS key, dst FROM nodes UNION ALL SELECT repo, dir, dst FROM nodes WHERE name IN ('index', '__init__', 'mod', 'lib')) WHERE key <> ''),
imps AS (SELECT repo, file_id AS src, path AS f, lang, imp, {tx.dirname('path', D)} AS d FROM imports_raw WHERE path IS NOT NULL),
keyed AS (
  SELECT repo, src, array_to_string(list_concat((CASE WHEN d = '' THEN [] ELSE string_split(d, '/') END)[:greatest(len(CASE WHEN d = '' THEN [] ELSE string_split(d, '/') END) - (length(regexp_extract(imp, '^(\\.+)', 1)) - 1), 0)],
      list_filter([replace(ltrim(imp, '.'), '.', '/')], lambda x: x <> '')), '/') AS key FROM imps WHERE lang = 'python' AND starts_with(imp, '.')
  UNION ALL SELECT repo, src, regexp_replace({_folded("concat(d, '/', imp)")}, '\\.(js|ts|mjs|jsx|tsx)$', '') FROM imps WHERE lang IN ('javascript', 'typescript', 'vue', 'svelte') AND starts_with(imp, '.')
  UNION ALL SELECT repo, src, {tx.without_extension("concat('src/', regexp_replace(imp, '^[^/]*/', ''))", D)} FROM imps WHERE lang IN ('javascript', 'typescript', 'vue', 'svelte') AND regexp_matches(imp, '^(@|~|src)/')
  UNION ALL SELECT repo, src, ltrim(concat(d, '/', imp), '/') FROM imps WHERE lang = 'rust' AND NOT contains(imp, '::')),
crates AS (SELECT c.repo, c.src, c.imp, c.key FROM (
    SELECT repo, src, imp, k, r, concat(CASE WHEN r = 1 THEN 'src/' ELSE '' END, array_to_string(p[:k], '/')) AS key FROM (
      SELECT repo, src, imp, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT *, string_split(imp, '::')[2:] AS p FROM imps WHERE lang = 'rust' AND starts_with(imp, 'crate::'))) CROSS JOIN (VALUES (0), (1)) v(r)) c
  SEMI JOIN stems s ON s.repo = c.repo AND s.key = c.key QUALIFY row_number() OVER (PARTITION BY c.src, c.imp ORDER BY c.k DESC, c.r DESC) = 1),
go AS (SELECT g.repo, g.src, g.dir FROM (SELECT repo, src, imp, array_to_string(string_split(imp, '/')[k:], '/') AS dir FROM (SELECT *, unnest(range(1, len(string_split(imp, '/')) + 1)) AS k FROM imps WHERE lang = 'go')) g
  SEMI JOIN nodes n ON n.repo = g.repo AND n.dir = g.dir AND n.dir <> '' AND n.p LIKE '%.go' QUALIFY row_number() OVER (PARTITION BY g.src, g.imp ORDER BY g.dir) = 1),
c AS (SELECT *, {_folded("concat(d, '/', imp)")} AS key, {tx.basename('imp', D)} AS base FROM imps WHERE lang IN ('c', 'cpp', 'objc')),
near_c AS (SELECT c.src, n.dst FROM c JOIN nodes n ON n.repo = c.repo AND n.base = c.base AND (n.p = c.imp OR ends_with(n.p, concat('/', c.imp))) ANTI JOIN nodes x ON x.repo = c.repo AND x.p = c.key
  QUALIFY row_number() OVER (PARTITION BY c.src, c.imp ORDER BY len(list_filter(range(1, least(len(string_split(n.p, '/')), len(string_split(c.f, '/'))) + 1), lambda k: string_split(n.p, '/')[:k] = string_split(c.f, '/')[:k])) DESC,
    length(n.p), n.p) = 1),
jvm AS (SELECT i.src, n.dst FROM (SELECT *, replace(imp, '.', '/') AS tail FROM imps WHERE lang IN ('java', 'kotlin', 'scala', 'csharp')) i JOIN nodes n ON n.repo = i.repo AND n.name = {tx.basename('i.tail', D)} AND ends_with(n.stem, i.tail)
  QUALIFY row_number() OVER (PARTITION BY i.src, i.imp ORDER BY n.p) = 1),
ruby AS (SELECT *, {_folded("concat(d, '/', imp)")} AS key FROM imps WHERE lang = 'ruby'),
edges AS (SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM keyed JOIN stems USING (repo, key) UNION ALL SELECT src, dst FROM py_edges UNION ALL SELECT src, dst FROM crates JOIN stems USING (repo, key)
  UNION ALL SELECT g.src, n.dst FROM go g JOIN nodes n ON n.repo = g.repo AND n.dir = g.dir AND n.p LIKE '%.go' UNION ALL SELECT c.src, n.dst FROM c JOIN nodes n ON n.repo = c.repo AND n.p = c.key
  UNION ALL SELECT src, dst FROM near_c UNION ALL SELECT src, dst FROM jvm UNION ALL SELECT src, dst FROM ruby JOIN stems USING (repo, key)
  UNION ALL SELECT r.src, s.dst FROM ruby r JOIN stems s ON s.repo = r.repo AND s.key = concat('lib/', r.imp) ANTI JOIN stems x ON x.repo = r.repo AND x.key = r.key) WHERE src <> dst)"""
EDGES_SQL = (v.F_SQL, v.I_SQL, _PY, _EDGES)
LINKS_SQL = (v.S_SQL, _TARGETS, _BODIES, f"""words AS (SELECT DISTINCT s.repo, b.file_id, b.i, b.tail FROM (SELECT file_id, i, unnest({tx.matches('body', tx.IDENTIFIER, D)}) AS tail FROM bodies) b JOIN symbols_one s ON s.file_id = b.file_id AND s.i = b.i),
near AS (SELECT src AS file_id, dst AS dst_file FROM edges UNION SELECT file_id, file_id FROM files_now),
cands AS (SELECT w.file_id, w.i, w.tail, t.file_id AS dst_file, t.i AS dst_i, t.path, t.start_line AS a, t.end_line AS b, EXISTS (SELECT 1 FROM near n WHERE n.file_id = w.file_id AND n.dst_file = t.file_id) AS near
  FROM words w JOIN targets t ON t.repo = w.repo AND t.tail = w.tail WHERE NOT (w.file_id = t.file_id AND w.i = t.i)),
judged AS (SELECT *, count(*) OVER q AS n, bool_or(near) OVER q AS any_near FROM cands WINDOW q AS (PARTITION BY file_id, i, tail)),
kept AS (SELECT * FROM judged WHERE n = 1 OR near OR (NOT any_near AND n <= 2) QUALIFY row_number() OVER (PARTITION BY file_id, i, tail ORDER BY path, dst_file, dst_i) <= {links.MOST}),
links AS (SELECT DISTINCT k.file_id AS src_file, k.i AS src_i, k.dst_file, k.dst_i FROM kept k JOIN symbols_one s ON s.file_id = k.file_id AND s.i = k.i
  WHERE NOT (k.file_id = k.dst_file AND ((s.start_line <= k.a AND k.b <= s.end_line) OR (k.a <= s.start_line AND s.end_line <= k.b))))""")
SQL = {
    "import_edges": v.with_(*EDGES_SQL) + "SELECT src, dst FROM edges",
    "reverse_edges": v.with_(*EDGES_SQL) + "SELECT dst AS src, src AS dst FROM edges",
    "import_degrees": v.with_(*EDGES_SQL) + """SELECT file_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(b) AS BIGINT) AS in_degree FROM (SELECT src AS file_id, 1 AS o, 0 AS b FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY file_id""",
    "module_dependencies": v.with_(*EDGES_SQL) + """SELECT DISTINCT a.repo, a.module, b.module AS depends_on FROM edges e JOIN files_now a ON a.file_id = e.src JOIN files_now b ON b.file_id = e.dst WHERE a.module <> b.module""",
    "module_tests": v.with_(*EDGES_SQL) + """SELECT repo, module, file_id AS test_id FROM files_now WHERE is_test AND module IS NOT NULL
  UNION SELECT b.repo, b.module, a.file_id FROM edges e JOIN files_now a ON a.file_id = e.src AND a.is_test JOIN files_now b ON b.file_id = e.dst WHERE b.module IS NOT NULL""",
    "link_graph": v.with_(*EDGES_SQL, *LINKS_SQL) + "SELECT src_file, src_i, dst_file, dst_i FROM links",
    "import_statistics": v.with_(v.F_SQL, v.I_SQL) + "SELECT repo, imp, count(*) AS importers FROM imports_raw GROUP BY ALL",
    "python_module_edges": v.with_(v.F_SQL, v.I_SQL, _PY) + "SELECT src, dst FROM py_edges",
    "link_targets": v.with_(v.S_SQL, _TARGETS) + "SELECT repo, tail, count(*) AS symbols FROM targets GROUP BY ALL",
    "member_containers": v.with_(v.S_SQL) + """SELECT s.file_id, s.i, concat(string_agg(c.name, '.' ORDER BY c.start_line, c.i), '.', s.name) AS qualified FROM symbols_one s JOIN symbols_one c
  ON c.file_id = s.file_id AND c.kind IN ('class', 'impl', 'type', 'module') AND c.start_line < s.start_line AND s.end_line <= c.end_line
  WHERE s.kind IN ('method', 'function') AND NOT contains(s.name, '.') GROUP BY s.file_id, s.i, s.name""",
    "symbol_identifiers": v.with_(v.F_SQL, v.S_SQL, _BODIES) + f"SELECT file_id, i, unnest(list_distinct({tx.matches('body', tx.IDENTIFIER, D)})) AS ident FROM bodies",
}
