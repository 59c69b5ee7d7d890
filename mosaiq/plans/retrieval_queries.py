"""Queries over the index: search, blended scores, greedy packs, lookups, citations, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import text as tx
from mosaiq.operators import enrich, links, packs, search, verify
from mosaiq.plans import graph_queries as graph
from mosaiq.plans import views as v
from mosaiq.runtime import materialise, table

D = tx.DUCK


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return v.index(spark, d).postings


def _hits(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """The hits of the stated questions, written once: several operators read them."""
    return materialise(v.found(spark, d, k))


def index_units(spark: SparkSession, d: str) -> DataFrame:
    rows = _postings(spark, d).groupBy("utype", "uid").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("terms"))
    return rows.groupBy("utype").agg(F.count(F.lit(1)).alias("units"), F.sum("len").alias("len"), F.sum("terms").alias("postings"))


def index_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("term").agg(F.max("df").alias("df"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return v.found(spark, d, 30).select("qid", "uid", "utype", "score", "rank")


def bm25_typed_search(spark: SparkSession, d: str) -> DataFrame:
    return v.found(spark, d, 10, ["sym"]).select("qid", "uid", "score", "rank")


def file_score_blend(spark: SparkSession, d: str) -> DataFrame:
    return packs.file_scores(_hits(spark, d, 60), v.stored_symbols(spark, d), v.stored_qa(spark, d), v.stored_files(spark, d))


def symbol_score_blend(spark: SparkSession, d: str) -> DataFrame:
    return packs.symbol_scores(_hits(spark, d), v.stored_symbols(spark, d), v.stored_qa(spark, d)).select("qid", "file_id", "i", "score")


def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    """Of the hits of each question, in order, those whose names fit a budget of 60 tokens."""
    hits = v.found(spark, d, 40, ["sym"])
    s = v.stored_symbols(spark, d).select(F.concat(F.lit("sym:"), "file_id", F.lit(":"), "i").alias("uid"), F.expr(f"CAST({tx.estimated_tokens('concat(name, path)')} AS BIGINT)").alias("tokens"))
    return packs.greedy(hits.join(s, "uid").select("qid", F.col("rank").alias("ord"), F.col("uid").alias("key"), "tokens"), 60)


def seed_nms(spark: SparkSession, d: str) -> DataFrame:
    return packs.seeds(packs.symbol_scores(_hits(spark, d), v.stored_symbols(spark, d), v.stored_qa(spark, d)), 4)


def link_score_expand(spark: SparkSession, d: str) -> DataFrame:
    symbols = v.stored_symbols(spark, d)
    seeds = materialise(packs.seeds(packs.symbol_scores(_hits(spark, d), symbols, v.stored_qa(spark, d)), 4))
    return packs.linked(seeds, v.links_of(spark, d, seeds), symbols, v.questions(spark, d), 12)


def link_pack(spark: SparkSession, d: str) -> DataFrame:
    files, symbols = v.stored_files(spark, d), v.stored_symbols(spark, d)
    return packs.link_pack(_hits(spark, d), v.questions(spark, d), symbols, v.stored_qa(spark, d), files, lambda seeds: v.links_of(spark, d, seeds), links.definitions(symbols))


def pointer_pack(spark: SparkSession, d: str) -> DataFrame:
    return packs.pointer_pack(_hits(spark, d, 80), v.stored_symbols(spark, d), v.stored_qa(spark, d), v.stored_files(spark, d))


def full_pack(spark: SparkSession, d: str) -> DataFrame:
    """(qid, ord, key, tokens, text): answers, files with their symbols and a module within 2000 tokens, and excerpts of source within 1800."""
    files, symbols = v.stored_files(spark, d), v.stored_symbols(spark, d)
    return packs.full_pack(_hits(spark, d, 60), v.questions(spark, d), symbols, v.stored_qa(spark, d), files)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(qid, cid, pos): up to 70 candidates, the first 45 hits and then the symbols of the eight best files."""
    from pyspark.sql.window import Window

    hits = _hits(spark, d, 120)
    first = hits.where("rank <= 45").select("qid", F.col("uid").alias("cid"), F.col("rank").alias("pos"))
    own = F.expr("CASE utype WHEN 'file' THEN CAST(substr(uid, 6) AS BIGINT) WHEN 'sym' THEN CAST(split(uid, ':')[1] AS BIGINT) END")
    tops = hits.withColumn("file_id", own).where("file_id IS NOT NULL").groupBy("qid", "file_id").agg(F.min("rank").alias("r"))
    tops = tops.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("r"))).where("n <= 8")
    more = tops.join(v.stored_symbols(spark, d).where("kind <> 'section' OR kind IS NULL").select("file_id", "i"), "file_id")
    more = more.select("qid", F.concat(F.lit("sym:"), "file_id", F.lit(":"), "i").alias("cid"), (F.lit(1000) + F.col("n") * 100000 + F.col("i")).cast("bigint").alias("pos"))
    rows = first.unionByName(more).groupBy("qid", "cid").agg(F.min("pos").alias("pos"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "cid")).cast("bigint")
    return rows.withColumn("pos", order).where("pos <= 70")


def judge_select(spark: SparkSession, d: str) -> DataFrame:
    """Hits a judge keeps whose probability is the score over the best score of all questions."""
    hits = _hits(spark, d, 30)
    best = hits.agg(F.max("score").alias("m"))
    rows = hits.crossJoin(F.broadcast(best)).select("qid", F.col("uid").alias("id"), F.round(F.col("score") / F.col("m"), 6).alias("p"))  # one row
    return packs.judged(rows, relative=0.5)


def symbol_where(spark: SparkSession, d: str) -> DataFrame:
    """(want, file_id, i, kind, exact): the symbols of every wanted name, by full name or last part; wanted are the names that answers' references cite."""
    refs = v.stored_qa(spark, d).select(F.explode("refs").alias("ref")).where("ref LIKE '%::%'").select(F.regexp_extract("ref", r"::(.+)$", 1).alias("want")).distinct()
    refs = refs.withColumn("last", F.expr(tx.last_part("want")))
    s = v.stored_symbols(spark, d).where("name IS NOT NULL").select("file_id", "i", "name", "kind", F.expr(tx.last_part("name")).alias("last"))
    return refs.join(s, "last").select("want", "file_id", "i", "kind", (F.col("name") == F.col("want")).alias("exact"))


def file_card(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, path, lines, symbols, map): each file with how many symbols it has and the first 80 with their spans."""
    s = v.stored_symbols(spark, d).withColumn("line", F.expr(f"concat({tx.span('start_line', 'end_line')}, ' ', coalesce(name, ''))"))
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("i"))
    rows = s.withColumn("n", pos).groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"), F.array_join(F.expr("transform(array_sort(collect_list(CASE WHEN n <= 80 THEN struct(n, line) END)), x -> x.line)"), "; ").alias("map"))
    return v.stored_files(spark, d).select("file_id", "path", "lines").join(rows, "file_id")


def module_card(spark: SparkSession, d: str) -> DataFrame:
    f = v.stored_files(spark, d).where("module IS NOT NULL")
    q = v.stored_qa(spark, d).where("module IS NOT NULL").groupBy("repo", "module").agg(F.count(F.lit(1)).alias("answers"))
    rows = f.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.count_if("is_test").alias("tests"), F.min("path").alias("first_path"))
    return rows.join(q, ["repo", "module"], "left").withColumn("answers", F.coalesce("answers", F.lit(0)))


def reference_verify(spark: SparkSession, d: str) -> DataFrame:
    refs = v.stored_qa(spark, d).select("qa_id", "repo", F.posexplode("refs").alias("pos", "ref")).where("ref IS NOT NULL")
    return verify.resolve(refs, v.stored_symbols(spark, d), v.stored_files(spark, d)).select("qa_id", "pos", "ref", "resolved")


def citation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return verify.counts(reference_verify(spark, d))


def inline_annotate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").alias("key"), F.lower(F.trim("source")).alias("repo"), "text")
    return verify.annotate(texts, v.stored_symbols(spark, d), v.stored_files(spark, d)).select("key", F.sha2("annotated", 256).alias("annotated_sha"), F.length("annotated").alias("length"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", enrich.salvage("text").alias("json")).where("json IS NOT NULL")
    return rows.select("doc_id", F.length("json").alias("length"))


def enrichment_jobs(spark: SparkSession, d: str) -> DataFrame:
    """(key, answer): the stub's answer for one prompt a module."""
    jobs = v.stored_files(spark, d).where("module IS NOT NULL").groupBy("repo", "module").agg(F.sum("lines").alias("lines"))
    jobs = jobs.select(F.concat_ws("/", "repo", "module").alias("key"), F.concat(F.lit("Describe "), "module", F.lit(" with "), F.col("lines").cast("string"), F.lit(" lines")).alias("prompt"))
    return enrich.complete(jobs).select("key", "prompt", "answer")


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return enrich.nearest(e.select("vec_id", F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")))


QUERIES = {
    f.__name__: f
    for f in (
        index_units, index_term_frequency, bm25_topk, bm25_typed_search, file_score_blend, symbol_score_blend, greedy_pack, seed_nms, link_score_expand, link_pack, pointer_pack, full_pack, candidates,
        judge_select, symbol_where, file_card, module_card, reference_verify, citation_ratio, inline_annotate, json_salvage, enrichment_jobs, embedding_topk,
    )
}

_BASE = (v.F_SQL, v.S_SQL, v.Q_SQL, search.UNITS_SQL, search.POSTINGS_SQL)
_FILE_ID = "CAST(substr(uid, 6) AS BIGINT)"
_SYM_FILE, _SYM_I = "CAST(split_part(uid, ':', 2) AS BIGINT)", "CAST(split_part(uid, ':', 3) AS INT)"
_RESOLVED = f"""refs AS (SELECT qa_id, repo, CAST(pos - 1 AS INT) AS pos, ref FROM (SELECT qa_id, repo, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM qa_now) WHERE ref IS NOT NULL),
bare AS (SELECT DISTINCT repo, ref, regexp_replace(trim(ref), '^`+|`+$', '', 'g') AS r FROM refs),
named AS (SELECT repo, ref, regexp_extract(r, '{verify.NAMED}', 1) AS path, regexp_replace(regexp_extract(r, '{verify.NAMED}', 2), '[().]+$', '') AS want
  FROM bare WHERE regexp_matches(r, '{verify.NAMED}') AND NOT regexp_matches(r, '{verify.LINES}')),
picked AS (SELECT n.repo, n.ref, concat(n.path, ':', {tx.span('s.start_line', 's.end_line')}) AS resolved FROM named n JOIN symbols_one s
    ON s.repo = n.repo AND s.path = n.path AND {tx.last_part('s.name', D)} = {tx.last_part('n.want', D)}
  QUALIFY row_number() OVER (PARTITION BY n.repo, n.ref ORDER BY CASE WHEN s.name = n.want THEN 0 WHEN starts_with(s.name, coalesce({tx.name_parts('n.want', D)}[1], n.want)) THEN 1 ELSE 2 END, s.i, s.file_id) = 1),
sizes AS (SELECT repo, path, max(lines) AS n FROM files_now WHERE path IS NOT NULL GROUP BY ALL),
cited_lines AS (SELECT repo, ref, regexp_extract(r, '{verify.LINES}', 1) AS path, CAST(regexp_extract(r, '{verify.LINES}', 2) AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(r, '{verify.LINES}', 3), '') AS BIGINT) AS b
  FROM bare WHERE regexp_matches(r, '{verify.LINES}')),
found AS (SELECT * FROM picked UNION ALL SELECT a.repo, a.ref, concat(a.path, ':L', a.a, '-', least(greatest(a.a, coalesce(a.b, a.a)), s.n)) FROM cited_lines a JOIN sizes s ON s.repo = a.repo AND s.path = a.path WHERE a.a BETWEEN 1 AND s.n
  UNION ALL SELECT b.repo, b.ref, b.r FROM bare b JOIN sizes s ON s.repo = b.repo AND s.path = b.r),
resolved AS (SELECT r.qa_id, r.pos, r.ref, f.resolved FROM refs r LEFT JOIN found f ON f.repo = r.repo AND f.ref = r.ref)"""
_SCORED = f"""tops AS (SELECT qid, max(score) AS top FROM hits GROUP BY qid),
ff AS (SELECT qid, {_FILE_ID} AS file_id, max(score) AS fs FROM hits WHERE utype = 'file' GROUP BY ALL),
direct AS (SELECT h.qid, h.file_id, h.i, h.score + 0.25::DOUBLE * coalesce(ff.fs, 0) AS s FROM (SELECT qid, {_SYM_FILE} AS file_id, {_SYM_I} AS i, score FROM hits WHERE utype = 'sym') h LEFT JOIN ff ON ff.qid = h.qid AND ff.file_id = h.file_id),
cites AS (SELECT h.qid, q.repo, h.score, unnest(q.refs[:4]) AS ref FROM hits h JOIN tops t ON t.qid = h.qid AND h.score >= 0.5::DOUBLE * t.top JOIN qa_now q ON h.utype = 'qa' AND q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)),
spans AS (SELECT repo, path, start_line, end_line, max({{'f': file_id, 'i': i}}) AS s FROM symbols_one GROUP BY ALL),
cited AS (SELECT c.qid, s.s.f AS file_id, s.s.i AS i, 0.6::DOUBLE * c.score AS s FROM cites c JOIN spans s ON regexp_matches(c.ref, '{tx.SPAN}') AND s.repo = c.repo AND s.path = regexp_extract(c.ref, '{tx.SPAN}', 1)
    AND s.start_line = TRY_CAST(regexp_extract(c.ref, '{tx.SPAN}', 2) AS INT) AND s.end_line = TRY_CAST(regexp_extract(c.ref, '{tx.SPAN}', 3) AS INT)),
scored_symbols AS (SELECT t.qid, t.file_id, t.i, t.score, s.kind, s.start_line AS a, s.end_line AS b FROM (SELECT qid, file_id, i, round(sum(s), 6) AS score FROM (SELECT * FROM direct UNION ALL SELECT * FROM cited) GROUP BY ALL) t JOIN symbols_one s USING (file_id, i) WHERE s.kind <> 'section' OR s.kind IS NULL)"""
_SEEDS = f"""ordered AS (SELECT qid, file_id, i, score, kind, a, b, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id, i) AS rn FROM scored_symbols
  QUALIFY score >= {packs.SEED_CUT}::DOUBLE * max(score) OVER (PARTITION BY qid)),
walk AS (
  SELECT qid, rn, [{{'f': file_id, 'i': i, 's': score, 'a': a, 'b': b}}] AS acc FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.qid, o.rn, CASE WHEN len(w.acc) >= 4 OR (coalesce(o.kind, '') IN ('variable', 'attribute', 'constant') AND o.b - o.a < 2)
      OR len(list_filter(w.acc, lambda k: k.f = o.file_id AND ((k.a <= o.a AND o.b <= k.b) OR (o.a <= k.a AND k.b <= o.b)))) > 0
    THEN w.acc ELSE list_append(w.acc, {{'f': o.file_id, 'i': o.i, 's': o.score, 'a': o.a, 'b': o.b}}) END
  FROM walk w JOIN ordered o ON o.qid = w.qid AND o.rn = w.rn + 1),
seeds AS (SELECT qid, CAST(k - 1 AS INT) AS rank, x.f AS file_id, x.i AS i, x.s AS score FROM (
  SELECT qid, unnest(acc) AS x, generate_subscripts(acc, 1) AS k FROM (SELECT qid, acc FROM walk QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rn DESC) = 1)))"""
_EXPAND = f"""
raw_links AS (SELECT s.qid, l.dst_file AS file_id, l.dst_i AS i, s.score / (1 + s.rank) AS w, true AS uses FROM seeds s JOIN links l ON l.src_file = s.file_id AND l.src_i = s.i
  UNION ALL SELECT s.qid, l.src_file, l.src_i, s.score / (1 + s.rank), false FROM seeds s JOIN links l ON l.dst_file = s.file_id AND l.dst_i = s.i),
asked AS (SELECT qid, list_distinct({tx.tokens('text', D)}) AS q FROM questions),
weighed AS (SELECT r.qid, r.file_id, r.i, round(sum(CASE WHEN uses THEN w * (0.5::DOUBLE + {tx.overlap('q', tx.tokens('s.name', D), D)}) ELSE w * (0.3::DOUBLE + {tx.overlap('q', tx.tokens('s.name', D), D)})
    * CASE WHEN contains({tx.basename('s.path', D)}, 'test') AND list_contains(q, 'test') THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END END), 6) AS score, max(s.start_line) AS a, max(s.end_line) AS b
  FROM raw_links r JOIN symbols_one s ON s.file_id = r.file_id AND s.i = r.i JOIN asked USING (qid) GROUP BY ALL),
free AS (SELECT * FROM weighed w WHERE NOT EXISTS (SELECT 1 FROM seeds e JOIN symbols_one x ON x.file_id = e.file_id AND x.i = e.i WHERE e.qid = w.qid AND e.file_id = w.file_id
    AND ((x.start_line <= w.a AND w.b <= x.end_line) OR (w.a <= x.start_line AND x.end_line <= w.b)))),
linked AS (SELECT qid, file_id, i, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id, i) AS rank FROM free QUALIFY rank <= 12)"""


def _paragraphs(name: str, most: int) -> str:
    """A CTE of the headings and numbered source of all symbols, long ones half and with their members."""
    size = f"CASE WHEN s.end_line - s.start_line + 1 <= {most} THEN s.end_line - s.start_line + 1 ELSE {most // 2} END"
    return f"""{name} AS (SELECT s.file_id, s.i, 'SOURCE ' || s.path || ':' || {tx.span('s.start_line', 's.end_line')} || ' ' || s.name || chr(10)
    || coalesce(array_to_string(list_transform(string_split(f.head, chr(10))[s.start_line : s.start_line + greatest({size}, 0) - 1], lambda x, k: concat(s.start_line + k - 1, '|', x)), chr(10)), '')
    || CASE WHEN s.end_line - s.start_line + 1 > {most} THEN concat(chr(10), '   … (continues to L', s.end_line, ')', chr(10) || (SELECT string_agg(concat('   … ', m.name, ' ', {tx.span('m.start_line', 'm.end_line')}), chr(10) ORDER BY m.i) FROM (
      SELECT * FROM symbols_one m WHERE m.file_id = s.file_id AND m.start_line > s.start_line AND m.start_line <= s.end_line AND starts_with(m.name, concat(s.name, '.')) ORDER BY m.i LIMIT 25) m)) ELSE '' END AS text
  FROM (SELECT DISTINCT file_id, i FROM (SELECT file_id, i FROM roots UNION ALL SELECT file_id, i FROM around)) w JOIN symbols_one s ON s.file_id = w.file_id AND s.i = w.i AND s.start_line >= 1 LEFT JOIN files_now f ON f.file_id = s.file_id)"""


SQL = {
    "index_units": v.with_(*_BASE) + "SELECT utype, count(*) AS units, CAST(sum(len) AS BIGINT) AS len, CAST(sum(terms) AS BIGINT) AS postings FROM (SELECT utype, uid, max(len) AS len, count(*) AS terms FROM postings GROUP BY ALL) GROUP BY utype",
    "index_term_frequency": v.with_(*_BASE) + "SELECT term, df FROM df",
    "bm25_topk": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(30)) + "SELECT qid, uid, utype, score, rank FROM hits",
    "bm25_typed_search": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(10, ["sym"])) + "SELECT qid, uid, score, rank FROM hits",
    "file_score_blend": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(60)) + f"""SELECT qid, file_id, round(sum(s), 6) AS score FROM (
  SELECT qid, {_FILE_ID} AS file_id, score AS s FROM hits WHERE utype = 'file'
  UNION ALL SELECT qid, {_SYM_FILE}, 0.5::DOUBLE * score FROM hits WHERE utype = 'sym'
  UNION ALL SELECT c.qid, f.file_id, 0.3::DOUBLE * c.score FROM (
    SELECT h.qid, h.score, q.repo, split_part(unnest(q.refs[:3]), ':', 1) AS path FROM hits h JOIN qa_now q ON h.utype = 'qa' AND q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)) c
    JOIN files_now f ON f.repo = c.repo AND f.path = c.path) GROUP BY ALL""",
    "symbol_score_blend": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(100), _SCORED) + "SELECT qid, file_id, i, score FROM scored_symbols",
    "seed_nms": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(100), _SCORED, _SEEDS) + "SELECT qid, rank, file_id, i, score FROM seeds",
    "link_score_expand": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(100), _SCORED, _SEEDS, *graph.EDGES_SQL[1:], *graph.LINKS_SQL[1:], _EXPAND) + "SELECT qid, file_id, i, score, rank FROM linked",
    "link_pack": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(100), _SCORED, _SEEDS, *graph.EDGES_SQL[1:], *graph.LINKS_SQL[1:], _EXPAND, f"""
keyed_names AS (SELECT *, array_to_string({tx.name_parts('name', D)}[-2:], '.') AS key FROM symbols_one WHERE kind IN ('declaration', 'method')),
defs AS (SELECT d.file_id, d.i, m.file_id AS def_file, m.i AS def_i FROM keyed_names d JOIN keyed_names m ON d.kind = 'declaration' AND m.kind = 'method' AND contains(m.name, '::') AND m.repo = d.repo AND m.key = d.key
  QUALIFY row_number() OVER (PARTITION BY d.file_id, d.i ORDER BY CAST({tx.dirname('d.path', D)} = {tx.dirname('m.path', D)} AS INT) DESC,
    CAST(starts_with({tx.basename('m.path', D)}, {tx.without_extension(tx.basename('d.path', D), D)}) AS INT) DESC, m.path, m.i) = 1),
moved AS (SELECT s.*, d.def_file, d.def_i FROM seeds s LEFT JOIN defs d ON d.file_id = s.file_id AND d.i = s.i),
roots AS (SELECT qid, coalesce(def_file, file_id) AS file_id, coalesce(def_i, i) AS i, min(rank) AS rank FROM moved GROUP BY ALL),
around AS (SELECT l.qid, l.file_id, l.i, l.pos, s.path, s.name, s.start_line, s.end_line FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (
    SELECT qid, file_id, i, rank FROM linked UNION ALL SELECT qid, file_id, i, rank - 100 FROM moved WHERE def_file IS NOT NULL)) l JOIN symbols_one s ON s.file_id = l.file_id AND s.i = l.i),
best_answers AS (SELECT h.qid, h.uid, q.q, q.a FROM (SELECT h.*, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS n FROM hits h JOIN tops t ON t.qid = h.qid AND h.utype = 'qa' AND h.score >= 0.5::DOUBLE * t.top
    WHERE h.qid IN (SELECT qid FROM scored_symbols) QUALIFY n <= 1) h JOIN qa_now q ON q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)),
{_paragraphs("para_full", 60)},
{_paragraphs("para_half", 30)},
shown AS (
  SELECT qid, 1 AS ord, uid AS key, concat('Q: ', coalesce(q, ''), chr(10), 'A: ', coalesce(a, '')) AS text FROM best_answers
  UNION ALL SELECT r.qid, r.rank + 100, concat('sym:', r.file_id, ':', r.i), p.text FROM roots r JOIN para_full p ON p.file_id = r.file_id AND p.i = r.i
  UNION ALL SELECT l.qid, l.pos + 200, concat('sym:', l.file_id, ':', l.i), p.text FROM around l JOIN para_half p ON p.file_id = l.file_id AND p.i = l.i WHERE l.pos <= 2 AND l.end_line - l.start_line < 60),
items AS (SELECT qid, ord, key, coalesce({tx.estimated_tokens('text', D)}, 0) AS tokens FROM shown)""", packs.greedy_sql("items", 3500), f"""
spent AS (SELECT qid, sum(tokens) AS used FROM taken GROUP BY qid),
listed AS (SELECT l.qid, max(coalesce(u.used, 0)) AS used, concat('LINKED (definitions used, callers, tests):', chr(10), string_agg('- ' || l.path || ':' || {tx.span('l.start_line', 'l.end_line')} || ' ' || l.name, chr(10) ORDER BY l.pos)) AS text
  FROM around l LEFT JOIN spent u ON u.qid = l.qid WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.qid = l.qid AND t.key = concat('sym:', l.file_id, ':', l.i)) GROUP BY l.qid)""") + f"""
SELECT s.qid, CAST(s.ord AS BIGINT) AS ord, s.key AS unit, CAST({tx.estimated_tokens('s.text', D)} AS BIGINT) AS tokens, s.text FROM shown s JOIN taken t ON t.qid = s.qid AND t.ord = s.ord AND t.key = s.key
UNION ALL SELECT qid, 300, 'links', {tx.estimated_tokens('text', D)}, text FROM listed WHERE used + {tx.estimated_tokens('text', D)} <= 3500""",
    "pointer_pack": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(80), f"""tops AS (SELECT qid, max(score) AS top FROM hits GROUP BY qid),
answers AS (SELECT h.qid, h.uid, h.score, t.top, q.repo, q.q, q.a, q.refs, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS n FROM hits h JOIN tops t ON t.qid = h.qid AND h.utype = 'qa' AND h.score >= 0.55::DOUBLE * t.top
  JOIN qa_now q ON q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT) QUALIFY n <= 2),
quoted AS (SELECT qid, repo, n, top, unnest(refs[:4]) AS ref, generate_subscripts(refs[:4], 1) - 1 AS k FROM answers),
owners AS (SELECT repo, path, max(file_id) AS file_id FROM files_now GROUP BY ALL),
cited AS (SELECT c.qid, k.file_id, c.repo, c.path, c.a, c.b, round(c.top, 6) AS s, c.n * 10 + c.k AS pos FROM (
    SELECT *, {tx.normal_path(f"regexp_extract(ref, '{tx.SPAN}', 1)", D)} AS path, TRY_CAST(regexp_extract(ref, '{tx.SPAN}', 2) AS INT) AS a, TRY_CAST(regexp_extract(ref, '{tx.SPAN}', 3) AS INT) AS b FROM quoted WHERE regexp_matches(ref, '{tx.SPAN}')) c
  LEFT JOIN owners k ON k.repo = c.repo AND k.path = c.path WHERE c.a IS NOT NULL AND c.b IS NOT NULL),
boost AS (SELECT qid, {_FILE_ID} AS file_id, max(score) AS boost FROM hits WHERE utype = 'file' GROUP BY ALL),
sym AS (SELECT qid, {_SYM_FILE} AS file_id, {_SYM_I} AS i, score FROM hits WHERE utype = 'sym'),
direct AS (SELECT y.qid, y.file_id, s.repo, s.path, s.start_line AS a, s.end_line AS b, round(y.score + 0.3::DOUBLE * coalesce(o.boost, 0), 6) AS s, 1 << 30 AS pos FROM sym y JOIN symbols_one s ON s.file_id = y.file_id AND s.i = y.i
    AND coalesce(s.kind, '') <> 'section' AND NOT coalesce(s.kind = 'class' AND s.end_line - s.start_line > 150, false) LEFT JOIN boost o ON o.qid = y.qid AND o.file_id = y.file_id),
both_ AS (SELECT *, coalesce('file:' || file_id, concat_ws('', 'path:', repo, chr(10), path)) AS place FROM (SELECT * FROM direct UNION ALL SELECT * FROM cited)),
ptr AS (SELECT qid, place, file_id, a, b, max(s) AS s, min(pos) AS pos, max(path) AS path FROM both_ GROUP BY ALL),
ranked_ptr AS (SELECT p.*, row_number() OVER (PARTITION BY p.qid ORDER BY s DESC, pos, file_id NULLS FIRST, place, a, b) AS ord FROM ptr p JOIN tops t USING (qid) WHERE s >= 0.3::DOUBLE * top),
walk AS (
  SELECT qid, ord, [{{'ord': ord, 'f': place, 'a': a, 'b': b}}] AS acc FROM ranked_ptr WHERE ord = 1
  UNION ALL
  SELECT p.qid, p.ord, CASE WHEN len(w.acc) >= 10 OR len(list_filter(w.acc, lambda k: k.f = p.place AND k.a <= p.a AND p.b <= k.b)) > 0 THEN w.acc ELSE list_append(w.acc, {{'ord': p.ord, 'f': p.place, 'a': p.a, 'b': p.b}}) END
  FROM walk w JOIN ranked_ptr p ON p.qid = w.qid AND p.ord = w.ord + 1),
final AS (SELECT qid, unnest(acc) AS x FROM (SELECT qid, acc FROM walk QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ord DESC) = 1)),
first_names AS (SELECT file_id, start_line AS a, end_line AS b, arg_min(name, i) AS name FROM symbols_one WHERE name IS NOT NULL GROUP BY ALL)""") + f"""SELECT qid, n - 2 AS ord, uid AS unit, CAST(NULL AS BIGINT) AS file_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b, round(score, 6) AS score,
  concat('Q: ', coalesce(q, ''), chr(10), 'A: ', coalesce(a, '')) AS text FROM answers
UNION ALL SELECT r.qid, r.ord, 'span', r.file_id, r.path, r.a, r.b, r.s, rtrim(concat('- ', coalesce(r.path, ''), ':', coalesce({tx.span('r.a', 'r.b')}, ''), ' ', coalesce(m.name, '')))
  FROM final f JOIN ranked_ptr r ON r.qid = f.qid AND r.ord = f.x.ord LEFT JOIN first_names m ON m.file_id = r.file_id AND m.a = r.a AND m.b = r.b""",
    "candidates": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(120), f"""owned AS (SELECT qid, rank, CASE utype WHEN 'file' THEN {_FILE_ID} WHEN 'sym' THEN {_SYM_FILE} END AS file_id FROM hits WHERE utype IN ('file', 'sym')),
best AS (SELECT qid, file_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS n FROM owned GROUP BY qid, file_id QUALIFY n <= 8),
pool AS (SELECT qid, uid AS cid, rank AS pos FROM hits WHERE rank <= 45
  UNION ALL SELECT b.qid, concat('sym:', s.file_id, ':', s.i), 1000 + b.n * 100000 + s.i FROM best b JOIN symbols_one s USING (file_id) WHERE s.kind <> 'section' OR s.kind IS NULL)""")
  + "SELECT qid, cid, n AS pos FROM (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY min(pos), cid) AS n FROM pool GROUP BY qid, cid) WHERE n <= 70",
    "full_pack": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(60), f"""tops AS (SELECT qid, max(score) AS top FROM hits GROUP BY qid),
answers AS (SELECT h.qid, h.rank AS ord, h.uid AS key, concat('Q: ', coalesce(q.q, ''), chr(10), 'A: ', coalesce(q.a, ''), CASE WHEN len(q.refs) > 0 THEN concat(chr(10), '   refs: ', array_to_string(q.refs[:5], ', ')) ELSE '' END) AS text
  FROM hits h JOIN tops t ON t.qid = h.qid AND h.utype = 'qa' AND h.score >= 0.45::DOUBLE * t.top JOIN qa_now q ON q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)),
blend AS (SELECT qid, file_id, round(sum(s), 6) AS score FROM (
  SELECT qid, {_FILE_ID} AS file_id, score AS s FROM hits WHERE utype = 'file' UNION ALL SELECT qid, {_SYM_FILE}, 0.5::DOUBLE * score FROM hits WHERE utype = 'sym'
  UNION ALL SELECT c.qid, f.file_id, 0.3::DOUBLE * c.score FROM (SELECT h.qid, h.score, q.repo, split_part(unnest(q.refs[:3]), ':', 1) AS path FROM hits h JOIN qa_now q ON h.utype = 'qa' AND q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)) c
    JOIN files_now f ON f.repo = c.repo AND f.path = c.path) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id) AS n FROM blend QUALIFY n <= 6),
sym AS (SELECT qid, {_SYM_FILE} AS file_id, {_SYM_I} AS i, score FROM hits WHERE utype = 'sym'),
asked AS (SELECT qid, list_distinct({tx.tokens('text', D)}) AS q FROM questions),
own AS (SELECT b.qid, b.file_id, s.i, s.name, s.sig, s.start_line, s.end_line, y.score FROM best b JOIN symbols_one s USING (file_id) LEFT JOIN sym y ON y.qid = b.qid AND y.file_id = b.file_id AND y.i = s.i JOIN asked k ON k.qid = b.qid
  WHERE y.score IS NOT NULL OR list_has_any(k.q, {tx.tokens('s.name', D)})),
chosen AS (SELECT * FROM (SELECT *, count(score) OVER (PARTITION BY qid, file_id) AS direct, row_number() OVER (PARTITION BY qid, file_id ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN i ELSE -i END) AS pos FROM own)
  WHERE (score IS NOT NULL AND pos <= 6) OR (score IS NULL AND direct < 3 AND pos <= 5)),
listed AS (SELECT qid, file_id, string_agg(concat(chr(10), '  - ', coalesce(name, ''), ' ', coalesce({tx.span('start_line', 'end_line')}, ''), ': ', substr(coalesce(sig, ''), 1, 300)), '' ORDER BY pos) AS ls FROM chosen GROUP BY ALL),
cards AS (SELECT b.qid, 1000 + b.n AS ord, concat('file:', b.file_id) AS key, concat('FILE ', coalesce(f.path, ''), ' (', f.lines, ' lines)', coalesce(l.ls, '')) AS text FROM best b JOIN files_now f USING (file_id) LEFT JOIN listed l ON l.qid = b.qid AND l.file_id = b.file_id),
sizes AS (SELECT concat('module:', repo, '/', module) AS uid, count(*) AS files, sum(lines) AS lines FROM files_now WHERE module IS NOT NULL GROUP BY repo, module),
mods AS (SELECT h.qid, 1000000 AS ord, h.uid AS key, concat('MODULE ', substr(h.uid, 8), '/: ', s.files, ' files, ', s.lines, ' lines') AS text FROM (
    SELECT h.* FROM hits h JOIN tops t ON t.qid = h.qid AND h.utype = 'module' AND h.score >= 0.4::DOUBLE * t.top QUALIFY row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) = 1) h JOIN sizes s USING (uid)),
items AS (SELECT qid, ord, key, text, CAST({tx.estimated_tokens('text', D)} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY qid ORDER BY ord, key) AS rn FROM (SELECT * FROM answers UNION ALL SELECT * FROM cards UNION ALL SELECT * FROM mods)),
fold AS (
  SELECT qid, rn, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used, CAST(tokens <= 2000 AS INT) AS kept, tokens <= 2000 AS ok FROM items WHERE rn = 1
  UNION ALL
  SELECT i.qid, i.rn, f.used + CASE WHEN f.used + i.tokens <= 2000 AND NOT (starts_with(i.key, 'qa:') AND f.kept >= 4) THEN i.tokens ELSE 0 END,
    f.kept + CAST(f.used + i.tokens <= 2000 AND NOT (starts_with(i.key, 'qa:') AND f.kept >= 4) AS INT), f.used + i.tokens <= 2000 AND NOT (starts_with(i.key, 'qa:') AND f.kept >= 4)
  FROM fold f JOIN items i ON i.qid = f.qid AND i.rn = f.rn + 1),
taken AS (SELECT i.* FROM items i JOIN fold f ON f.qid = i.qid AND f.rn = i.rn AND f.ok),
quoted AS (SELECT h.qid, q.repo, h.rank, unnest(q.refs[:2]) AS ref, generate_subscripts(q.refs[:2], 1) - 1 AS k FROM taken t JOIN hits h ON h.qid = t.qid AND h.uid = t.key AND h.utype = 'qa' JOIN qa_now q ON q.qa_id = TRY_CAST(substr(h.uid, 4) AS BIGINT)),
owners AS (SELECT repo, path, max(file_id) AS file_id FROM files_now GROUP BY ALL),
spans AS (
  SELECT c.qid, c.rank * 10 + c.k AS pos, o.file_id, TRY_CAST(regexp_extract(ref, '{tx.SPAN}', 2) AS INT) AS a, TRY_CAST(regexp_extract(ref, '{tx.SPAN}', 3) AS INT) AS b FROM quoted c
    JOIN owners o ON regexp_matches(c.ref, '{tx.SPAN}') AND o.repo = c.repo AND o.path = {tx.normal_path(f"regexp_extract(c.ref, '{tx.SPAN}', 1)", D)}
  UNION ALL SELECT h.qid, h.rank * 10, s.file_id, s.start_line, s.end_line FROM hits h JOIN tops t ON t.qid = h.qid AND h.utype = 'sym' AND h.score >= {packs.SEED_CUT}::DOUBLE * t.top
    JOIN symbols_one s ON s.file_id = {_SYM_FILE.replace('uid', 'h.uid')} AND s.i = {_SYM_I.replace('uid', 'h.uid')} AND (coalesce(s.kind, '') NOT IN ('class', 'impl', 'module', 'section') OR s.end_line - s.start_line < 60)),
cut AS (SELECT p.*, f.path, least(b, a + 44) AS last, regexp_split_to_array(CASE WHEN f.head LIKE concat('%', chr(10)) THEN substr(f.head, 1, length(f.head) - 1) ELSE f.head END, '\\r?\\n')[a : least(b, a + 44)] AS src
  FROM spans p JOIN files_now f ON f.file_id = p.file_id AND f.head <> '' WHERE a >= 1 AND b >= a),
source AS (SELECT *, CAST({tx.estimated_tokens('text', D)} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY qid ORDER BY pos, file_id, a, b) AS rn FROM (
  SELECT *, concat('SOURCE ', coalesce(path, ''), ':', {tx.span('a', 'a + len(src) - 1')}, chr(10), array_to_string(list_transform(src, lambda x, k: concat(a + k - 1, '|', x)), chr(10))) AS text FROM cut WHERE len(src) > 0)),
pick AS (
  SELECT qid, rn, CASE WHEN tokens <= 1800 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 1800 THEN [{{'rn': rn, 'f': file_id, 'a': a, 'z': last}}] ELSE [] END AS acc FROM source WHERE rn = 1
  UNION ALL
  SELECT s.qid, s.rn, p.used + CASE WHEN len(p.acc) >= 4 OR p.used + s.tokens > 1800 OR len(list_filter(p.acc, lambda k: k.f = s.file_id AND NOT (s.b < k.a OR s.a > k.z))) > 0 THEN 0 ELSE s.tokens END,
    CASE WHEN len(p.acc) >= 4 OR p.used + s.tokens > 1800 OR len(list_filter(p.acc, lambda k: k.f = s.file_id AND NOT (s.b < k.a OR s.a > k.z))) > 0 THEN p.acc ELSE list_append(p.acc, {{'rn': s.rn, 'f': s.file_id, 'a': s.a, 'z': s.last}}) END
  FROM pick p JOIN source s ON s.qid = p.qid AND s.rn = p.rn + 1),
picked AS (SELECT qid, unnest(acc) AS x FROM (SELECT qid, acc FROM pick QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rn DESC) = 1))""") + """SELECT qid, ord, key, tokens, text FROM taken
UNION ALL SELECT s.qid, s.pos + 2000, concat('source:', s.file_id, ':', s.a, '-', s.last), s.tokens, s.text FROM picked p JOIN source s ON s.qid = p.qid AND s.rn = p.x.rn""",
    "inline_annotate": v.with_(v.F_SQL, v.S_SQL, f"""docs AS (SELECT doc_id AS key, lower(trim(source)) AS repo, text FROM documents WHERE doc_id IS NOT NULL),
ms AS (SELECT key, repo, unnest(m) AS ref, generate_subscripts(m, 1) AS k FROM (SELECT key, repo, regexp_extract_all(text, '{verify.INLINE}') AS m FROM docs WHERE regexp_matches(text, '{verify.INLINE}'))),
qa_now AS (SELECT row_number() OVER () AS qa_id, repo, list(DISTINCT ref) AS refs FROM ms GROUP BY repo)""", _RESOLVED, f"""one AS (SELECT DISTINCT r.repo, r.ref, r.resolved FROM (SELECT q.repo, r.ref, r.resolved FROM resolved r JOIN qa_now q USING (qa_id)) r),
known AS (SELECT DISTINCT repo, path FROM files_now WHERE path IS NOT NULL),
shown AS (SELECT m.key, m.k, m.ref, CASE WHEN regexp_matches(b, '{verify.LINES}') AND n.path IS NOT NULL THEN replace(concat('`', regexp_replace(b, '::L?([0-9]+)(?:-L?([0-9]+))?$', ':L\\1-\\2'), '`'), '-`', '`')
    WHEN o.resolved IS NOT NULL THEN concat('`', b, '` (', regexp_extract(o.resolved, ':(L[0-9]+-[0-9]+)$', 1), ')') WHEN n.path IS NOT NULL THEN concat('`', b, '` (unverified)') ELSE m.ref END AS t
  FROM (SELECT *, replace(ref, '`', '') AS b FROM ms) m LEFT JOIN one o ON o.repo = m.repo AND o.ref = m.ref LEFT JOIN known n ON n.repo = m.repo AND n.path = regexp_extract(m.b, '^(.*?)::', 1)),
shows AS (SELECT key, list(t ORDER BY k) AS ts FROM shown GROUP BY key),
gaps AS (SELECT d.key, regexp_split_to_array(d.text, '{verify.INLINE}') AS g, s.ts FROM docs d JOIN shows s USING (key)),
joined AS (SELECT key, string_agg(concat(g[k], coalesce(ts[k], '')), '' ORDER BY k) AS annotated FROM (SELECT key, g, ts, unnest(range(1, len(g) + 1)) AS k FROM gaps) GROUP BY key)""")
  + "SELECT key, sha256(coalesce(annotated, text)) AS annotated_sha, CAST(length(coalesce(annotated, text)) AS INT) AS length FROM docs LEFT JOIN joined USING (key)",
    "json_salvage": """WITH inner_text AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)```(?:json)?\\s*(.*?)```') THEN regexp_extract(text, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE text END AS t FROM documents),
rest AS (SELECT doc_id, regexp_extract(t, '(?s)[\\[{].*', 0) AS r FROM inner_text WHERE regexp_matches(t, '[\\[{]')),
tries AS (SELECT doc_id, 1 AS k, r FROM rest UNION ALL SELECT doc_id, 2, regexp_replace(r, ',(\\s*[}\\]])', '\\1', 'g') FROM rest),
ends AS (SELECT doc_id, k, r, unnest(range(1, length(r) + 1)) AS n FROM tries)
SELECT doc_id, CAST(min_by(n, k * 1000000000 + n) AS INT) AS length FROM ends WHERE substr(r, n, 1) IN ('}', ']') AND json_valid(substr(r, 1, n)) GROUP BY doc_id""",
    "enrichment_jobs": v.with_(v.F_SQL) + """SELECT key, prompt, concat('stub ', substr(sha256(prompt), 1, 12)) AS answer FROM (
  SELECT concat_ws('/', repo, module) AS key, concat('Describe ', module, ' with ', sum(lines), ' lines') AS prompt FROM files_now WHERE module IS NOT NULL GROUP BY repo, module)""",
    "greedy_pack": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(40, ["sym"]), f"""items AS (SELECT h.qid, h.rank AS ord, h.uid AS key, CAST({tx.estimated_tokens('concat(s.name, s.path)', D)} AS BIGINT) AS tokens
  FROM hits h JOIN symbols_one s ON h.uid = concat('sym:', s.file_id, ':', s.i))""", packs.greedy_sql("items", 60)) + "SELECT qid, ord, key, tokens FROM taken",
    "judge_select": v.with_(*_BASE, v.QUESTIONS_SQL, search.search_sql(30)) + """SELECT qid, id, p FROM (SELECT qid, uid AS id, round(score / (SELECT max(score) FROM hits), 6) AS p FROM hits) QUALIFY p >= 0.5::DOUBLE * max(p) OVER (PARTITION BY qid)""",
    "symbol_where": v.with_(v.S_SQL, v.Q_SQL) + f"""SELECT want, file_id, i, kind, name = want AS exact FROM (SELECT DISTINCT regexp_extract(ref, '::(.+)$', 1) AS want FROM (SELECT unnest(refs) AS ref FROM qa_now) WHERE ref LIKE '%::%') w
  JOIN symbols_one s ON s.name IS NOT NULL AND {tx.last_part('s.name', D)} = {tx.last_part('w.want', D)}""",
    "file_card": v.with_(v.F_SQL, v.S_SQL) + f"""SELECT f.file_id, f.path, f.lines, count(*) AS symbols, string_agg(CASE WHEN n <= 80 THEN concat({tx.span('start_line', 'end_line')}, ' ', coalesce(name, '')) END, '; ' ORDER BY n) AS map
  FROM files_now f JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY i) AS n FROM symbols_one) s USING (file_id) GROUP BY f.file_id, f.path, f.lines""",
    "module_card": v.with_(v.F_SQL, v.Q_SQL) + """SELECT m.repo, m.module, files, lines, tests, first_path, coalesce(q.answers, 0) AS answers FROM (
    SELECT repo, module, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(count(*) FILTER (is_test) AS BIGINT) AS tests, min(path) AS first_path FROM files_now WHERE module IS NOT NULL GROUP BY ALL) m
  LEFT JOIN (SELECT repo, module, count(*) AS answers FROM qa_now WHERE module IS NOT NULL GROUP BY ALL) q ON q.repo = m.repo AND q.module = m.module""",
    "reference_verify": v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, _RESOLVED) + "SELECT qa_id, pos, ref, resolved FROM resolved",
    "citation_ratio": v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, _RESOLVED) + "SELECT count(resolved) AS ok, count(*) - count(resolved) AS bad, round_even(count(resolved) / greatest(1, count(*)), 4) AS ratio FROM resolved",
    "embedding_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), p AS (SELECT q.vec_id AS qid, x.vec_id, round(list_dot_product(x.v, q.v) / (x.n * q.n), 6) AS similarity FROM n x, n q WHERE q.vec_id % 100 = 0 AND x.n > 0 AND q.n > 0)
SELECT qid, vec_id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank FROM p QUALIFY rank <= 10""",
}
