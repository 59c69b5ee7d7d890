"""Queries over what was written about a corpus, over packs made of it, and over the events that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx
from mosaiq.operators import enrich, evaluate, extract, imports, incremental, links, packs, rules, search
from mosaiq.operators import knowledge as kn
from mosaiq.plans import corpus_queries as corpus
from mosaiq.plans import evaluation_queries as evaluation
from mosaiq.plans import graph_queries as graph
from mosaiq.plans import retrieval_queries as retrieval
from mosaiq.plans import views as v
from mosaiq.runtime import latest, materialise, table
from mosaiq.streaming import sessions

D = tx.DUCK
TIERS = {"large": "strong", "small": "fast"}
MIN_SCORE = 12.0
SCOPE = rules.parse_rules(["src/", "lib/", "/core/**", "pkg/**", "!**/generated/**"])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def flow_steps(spark: SparkSession, d: str) -> DataFrame:
    return kn.flow_steps(_documents(spark, d))


def symbol_notes(spark: SparkSession, d: str) -> DataFrame:
    return kn.symbol_notes(kn.card_sentences(_documents(spark, d)), v.stored_symbols(spark, d))


def fact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of cards of the files among the 60 best hits of each stated question that share a term with it."""
    return kn.facts_for(v.questions(spark, d), v.found(spark, d, 60), v.stored_files(spark, d), kn.card_sentences(_documents(spark, d)))


def orienting_texts(spark: SparkSession, d: str) -> DataFrame:
    return kn.orienting_texts(_documents(spark, d), ["guide", "changelog"])


def question_windows(spark: SparkSession, d: str) -> DataFrame:
    return kn.question_windows(v.stored_files(spark, d))


def alias_write_back(spark: SparkSession, d: str) -> DataFrame:
    """The aliases of symbols, where a model answers with the parts of their names."""
    jobs = kn.alias_jobs(v.stored_symbols(spark, d))
    answers = jobs.select("batch", "key", F.expr(f"transform({tx.split_identifier('name')}, x -> lower(x))").alias("aliases"))
    return kn.alias_write_back(jobs, answers).select("file_id", "i", F.array_join("aka", " ").alias("aka"))


def core_sections(spark: SparkSession, d: str) -> DataFrame:
    texts = _documents(spark, d).where("kind IN ('guide', 'module_card')").select(F.col("doc_id").alias("key"), "text")
    return kn.compact_core(texts, 120, ()).select("key", "ord", "head", F.length("text").alias("length"))


def valid_qa(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that have both a question and an answer."""
    return v.stored_qa(spark, d).where("trim(q) <> '' AND trim(a) <> ''").select("qa_id")


def core_refresh(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "files")
    new, old = incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, corpus.CUTOFF)
    described = _documents(spark, d).where("kind = 'guide'").select(F.lower(F.trim("source")).alias("repo"))
    return incremental.refreshed(new, incremental.dirty_modules(incremental.changed(new, old), new, old), described)


def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, shown): the path of each file of the old snapshot, marked where it has changed since."""
    raw = table(spark, d, "files")
    gone = incremental.stale(incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, corpus.CUTOFF))
    shown = F.concat("path", F.when(F.col("stale"), " (changed since)").otherwise(""))
    return gone.join(v.stored_files(spark, d).where("path IS NOT NULL").select("file_id", "path"), "file_id").select("file_id", shown.alias("shown"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, rel): paths as a tool gives them, from the folder of the file, as the corpus spells them."""
    given = F.concat("folder", F.lit("/../"), F.expr(tx.basename("folder")), F.lit("/./"), F.expr(tx.basename("path")))
    return v.stored_files(spark, d).where("path IS NOT NULL AND folder <> ''").select("file_id", imports.folded_path(given).alias("rel"))


def model_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("model")), F.lit("medium"))
    return table(spark, d, "bench_results").where("result_id IS NOT NULL").select("result_id", tier.alias("tier")).distinct()


def _runs(spark: SparkSession, d: str) -> DataFrame:
    keep = ["repo", "model", "arm", "k", "is_error", "cost", "tokens"]
    return latest(table(spark, d, "bench_results"), "result_id", [F.col("loaded_at"), F.col("run_at")], keep)


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """(model, calls, errors, cost, input, output, tokens): what the calls of each model used; ``tokens`` are all four classes."""
    whole = sum((F.coalesce(f"tokens.{c}", F.lit(0)) for c in ("input", "cache_write", "cache_read", "output")), F.lit(0))
    return _runs(spark, d).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.round(F.sum(F.when(F.col("cost") > 0, F.col("cost"))), 6).alias("cost"), F.sum("tokens.input").alias("input"),
        F.sum("tokens.output").alias("output"), F.sum(whole).alias("tokens"),
    )


def reader_usage(spark: SparkSession, d: str) -> DataFrame:
    """(repo, model, runs, tokens): what small readers used in the sessions of eight questions in which hooks ran too."""
    rows = _runs(spark, d).where("repo IS NOT NULL AND model IS NOT NULL AND k IS NOT NULL").withColumn("session", F.expr("CAST(k div 8 AS BIGINT)"))
    wanted = rows.where("arm = 'hooks'").select("repo", "session").distinct()
    readers = rows.where("arm = 'reader-small'").join(wanted, ["repo", "session"], "left_semi")
    return readers.groupBy("repo", "model").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens.total").alias("tokens"))


def arm_ratios(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.arm_ratios(evaluation.paired_arm_report(spark, d), ["repo"])


def search_min_score(spark: SparkSession, d: str) -> DataFrame:
    return v.found(spark, d, 10, min_score=MIN_SCORE).select("qid", "uid", "score", "rank")


def search_unsent(spark: SparkSession, d: str) -> DataFrame:
    """(qid, uid, n): the ten best hits of each stated question that no earlier question on its repository had among its three best; a repository is a session here."""
    asked = v.stored_qa(spark, d).where("qa_id % 100 = 0 AND repo IS NOT NULL").select(F.col("qa_id").alias("qid"), F.col("repo").alias("session"))
    hits = materialise(v.found(spark, d, 30).join(asked, "qid"))
    first = hits.where("rank <= 3").groupBy("session", "uid").agg(F.min("qid").alias("first"))
    sent = hits.join(first, ["session", "uid"]).where("first < qid").select("qid", "uid")
    rows = packs.unsent(hits, sent, answers_only=False)
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("bigint")
    return rows.withColumn("n", n).where("n <= 10").select("qid", "uid", "n")


def pack_selected(spark: SparkSession, d: str) -> DataFrame:
    """The first candidates of each stated question, as a reader would choose them, within 120 tokens."""
    ids = retrieval.candidates(spark, d).where("pos <= 12").select("qid", F.col("pos").alias("ord"), F.col("cid").alias("uid"))
    return packs.selected(ids, v.stored_symbols(spark, d), v.stored_qa(spark, d), v.stored_files(spark, d), 120).select("qid", "ord", "key", "tokens")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(qid, answer): what a model (here the stub) says to each stated question with its link pack before it."""
    parts = retrieval.link_pack(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "unit", "text"))).alias("ps"))
    prompt = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\n\n"), F.coalesce(F.array_join("ps.text", "\n\n"), F.lit("")))
    jobs = v.questions(spark, d).join(parts, "qid", "left").select(F.col("qid").alias("key"), prompt.alias("prompt"))
    return enrich.complete(jobs).select(F.col("key").alias("qid"), "answer")


def pack_recall(spark: SparkSession, d: str) -> DataFrame:
    """(key, kind, wanted, found, recall): of the files and names each stated question's answer mentions, the share that its full pack shows."""
    asked = v.questions(spark, d).select(F.col("qid").alias("key"))
    told = v.stored_qa(spark, d).where("repo IS NOT NULL").select(F.col("qa_id").alias("key"), "repo", F.col("a").alias("text")).join(asked, "key", "left_semi")
    files = evaluate.mentioned_files(told, v.stored_files(spark, d)).select("key", F.lit("file").alias("kind"), F.col("path").alias("item"))
    names = evaluate.mentioned_names(told, v.stored_symbols(spark, d)).select("key", F.lit("name").alias("kind"), F.col("part").alias("item"))
    return evaluate.pack_recall(files.unionByName(names), retrieval.full_pack(spark, d).select(F.col("qid").alias("key"), "text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Requests as lines of text, of which those of errors are broken."""
    line = F.expr("CASE WHEN event_type = 'error' THEN concat('{\"id\": ', event_id) ELSE concat('{\"id\": ', event_id, ', \"method\": \"', event_type, '\", \"params\": ', props, '}') END")
    return table(spark, d, "events").where("props IS NOT NULL").select(line.alias("value"))


def rpc_requests(spark: SparkSession, d: str) -> DataFrame:
    return sessions.requests(_lines(spark, d)).select("id", "method", "params")


def event_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return sessions.dispatched(sessions.requests(_lines(spark, d)), {"view": "read", "click": "grep", "purchase": "prompt", "signup": "session-start"})


def last_events(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, last_id, kinds): the last purchase of each user and how many kinds of events there were."""
    last = F.max_by(F.when(F.col("event_type") == "purchase", F.col("event_id")), F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("last_id"), F.count_distinct("event_type").alias("kinds"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("kind = 'source_file'").select(F.col("doc_id").alias("file_id"), F.col("file_lang").alias("lang"), "text")


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of all source texts."""
    return extract.symbols_of(_sources(spark, d))


def extract_declarations(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, line, name): where the declarations of the languages begin whose heads need no context; names without their containers."""
    rows = extract.symbols_of(_sources(spark, d).where("lang IN ('go', 'shell', 'lua', 'sql')"))
    return rows.select("file_id", F.col("start_line").alias("line"), F.expr(tx.tail("name")).alias("name"))


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    """The raw imports of all source texts but those in Python, which its own grammar reads."""
    return extract.imports_of(_sources(spark, d).where("lang <> 'python'"))


def extract_python(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, imp): the raw imports of Python texts."""
    return extract.imports_of(_sources(spark, d).where("lang = 'python'"))


def index_all_units(spark: SparkSession, d: str) -> DataFrame:
    """(utype, units, len, postings) of an index that also holds flows, the cards of files and the notes of symbols."""
    docs, files, symbols = _documents(spark, d), v.stored_files(spark, d), v.stored_symbols(spark, d)
    sentences = kn.card_sentences(docs)
    cards = sentences.groupBy("repo", "path").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(doc_id, pos, sentence))), x -> x.sentence)"), " ").alias("text"))
    cards = files.where("path IS NOT NULL").select(F.concat(F.lit("file:"), "file_id").alias("uid"), F.lower("repo").alias("repo"), "path").join(cards, ["repo", "path"]).select("uid", "text")
    notes = kn.symbol_notes(sentences, symbols).select(F.concat(F.lit("sym:"), "file_id", F.lit(":"), "i").alias("uid"), F.col("note").alias("text"))
    units = search.units(files, symbols, v.stored_qa(spark, d)).unionByName(search.flow_units(kn.flow_steps(docs)))
    rows = search.postings(search.with_texts(units, cards.unionByName(notes))).groupBy("utype", "uid").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("terms"))
    return rows.groupBy("utype").agg(F.count(F.lit(1)).alias("units"), F.sum("len").alias("len"), F.sum("terms").alias("postings"))


def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """(want, n, file_id, i, exact, note): the first ten symbols of every name that answers cite, full matches first, with the note a card has on them. Registrations match by any word of theirs."""
    refs = v.stored_qa(spark, d).select(F.explode("refs").alias("ref")).where("ref LIKE '%::%'").select(F.regexp_extract("ref", r"::(.+)$", 1).alias("name")).distinct()
    symbols = v.stored_symbols(spark, d)
    words = F.explode(F.expr(r"array_distinct(regexp_extract_all(name, r'\w+', 0))"))
    registered = symbols.where("kind = 'registration'").select("file_id", "i", "path", "start_line", "end_line", "kind", words.alias("name"))
    pool = symbols.where("kind <> 'registration' OR kind IS NULL").select("file_id", "i", "path", "start_line", "end_line", "kind", "name").unionByName(registered)
    found = sessions.definitions(refs.select(F.lit(0).alias("event_id"), F.lit(0).alias("pos"), "name"), pool, most=10)
    notes = kn.symbol_notes(kn.card_sentences(_documents(spark, d)), symbols)
    return found.join(notes, ["file_id", "i"], "left").select(F.col("name").alias("want"), "n", "file_id", "i", "exact", F.coalesce("note", F.lit("")).alias("note"))


def corpus_scan_rules(spark: SparkSession, d: str) -> DataFrame:
    """The files that a scan keeps with rules of its own, which overrule the built-in ones, a scope of folders, and a file type of its own."""
    return rules.scan_filter(v.stored_files(spark, d), corpus.RULES, SCOPE, {".h": "cpp"}).select("file_id", "language")


def _card_files(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("kind = 'card' AND path IS NOT NULL").select(F.lower(F.trim("source")).alias("repo"), F.expr(tx.normal_path("path")).alias("path")).distinct()
    files = v.stored_files(spark, d).where("path IS NOT NULL").select("file_id", F.lower("repo").alias("repo"), "path")
    return files.join(docs, ["repo", "path"]).select("file_id").distinct()


def card_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, state): cards after an update: those of unchanged files are kept, those of changed and added ones written anew, those of deleted ones gone."""
    raw = table(spark, d, "files")
    changes = incremental.changed(incremental.snapshot(raw, "2999-01-01"), incremental.snapshot(raw, corpus.CUTOFF))
    fresh = changes.where("status <> 'deleted'").select("file_id", F.lit("new").alias("state"))
    kept = _card_files(spark, d).join(changes.where("status = 'deleted'"), "file_id", "left_anti").select("file_id", F.lit("kept").alias("state"))
    return incremental.upsert(kept, fresh, ["file_id"])


def card_merge(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, purpose, summary, facts): the cards of long files, put together from the answers on their parts."""
    from mosaiq.operators import modules

    parts = modules.chunk_cuts(v.stored_files(spark, d), v.stored_symbols(spark, d))
    jobs = parts.select(F.concat_ws("-", "file_id", "part").alias("key"), "file_id", "part")
    told = F.concat(F.lit('sure: {"purpose": "p'), "part", F.lit('", "summary": "lines '), "start_line", F.lit(" to "), "end_line", F.lit('", "facts": ["f'), "part", F.lit('",]}'))
    cards = enrich.cards(parts.select(F.concat_ws("-", "file_id", "part").alias("key"), told.alias("answer")), jobs)
    return cards.select("file_id", "purpose", "summary", F.array_join("facts", " ").alias("facts"))


def memoised_answers(spark: SparkSession, d: str) -> DataFrame:
    """(key, answer): a prompt for each module, where answers on repositories before ``m`` are known and only the others are asked for."""
    calls = v.stored_files(spark, d).where("module IS NOT NULL AND repo IS NOT NULL").select(F.concat_ws("/", "repo", "module").alias("key"), "repo", F.concat(F.lit("Describe "), "module").alias("prompt")).distinct()
    cache = calls.where("repo < 'm'").select("key", F.lit("known").alias("answer"))
    return incremental.memoised(calls.select("key", "prompt"), cache, enrich.complete)[0].select("key", "answer")


def proxy_judge(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id, p): the probabilities that a reader's list of the first ten candidates stands for."""
    lists = retrieval.candidates(spark, d).where("pos <= 10").groupBy("qid").agg(F.expr("transform(array_sort(collect_list(struct(pos, cid))), x -> x.cid)").alias("ids"))
    return evaluate.proxy_probabilities(lists).select("qid", "id", F.round("p", 6).alias("p"))


def session_keys(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", sessions.session_key("source").alias("key"))


#: A small tree in which every rule of import resolution gives edges: ``{n}`` runs from 0 to 9.
TREE = (
    ("py{n}/pkg/a.py", "python", (".util", "py{n}.pkg.util.name", "pkg{n}.deep.mod.x")), ("py{n}/pkg/util.py", "python", ("..pkg.a",)), ("src{n}/pkg{n}/deep/mod.py", "python", ()),
    ("web{n}/x.ts", "typescript", ("./y", "../web{n}/lib", "@/app{n}/z")), ("web{n}/y.js", "javascript", ("./x.ts",)), ("web{n}/lib/index.ts", "typescript", ()), ("src/app{n}/z.ts", "typescript", ()),
    ("c{n}/src/f.cpp", "cpp", ("f.h", "mesh{n}/m.h")), ("c{n}/src/f.h", "cpp", ()), ("c{n}/inc/mesh{n}/m.h", "c", ("../../src/f.h",)),
    ("go{n}/cmd/main.go", "go", ("example.com/p/go{n}/store",)), ("go{n}/store/a.go", "go", ()), ("go{n}/store/b.go", "go", ()),
    ("src/r{n}.rs", "rust", ("crate::deep{n}::inner::T", "m{n}")), ("src/deep{n}/inner.rs", "rust", ()), ("src/m{n}.rs", "rust", ()),
    ("j{n}/com/acme{n}/App.java", "java", ("com.acme{n}.Tool",)), ("j{n}/com/acme{n}/Tool.java", "java", ()), ("k{n}/com/kt{n}/Use.kt", "kotlin", ("com.acme{n}.Tool",)),
    ("rb{n}/main.rb", "ruby", ("helper", "util{n}")), ("rb{n}/helper.rb", "ruby", ()), ("lib/util{n}.rb", "ruby", ()), ("notes{n}.zzz{n}", None, ()), ("data.qqq", None, ()),
)
NESTED = (("module", "M{n}", 1, 90), ("class", "C{n}", 2, 50), ("method", "run", 3, 9), ("function", "free", 60, 70), ("function", "out", 95, 99), ("class", "D{n}", 61, 69), ("method", "last", 62, 62), ("method", "C{n}.own", 10, 12))


def _tree() -> list[tuple]:
    rows = [(p.format(n=n), lang, [x.format(n=n) for x in imps]) for n in range(10) for p, lang, imps in TREE]
    return [(i, p, lang, imps) for i, (p, (lang, imps)) in enumerate(sorted({p: (lang, imps) for p, lang, imps in rows}.items()))]


def import_rules(spark: SparkSession, d: str) -> DataFrame:
    """(lang, src, dst): the edges of a small tree that has imports in every language."""
    rows = [(i, "r", p, lang, imps) for i, p, lang, imps in _tree()]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, lang string, imports array<string>")
    path = files.select("file_id", "path", "lang")
    edges = imports.import_edges(files).join(path.select(F.col("file_id").alias("src"), "lang", F.col("path").alias("a")), "src")
    return edges.join(path.select(F.col("file_id").alias("dst"), F.col("path").alias("b")), "dst").select("lang", F.col("a").alias("src"), F.col("b").alias("dst"))


def unknown_extension_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.unknown_extensions(spark.createDataFrame([(p,) for _, p, _, _ in _tree()], "path string"), least=1)


def nested_members(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, i, qualified): members of a few nested containers."""
    rows = [(n, i, kind, name.format(n=n), a, b) for n in range(10) for i, (kind, name, a, b) in enumerate(NESTED)]
    return links.enclosing(spark.createDataFrame(rows, "file_id long, i int, kind string, name string, start_line int, end_line int"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_steps, symbol_notes, fact_overlap, orienting_texts, question_windows, alias_write_back, core_sections, valid_qa, core_refresh, stale_marks, relative_paths, model_tiers, usage_totals,
        reader_usage, arm_ratios, search_min_score, search_unsent, pack_selected, answers, pack_recall, rpc_requests, event_dispatch, last_events, extract_symbols, extract_declarations, extract_imports,
        extract_python, import_rules, unknown_extension_rules, nested_members, index_all_units, symbol_lookup, corpus_scan_rules, card_carry_over, card_merge, memoised_answers, proxy_judge, session_keys,
    )
}


def _quote(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_TREE_SQL = "files AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, 'r', {_quote(p)}, {_quote(lang)}, [{', '.join(map(_quote, imps))}]::VARCHAR[])" for i, p, lang, imps in _tree()
) + ") t(file_id, repo, path, lang, imports))"
_TREE_NOW = "files_now AS (SELECT * FROM files)"
_NESTED_SQL = "nested AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {i}, '{kind}', '{name.format(n=n)}', {a}, {b})" for n in range(10) for i, (kind, name, a, b) in enumerate(NESTED)) + ") t(file_id, i, kind, name, a, b))"
_BASE = (v.F_SQL, v.S_SQL, v.Q_SQL, search.UNITS_SQL, search.POSTINGS_SQL, v.QUESTIONS_SQL)
_CARDS = f"""card_lines AS (SELECT doc_id, lower(trim(source)) AS repo, {tx.normal_path('path', D)} AS path, string_split(regexp_replace(text, '^[^\\n]*\\n?', ''), '. ') AS ss FROM documents WHERE kind = 'card' AND path IS NOT NULL AND text IS NOT NULL),
sentences AS (SELECT * FROM (SELECT doc_id, repo, path, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM card_lines) WHERE sentence <> '')"""
_RUNS = """runs AS (SELECT result_id, repo, model, arm, k, is_error, cost, tokens FROM bench_results WHERE result_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, run_at DESC NULLS LAST, repo DESC NULLS LAST, model DESC NULLS LAST, arm DESC NULLS LAST, k DESC NULLS LAST, is_error DESC NULLS LAST, cost DESC NULLS LAST) = 1)"""
_LINES = "lines AS (SELECT CASE WHEN event_type = 'error' THEN concat('{\"id\": ', event_id) ELSE concat('{\"id\": ', event_id, ', \"method\": \"', event_type, '\", \"params\": ', props, '}') END AS value FROM events WHERE props IS NOT NULL)"
_SRC = "src AS (SELECT doc_id AS file_id, file_lang AS lang, text FROM documents WHERE kind = 'source_file' AND text IS NOT NULL AND file_lang IS NOT NULL)"
_IMPORTS_SQL = " UNION ALL ".join(
    f"SELECT file_id, unnest(regexp_extract_all(text, {tx.literal('(?m)' + p, D)}, 1)) AS imp FROM src WHERE lang = '{lang}'" for lang, ps in extract.IMPORTS.items() if lang != "python" for p in ps
)
_FLOWS = f"""SELECT doc_id, name, TRY_CAST(regexp_extract(l, '{kn.STEP}', 1) AS INT) AS step, regexp_extract(l, '{kn.STEP}', 2) AS ref, regexp_extract(l, '{kn.STEP}', 3) AS note FROM (
  SELECT doc_id, ls[1] AS name, unnest(ls) AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE kind = 'flow' AND text IS NOT NULL)) WHERE regexp_matches(l, '{kn.STEP}')"""
SQL = {
    "flow_steps": _FLOWS,
    "symbol_notes": v.with_(v.S_SQL, _CARDS) + f""", named AS (SELECT repo, path, doc_id, pos, sentence, unnest(list_distinct(regexp_extract_all(sentence, '{kn.QUOTED_NAME}', 1))) AS last FROM sentences),
first_notes AS (SELECT repo, path, last, arg_min(sentence, {{'d': doc_id, 'p': pos}}) AS note FROM named GROUP BY ALL)
SELECT s.file_id, s.i, coalesce(f.note, '') AS note FROM symbols_one s LEFT JOIN first_notes f ON f.repo = lower(s.repo) AND f.path = s.path AND f.last = {tx.last_part('s.name', D)} WHERE s.name IS NOT NULL""",
    "fact_overlap": v.with_(*_BASE, search.search_sql(60), _CARDS) + f"""SELECT qid, file_id, n, sentence FROM (
  SELECT h.qid, h.file_id, s.sentence, row_number() OVER (PARTITION BY h.qid, h.file_id ORDER BY s.doc_id, s.pos) AS n FROM (SELECT qid, CAST(substr(uid, 6) AS BIGINT) AS file_id FROM hits WHERE utype = 'file') h
  JOIN files_now f ON f.file_id = h.file_id JOIN sentences s ON s.repo = lower(f.repo) AND s.path = f.path JOIN questions q ON q.qid = h.qid WHERE list_has_any({tx.tokens('q.text', D)}, {tx.tokens('s.sentence', D)})) WHERE n <= 4""",
    "orienting_texts": """SELECT repo, doc_id, chars FROM (SELECT repo, doc_id, chars, coalesce(sum(chars) OVER (PARTITION BY repo ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT lower(trim(source)) AS repo, doc_id, CAST(least(length(text), 12000) AS BIGINT) AS chars FROM documents WHERE kind IN ('guide', 'changelog') AND source IS NOT NULL AND text <> '')) WHERE before <= 40000""",
    "question_windows": v.with_(v.F_SQL, f"""own AS (SELECT repo, module, file_id, path, lines, coalesce(bytes, 0) AS bytes FROM files_now WHERE module IS NOT NULL AND path IS NOT NULL AND lines >= 1 AND NOT coalesce(is_test, false) AND (coalesce(is_code, false) OR lang IN ('markdown', 'rst'))),
ranks AS (SELECT *, row_number() OVER (PARTITION BY repo, module ORDER BY path, file_id) AS rn FROM own WHERE bytes <= {kn.WINDOW_CHARS}),
bins AS (SELECT repo, module, rn, lines, bytes AS used, 0 AS bin FROM ranks WHERE rn = 1
  UNION ALL SELECT r.repo, r.module, r.rn, r.lines, CASE WHEN b.used + r.bytes > {kn.WINDOW_CHARS} THEN r.bytes ELSE b.used + r.bytes END, b.bin + CAST(b.used + r.bytes > {kn.WINDOW_CHARS} AS INT)
  FROM bins b JOIN ranks r ON r.repo IS NOT DISTINCT FROM b.repo AND r.module = b.module AND r.rn = b.rn + 1),
parts AS (SELECT repo, module, concat('b', bin) AS part, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM bins GROUP BY ALL
  UNION ALL SELECT repo, module, concat('h', file_id, '-', k), 1, least(step, lines - k * step) FROM (SELECT *, unnest(range(0, (lines - 1) // step + 1)) AS k FROM (
    SELECT *, greatest(1, {kn.WINDOW_CHARS} // greatest(1, bytes // lines)) AS step FROM own WHERE bytes > {kn.WINDOW_CHARS})))""") + "SELECT repo, module, part, files, lines, CAST(greatest(6, least(40, round_even(lines / 1000 * 14, 0))) AS INT) AS questions FROM parts",
    "alias_write_back": v.with_(v.S_SQL) + f"SELECT file_id, i, array_to_string(list_transform({tx.split_identifier('name', D)}[:4], lambda x: substr({tx.lower('x', D)}, 1, 160)), ' ') AS aka FROM symbols_one WHERE name IS NOT NULL",
    "core_sections": v.with_("texts AS (SELECT doc_id AS key, text FROM documents WHERE kind IN ('guide', 'module_card') AND text IS NOT NULL)", """blocks AS (SELECT key, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS pos FROM (SELECT key, string_split(chr(10) || text, chr(10) || '## ') AS bs FROM texts)),
heads AS (SELECT key, pos, trim(string_split(block, chr(10))[1], ' ' || chr(10) || chr(9) || chr(13)) AS head, trim(regexp_replace(block, '^[^\\n]*', ''), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM blocks WHERE trim(block, ' ' || chr(10) || chr(9) || chr(13)) <> ''),
lasts AS (SELECT key, max(pos) AS pos, head, arg_max(body, pos) AS body FROM heads GROUP BY key, head), secs AS (SELECT key AS qid, pos + 1 AS ord, head AS key, concat('## ', head, chr(10), body) AS text FROM lasts)""",
        f"items AS (SELECT qid, ord, key, {tx.estimated_tokens('text', D)} AS tokens FROM secs)", packs.greedy_sql("items", 120)) + """SELECT s.qid AS key, CAST(s.ord AS BIGINT) AS ord, s.key AS head, CAST(length(s.text) AS INT) AS length FROM secs s JOIN taken t ON t.qid = s.qid AND t.ord = s.ord AND t.key = s.key
UNION ALL SELECT key, -1, '', CAST(length(substr(text, 1, 480)) AS INT) FROM texts WHERE text <> '' AND key NOT IN (SELECT qid FROM taken)""",
    "valid_qa": v.with_(v.Q_SQL) + "SELECT qa_id FROM qa_now WHERE trim(q) <> '' AND trim(a) <> ''",
    "core_refresh": v.with_(corpus._SNAPSHOTS) + """SELECT repo, repo IN (SELECT repo FROM dirty WHERE repo IS NOT NULL) OR repo NOT IN (SELECT lower(trim(source)) FROM documents WHERE kind = 'guide' AND source IS NOT NULL) AS refresh FROM (SELECT DISTINCT repo FROM new WHERE repo IS NOT NULL)""",
    "stale_marks": v.with_(v.F_SQL, corpus._SNAPSHOTS) + """SELECT f.file_id, concat(f.path, CASE WHEN n.bytes IS NOT DISTINCT FROM o.bytes AND n.mtime IS NOT DISTINCT FROM o.mtime THEN '' WHEN n.sha IS DISTINCT FROM o.sha THEN ' (changed since)' ELSE '' END) AS shown
  FROM old o JOIN files_now f ON f.file_id = o.file_id AND f.path IS NOT NULL LEFT JOIN new n ON n.file_id = o.file_id""",
    "relative_paths": v.with_(v.F_SQL) + "SELECT file_id, path AS rel FROM files_now WHERE path IS NOT NULL AND folder <> ''",
    "model_tiers": "SELECT DISTINCT result_id, CASE model WHEN 'large' THEN 'strong' WHEN 'small' THEN 'fast' ELSE 'medium' END AS tier FROM bench_results WHERE result_id IS NOT NULL",
    "usage_totals": v.with_(_RUNS) + """SELECT model, count(*) AS calls, CAST(count(*) FILTER (is_error) AS BIGINT) AS errors, round(sum(cost) FILTER (cost > 0), 6) AS cost, CAST(sum(tokens.input) AS BIGINT) AS input, CAST(sum(tokens.output) AS BIGINT) AS output,
  CAST(sum(coalesce(tokens.input, 0) + coalesce(tokens.cache_write, 0) + coalesce(tokens.cache_read, 0) + coalesce(tokens.output, 0)) AS BIGINT) AS tokens FROM runs GROUP BY model""",
    "reader_usage": v.with_(_RUNS) + """SELECT repo, model, count(*) AS runs, CAST(sum(tokens.total) AS BIGINT) AS tokens FROM runs r WHERE arm = 'reader-small' AND k IS NOT NULL AND model IS NOT NULL
  AND EXISTS (SELECT 1 FROM runs h WHERE h.arm = 'hooks' AND h.repo = r.repo AND h.model IS NOT NULL AND h.k // 8 = r.k // 8) GROUP BY repo, model""",
    "arm_ratios": v.with_(evaluation._GRADED, evaluation._PAIRED) + """SELECT r.repo, r.arm, round(CASE WHEN b.mean_cost > 0 THEN r.mean_cost / b.mean_cost END, 6) AS cost_ratio, round(CASE WHEN b.mean_tokens > 0 THEN r.mean_tokens / b.mean_tokens END, 6) AS token_ratio,
  round(r.mean_total - b.mean_total, 6) AS score_gain, round(CASE WHEN b.mean_cost - r.mean_cost > 0 THEN r.mean_cost / (b.mean_cost - r.mean_cost) END, 6) AS pay_back FROM report r JOIN report b ON b.repo = r.repo AND b.arm = 'baseline'""",
    "search_min_score": v.with_(*_BASE, search.search_sql(10)) + f"SELECT qid, uid, score, rank FROM hits QUALIFY max(score) OVER (PARTITION BY qid) >= {MIN_SCORE}",
    "search_unsent": v.with_(*_BASE, search.search_sql(30)) + """, owned AS (SELECT h.*, q.repo FROM hits h JOIN qa_now q ON q.qa_id = h.qid AND q.repo IS NOT NULL)
SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM owned a WHERE NOT EXISTS (SELECT 1 FROM owned b WHERE b.repo = a.repo AND b.uid = a.uid AND b.rank <= 3 AND b.qid < a.qid) QUALIFY n <= 10""",
    "pack_selected": v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, f"cand AS ({retrieval.SQL['candidates']})", f"""units AS (SELECT concat('qa:', qa_id) AS uid, concat('Q: ', coalesce(q, ''), chr(10), 'A: ', coalesce(a, '')) AS text FROM qa_now
  UNION ALL SELECT concat('file:', file_id), concat('FILE ', coalesce(path, ''), ' (', lines, ' lines)') FROM files_now
  UNION ALL SELECT concat('sym:', file_id, ':', i), concat(coalesce(path, ''), ':', coalesce({tx.span('start_line', 'end_line')}, ''), ' ', coalesce(name, '')) FROM symbols_one),
items AS (SELECT c.qid, c.pos AS ord, c.cid AS key, CAST({tx.estimated_tokens('u.text', D)} AS BIGINT) AS tokens FROM cand c JOIN units u ON u.uid = c.cid WHERE c.pos <= 12)""", packs.greedy_sql("items", 120)) + "SELECT qid, ord, key, tokens FROM taken",
    "answers": v.with_(v.Q_SQL, v.QUESTIONS_SQL, f"packed AS ({retrieval.SQL['link_pack']})", "joined AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY ord, unit) AS pack FROM packed GROUP BY qid)") + """SELECT q.qid,
  concat('stub ', substr(sha256(concat('Question: ', coalesce(q.text, ''), chr(10), chr(10), coalesce(j.pack, ''))), 1, 12)) AS answer FROM questions q LEFT JOIN joined j USING (qid)""",
    "pack_recall": v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, f"packed AS ({retrieval.SQL['full_pack']})", """told AS (SELECT qa_id AS key, repo, a FROM qa_now WHERE repo IS NOT NULL AND qa_id % 100 = 0),
wanted AS (SELECT DISTINCT t.key, 'file' AS kind, f.path AS item FROM (SELECT key, repo, unnest(regexp_extract_all(coalesce(a, ''), '[A-Za-z0-9_./-]+\\.[A-Za-z0-9]+')) AS path FROM told) t JOIN files_now f ON f.repo = t.repo AND f.path = t.path
  UNION SELECT DISTINCT t.key, 'name', t.part FROM (SELECT key, repo, unnest(regexp_extract_all(span, '[A-Za-z_][A-Za-z0-9_]{3,}')) AS part FROM (SELECT key, repo, unnest(regexp_extract_all(coalesce(a, ''), '`([^`]+)`', 1)) AS span FROM told)) t
    JOIN (SELECT DISTINCT repo, part FROM (SELECT repo, unnest(string_split(name, '.')) AS part FROM symbols_one WHERE kind <> 'section' OR kind IS NULL) WHERE length(part) > 3) k ON k.repo = t.repo AND k.part = t.part)""") + """SELECT key, kind, count(*) AS wanted,
  count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM (SELECT w.*, EXISTS (SELECT 1 FROM packed p WHERE p.qid = w.key AND contains(p.text, w.item)) AS hit FROM wanted w) GROUP BY key, kind""",
    "rpc_requests": v.with_(_LINES) + "SELECT CAST(json_extract_string(value, '$.id') AS BIGINT) AS id, json_extract_string(value, '$.method') AS method, json_extract_string(value, '$.params.k') AS params FROM lines WHERE json_valid(value)",
    "event_dispatch": v.with_(_LINES) + """SELECT id, to_json({'id': id, 'handler': handler, 'unit': unit}) AS line FROM (SELECT CAST(json_extract_string(value, '$.id') AS BIGINT) AS id,
  CASE json_extract_string(value, '$.method') WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'prompt' WHEN 'signup' THEN 'session-start' END AS handler, json_extract_string(value, '$.params.k') AS unit FROM lines WHERE json_valid(value)) WHERE handler IS NOT NULL""",
    "last_events": "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) FILTER (event_type = 'purchase') AS last_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "extract_declarations": v.with_(_SRC, """ls AS (SELECT file_id, lang, unnest(l) AS l, generate_subscripts(l, 1) AS line FROM (SELECT file_id, lang, string_split(text, chr(10)) AS l FROM src WHERE lang IN ('go', 'shell', 'lua', 'sql'))),
found AS (SELECT file_id, line, coalesce(CASE lang
    WHEN 'go' THEN coalesce(nullif(regexp_extract(l, '^func~+\\(~*#+~*\\*?~*#+~*\\)~*(@#*)', 1), ''), nullif(regexp_extract(l, '^func~+(@#*)', 1), ''), regexp_extract(l, '^type~+(@#*)~+(?:struct|interface)', 1))
    WHEN 'shell' THEN regexp_extract(l, '^~*(?:function~+)?(@(?:#|-)*)~*\\(~*\\)~*\\{', 1) WHEN 'lua' THEN regexp_extract(l, '^~*(?:local~+)?function~+(@(?:#|[.:])*)', 1)
    WHEN 'sql' THEN regexp_extract(l, '(?i)^~*create~+(?:or~+replace~+)?(?:table|view|function|procedure|index)~+(?:if~+not~+exists~+)?(@(?:#|[.])*)', 1) END, '') AS name FROM ls WHERE length(l) <= 300)""".replace("~", "[\\s\\p{Z}]").replace("#", "[\\p{L}\\p{N}_$]").replace("@", "[\\p{L}_$]"))
  + f"SELECT file_id, CAST(line AS INT) AS line, {tx.tail('name', D)} AS name FROM found WHERE name <> ''",
    "extract_imports": v.with_(_SRC, f"raw AS ({_IMPORTS_SQL} UNION ALL SELECT file_id, unnest(regexp_extract_all(block, '\"([\\w./-]+)\"', 1)) FROM (SELECT file_id, unnest(regexp_extract_all(text, '(?ms)^import\\s*\\((.*?)^\\)', 1)) AS block FROM src WHERE lang = 'go'))") + "SELECT DISTINCT file_id, imp FROM raw",
    "index_all_units": v.with_(v.F_SQL, v.S_SQL, v.Q_SQL, search.UNITS_SQL.replace("units AS (", "plain AS (", 1), _CARDS, f"""steps AS ({_FLOWS}),
flows AS (SELECT concat('flow:', doc_id) AS uid, 'flow' AS utype, [{{'text': coalesce(max(name), ''), 'tenths': 20}}, {{'text': coalesce(string_agg(concat(ref, ' ', note), ' ' ORDER BY step, ref, note), ''), 'tenths': 10}}] AS fields FROM steps GROUP BY doc_id),
named AS (SELECT repo, path, doc_id, pos, sentence, unnest(list_distinct(regexp_extract_all(sentence, '{kn.QUOTED_NAME}', 1))) AS last FROM sentences),
more AS (SELECT concat('file:', f.file_id) AS uid, c.text FROM files_now f JOIN (SELECT repo, path, string_agg(sentence, ' ' ORDER BY doc_id, pos, sentence) AS text FROM sentences GROUP BY ALL) c ON c.repo = lower(f.repo) AND c.path = f.path
  UNION ALL SELECT concat('sym:', s.file_id, ':', s.i), n.text FROM symbols_one s JOIN (SELECT repo, path, last, arg_min(sentence, {{'d': doc_id, 'p': pos}}) AS text FROM named GROUP BY ALL) n ON n.repo = lower(s.repo) AND n.path = s.path AND n.last = {tx.last_part('s.name', D)}),
units AS (SELECT u.uid, u.utype, CASE WHEN m.text IS NULL THEN u.fields ELSE list_append(u.fields, {{'text': m.text, 'tenths': 10}}) END AS fields FROM (SELECT * FROM plain UNION ALL SELECT * FROM flows) u LEFT JOIN more m ON m.uid = u.uid AND m.text <> '')""", search.POSTINGS_SQL)
  + "SELECT utype, count(*) AS units, CAST(sum(len) AS BIGINT) AS len, CAST(sum(terms) AS BIGINT) AS postings FROM (SELECT utype, uid, max(len) AS len, count(*) AS terms FROM postings GROUP BY ALL) GROUP BY utype",
    "symbol_lookup": v.with_(v.S_SQL, v.Q_SQL, _CARDS, f"""quoted AS (SELECT repo, path, doc_id, pos, sentence, unnest(list_distinct(regexp_extract_all(sentence, '{kn.QUOTED_NAME}', 1))) AS last FROM sentences),
notes AS (SELECT repo, path, last, arg_min(sentence, {{'d': doc_id, 'p': pos}}) AS note FROM quoted GROUP BY ALL),
wanted AS (SELECT name, rtrim(name, '.') AS want FROM (SELECT DISTINCT regexp_extract(ref, '::(.+)$', 1) AS name FROM (SELECT unnest(refs) AS ref FROM qa_now) WHERE ref LIKE '%::%')),
pool AS (SELECT file_id, i, repo, path, name, name AS full_name FROM symbols_one WHERE kind <> 'registration' OR kind IS NULL UNION ALL SELECT file_id, i, repo, path, unnest(list_distinct(regexp_extract_all(name, '\\w+'))), name FROM symbols_one WHERE kind = 'registration'),
found AS (SELECT w.want, p.*, p.name = w.want AS exact, row_number() OVER (PARTITION BY w.want ORDER BY p.name = w.want DESC, p.file_id, p.i) AS n FROM (SELECT DISTINCT want FROM wanted WHERE want <> '') w JOIN pool p ON {tx.last_part('p.name', D)} = {tx.last_part('w.want', D)} QUALIFY n <= 10)""")
  + f"SELECT w.name AS want, f.n, f.file_id, f.i, f.exact, coalesce(o.note, '') AS note FROM wanted w JOIN found f USING (want) LEFT JOIN notes o ON o.repo = lower(f.repo) AND o.path = f.path AND o.last = {tx.last_part('f.full_name', D)}",
    "corpus_scan_rules": v.with_(v.F_SQL) + f"""SELECT file_id, language FROM (SELECT *, {rules.language_sql('path', D, {'.h': 'cpp'})} AS language FROM files_now
  WHERE NOT coalesce({rules.decide_sql('path', corpus.RULES)}, regexp_matches(path, {tx.literal(rules.ignored_pattern(rules.IGNORED), D)})) AND coalesce({rules.decide_sql('path', SCOPE)}, false) AND bytes BETWEEN 1 AND {rules.MAX_BYTES})
  WHERE language <> '' AND (lines <= 0 OR bytes / greatest(lines, 1) <= {rules.MAX_MEAN_LINE})""",
    "card_carry_over": v.with_(v.F_SQL, corpus._SNAPSHOTS) + f"""SELECT file_id, 'new' AS state FROM changes WHERE status IN ('added', 'changed') UNION ALL
SELECT DISTINCT f.file_id, 'kept' FROM files_now f JOIN documents x ON x.kind = 'card' AND lower(trim(x.source)) = lower(f.repo) AND {tx.normal_path('x.path', D)} = f.path WHERE f.file_id NOT IN (SELECT file_id FROM changes WHERE status IS NOT NULL)""",
    "card_merge": corpus.SQL["chunk_cuts"].replace("SELECT file_id, part, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM cuts", """SELECT file_id, 'p0' AS purpose, string_agg(concat('lines ', a, ' to ', b), ' ' ORDER BY part) AS summary,
  string_agg(concat('f', part), ' ' ORDER BY part) AS facts FROM cuts GROUP BY file_id"""),
    "memoised_answers": v.with_(v.F_SQL) + """SELECT key, CASE WHEN repo < 'm' THEN 'known' ELSE concat('stub ', substr(sha256(prompt), 1, 12)) END AS answer FROM (
  SELECT DISTINCT concat_ws('/', repo, module) AS key, repo, concat('Describe ', module) AS prompt FROM files_now WHERE module IS NOT NULL AND repo IS NOT NULL)""",
    "proxy_judge": f"SELECT qid, cid AS id, round(1 - 0.01::DOUBLE * (pos - 1), 6) AS p FROM ({retrieval.SQL['candidates']}) WHERE pos <= 10",
    "session_keys": "SELECT doc_id, CASE WHEN k = '' THEN 'default' ELSE k END AS key FROM (SELECT doc_id, substr(regexp_replace(coalesce(source, ''), '[^\\p{L}\\p{N}_-]', '', 'g'), 1, 80) AS k FROM documents)",
    "import_rules": v.with_(_TREE_SQL, _TREE_NOW, *graph.EDGES_SQL[1:]) + "SELECT a.lang, a.path AS src, b.path AS dst FROM edges e JOIN files a ON a.file_id = e.src JOIN files b ON b.file_id = e.dst",
    "unknown_extension_rules": v.with_(_TREE_SQL) + f"""SELECT ext, count(*) AS n FROM (SELECT {tx.extension(tx.basename('path', D), D)} AS ext FROM files WHERE {rules.language_sql('path', D)} = '') WHERE ext <> '' GROUP BY ext ORDER BY n DESC, ext LIMIT 5""",
    "nested_members": v.with_(_NESTED_SQL) + """SELECT s.file_id, s.i, concat(string_agg(c.name, '.' ORDER BY c.a DESC), '.', any_value(s.name)) AS qualified FROM nested s JOIN nested c ON c.file_id = s.file_id AND c.kind IN ('class', 'impl', 'type', 'module') AND c.a < s.a AND s.b <= c.b
  WHERE s.kind IN ('method', 'function') AND NOT contains(s.name, '.') GROUP BY s.file_id, s.i""",
}
