"""Cards, notes, flows, core texts, windows, exclusion sets, sinks, requests: nulls, ties, empty tables, clashing names."""

import json
import os

from mosaiq.operators import evaluate as ev
from mosaiq.operators import incremental as inc
from mosaiq.operators import knowledge as kn
from mosaiq.operators import packs as pk
from mosaiq.operators import search as se
from mosaiq.runtime import cached, prefix_sums
from mosaiq.sources import tree
from mosaiq.streaming import sessions as ss

DOCS = "doc_id long, kind string, source string, path string, text string, name string, pos int"


def test_flows(spark):
    rows = [(1, "flow", "r", None, "Load page\n1. a.py::load — opens\r\n2. b — reads — twice\nnot a step\n3.x — no", "x", 1), (2, "flow", None, None, None, None, None), (3, "flow", "r", None, "", None, None), (4, "card", "r", None, "N\n1. a — b", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert [tuple(r) for r in kn.flow_steps(df).orderBy("step").collect()] == [(1, "Load page", 1, "a.py::load", "opens"), (1, "Load page", 2, "b", "reads — twice")]
    assert kn.flow_steps(df.where("doc_id > 9")).collect() == []


def test_notes_and_facts(spark):
    rows = [(5, "card", " R ", "./a.py", "a.py\nFirst `load` opens. Then `C.save` and `load` read. ", None, None), (4, "card", "r", "a.py", "a.py\nEarlier `load` wins", None, None), (6, "card", "r", None, "x\n`load`", None, None), (7, "card", "r", "b.py", None, None, None)]
    sentences = kn.card_sentences(spark.createDataFrame(rows, DOCS))
    symbols = spark.createDataFrame([(1, 0, "X.load", "R", "a.py"), (1, 1, "C.save", "R", "a.py"), (1, 2, None, "R", "a.py"), (2, 0, "load", "r", "b.py")], "file_id long, i int, name string, repo string, path string")
    got = {(r.file_id, r.i): r.note for r in kn.symbol_notes(sentences, symbols).collect()}
    assert got == {(1, 0): "Earlier `load` wins", (1, 1): "", (2, 0): ""}
    hits = spark.createDataFrame([(9, "file:1", "file", 1.0, 1), (9, "sym:1:0", "sym", 1.0, 2)], "qid long, uid string, utype string, score double, rank long")
    questions = spark.createDataFrame([(9, "who opens and reads it"), (8, None)], "qid long, text string")
    files = spark.createDataFrame([(1, "R", "a.py"), (2, "r", None)], "file_id long, repo string, path string")
    assert [(r.n, r.sentence) for r in kn.facts_for(questions, hits, files, sentences).orderBy("n").collect()] == [(1, "First `load` opens"), (2, "Then `C.save` and `load` read")]


def test_orienting_texts_stop_after_the_one_that_exceeds(spark):
    rows = [(i, "guide", "r", None, "x" * 15_000, None, None) for i in range(6)] + [(9, "guide", None, None, "y", None, None), (10, "guide", "s", None, "", None, None)]
    got = kn.orienting_texts(spark.createDataFrame(rows, DOCS), ["guide"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.chars) for r in got] == [(0, 12_000), (1, 12_000), (2, 12_000), (3, 12_000)]


def test_prefix_sums_agree_with_a_window(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS g", "hash(id) % 97 AS o", "id", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 7 END AS n")
    want = rows.selectExpr("id", "coalesce(sum(n) OVER (PARTITION BY g ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want")
    assert prefix_sums(rows, ["g"], ["o", "id"], "n", "before").join(want, "id").where("before = want").count() == 5000
    assert prefix_sums(rows.where("id < 0"), ["g"], ["o", "id"], "n", "before").collect() == []


def test_question_windows(spark):
    schema = "repo string, module string, file_id long, path string, lines int, bytes long, is_test boolean, is_code boolean, lang string"
    rows = [("r", "m", 1, "a", 1000, 60_000, False, True, "go"), ("r", "m", 2, "b", 10, 60_000, None, None, "markdown"), ("r", "m", 3, "c", 4000, 220_001, False, True, "go"), ("r", "m", 4, "d", 10, 10, True, True, "go"), ("r", None, 5, "e", 10, 10, False, True, "go"), (None, "m", 6, "f", 3, None, False, True, "go")]
    got = {(r.repo, r.part): (r.files, r.lines, r.questions) for r in kn.question_windows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("r", "b0"): (1, 1000, 14), ("r", "b1"): (1, 10, 6), ("r", "h3-0"): (1, 2000, 28), ("r", "h3-1"): (1, 2000, 28), (None, "b0"): (1, 3, 6)}


def test_aliases_go_back_to_their_symbols(spark):
    symbols = spark.createDataFrame([(f, i, f"n{f}_{i}") for f in range(10) for i in range(10)] + [(99, 0, None)], "file_id long, i int, name string")
    jobs = kn.alias_jobs(symbols)
    assert jobs.count() == 100 and {r.batch for r in jobs.select("batch").distinct().collect()} == {0, 1}
    answers = spark.createDataFrame([(1, "a0", ["x" * 200, "b", "c", "d", "e"]), (1, "a99", ["no"])], "batch long, key string, aliases array<string>")
    assert [(r.file_id, r.i, [len(x) for x in r.aka]) for r in kn.alias_write_back(jobs, answers).collect()] == [(7, 0, [160, 1, 1, 1])]


def test_compact_cores(spark):
    text = "## Glossary\nw\n## What this is\nx\n## Module map\n" + "y" * 400
    df = spark.createDataFrame([(1, text), (2, "no sections"), (3, None), (4, "## Other\nz\n## Glossary\nold\n## Glossary\nnew"), (5, "")], "key long, text string")
    got = [(r.key, r.head, r.text) for r in kn.compact_core(df, 30).orderBy("key", "ord").collect()]
    assert got == [(1, "What this is", "## What this is\nx"), (1, "Glossary", "## Glossary\nw"), (2, "", "no sections"), (4, "Glossary", "## Glossary\nnew")]
    assert [(r.head, r.ord) for r in kn.compact_core(df.where("key = 4"), 30, ()).orderBy("ord").collect()] == [("Other", 1 + 1), ("Glossary", 4)]
    assert kn.compact_core(df.where("key = 2"), 2).collect()[0].text == "no secti"


def test_units_sent_before_stay_away(spark):
    hits = spark.createDataFrame([(1, "qa:1", "qa"), (1, "sym:1:0", "sym"), (2, "qa:1", "qa")], "qid long, uid string, utype string")
    sent = spark.createDataFrame([(1, "qa:1"), (1, "sym:1:0"), (1, "qa:1")], "qid long, uid string")
    assert sorted(tuple(r)[:2] for r in pk.unsent(hits, sent).select("qid", "uid").collect()) == [(1, "sym:1:0"), (2, "qa:1")]
    assert pk.unsent(hits, sent, answers_only=False).count() == 1 and pk.unsent(hits, None).count() == 3


def test_selected_units_are_rendered(spark):
    ids = spark.createDataFrame([(1, 1, "sym:7:0"), (1, 2, "qa:5"), (1, 3, "file:7"), (1, 4, "gone:1")], "qid long, ord int, uid string")
    symbols = spark.createDataFrame([(7, 0, "f", "a.py", 1, 2)], "file_id long, i int, name string, path string, start_line int, end_line int")
    qa = spark.createDataFrame([(5, "q", None)], "qa_id long, q string, a string")
    files = spark.createDataFrame([(7, "a.py", 9)], "file_id long, path string, lines int")
    assert [r.text for r in pk.selected(ids, symbols, qa, files).orderBy("ord").collect()] == ["a.py:L1-2 f", "Q: q\nA: ", "FILE a.py (9 lines)"]
    assert [r.key for r in pk.selected(ids, symbols, qa, files, 4).collect()] == ["sym:7:0"]


def test_search_without_a_hit_of_the_least_score(spark):
    postings = spark.createDataFrame([("a", "qa", "load", 30, 3), ("b", "qa", "load", 10, 9), ("c", "qa", "rare", 10, 1)], "uid string, utype string, term string, tenths long, len long")
    asked = spark.createDataFrame([(1, "load"), (2, "rare")], "qid long, text string")
    every = {r.qid for r in se.search(postings, asked, 5).collect()}
    best = {r.qid: r.score for r in se.search(postings, asked, 1).collect()}
    least = max(best.values())
    assert every == {1, 2} and {r.qid for r in se.search(postings, asked, 5, min_score=least).collect()} == {q for q, s in best.items() if s >= least}


def test_refresh_and_upgrade(spark):
    new = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", None), (None, "x")], "repo string, module string")
    dirty = spark.createDataFrame([("a", "m")], "repo string, module string")
    known = spark.createDataFrame([("a",), ("b",)], "repo string")
    assert {r.repo: r.refresh for r in inc.refreshed(new, dirty, known).collect()} == {"a": True, "b": False, "c": True}
    assert inc.upgraded(dirty, new, "structure", "full").count() == 3 and inc.upgraded(dirty, new, "full", "full").count() == 1


def test_ratios_and_recall_of_packs(spark):
    report = spark.createDataFrame([("r", "baseline", 1.0, 100.0, 50.0), ("r", "x", 0.75, 50.0, 60.0), ("s", "y", 1.0, 1.0, 1.0)], "repo string, arm string, mean_cost double, mean_tokens double, mean_total double")
    got = {r.arm: (r.cost_ratio, r.token_ratio, r.score_gain, r.pay_back) for r in ev.arm_ratios(report, ["repo"]).collect()}
    assert got == {"baseline": (1.0, 1.0, 0.0, None), "x": (0.75, 0.5, 10.0, 3.0)}
    wanted = spark.createDataFrame([(1, "file", "a.py"), (1, "file", "b.py"), (1, "name", "load"), (2, "name", "x")], "key long, kind string, item string")
    packs = spark.createDataFrame([(1, "see a.py"), (1, "and load"), (1, None)], "key long, text string")
    assert {(r.key, r.kind): (r.wanted, r.found) for r in ev.pack_recall(wanted, packs).collect()} == {(1, "file"): (2, 1), (1, "name"): (1, 1), (2, "name"): (1, 0)}


def test_requests_and_dispatch(spark):
    lines = spark.createDataFrame([('{"id": 1, "method": "view", "params": {"k": "5"}}',), ('{"id": 2',), ("",), (None,), ('{"id": 3, "method": "odd"}',), ("[1]",)], "value string")
    calls = ss.requests(lines)
    assert sorted((r.id, r.method, r.params) for r in calls.collect()) == [(1, "view", "5"), (3, "odd", None)]
    assert [r.line for r in ss.dispatched(calls, {"view": "read"}).collect()] == ['{"id":1,"handler":"read","unit":"5"}']


def test_sinks(spark, tmp_path):
    packs = spark.createDataFrame([(7, 2, "second"), (7, 1, "first"), (8, 1, None)], "qid long, ord int, text string")
    tree.write_packs(packs, str(tmp_path / "packs"))
    assert open(next((tmp_path / "packs" / "qid=7").glob("*.txt"))).read().rstrip("\n") == "# Context\n\nfirst\n\nsecond"
    tree.write_renamed(spark.createDataFrame([("r", "a.py", "x"), ("r", None, "y")], "repo string, path string, renamed string"), str(tmp_path / "renamed"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "renamed")).select("repo", "path", "text").collect()] == [("r", "a.py", "x")]
    path = str(tmp_path / "c.json")
    tree.update_config(path, add={"ignore": ["a", "b", "a"]}, extensions=".H=cpp")
    assert tree.update_config(path, add={"ignore": ["c", "a"]}, remove={"ignore": ["b"]}) == {"ignore": ["a", "c"], "extensions": {".H": "cpp"}} == json.load(open(path))


def test_a_manifest_is_gone_while_tables_are_written(spark, tmp_path):
    folder = str(tmp_path / "art")
    tree.write_artefact({"t": spark.range(3)}, folder, {"stamp": "1"})
    assert tree.read_manifest(spark, folder) == {"stamp": "1"} and tree.read_manifest(spark, str(tmp_path / "none")) == {}
    try:
        tree.write_artefact({"t": spark.range(3).selectExpr("assert_true(id < 1)")}, folder, {"stamp": "2"})
    except Exception:  # noqa: BLE001
        pass
    assert not os.path.exists(f"{folder}/_MANIFEST.json")


def test_derived_tables_follow_their_inputs(spark, tmp_path):
    path, built = str(tmp_path / "in.parquet"), []

    def build():
        built.append(1)
        return spark.read.parquet(path).selectExpr("id * 2 AS x")

    spark.range(3).write.parquet(path)
    assert cached(spark, "doubles", [path], build).count() == 3 and cached(spark, "doubles", [path], build).count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert cached(spark, "doubles", [path], build).count() == 5 and len(built) == 2


def test_a_stream_of_reads_agrees_with_the_batch(spark, tmp_path):
    import datetime as dt
    import random

    random.seed(6)
    schema = "session string, path string, lines int, whole boolean, stale boolean, ts timestamp, event_id long"
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"s{random.randint(0, 2)}", f"p{random.randint(0, 4)}", random.choice([100, 300, 900]), random.random() < 0.5, random.random() < 0.2, t0 + dt.timedelta(seconds=k), k) for k in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = ss.stream_reads(stream).writeStream.format("memory").queryName("reads").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.sql("SELECT * FROM reads").collect()
    denied = {r.event_id for r in ss.read_guard(df).where("decision = 'deny'").collect()}
    assert len(got) == 60 and denied and {r.event_id for r in got if r.decision == "deny"} == denied
    given, cards = set(), set()
    for r in rows:
        if r[3] and r[2] > 500 and not r[4]:
            given.add(r[:2])
        elif not r[3] and r[2] >= 150 and r[:2] not in given:
            given.add(r[:2])
            cards.add(r[6])
    assert {r.event_id for r in got if r.card} == cards
