"""Increments, evaluation, enrichment, sessions in batch and stream, folder trees and artefacts."""

import datetime as dt
import json
import os

import pytest

from mosaiq.operators import enrich as en
from mosaiq.operators import evaluate as ev
from mosaiq.operators import incremental as inc
from mosaiq.operators import search
from mosaiq.sources import tree
from mosaiq.streaming import sessions as ss

T0 = dt.datetime(2025, 1, 1)


def test_changes_staleness_and_carry_over(spark):
    schema = "file_id long, repo string, sha string, bytes long, mtime long, module string"
    old = spark.createDataFrame([(1, "r", "a", 1, 1, "m"), (2, "r", "b", 1, 1, "m"), (3, "r", "c", 1, 1, "n"), (4, "r", None, 1, 1, "n"), (5, "r", "e", 1, 1, "o")], schema)
    new = spark.createDataFrame([(1, "r", "a", 1, 1, "m"), (2, "r", "x", 1, 2, "m"), (4, "r", None, 1, 1, "n"), (5, "r", "e", 2, 2, "o"), (6, "r", "f", 1, 1, "p")], schema)
    changes = inc.changed(new, old)
    assert {r.file_id: r.status for r in changes.collect()} == {2: "changed", 3: "deleted", 6: "added"}
    assert {r.file_id: r.stale for r in inc.stale(new, old).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    dirty = inc.dirty_modules(changes, new, old)
    assert sorted(r.module for r in dirty.collect()) == ["m", "p"]
    rows = spark.createDataFrame([("r", m, i) for i, m in enumerate(["m", "n", "o", "gone", None])], "repo string, module string, qa int")
    assert sorted(r.module for r in inc.carry_over(rows, dirty, new).collect()) == ["n", "o"]


def test_upsert_and_memo(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in inc.upsert(table, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), ["k"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    calls = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "q")], "key string, prompt string")
    cache = spark.createDataFrame([("y", "known")], "key string, answer string")
    answers, grown = inc.memoised(calls, cache, lambda todo: en.complete(todo))
    assert sorted((r.key, r.answer) for r in answers.collect()) == [("x", en.stub(["p"])[0])] * 2 + [("y", "known")] and grown.count() == 2


def test_enrichment_retries_and_reports(spark):
    def flaky(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("rate limit reached")
        return [p.upper() for p in prompts]

    jobs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "key int, prompt string")
    got = {r.key: (r.answer, r.error) for r in en.complete(jobs, flaky, batch=1, wait_s=0).collect()}
    assert got == {1: ("A", None), 2: (None, "rate limit reached"), 3: (None, None)}


def test_json_salvage_and_cards(spark):
    df = spark.createDataFrame([(1, '```json\n{"purpose": "p", "facts": ["x",],}\n```'), (2, "none"), (3, '{"purpose": "q", "summary": "s", "facts": ["y"]}')], "key int, answer string")
    got = {r.key: r.j for r in df.select("key", en.salvage().alias("j")).collect()}
    assert json.loads(got[1]) == {"purpose": "p", "facts": ["x"]} and got[2] is None
    card = en.cards(df, spark.createDataFrame([(1, 7, 1), (3, 7, 2), (2, 8, 1)], "key int, file_id int, part int"))
    rows = {r.file_id: r for r in card.collect()}
    assert rows[7].purpose == "p" and rows[7].facts == ["x", "y"] and rows[7].summary.strip() == "s" and rows[8].purpose == ""


def test_only_the_first_json_value_counts():
    assert en.first_json('see {"a": 1} and {"b": 2} [1]') == '{"a": 1}' and en.first_json("[1, 2,] tail ]") == "[1, 2]" and en.first_json("a [b c") is None and en.first_json("") is None
    assert en.first_json('[x] ```json\n{"a": [1, {"b": 2}]}\n``` {}') == '{"a": [1, {"b": 2}]}' and en.first_json("[" * 100_000) is None


def test_nearest_agrees_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = {}
    for r in en.nearest(df, df.where("vec_id % 50 = 0").selectExpr("vec_id AS qid", "v AS q"), 5, block=64).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    norm = np.linalg.norm(v, axis=1)
    for q in (i for i in range(0, 300, 50) if norm[i] > 0):
        sim = [(-round(float(v[i] @ v[q] / norm[i] / norm[q]), 6), i) for i in range(300) if norm[i] > 0]
        assert [x for _, x in sorted(got[q])] == [i for _, i in sorted(sim)[:5]]


def test_nearest_is_exact_and_skips_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "vec_id int, v array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid int, q array<float>")
    assert [r.vec_id for r in en.nearest(v, q, 2).orderBy("rank").collect()] == [1, 2]


def test_paired_arms(spark):
    rows = [(1, "r", "baseline", 0, 10, 5, 1.0, 1, 2.0, 8), (2, "r", "new", 0, 12, 5, 1.0, 1, 2.0, 8), (3, "r", "baseline", 1, 10, 5, 1.0, 1, 2.0, 8), (4, "r", "baseline", 2, 9, 5, 1.0, 1, 2.0, 8), (5, "r", "new", 2, 9, 5, 1.0, None, 2.0, 8)]
    df = spark.createDataFrame(rows, "result_id int, repo string, arm string, k int, total int, correctness int, cost double, turns int, duration_s double, tokens int")
    got = {r.arm: r for r in ev.arm_report(df, ["repo"]).collect()}
    assert got["new"].questions == 2 and (got["new"].wins, got["new"].ties, got["new"].losses) == (1, 1, 0) and got["baseline"].mean_total == 9.5 and got["new"].mean_turns == 0.5


def test_sessions_of_usage(spark):
    steps = spark.createDataFrame([("a", [(1, 0.1, None), (5, 0.5, None)]), ("b", [(1, 0.1, None)]), ("c", [(1, 0.1, "x"), (2, 0.2, None)])], "session string, steps array<struct<tokens: int, cost: double, error: string>>")
    assert [tuple(r) for r in ev.last_steps(steps).collect()] == [("a", 5, 0.5)]


def test_recall_and_renaming(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "key int, item string")
    got = {r.key: r.recall for r in ev.recall(wanted, spark.createDataFrame([(1, "a"), (1, "a"), (2, "x")], "key int, item string")).collect()}
    assert got == {1: 0.5, 2: 0.0}
    names = spark.createDataFrame([("FlowField",), ("flow_field",), ("get",), ("__init__",), ("abc",), ("longername",)], "name string")
    mapping = ev.rename_map(ev.distinctive(names))
    table = {r.name: r.new_name for r in mapping.collect()}
    assert set(table) == {"FlowField", "flow_field", "longername"} and len(set(table.values())) == 3
    texts = spark.createDataFrame([(1, "use FlowField.get, not flow_fieldx"), (2, None), (3, "")], "key int, text string")
    out = {r.key: r.renamed for r in ev.rename(texts, mapping).collect()}
    assert out == {1: f"use {table['FlowField']}.get, not flow_fieldx", 2: None, 3: ""}


def test_grades_and_proxy(spark):
    df = spark.createDataFrame([(1, (1, 20, 5, 5, 5)), (2, (0, 5, 5, 5, 5)), (3, (5, 5, 5, 5, None))], "id int, score struct<correctness: int, completeness: int, relevance: int, clarity: int, reasoning: int>")
    assert [(r.id, r.total) for r in ev.judge_grades(df).collect()] == [(1, 36)]
    p = ev.proxy_probabilities(spark.createDataFrame([(1, ["a", "b"])], "qid int, ids array<string>"))
    assert {r.id: r.p for r in p.collect()} == {"a": 1.0, "b": 0.99}


def test_search_on_a_hand_written_index(spark):
    units = spark.createDataFrame([("a", "x", [("cache loader", 30), ("opens cache", 5)]), ("b", "x", [("loader", 10)]), ("c", "y", [("cache cache", 10)]), ("d", "y", [("the of", 10), (None, 10)])], "uid string, utype string, fields array<struct<text: string, tenths: int>>")
    post = search.postings(units)
    assert {(r.uid, r.term): (r.tenths, r.len) for r in post.collect()} == {
        ("a", "cache"): (35, 7), ("a", "load"): (30, 7), ("a", "open"): (5, 7), ("b", "load"): (10, 1), ("c", "cache"): (20, 2),
    }
    asked = spark.createDataFrame([(1, "cache"), (2, "unknown"), (3, None), (4, "cache")], "qid int, text string")
    got = {q: [r.uid for r in search.search(post, asked, 2).where(f"qid = {q}").orderBy("rank").collect()] for q in (1, 2, 3, 4)}
    assert got[1] == got[4] and set(got[1]) == {"a", "c"} and got[2] == got[3] == []
    assert [r.uid for r in search.search(post, asked, 9, ["y"]).where("qid = 1").collect()] == ["c"]


EVENTS = [("s", "u1", T0, 1), ("s", "u2", T0, 2), ("s", "u1", T0 + dt.timedelta(minutes=1), 3), ("t", "u1", T0, 4), ("s", None, T0, 5)]
SCHEMA = "session string, unit string, ts timestamp, event_id bigint"


def test_first_sent_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    batch = sorted((r.session, r.unit, r.event_id) for r in ss.first_sent(df).collect())
    assert batch == [("s", "u1", 1), ("s", "u2", 2), ("t", "u1", 4)]
    for k, part in enumerate((EVENTS[:2], EVENTS[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ss.stream_first_sent(stream).writeStream.format("memory").queryName("first_sent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = [(r.session, r.unit) for r in spark.sql("SELECT * FROM first_sent").collect()]
    assert sorted(got) == [(s, u) for s, u, _ in batch]


def test_guards(spark):
    schema = "session string, path string, lines int, whole boolean, stale boolean, ts timestamp, event_id int"
    reads = [("s", "p", 900, True, False, T0, 1), ("s", "p", 900, True, False, T0, 2), ("s", "q", 900, True, True, T0, 3), ("s", "r", 100, True, False, T0, 4), ("s", "x", 200, False, None, T0, 5), ("s", "x", 200, False, None, T0, 6), ("s", "p", 900, False, False, T0, 7), ("s", "y", None, None, None, T0, 8)]
    df = spark.createDataFrame(reads, schema)
    assert {r.event_id for r in ss.read_guard(df).where("decision = 'deny'").collect()} == {1}
    assert {r.event_id for r in ss.card_once(df).collect()} == {5}
    prompts = spark.createDataFrame([("x",), ("",), (None,), (" /cmd",)], "prompt string")
    assert ss.prompt_gate(prompts).count() == 1
    names = ss.grep_names(spark.createDataFrame([(1, "def load_page|class Foo.bar|xy|abc|more")], "event_id int, pattern string"))
    assert [r.name for r in names.orderBy("pos").collect()] == ["load_page", "Foo.bar", "abc"]
    keys = spark.createDataFrame([("a b/c-1",), ("!!",), (None,), ("x" * 200,)], "s string").select(ss.session_key("s").alias("k"))
    assert [r.k for r in keys.collect()] == ["abc-1", "default", "default", "x" * 80]


def write(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_tree_keeps_hidden_names_and_follows_rules(spark, tmp_path):
    root = str(tmp_path)
    for name in ("x/a.py", "x/__init__.py", "x/.hid.py", "_pkg/b.py", "src/Field.C", "tutorials/run.py", "k.foam"):
        write(root, name, b"x = 1\n")
    write(root, "bin.py", b"a\0b")
    write(root, "empty.py", b"")
    write(root, "long.js", b"x" * 900)
    write(root, ".corpus.json", json.dumps({"ignore": ["tutorials/"]}).encode())
    rows = {r.path: r for r in tree.scan(spark, root).collect()}
    assert set(rows) == {"x/a.py", "x/__init__.py", "x/.hid.py", "_pkg/b.py", "src/Field.C"} | ({".corpus.json"} & set(rows))
    assert rows["src/Field.C"].lang == "cpp" and rows["x/a.py"].lines == 1 and rows["x/a.py"].is_code


def test_artefacts_caches_and_registry(spark, tmp_path):
    folder = str(tmp_path / "art")
    os.makedirs(folder)
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert tree.cached_table(spark, folder, "v1", build).count() == 3 and tree.cached_table(spark, folder, "v1", build).count() == 3 and len(built) == 1
    tree.cached_table(spark, folder, "v2", build)
    assert len(built) == 2 and tree.find_root(os.path.join(folder, "data")) == folder and tree.find_root(str(tmp_path)) is None
    reg = str(tmp_path / "reg.json")
    tree.register(reg, folder, {"compiled_at": "2025"})
    tree.register(reg, "/nowhere", {"compiled_at": "2026"})
    assert [r["root"] for r in tree.registered(reg)] == [folder]
    assert tree.project_config(str(tmp_path))["ignore"] == []
    with open(tmp_path / "rows.jsonl", "w") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert tree.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "a int").where("a IS NOT NULL").count() == 2
    with open(tmp_path / "broken.json", "w") as f:
        f.write('{"a": ')
    assert tree.read_json(spark, str(tmp_path / "broken.json"), "a int").where("a IS NOT NULL").count() == 0
    with pytest.raises(Exception):
        tree.read_jsonl(spark, str(tmp_path / "broken.json"), "a int").collect()
