"""Definitions of the names in a prompt."""

from mosaiq.plans import session_queries as sq
from mosaiq.streaming import sessions as ss

NAMES = "event_id long, pos int, name string"


def test_definitions_are_the_symbols_by_full_name_or_last_part(spark):
    prompts = spark.createDataFrame([(7, "Store.load größe_x save_all. and more_names"), (8, "class load"), (9, "nothing_here ..."), (10, None)], "event_id long, pattern string")
    symbols = spark.createDataFrame(
        [(1, 0, "Cache.load", "method", 3, 4, "a.py"), (1, 1, "Store.load", "method", 5, 6, "a.py"), (2, 0, "save_all", "function", 1, 2, "b.py"), (2, 1, None, "function", 3, 3, "b.py"), (2, 2, "größe_x", "function", 3, 3, "b.py"), (3, 0, "ns::load", "function", 1, 1, "c.rs")],
        "file_id long, i int, name string, kind string, start_line int, end_line int, path string",
    )
    got = ss.definitions(ss.grep_names(prompts), symbols).orderBy("event_id", "pos", "n").collect()
    assert [(r.event_id, r.name, r.n, r.symbol, r.exact) for r in got] == [
        (7, "Store.load", 1, "Store.load", True), (7, "Store.load", 2, "Cache.load", False), (7, "Store.load", 3, "ns::load", False),
        (7, "größe_x", 1, "größe_x", True), (7, "save_all.", 1, "save_all", True),
        (8, "load", 1, "Cache.load", False), (8, "load", 2, "Store.load", False), (8, "load", 3, "ns::load", False),
    ]
    assert [(r.path, r.start_line, r.end_line, r.kind) for r in got][:1] == [("a.py", 5, 6, "method")]


def test_a_full_stop_after_a_name_does_not_count(spark):
    symbols = spark.createDataFrame([(2, 0, "save_all", "function", 1, 2, "b.py")], "file_id long, i int, name string, kind string, start_line int, end_line int, path string")
    got = ss.definitions(spark.createDataFrame([(7, 0, "save_all."), (8, 0, "save_all")], NAMES), symbols).collect()
    assert sorted((r.event_id, r.symbol, r.exact) for r in got) == [(7, "save_all", True), (8, "save_all", True)]


def test_every_prompt_is_looked_up(spark):
    rows = sq.grep_definitions(spark, "/root/testdata/sf0.001").select("event_id").distinct().collect()
    assert sum(r.event_id % 100 != 0 for r in rows) > 10
