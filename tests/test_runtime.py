"""Ranks, medians and latest rows against plain Python."""

import os
import random
from statistics import median

from pyspark.sql import functions as F

from mosaiq import runtime as rt


def test_ranked_numbers_skewed_groups_in_order(spark):
    random.seed(1)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", random.randint(0, 5), i) for i in range(500)]
    got = rt.ranked(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()
    by = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((-v, i))
    want = {(g, i): n for g, xs in by.items() for n, (_, i) in enumerate(sorted(xs), 1)}
    assert {(r.g, r.id): r["rank"] for r in got} == want


def test_ranked_of_an_empty_table(spark):
    assert rt.ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).collect() == []


def test_exact_median(spark):
    random.seed(2)
    rows = [("a" if i % 3 else None, float(random.randint(0, 9)) if i % 11 else None, i) for i in range(301)]
    got = {r.g: r["median"] for r in rt.exact_median(spark.createDataFrame(rows, "g string, x double, id int"), ["g"], "x", ["id"]).collect()}
    for g in ("a", None):
        assert got[g] == median(x for h, x, _ in rows if h == g and x is not None)


def test_latest_collapses_ties_and_drops_null_keys(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (None, 9, "q"), (2, None, "n")]
    got = rt.latest(spark.createDataFrame(rows, "k int, t int, v string"), "k", [F.col("t")], ["v"]).collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "b"), (2, "n")]


def test_match_joins_nulls(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert [(r.k, r.a, r.b) for r in rt.match(a, b, ["k"]).collect()] == [(None, 1, 3)]


def test_shared_dir_follows_the_session(spark):
    where = rt.shared_dir(spark)
    assert rt.shared_dir(spark) == where and rt.materialise(spark.range(3)).count() == 3
    mine = list(rt._WRITTEN)
    assert mine and rt.forget(spark) == len(mine) and rt.forget(spark) == 0 and not [x for x in mine if os.path.exists(rt.local_path(x))]


def test_latest_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, 5, "a", "x"), (1, 6, "b", "y")], "k int, o0 int, best string, v string")
    assert [tuple(r) for r in rt.latest(rows, "k", [F.col("o0")], ["o0", "best", "v"]).collect()] == [(1, 6, "b", "y")]


def test_ranks_agree_on_a_third_of_rows_in_one_group(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 700) END AS g", "hash(id) % 50 AS v", "id")
    got = rt.ranked(rows, ["g"], ["v", "id"])
    want = rows.selectExpr("g", "id", "row_number() OVER (PARTITION BY g ORDER BY v, id) AS want")
    assert got.join(want, ["g", "id"]).where("rank = want").count() == 30_000
