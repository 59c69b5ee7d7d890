"""Ranking, packing and splitting against plain Python, with nulls, ties, empty tables and clashing columns."""

import math
import random
from statistics import median

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import pack_items as pk
from mosaiq.llm import rank_scores as rs
from mosaiq.llm import split_items as sp

SCORES = [rs.Score("a", True, 2.0), rs.Score("b", False, 1.0, 0.0)]


def plain_ranks(rows):
    out = {}
    groups = {}
    for g, k, a, b in rows:
        groups.setdefault(g, []).append((k, a, b if b is not None and b >= 0 else None))
    for g, xs in groups.items():
        values = {k: [] for k, _, _ in xs}
        for col, sign, weight in ((1, 1, 2.0), (2, -1, 1.0)):
            have = [x[col] for x in xs if x[col] is not None]
            if not have:
                continue
            med = median(have)
            mad = median(abs(x - med) for x in have)
            mean = sum(abs(x - med) for x in have) / len(have)
            scale = mad * rs.MAD_SCALE if mad > 0 else mean * rs.MEAN_SCALE if mean > 0 else 1.0
            for x in xs:
                if x[col] is not None:
                    z = max(-30.0, min(30.0, (x[col] - med) / scale * sign))
                    values[x[0]].append((weight, 1 / (1 + math.exp(-z)), col))
        comb = {k: round(math.exp(sum(w * math.log(v) for w, v, _ in vs) / sum(w for w, _, _ in vs)), 9) if vs else None for k, vs in values.items()}
        grade = {k: any(c == 1 for _, _, c in vs) for k, vs in values.items()}
        order = sorted(comb, key=lambda k: (not grade[k], comb[k] is None, -(comb[k] or 0), k))
        out |= {(g, k): i for i, k in enumerate(order, 1)}
    return out


def test_ranks_agree_with_brute_force(spark):
    random.seed(3)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else "g", i, None if i % 13 == 0 else float(random.randint(0, 30)), None if i % 7 == 0 else random.choice([-1.0, 0.5, 3.0, 1e9])) for i in range(200)]
    df = spark.createDataFrame(rows, "repo string, id int, a double, b double")
    got = rs.rank_scores(df, "repo", "id", SCORES, "a").collect()
    assert {(r.repo, r.id): r["rank"] for r in got} == plain_ranks(rows)


def test_no_score_outweighs_by_its_range(spark):
    rows = [("r", i, float(i), float(i)) for i in range(9)] + [("r", 9, 4.0, 1e12)]
    got = {r.id: r["rank"] for r in rs.rank_scores(spark.createDataFrame(rows, "repo string, id int, a double, b double"), "repo", "id", SCORES, "a").collect()}
    assert got[8] < got[0]  # the better first score still counts beside an outlier of the other


def test_a_unit_has_no_say_where_most_values_are_equal(spark):
    ranks = []
    for unit in (1e-6, 1.0, 1e6):
        rows = [("r", i, float(i % 4), unit * (1.0 if i < 7 else float(i))) for i in range(10)]
        df = spark.createDataFrame(rows, "repo string, id int, a double, b double")
        ranks.append([(r.id, r.combined) for r in rs.rank_scores(df, "repo", "id", SCORES, "a").orderBy("rank").collect()])
    assert ranks[0] == ranks[1] == ranks[2]


def test_ranks_of_empty_equal_and_unmeasured(spark):
    schema = "repo string, id int, a double, b double, score string, rank int, combined double"
    assert rs.rank_scores(spark.createDataFrame([], schema), "repo", "id", SCORES, "a").collect() == []
    rows = [("r", 1, 5.0, 1.0, "x", 1, 1.0), ("r", 2, 5.0, 1.0, "x", 1, 1.0), ("r", 3, None, None, "x", 1, 1.0), ("r", 4, float("nan"), float("inf"), "x", 1, 1.0)]
    got = {r.id: (r["rank"], r.combined, r.graded) for r in rs.rank_scores(spark.createDataFrame(rows, schema), "repo", "id", SCORES, "a").collect()}
    assert got == {1: (1, 0.5, True), 2: (2, 0.5, True), 3: (3, None, False), 4: (4, None, False)}


def test_bench_rows_loaded_last_count(spark):
    schema = "result_id long, repo string, score struct<total: int>, cost double, tokens struct<total: long>, duration_s double, loaded_at int"
    rows = [(1, "r", (90,), 0.1, (10,), 5.0, 1), (1, "r", (10,), 0.1, (10,), 5.0, 2), (2, "r", (50,), 0.1, (10,), 5.0, 1), (2, "r", (50,), 0.1, (10,), 5.0, 1), (3, "r", None, -1.0, None, -1.0, 1), (None, "r", (99,), 1.0, (1,), 1.0, 1)]
    got = {r.result_id: r["rank"] for r in rs.bench_ranks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: 1, 1: 2, 3: 3}


def check_packing(items, rows, capacity):
    by = {}
    for r in rows:
        by.setdefault((r.grp, r.item_id), []).append(r)
    assert set(by) == {(g, i) for g, i, s in items if s is not None}
    use = {}
    for r in rows:
        use[(r.grp, r.container)] = use.get((r.grp, r.container), 0) + r.size
        assert 0 <= r.size <= capacity
    assert max(use.values(), default=0) <= capacity
    for g, i, s in items:
        if s is not None:
            parts = sorted(by[(g, i)], key=lambda r: r.part)
            assert sum(r.size for r in parts) == max(s, 0)
            assert [r.part for r in parts] == list(range(len(parts)))
            assert len(parts) == 1 or s > capacity
    return use


def test_packing_is_whole_and_tight(spark):
    random.seed(5)
    items = [("hot" if i % 3 else None if i % 2 else f"g{i % 4}", i, random.choice([random.randint(0, 60), random.randint(1, 20), 100, 130, 350, 99, 50, 1])) for i in range(900)]
    items.append(("hot", 5000, None))
    df = spark.createDataFrame([(*x, 7) for x in items], "grp string, item_id int, size int, part int")
    rows = pk.pack_items(df, 100, classes=12).collect()
    use = check_packing(items, rows, 100)
    for g in {x[0] for x in items}:
        whole = sum(x[2] for x in items if x[0] == g and x[2])
        assert sum(1 for k in use if k[0] == g and use[k] > 0) <= math.ceil(whole / 100) * 1.08 + 2


def test_packing_of_nothing_and_of_zeros(spark):
    schema = "grp string, item_id int, size int"
    assert pk.pack_items(spark.createDataFrame([], schema), 10).collect() == []
    rows = pk.pack_items(spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, -4), ("b", 4, 10), ("c", 5, 21)], schema), 10).collect()
    check_packing([("a", 1, 0), ("a", 2, 0), ("a", 3, -4), ("b", 4, 10), ("c", 5, 21)], rows, 10)
    assert len({r.container for r in rows if r.grp == "a"}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 9))
def test_large_plan_holds_every_item_once(sizes, classes):
    sizes = sorted(sizes, reverse=True)
    values, counts = np.unique(np.array(sizes), return_counts=True)
    rows, n = pk.plan_large(values, counts, 40, classes)
    where = {}
    for _, lo, hi, base, per in rows:
        for r in range(lo, hi):
            assert r not in where
            where[r] = base + (r - lo) // per
    assert sorted(where) == list(range(len(sizes)))
    use = {}
    for r, c in where.items():
        use[c] = use.get(c, 0) + sizes[r]
    assert max(use.values()) <= 40 and len(use) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=50), st.lists(st.integers(0, 30), max_size=15))
def test_small_plan_never_overfills(sizes, gaps):
    sizes, gaps = sorted(sizes, reverse=True), sorted(gaps)
    count = lambda xs: ([x for x in sorted(set(xs))], [xs.count(x) for x in sorted(set(xs))])
    rows = pk.plan_small(*count(sizes), *count(gaps), 30)
    room = dict(enumerate(gaps))
    seen = []
    for size, lo, hi, base, per in rows:
        for r in range(lo, hi):
            seen.append(r)
            assert sizes[r] == size
            c = base + (r - lo) // per
            room[c] = room.get(c, 30) - size
            assert room[c] >= 0
    assert sorted(seen) == list(range(len(sizes)))


def check_ranges(ranges, lines, limit, overlap):
    assert ranges[0][0] == 1 and ranges[-1][1] == lines
    for a, b in ranges:
        assert 1 <= b - a + 1 <= limit
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert b - c + 1 == overlap and c > a and d > b


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 900), st.integers(2, 90), st.data())
def test_ranges_cover_overlap_and_stay_below_the_limit(lines, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    starts = data.draw(st.lists(st.integers(-3, 950), max_size=30))
    check_ranges(sp.best_ranges(lines, starts, [s % 2 == 0 for s in starts], limit, overlap), lines, limit, overlap)


def test_ranges_begin_at_symbols_where_they_can():
    got = sp.best_ranges(300, [90, 105, 150, 195, 250], [True, False, True, True, True], 110, 5)
    assert all(a in (1, 90, 105, 150, 195, 250) for a, _ in got)
    check_ranges(got, 300, 110, 5)


def plain_best(lines, starts, limit, overlap, grid):
    """Exhaustive search over all choices of beginnings."""
    step = limit - overlap
    cost = {x: sp.ELSEWHERE for x in range(1 + grid, lines + 1, grid)} | {s: sp.TOP for s in starts if 1 < s <= lines}
    ideal = (lines - overlap) / -(-(lines - overlap) // step)
    best = {}

    def go(at):
        if at in best:
            return best[at]
        out = float("inf")
        if lines - at + 1 <= limit and at <= lines - overlap:
            out = sp.BALANCE * ((lines - overlap + 1 - at) / ideal - 1) ** 2
        for nxt in cost:
            if at < nxt <= at + step:
                out = min(out, sp.BALANCE * ((nxt - at) / ideal - 1) ** 2 + cost[nxt] + sp.RANGE + go(nxt))
        best[at] = out
        return out

    return go(1)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_are_the_best(seed):
    random.seed(seed)
    lines, limit, overlap = random.randint(80, 160), random.randint(20, 40), random.randint(0, 8)
    starts = [random.randint(2, lines) for _ in range(8)]
    got = sp.best_ranges(lines, starts, [True] * 8, limit, overlap, grid=4)
    step = limit - overlap
    grid = max(1, min(4, step))
    cost = {x: sp.ELSEWHERE for x in range(1 + grid, lines + 1, grid)} | {s: sp.TOP for s in starts if 1 < s <= lines}
    ideal = (lines - overlap) / -(-(lines - overlap) // step)
    begin = [a for a, _ in got]
    value = sum(sp.BALANCE * ((b - a) / ideal - 1) ** 2 + cost[b] + sp.RANGE for a, b in zip(begin, begin[1:])) + sp.BALANCE * ((lines - overlap + 1 - begin[-1]) / ideal - 1) ** 2
    assert value == pytest.approx(plain_best(lines, starts, limit, overlap, grid))


def test_split_items_edge_cases(spark):
    items = spark.createDataFrame([(1, 250, 0), (2, 100, 0), (3, None, 0), (4, 101, 0), (5, 200_000, 0)], "item_id long, lines int, piece int")
    marks = spark.createDataFrame([(1, 80, True), (1, 80, True), (1, 80, False), (1, None, True), (1, 900, True), (9, 5, True), (4, 50, None)], "item_id long, line int, top boolean")
    rows = sp.split_items(items, marks, 100, 10).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r.piece)):
        by.setdefault(r.item_id, []).append((r.start_line, r.end_line))
    assert set(by) == {1, 4, 5}
    check_ranges(by[1], 250, 100, 10)
    check_ranges(by[5], 200_000, 100, 10)
    assert 80 in [a for a, _ in by[1]]
    assert sp.split_items(items.where("lines < 0"), marks, 100, 10).collect() == []
    with pytest.raises(ValueError):
        sp.split_items(items, marks, 10, 10)
