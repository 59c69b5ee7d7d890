"""Filling fixed-capacity containers by linear grouping.

The items of a group (a repo) are of two kinds. *Large* ones are sorted by size and cut into a fixed number of classes of
equal cardinality; every size is rounded up to the largest of its class, which leaves a problem with few sizes, solved by
patterns (how many items of each class fill a container best). The real items are then put in the place of the rounded
ones; they fit, as they are never larger. *Small* ones go best-fit into the room that is really left, then into new containers.

Only histograms (at most ``capacity`` rows a group) are gathered per group; items and containers are numbered by
distributed ranks and meet the plan by equi-joins, so a group may hold any share of the rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import latest, materialise, ranked

PLAN = "grp string, kind string, size int, lo bigint, hi bigint, base bigint, per bigint"


def _best_fill(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """How many of each size fill ``room`` best: a bounded knapsack in which size is value. Earlier sizes are preferred."""
    reach = np.full(room + 1, -1, np.int64)  # the index of the last size added to reach a sum
    used = np.zeros(room + 1, np.int64)
    reach[0] = len(sizes)
    for g, (size, n) in enumerate(zip(sizes, counts)):
        if n <= 0 or size > room:
            continue
        used[:] = 0
        for at in np.flatnonzero(reach[: room + 1 - size] >= 0).tolist() if n == 1 else range(room + 1 - size):
            if reach[at] >= 0 and reach[at + size] < 0 and (used[at] < n if reach[at] == g else True):
                k = used[at] + 1 if reach[at] == g else 1
                if k <= n:
                    reach[at + size] = g
                    used[at + size] = k
    take, at = [0] * len(sizes), int(np.flatnonzero(reach >= 0).max())
    while at > 0:
        take[reach[at]] += 1
        at -= sizes[reach[at]]
    return take


def plan_large(sizes: np.ndarray, counts: np.ndarray, capacity: int, classes: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the large items of a group go: rows (class, lo, hi, base, per) and the number of containers.

    Items have ranks from 0, larger ones first; those in [lo, hi) of a class go to container base + (rank - lo) // per.
    """
    order = np.argsort(-sizes)
    sizes, counts = sizes[order], counts[order]
    total = int(counts.sum())
    each = max(1, -(-total // classes))
    ends = np.cumsum(counts)
    start = np.arange(0, total, each)
    largest = [int(sizes[np.searchsorted(ends, s, side="right")]) for s in start]
    left = [int(min(each, total - s)) for s in start]
    pointer = [int(s) for s in start]
    rows, containers = [], 0
    while any(left):
        first = next(g for g, n in enumerate(left) if n)
        rest = left.copy()
        rest[first] -= 1
        take = _best_fill(capacity - largest[first], largest, rest)
        take[first] += 1
        times = min(n // k for n, k in zip(left, take) if k)
        for g, k in enumerate(take):
            if k:
                rows.append((g, pointer[g], pointer[g] + k * times, containers, k))
                pointer[g] += k * times
                left[g] -= k * times
        containers += times
    return rows, containers


def plan_small(sizes: list[int], counts: list[int], gaps: list[int], rooms: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the small items of a group go: rows (size, lo, hi, base, per).

    Items have ranks from 0, larger ones first; containers have ranks from 0, smaller gaps first, and new ones follow.
    Each item goes into the container with the least room that holds it; whole runs of equal items and equal gaps move at once.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for gap, n in sorted(zip(gaps, rooms)):
        free.setdefault(gap, []).append((at, at + n))
        at += n
    order = sorted(free)
    rows, rank = [], 0

    def put(gap: int, span: tuple[int, int]) -> None:
        if gap not in free:
            insort(order, gap)
        free.setdefault(gap, []).append(span)

    for size, n in sorted(zip(sizes, counts), reverse=True):
        while n:
            k = bisect_left(order, size)
            if k == len(order):
                per = n if size <= 0 else max(1, capacity // size)
                full, over = divmod(n, per)
                if full:
                    rows.append((size, rank, rank + full * per, at, per))
                    put(capacity - size * per, (at, at + full))
                if over:
                    rows.append((size, rank + full * per, rank + n, at + full, per))
                    put(capacity - size * over, (at + full, at + full + 1))
                at += full + (over > 0)
                rank += n
                n = 0
                continue
            gap = order[k]
            lo, hi = free[gap].pop()
            if not free[gap]:
                del free[gap]
                order.pop(k)
            per = n if size <= 0 else min(gap // size, n)  # after one, the same container is the tightest again
            moved = min(n // per, hi - lo)
            rows.append((size, rank, rank + moved * per, lo, per))
            put(gap - size * per, (lo, lo + moved))
            if lo + moved < hi:
                put(gap, (lo + moved, hi))
            rank += moved * per
            n -= moved * per
    return rows


def pack_items(items: DataFrame, capacity: int, classes: int = 48, large_share: float = 0.2) -> DataFrame:
    """(grp, item_id, part, size, container): where each item of ``items`` (grp string, item_id, size int) goes.

    ``item_id`` is unique. An item above ``capacity`` is cut into full containers of its own (``x<item>-<part>``) and a last part,
    which is packed like any other; all others have the one part 0. Sizes that are null count as not there; sizes below 0 count as 0.
    Items of size 0 take no room. Shared containers are called ``c<number>`` and numbered from 0 in each group; a null group is one too.
    """
    items = items.where(F.col("size").isNotNull()).select(
        F.col("grp").cast("string").alias("grp"), F.col("item_id"), F.greatest(F.col("size"), F.lit(0)).cast("int").alias("size")
    )
    over = items.where(F.col("size") >= capacity)
    full = over.select("grp", "item_id", F.explode(F.expr(f"sequence(0, cast(size div {capacity} as int) - 1)")).alias("part"), F.lit(capacity).alias("size"))
    full = full.withColumn("container", F.concat(F.lit("x"), F.col("item_id").cast("string"), F.lit("-"), F.col("part").cast("string")))
    rest = items.where((F.col("size") < capacity) | (F.col("size") % capacity > 0)).select(
        "grp", "item_id", F.expr(f"cast(size div {capacity} as int)").alias("part"), (F.col("size") % capacity).alias("size")
    )
    least_large = max(1, int(capacity * large_share))
    order = [F.col("size").desc(), F.col("item_id").asc()]
    tagged = rest.withColumn("big", F.col("size") >= least_large)
    placed = ranked(tagged, ["grp", "big"], order, "pos").withColumn("pos", F.col("pos") - 1)
    hist = materialise(tagged.groupBy("grp", "big", "size").agg(F.count(F.lit(1)).alias("n")))

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _ = plan_large(pdf["size"].to_numpy(), pdf["n"].to_numpy(), capacity, classes)
        total = int(pdf["n"].sum())
        each = max(1, -(-total // classes))
        out = pd.DataFrame(rows, columns=["size", "lo", "hi", "base", "per"])  # size holds the class
        out["grp"], out["kind"] = pdf["grp"].iloc[0], str(each)
        return out[["grp", "kind", "size", "lo", "hi", "base", "per"]]

    # histograms are small for what their plans cost, so sizes alone would put all groups into one task
    spread = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = materialise(hist.where("big").repartition(spread, "grp").groupBy("grp").applyInPandas(large, PLAN))
    each = plan.groupBy("grp").agg(F.max(F.col("kind").cast("bigint")).alias("each"))
    big = placed.where("big").alias("b").join(each.alias("e"), F.expr("b.grp <=> e.grp"))
    big = big.select("b.*", F.expr("cast(b.pos div e.each as int)").alias("cls"))
    big = big.alias("b").join(plan.alias("p"), F.expr("b.grp <=> p.grp and b.cls = p.size and b.pos >= p.lo and b.pos < p.hi"))
    big = materialise(big.select("b.grp", "b.item_id", "b.part", "b.size", F.expr("p.base + (b.pos - p.lo) div p.per").alias("no")))

    gaps = big.groupBy("grp", "no").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("gap"))
    gaps = ranked(gaps, ["grp"], [F.col("gap").asc(), F.col("no").asc()], "pos").withColumn("pos", F.col("pos") - 1)
    both = (
        hist.where("not big").select("grp", F.lit("item").alias("kind"), F.col("size"), "n")
        .unionByName(gaps.groupBy("grp", F.col("gap").alias("size")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("gap")))
    )

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        item, gap = pdf[pdf["kind"] == "item"], pdf[pdf["kind"] == "gap"]
        rows = plan_small(item["size"].tolist(), item["n"].tolist(), gap["size"].tolist(), gap["n"].tolist(), capacity)
        out = pd.DataFrame(rows, columns=["size", "lo", "hi", "base", "per"])
        out["grp"], out["kind"] = pdf["grp"].iloc[0], "small"
        return out[["grp", "kind", "size", "lo", "hi", "base", "per"]]

    fill = both.repartition(spread, "grp").groupBy("grp").applyInPandas(small, PLAN)
    little = placed.where("not big").alias("s").join(fill.alias("p"), F.expr("s.grp <=> p.grp and s.size = p.size and s.pos >= p.lo and s.pos < p.hi"))
    little = little.select("s.grp", "s.item_id", "s.part", "s.size", F.expr("p.base + (s.pos - p.lo) div p.per").alias("slot"))
    known = little.alias("s").join(gaps.alias("g"), F.expr("s.grp <=> g.grp and s.slot = g.pos"), "left")
    little = known.select("s.grp", "s.item_id", "s.part", "s.size", F.coalesce("g.no", "s.slot").alias("no"))
    shared = big.unionByName(little).withColumn("container", F.concat(F.lit("c"), F.col("no").cast("string"))).drop("no")
    return full.select("grp", "item_id", "part", "size", "container").unionByName(shared.select("grp", "item_id", "part", "size", "container"))


def current_files(files: DataFrame, keep: list[str]) -> DataFrame:
    """The current row of each file: the one scanned last among its rows with ``lines``; files without such a row are left out.

    Rows scanned at the same time are told apart by load time, then by their values.
    """
    rest = [c for c in keep if c != "file_id"]
    rows = files.where(F.col("lines").isNotNull())
    return latest(rows, "file_id", [F.col("scanned_at"), F.col("loaded_at")], rest)


def file_containers(files: DataFrame, capacity: int) -> DataFrame:
    """(repo, file_id, part, lines, container) for the current row of every file."""
    current = current_files(files, ["repo", "lines"])
    packed = pack_items(current.select(F.col("repo").alias("grp"), F.col("file_id").alias("item_id"), F.col("lines").alias("size")), capacity)
    return packed.select(F.col("grp").alias("repo"), F.col("item_id").alias("file_id"), "part", F.col("size").alias("lines"), "container")
