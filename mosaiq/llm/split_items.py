"""Splitting oversized items at natural boundaries.

An item of ``n`` lines is covered by ranges that begin at chosen lines; each range ends ``overlap`` lines into the next one. A
dynamic program over the possible beginnings minimises the sum of cut penalties (a top-level symbol is free, a member costs
a little, a line in the middle of nothing named costs most) and squared imbalance, subject to the maximum length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.pack_items import current_files
from mosaiq.runtime import match

#: Penalties of beginning a range at a top-level symbol, at a member, and elsewhere; of any range; weight of imbalance.
TOP, MEMBER, ELSEWHERE, RANGE, BALANCE = 0.0, 1.0, 8.0, 4.0, 2.0


def best_ranges(lines: int, starts: list[int], tops: list[bool], limit: int, overlap: int, grid: int = 16) -> list[tuple[int, int]]:
    """The ranges (first line, last line) of an item of ``lines`` lines; one range where it is within ``limit``.

    ``starts`` are the natural beginnings. Besides them every ``grid``-th line may begin a range, so there always is a
    solution. ``overlap`` must be less than ``limit``.
    """
    if lines <= limit:
        return [(1, lines)]
    step = limit - overlap
    grid = max(1, min(grid, step))
    cost = {int(x): ELSEWHERE for x in range(1 + grid, lines + 1, grid)}
    for at, top in zip(starts, tops):
        if 1 < at <= lines:
            cost[at] = min(cost.get(at, ELSEWHERE), TOP if top else MEMBER)
    at = np.array([1, *sorted(cost)], np.int64)
    price = np.array([0.0, *[cost[x] for x in at[1:].tolist()]]) + RANGE
    pieces = -(-(lines - overlap) // step)
    ideal = (lines - overlap) / pieces
    best = np.full(len(at), np.inf)
    best[0] = price[0]
    came = np.zeros(len(at), np.int64)
    low = np.searchsorted(at, at - step)
    for j in range(1, len(at)):
        fresh = (at[j] - at[low[j] : j]) / ideal - 1
        total = best[low[j] : j] + BALANCE * fresh * fresh
        k = int(total.argmin())
        best[j], came[j] = total[k] + price[j], low[j] + k
    last = np.flatnonzero(at > lines - limit)
    # a last range that is all overlap would only repeat the range before
    last = last[(at[last] <= lines - overlap) | (at[last] == 1)]
    tail = (lines - overlap + 1 - at[last]) / ideal - 1
    j = int(last[(best[last] + BALANCE * tail * tail).argmin()])
    begin = []
    while True:
        begin.append(int(at[j]))
        if j == 0:
            break
        j = int(came[j])
    begin.reverse()
    return [(s, begin[i + 1] + overlap - 1 if i + 1 < len(begin) else lines) for i, s in enumerate(begin)]


def split_items(items: DataFrame, boundaries: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item_id, piece, start_line, end_line) of every item above ``limit`` lines.

    ``items`` has unique ``item_id`` and ``lines`` (null: left out); ``boundaries`` has ``item_id, line, top`` (nulls and lines outside the item
    are not boundaries, repeated rows count once, an item may have none). Pieces are numbered from 0, hold at most ``limit`` lines,
    cover the item and share exactly ``overlap`` lines with the piece before. Further columns of the inputs are not looked at.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    big = items.where(F.col("lines") > limit).select("item_id", "lines")
    marks = boundaries.where(F.col("line").isNotNull()).select("item_id", F.col("line").cast("int").alias("line"), F.coalesce("top", F.lit(False)).alias("top"))
    marks = marks.join(big.select("item_id"), "item_id", "left_semi")
    marks = marks.groupBy("item_id", "line").agg(F.max("top").alias("top"))
    marks = marks.groupBy("item_id").agg(F.collect_list(F.struct("line", "top")).alias("marks"))
    marks = marks.select("item_id", F.col("marks.line").alias("starts"), F.col("marks.top").alias("tops"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, lines, starts, tops in zip(pdf["item_id"], pdf["lines"], pdf["starts"], pdf["tops"]):
                starts, tops = ([], []) if starts is None else (list(starts), list(tops))
                rows += [(item, i, a, b) for i, (a, b) in enumerate(best_ranges(int(lines), starts, tops, limit, overlap))]
            yield pd.DataFrame(rows, columns=["item_id", "piece", "start_line", "end_line"])

    # the arrays are small for what their items cost, so sizes would put them all into one task
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = match(big, marks, ["item_id"], "left").repartition(spread, "item_id")
    kind = dict(items.dtypes)["item_id"]
    return joined.mapInPandas(cut, f"item_id {kind}, piece int, start_line int, end_line int")


def file_pieces(files: DataFrame, symbols: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(file_id, piece, start_line, end_line) of every file whose current row exceeds ``limit`` lines."""
    current = current_files(files, ["lines"])
    top = ~F.coalesce(F.col("name"), F.lit(".")).contains(".") | (F.col("kind") == "section")
    marks = symbols.select(F.col("file_id").alias("item_id"), F.col("start_line").alias("line"), top.alias("top"))
    pieces = split_items(current.withColumnRenamed("file_id", "item_id"), marks, limit, overlap)
    return pieces.withColumnRenamed("item_id", "file_id")
