"""One ranking from several differently scaled scores.

Every score is standardised within its group by median and median absolute deviation, turned so that more is better,
squashed by a logistic function (so an extreme outlier counts no more than a strong value) and combined by a weighted
geometric mean. The result depends on the order and typical spread of each score, not on its range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import exact_median, latest, match, materialise, ranked

#: Make the median and the mean absolute deviation of a normal distribution its standard deviation.
MAD_SCALE, MEAN_SCALE = 1.4826, 1.2533


@dataclass(frozen=True)
class Score:
    """A score: its column, whether more is better, its weight, and the least value that is a measurement."""

    column: str
    more_is_better: bool
    weight: float = 1.0
    least: float = float("-inf")


def squashed(df: DataFrame, by: list[str], key: str, scores: list[Score]) -> DataFrame:
    """(by, key, score, z, value): value in (0, 1) for each measured score of each row.

    Null, NaN, infinite values and values below ``least`` (markers) are not measurements: they have no row here and don't take part in
    the medians. Where the median deviation of a group is 0, as more than half of its values are equal, the mean deviation takes its place; where that is 0
too all values are equal and give 0.5. So no scale depends on the unit of a score.
    """
    entries = F.array(*[F.struct(F.lit(s.column).alias("score"), F.col(s.column).cast("double").alias("x")) for s in scores])
    least = F.create_map(*[x for s in scores for x in (F.lit(s.column), F.lit(s.least))])
    sign = F.create_map(*[x for s in scores for x in (F.lit(s.column), F.lit(1.0 if s.more_is_better else -1.0))])
    long = df.select(*by, key, F.explode(entries).alias("e")).select(*by, key, "e.score", "e.x")
    long = materialise(long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & (F.col("x") >= least[F.col("score")])))
    group = [*by, "score"]
    long = match(long, exact_median(long, group, "x", [key], "med"), group)
    long = long.withColumn("dev", F.abs(F.col("x") - F.col("med")))
    long = match(long, exact_median(long, group, "dev", [key], "mad"), group)
    long = match(long, long.groupBy(*group).agg(F.avg("dev").alias("mean_dev")), group)
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).when(F.col("mean_dev") > 0, F.col("mean_dev") * MEAN_SCALE).otherwise(1.0)
    z = F.least(F.greatest((F.col("x") - F.col("med")) / scale * sign[F.col("score")], F.lit(-30.0)), F.lit(30.0))
    return long.withColumn("z", z).withColumn("value", 1 / (1 + F.exp(-F.col("z")))).select(*by, key, "score", "z", "value")


def rank_scores(df: DataFrame, by: str, key: str, scores: list[Score], required: str) -> DataFrame:
    """(by, key, graded, combined, rank): one row per row of ``df``, whose ``key`` is unique.

    ``combined`` is the weighted geometric mean of the squashed values a row has (weights renormalised over them), rounded to 9
    places; it is null for a row with none. ``rank`` counts from 1 in each group of ``by`` (null is a group): rows with the
    ``required`` score come before those without it, then more ``combined`` first, then the smaller key, so ties have a fixed order.
    An empty table gives an empty result; other columns of ``df`` are not looked at, whatever their names.
    """
    base = materialise(df.select(by, key, *[F.col(s.column).cast("double").alias(s.column) for s in scores]))
    weight = F.create_map(*[x for s in scores for x in (F.lit(s.column), F.lit(float(s.weight)))])[F.col("score")]
    values = squashed(base, [by], key, scores)
    mean = values.groupBy(key).agg(
        F.round(F.exp(F.sum(weight * F.log("value")) / F.sum(weight)), 9).alias("combined"),
        F.max(F.col("score") == required).alias("graded"),
    )
    rows = base.select(by, key).join(mean, key, "left").withColumn("graded", F.coalesce("graded", F.lit(False)))
    order = [F.col("graded").desc(), F.col("combined").desc_nulls_last(), F.col(key).asc()]
    return ranked(rows.select(by, key, "graded", "combined"), [by], order, "rank")


#: Costs, tokens and durations are positive when measured, totals of five marks at least 1 each are at least 5.
BENCH_SCORES = [
    Score("score_total", True, 1.0, 5.0),
    Score("cost", False, 1.0, 1e-12),
    Score("tokens_total", False, 1.0, 1.0),
    Score("duration_s", False, 1.0, 1e-12),
]


def bench_ranks(bench_results: DataFrame) -> DataFrame:
    """The ranking of ``bench_results``: the row of each result that was loaded last, ranked within its repo.

    Result ids that are null are left out; a null repo is a group of its own.
    """
    flat = bench_results.select(
        "result_id", "repo", F.col("score.total").cast("double").alias("score_total"), "cost",
        F.col("tokens.total").cast("double").alias("tokens_total"), "duration_s", "loaded_at",
    )
    rows = latest(flat, "result_id", [F.col("loaded_at")], ["repo", "score_total", "cost", "tokens_total", "duration_s"])
    return rank_scores(rows, "repo", "result_id", BENCH_SCORES, "score_total")
