"""Mixing sources to target weights by Poisson replication.

How often a document comes into the mix is drawn from a Poisson distribution, cut off at the cap of its source, by inverting it at a
hash of the document: any executor draws the same number, and no state is kept. The mean of each source is set so that the expected
size of its share is the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.encode import encode
from mosaiq.runtime import materialise


def allot(sizes: dict[str, float], weights: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """How much each source gives to a mix of ``total``: in proportion to the weights, but at most cap times its size.

    What a source can't give is shared out among the others by weight, until the total is reached or all are at their caps.
    """
    room = {s: sizes.get(s, 0.0) * max(0, caps[s]) for s in weights}
    given = dict.fromkeys(weights, 0.0)
    open_ = {s for s in weights if room[s] > 0 and weights[s] > 0}
    left = total
    while open_ and left > 1e-9 * max(total, 1.0):
        sum_w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / sum_w >= room[s]}
        if not full:
            for s in open_:
                given[s] = left * weights[s] / sum_w
            break
        for s in full:
            given[s] = room[s]
        left -= sum(room[s] for s in full)
        open_ -= full
    return given


def poisson_steps(rate: float, cap: int) -> tuple[int, list[float]]:
    """(least, cumulative probabilities of least, least + 1, ...) of a Poisson distribution cut off at ``cap`` whose mean is ``rate``.

    A draw u is ``least`` plus the number of steps that are at most u. Numbers so rare that their probability rounds away have no step, so the list grows with
    the root of the rate and not with the cap.
    """
    if rate <= 0 or cap <= 0:
        return 0, []
    if rate >= cap:
        return cap, []

    def steps(lam: float) -> tuple[int, list[float]]:
        width = int(12 * math.sqrt(lam) + 60)
        first, last = max(0, int(lam) - width), min(cap - 1, int(lam) + width)
        total, out = 0.0, []
        for k in range(first, last + 1):
            total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
            out.append(min(1.0, total))
        return min(first, cap), out

    def mean(lam: float) -> float:
        first, out = steps(lam)
        return first + sum(1 - x for x in out)

    low, high = 0.0, 1.0
    while mean(high) < rate and high < 4 * cap + 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return steps((low + high) / 2)


def source_key(column: str) -> F.Column:
    """A source name without case and outer blanks; blank names are null."""
    bare = F.lower(F.regexp_replace(F.col(column), r"^[\s  -​　﻿]+|[\s  -​　﻿]+$", ""))
    return F.when(bare != "", bare)


def mix_sources(sized: DataFrame, targets: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """(doc_id, source, copy, n_tokens, place): the documents of the mix, each as often as drawn, in a random global order by ``place``.

    ``sized`` is (doc_id, source, n_tokens), ``targets`` is (source, weight, max_repeats), a configuration that the driver reads. The size aimed at is
    ``percent`` of all tokens, those of sources without target too. Documents without a target for their source (null or blank names among them) or without
    tokens are left out; targets without documents give nothing, and what they leave is shared by the others. Repeated targets of a source add
    their weights and take the least cap; null weights or caps count as 0. Copies have numbers from 1 to at most the cap.
    """
    spark = sized.sparkSession
    sized = sized.select("doc_id", source_key("source").alias("source"), "n_tokens")
    wanted = targets.select(source_key("source").alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))
    wanted = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("weight"), F.min("cap").alias("cap"))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    whole = sizes.agg(F.sum("tokens")).collect()[0][0] or 0
    # the plan is made by the driver from the targets, a configuration; it meets the documents in an equi-join, broadcast only if its measured size allows
    rows = wanted.join(sizes, "source", "left").collect()
    size = {r["source"]: float(r["tokens"] or 0) for r in rows}
    caps = {r["source"]: int(r["cap"]) for r in rows}
    given = allot(size, {r["source"]: float(r["weight"]) for r in rows}, caps, whole * percent / 100)
    plan = [(s, *poisson_steps(given[s] / size[s], caps[s])) for s in given if size[s] > 0 and given[s] > 0]
    steps = spark.createDataFrame(plan, "source string, least int, steps array<double>")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    drawn = sized.where(F.col("n_tokens") > 0).join(steps, "source").withColumn("u", unit)
    drawn = drawn.withColumn("times", F.expr("least + size(filter(steps, x -> u >= x))")).where("times > 0")
    copies = drawn.select("doc_id", "source", F.explode(F.expr("sequence(1, times)")).alias("copy"), "n_tokens")
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy")))
    return copies.repartitionByRange("place").sortWithinPartitions("place", "doc_id", "copy")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, documents, copies, tokens, share): what each source with a target or with documents in the mix really gives."""
    actual = mix.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"))
    whole = actual.agg(F.sum("tokens").alias("whole"))
    wanted = targets.select(source_key("source").alias("source"), "weight").groupBy("source").agg(F.sum("weight").alias("weight"))
    both = wanted.join(actual, "source", "full").crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    share = F.when(F.col("whole") > 0, F.coalesce("tokens", F.lit(0)) / F.col("whole")).otherwise(0.0)
    return both.select("source", "weight", zero("documents"), zero("copies"), zero("tokens"), share.alias("share"))


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, by a public tokenizer."""
    return materialise(encode(documents, vocabulary=vocabulary, ids=False, keep=("source",)))
