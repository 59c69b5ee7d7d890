"""Keeping derived tables up to date: what changed, what is stale, what carries over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import latest


def snapshot(files: DataFrame, before: str) -> DataFrame:
    """(file_id, repo, sha, bytes, mtime, module): the current rows as they stood before a time of loading."""
    rows = files.where(F.col("lines").isNotNull() & (F.col("loaded_at") < F.lit(before).cast("timestamp")))
    return latest(rows, "file_id", [F.col("scanned_at"), F.col("loaded_at")], ["repo", "sha", "bytes", "mtime", "module"])


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """(file_id, repo, module, status): ``added`` and ``changed`` files of the new snapshot (sums compared, null as a value), and ``deleted`` ones of the old."""
    pairs = new.alias("n").join(old.alias("o"), "file_id", "full")
    status = (
        F.when(F.col("n.sha").isNull() & F.col("n.repo").isNull() & F.col("n.bytes").isNull(), "deleted")
        .when(F.col("o.sha").isNull() & F.col("o.repo").isNull() & F.col("o.bytes").isNull(), "added")
        .when(~F.col("n.sha").eqNullSafe(F.col("o.sha")), "changed")
    )
    rows = pairs.select("file_id", F.coalesce("n.repo", "o.repo").alias("repo"), F.coalesce("n.module", "o.module").alias("module"), status.alias("status"))
    return rows.where(F.col("status").isNotNull())


def stale(new: DataFrame, old: DataFrame) -> DataFrame:
    """(file_id, stale) for the files of the old snapshot: gone, or another size or time and another sum. The sum is looked at only where size or time differ."""
    o = old.select("file_id", F.col("sha").alias("was"), F.col("bytes").alias("size_was"), F.col("mtime").alias("time_was"))
    pairs = o.join(new.select("file_id", "sha", "bytes", "mtime", F.lit(True).alias("there")), "file_id", "left")
    same = F.col("bytes").eqNullSafe(F.col("size_was")) & F.col("mtime").eqNullSafe(F.col("time_was"))
    return pairs.select("file_id", F.when(F.col("there").isNull(), True).when(same, False).otherwise(~F.col("sha").eqNullSafe(F.col("was"))).alias("stale"))


def dirty_modules(changes: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """(repo, module): modules with an added or changed file, and modules that are new. Deleted files alone don't make a module dirty."""
    touched = changes.where("status <> 'deleted'").select("repo", "module")
    fresh = new.select("repo", "module").distinct().join(old.select("repo", "module").distinct(), ["repo", "module"], "left_anti")
    return touched.unionByName(fresh).where("module IS NOT NULL").distinct()


def carry_over(rows: DataFrame, dirty: DataFrame, alive: DataFrame) -> DataFrame:
    """The rows (repo, module, ...) of modules that still exist and aren't dirty."""
    return rows.join(alive.select("repo", "module").distinct(), ["repo", "module"], "left_semi").join(dirty, ["repo", "module"], "left_anti")


def refreshed(repos: DataFrame, dirty: DataFrame, described: DataFrame) -> DataFrame:
    """(repo, refresh): whether the texts about a whole repository must be written again: a module of it is dirty, or it isn't among those ``described`` (repo) so far."""
    touched = dirty.select("repo").distinct().withColumn("touched", F.lit(True))
    known = described.select("repo").distinct().withColumn("known", F.lit(True))
    rows = repos.select("repo").where("repo IS NOT NULL").distinct().join(touched, "repo", "left").join(known, "repo", "left")
    return rows.select("repo", (F.col("touched").isNotNull() | F.col("known").isNull()).alias("refresh"))


def upgraded(dirty: DataFrame, new: DataFrame, old_mode: str | None, mode: str) -> DataFrame:
    """The dirty modules (repo, module); all there are where a corpus built as structure alone is now built in full."""
    return new.select("repo", "module").where("module IS NOT NULL").distinct() if (old_mode, mode) == ("structure", "full") else dirty


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those with the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def memoised(calls: DataFrame, cache: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache) for ``calls`` (key, prompt): calls whose key is in the cache (key, answer) aren't run again, equal calls run once."""
    todo = calls.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    grown = cache.unionByName(run(todo).select("key", "answer"))
    return calls.join(grown, "key", "left"), grown
