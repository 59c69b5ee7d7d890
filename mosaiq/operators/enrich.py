"""Rows written by a model: jobs in, answers out. The model is a function given by the caller; without one a fixed stub answers, and nothing calls a network."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors that trying again doesn't help.
ACCOUNT_LIMIT = re.compile(r"(?=.*limit)(?=.*(?:usage|spend))", re.I | re.S)
Model = Callable[[list[str]], list[str]]


def stub(prompts: list[str]) -> list[str]:
    """Answers that depend on the prompt alone."""
    return [f"stub {hashlib.sha256(p.encode()).hexdigest()[:12]}" for p in prompts]


def complete(jobs: DataFrame, model: Model = stub, batch: int = 32, tries: int = 4, wait_s: float = 5.0) -> DataFrame:
    """``jobs`` (key, prompt) with ``answer`` and ``error``: the model is asked in batches of similar length; a batch that fails is tried again after a growing
    pause, and after ``tries`` its rows carry the error. Limits of an account (usage or spend, as the error says) aren't tried again, those of a rate are. Null prompts get a null answer.
    """
    kind = dict(jobs.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers: list[str | None] = [None] * len(pdf)
            errors: list[str | None] = [None] * len(pdf)
            todo = sorted((i for i, p in enumerate(pdf["prompt"]) if p is not None), key=lambda i: len(pdf["prompt"].iloc[i]))
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for k in range(tries):
                    try:
                        for i, text in zip(part, model([pdf["prompt"].iloc[i] for i in part])):
                            answers[i] = text
                        break
                    except Exception as e:  # noqa: BLE001
                        if k + 1 == tries or ACCOUNT_LIMIT.search(str(e)):
                            for i in part:
                                errors[i] = str(e)[:200]
                            break
                        time.sleep(wait_s * (k + 1))
            yield pd.DataFrame({"key": pdf["key"], "prompt": pdf["prompt"], "answer": answers, "error": errors})

    return jobs.select("key", "prompt").mapInPandas(run, f"key {kind}, prompt string, answer string, error string")


def first_json(text: str | None) -> str | None:
    """The first JSON object or array of a text, as it stands there without trailing commas: inside its first code fence where there is one; null if there is none."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    inner = fence.group(1) if fence else text
    start = re.search(r"[\[{]", inner)
    if not start:
        return None
    rest = inner[start.start() :]
    for candidate in (rest, re.sub(r",(\s*[}\]])", r"\1", rest)):
        try:
            return candidate[: json.JSONDecoder().raw_decode(candidate)[1]]
        except (ValueError, RecursionError):
            continue
    return None


def salvage(text: str = "answer") -> F.Column:
    """:func:`first_json` of a column. Only texts with a bracket leave the engine, as finding where a value ends needs a parser."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(first_json, na_action="ignore").astype(object)

    return F.when(F.col(text).rlike(r"[\[{]"), decode(text))


def cards(answers: DataFrame, jobs: DataFrame) -> DataFrame:
    """File cards from answers (key, answer with JSON) and jobs (key, file_id, part): parts in order, the purpose of the first, summaries joined, lists one after the other."""
    schema = "purpose string, summary string, facts array<string>, gotchas array<string>, questions array<string>"
    rows = jobs.join(answers.select("key", F.from_json(salvage(), schema).alias("c")), "key", "left")
    parts = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("ps"))
    flat = lambda f: F.expr(f"flatten(transform(ps, p -> coalesce(p.c.{f}, array())))").alias(f)
    return parts.select("file_id", F.expr("coalesce(ps[0].c.purpose, '')").alias("purpose"), F.expr("array_join(transform(ps, p -> coalesce(p.c.summary, '')), ' ')").alias("summary"), flat("facts"), flat("gotchas"), flat("questions"))


def question_count(lines: str = "lines", per_kloc: int = 14) -> str:
    """How many questions a chunk of source gets: 14 per thousand lines (half to even), 6 to 40."""
    return f"greatest(6, least(40, CAST(bround({lines} / 1000D * {per_kloc}) AS INT)))"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(qid, vec_id, similarity, rank): the ``k`` nearest of (vec_id, v) for each of (qid, q) by cosine, exactly; ties go to the smaller id. A null or zero vector is near nothing.

    The queries are a stated set, so every block of ``block`` vectors meets every block of queries in one matrix product, and only the ``k`` best of each block go on.
    """

    def blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
        # rows of a partition are numbered, so that a block never holds more than it may
        number = F.expr(f"monotonically_increasing_id() div {block}")
        return rows.withColumn("_b", number).groupBy("_b").agg(F.collect_list("id").alias(f"{key}s"), F.flatten(F.collect_list("x")).alias(f"{vector}s")).drop("_b")

    kinds = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["qid"]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, vs, qids, qs in zip(pdf["vec_ids"], pdf["vs"], pdf["qids"], pdf["qs"]):
                v, q = np.asarray(vs, np.float64).reshape(len(ids), -1), np.asarray(qs, np.float64).reshape(len(qids), -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = np.round((q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]), 6)
                sim[~np.isfinite(sim)] = -np.inf
                ids = np.asarray(ids)
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                near = np.take_along_axis(sim, order, 1)
                rows = pd.DataFrame({"qid": np.repeat(np.asarray(qids), order.shape[1]), "vec_id": ids[order].ravel(), "similarity": near.ravel()})
                yield rows[np.isfinite(rows["similarity"])]

    pairs = blocks(vectors, "vec_id", "v").join(blocks(queries, "qid", "q"), F.lit(True))
    found = pairs.select("vec_ids", "vs", "qids", "qs").mapInPandas(best, f"qid {kinds[1]}, vec_id {kinds[0]}, similarity double")
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
