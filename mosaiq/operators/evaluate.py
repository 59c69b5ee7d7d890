"""Paired comparison of arms, sessions, recall of retrieval, and consistent renaming."""

from __future__ import annotations

import builtins
import keyword
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx
from mosaiq.runtime import latest


def graded(bench_results: DataFrame) -> DataFrame:
    """One row a result, the one loaded last, of those with a total score."""
    flat = bench_results.select(
        "result_id", "repo", "model", "arm", "k", "question", "answer", "cost", "turns", "duration_s", F.col("tokens.total").alias("tokens"), F.col("score.total").alias("total"),
        F.col("score.correctness").alias("correctness"), "loaded_at", "run_at",
    )
    keep = [c for c in flat.columns if c not in ("result_id", "loaded_at", "run_at")]
    return latest(flat, "result_id", [F.col("loaded_at"), F.col("run_at")], keep).where("total IS NOT NULL AND arm IS NOT NULL AND k IS NOT NULL")


def paired(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows of those questions that every arm of their group answered, one row for each (group, k, arm): the last result id."""
    one = rows.groupBy(*group, "k", "arm").agg(F.max("result_id").alias("result_id"))
    rows = rows.join(one.select("result_id"), "result_id", "left_semi")
    arms = rows.groupBy(*group).agg(F.count_distinct("arm").alias("arms"))
    full = rows.groupBy(*group, "k").agg(F.count(F.lit(1)).alias("n")).join(arms, group).where("n = arms").select(*group, "k")
    return rows.join(full, [*group, "k"], "left_semi")


def arm_report(rows: DataFrame, group: list[str], baseline: str = "baseline") -> DataFrame:
    """For each group and arm over the paired questions: means of score, correctness, tokens, cost, turns and time; wins, ties and losses against the baseline."""
    rows = paired(rows, group)
    base = rows.where(F.col("arm") == baseline).select(*group, "k", F.col("total").alias("base"))
    both = rows.join(base, [*group, "k"], "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 9).alias(f"mean_{c}")
    won = lambda test: F.count(F.when(test, 1))
    return both.groupBy(*group, "arm").agg(
        F.count(F.lit(1)).alias("questions"), *[mean(c) for c in ("total", "correctness", "tokens", "cost", "turns", "duration_s")],
        won(F.col("total") > F.col("base")).alias("wins"), won(F.col("total") == F.col("base")).alias("ties"), won(F.col("total") < F.col("base")).alias("losses"),
    )


def sessions(rows: DataFrame, size: int = 8) -> DataFrame:
    """(repo, model, arm, session, steps, tokens, cost, turns, score): every ``size`` consecutive questions are a session; one with fewer than two steps is left out.

    Usage of a session is the sum over its steps.
    """
    s = rows.withColumn("session", F.expr(f"CAST(k div {size} AS BIGINT)"))
    out = s.groupBy("repo", "model", "arm", "session").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"), F.sum("turns").cast("bigint").alias("turns"), F.round(F.avg("total"), 9).alias("score")
    )
    return out.where("steps >= 2")


def last_steps(steps: DataFrame) -> DataFrame:
    """(session, tokens, cost): for cumulative usage the last step of each session (array of struct) is its total; sessions with an error or under two steps fall out."""
    ok = steps.where("size(steps) >= 2 AND NOT exists(steps, s -> s.error IS NOT NULL)")
    return ok.select("session", F.expr("element_at(steps, -1).tokens").alias("tokens"), F.expr("element_at(steps, -1).cost").alias("cost"))


def mentioned_files(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(key, repo, file_id, path): the files of the repository that an answer (key, repo, text) names."""
    pattern = r"[A-Za-z0-9_./-]+\.[A-Za-z0-9]+"
    found = answers.select("key", "repo", F.explode(F.array_distinct(F.expr(tx.matches("coalesce(text, '')", pattern, tx.SPARK)))).alias("path"))
    return found.join(files.select("repo", "path", "file_id"), ["repo", "path"]).select("key", "repo", "file_id", "path").distinct()


def mentioned_names(answers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, repo, part): the identifiers in code spans of an answer that the repository defines (parts of over three characters, no headings)."""
    known = symbols.where("kind <> 'section' OR kind IS NULL").select("repo", F.explode(F.split("name", r"\.")).alias("part")).where("length(part) > 3").distinct()
    spans = answers.select("key", "repo", F.explode(F.expr("regexp_extract_all(coalesce(text, ''), r'`([^`]+)`', 1)")).alias("span"))
    parts = spans.select("key", "repo", F.explode(F.expr("regexp_extract_all(span, r'[A-Za-z_][A-Za-z0-9_]{3,}', 0)")).alias("part")).distinct()
    return parts.join(known, ["repo", "part"]).select("key", "repo", "part")


def recall(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(key, wanted, found, recall) of (key, item) rows: which share of the wanted items was got. Keys that want nothing have no row."""
    hit = got.select("key", "item").distinct().withColumn("hit", F.lit(1))
    rows = wanted.select("key", "item").distinct().join(hit, ["key", "item"], "left")
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


def arm_ratios(report: DataFrame, group: list[str], baseline: str = "baseline") -> DataFrame:
    """(group, arm, cost_ratio, token_ratio, score_gain, pay_back) of :func:`arm_report`: each arm against the baseline of its group.

    ``pay_back`` is how many questions of an arm cost as much as one of them saves; null where nothing is saved, as ratios are where the baseline has none.
    """
    base = report.where(F.col("arm") == baseline).select(*group, F.col("mean_cost").alias("c"), F.col("mean_tokens").alias("t"), F.col("mean_total").alias("s"))
    rows, saved = report.join(base, group), F.col("c") - F.col("mean_cost")
    return rows.select(
        *group, "arm", F.round(F.when(F.col("c") > 0, F.col("mean_cost") / F.col("c")), 6).alias("cost_ratio"), F.round(F.when(F.col("t") > 0, F.col("mean_tokens") / F.col("t")), 6).alias("token_ratio"),
        F.round(F.col("mean_total") - F.col("s"), 6).alias("score_gain"), F.round(F.when(saved > 0, F.col("mean_cost") / saved), 6).alias("pay_back"),
    )


def pack_recall(wanted: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, kind, wanted, found, recall): of the items (key, kind, item) the share that occurs in the pack (key, text) of their key, by kind."""
    one = wanted.select("key", "kind", "item").distinct().join(packed.where("text IS NOT NULL"), "key", "left")
    hit = one.groupBy("key", "kind", "item").agg(F.max(F.coalesce(F.contains("text", "item"), F.lit(False))).alias("hit"))
    out = hit.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("wanted"), F.count_if("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


#: Names that tell no project apart, besides what the language itself defines.
COMMON_NAMES = """self cls args kwargs main setup test tests conftest init name value data path file key items keys values update copy get set run add pop index close open read write load dump
loads dumps call wrapper decorator check process result response request session config app json utils helpers types typing globals logging views debug testing version docs examples src
lib""".split()
RESERVED_NAMES = sorted({*dir(builtins), *keyword.kwlist, *sys.stdlib_module_names, *COMMON_NAMES})


def distinctive(names: DataFrame) -> DataFrame:
    """The names (name) that tell a project apart: not dunder nor reserved, four or more characters, and two words, a capital or seven characters."""
    core = "regexp_replace(name, '^_+|_+$', '')"
    words = f"size(filter(split(regexp_replace({core}, '([a-z0-9])([A-Z])', '$1_$2'), '_'), p -> p <> ''))"
    free = ~F.expr(core).isin(RESERVED_NAMES) & ~F.lower(F.expr(core)).isin(RESERVED_NAMES)
    return names.where(free).where(f"NOT startswith(name, '__') AND length({core}) >= 4 AND ({words} >= 2 OR {core} RLIKE '^[A-Z]' OR length({core}) >= 7)").distinct()


def rename_map(names: DataFrame) -> DataFrame:
    """(name, new_name): a replacement of the same convention for each distinctive name: every word becomes one drawn from its hash.

    Equal words get equal replacements; a name that collides with another or with an original gets ``_x``.
    """
    word = "concat(CASE WHEN p RLIKE '^[A-Z]' THEN 'N' ELSE 'n' END, substr(sha1(lower(p)), 1, 6))"
    spaced = "regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '$1\u0001$2'), '_', '\u0001_\u0001')"
    made = names.select("name", F.expr(f"array_join(transform(split({spaced}, '\u0001'), p -> CASE WHEN p = '_' OR p = '' THEN p ELSE {word} END), '')").alias("new_name"))
    clash = F.row_number().over(Window.partitionBy("new_name").orderBy("name")) - 1
    made = made.withColumn("extra", clash)
    return made.select("name", F.expr("concat(new_name, repeat('_x', CAST(extra AS INT)))").alias("new_name"))


def rename(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``texts`` (key, text) with ``renamed``: whole words replaced by the mapping (name, new_name).

    The texts are taken apart at word borders, words meet the mapping in an equi-join, and the pieces are put together again; the mapping may have any size. Repeated keys are not allowed.
    """
    pieces = texts.where(F.col("text").isNotNull()).select("key", F.posexplode(F.expr("regexp_extract_all(text, r'[A-Za-z0-9_]+|[^A-Za-z0-9_]+', 0)")).alias("pos", "piece"))
    new = pieces.join(mapping.select(F.col("name").alias("piece"), "new_name"), "piece", "left").withColumn("out", F.coalesce("new_name", "piece"))
    whole = new.groupBy("key").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(pos, out))), x -> x.out)"), "").alias("renamed"))
    return texts.join(whole, "key", "left").withColumn("renamed", F.coalesce("renamed", "text"))


def judge_grades(rows: DataFrame) -> DataFrame:
    """The rows whose five marks are all whole numbers from 1 to 20, with their ``total``; others are left out."""
    marks = ["correctness", "completeness", "relevance", "clarity", "reasoning"]
    ok = None
    for m in marks:
        test = F.col(f"score.{m}").between(1, 20)
        ok = test if ok is None else ok & test
    return rows.where(ok).withColumn("total", sum((F.col(f"score.{m}") for m in marks), F.lit(0)))


def proxy_probabilities(chosen: DataFrame) -> DataFrame:
    """(qid, id, p) from the ids a reader lists (qid, ids): the first gets 1, each later one a hundredth less."""
    return chosen.select("qid", F.posexplode("ids").alias("rank", "id")).select("qid", "id", F.greatest(F.lit(0.0), 1.0 - 0.01 * F.col("rank")).alias("p"))
