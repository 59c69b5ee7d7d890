"""Resolving citations against the symbol table: ``path::Name``, ``path:L3-9``, plain paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx

#: The forms of a citation.
NAMED = r"^([A-Za-z0-9_./@+-]+\.[A-Za-z0-9]+)::([A-Za-z0-9_.$<>~]+(?:::[A-Za-z0-9_.$<>~]+)*)$"
LINES = r"^([A-Za-z0-9_./@+-]+\.[A-Za-z0-9]+)::?L?([0-9]+)(?:-L?([0-9]+))?$"
INLINE = r"`?[A-Za-z0-9_./@+-]+\.[A-Za-z0-9]+::(?:L?[0-9]+-L?[0-9]+|[A-Za-z0-9_.$<>~]+(?:::[A-Za-z0-9_.$<>~]+)*)`?"


def resolve(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (repo, ref, other columns) with ``resolved``: ``path:Lstart-end``, the path of a whole file, or null.

    A name is the symbol of that name, else the symbols with the same last part: one that begins with the first part of the name, else the first. Lines are cut off at the
    end of the file; lines that begin beyond it, unknown paths and names don't resolve.
    """
    bare = refs.select("repo", "ref").distinct().withColumn("r", F.regexp_replace(F.trim("ref"), r"^`+|`+$", ""))
    line = F.col("r").rlike(LINES)
    named = bare.where(F.col("r").rlike(NAMED) & ~line)
    named = named.select("repo", "ref", F.regexp_extract("r", NAMED, 1).alias("path"), F.regexp_replace(F.regexp_extract("r", NAMED, 2), r"[().]+$", "").alias("want"))
    named = named.withColumn("last", F.expr(tx.last_part("want"))).withColumn("first", F.expr(f"coalesce(try_element_at({tx.name_parts('want')}, 1), want)"))
    table = symbols.select("repo", "path", "i", "name", "start_line", "end_line", F.expr(tx.last_part("name")).alias("last"), "file_id")
    pairs = named.join(table, ["repo", "path", "last"])
    tier = F.when(F.col("name") == F.col("want"), 0).when(F.expr("startswith(name, first)"), 1).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("repo", "ref").orderBy(tier, "i", "file_id"))
    by_name = pairs.withColumn("rn", rn).where("rn = 1").select("repo", "ref", F.expr(f"concat(path, ':', {tx.span('start_line', 'end_line')})").alias("resolved"))
    sizes = files.where("path IS NOT NULL").groupBy("repo", "path").agg(F.max("lines").alias("n"))
    at = bare.where(line).select("repo", "ref", F.regexp_extract("r", LINES, 1).alias("path"), F.regexp_extract("r", LINES, 2).cast("bigint").alias("a"), F.expr(f"try_cast(nullif(regexp_extract(r, r'{LINES}', 3), '') AS BIGINT)").alias("b"))
    at = at.join(sizes, ["repo", "path"]).where("a BETWEEN 1 AND n")
    by_line = at.select("repo", "ref", F.expr("concat(path, ':L', CAST(a AS STRING), '-', CAST(least(greatest(a, coalesce(b, a)), n) AS STRING))").alias("resolved"))
    whole = bare.join(sizes.select("repo", F.col("path").alias("r")), ["repo", "r"]).select("repo", "ref", F.col("r").alias("resolved"))
    found = by_name.unionByName(by_line).unionByName(whole)
    return refs.join(found, ["repo", "ref"], "left")


def counts(resolved: DataFrame) -> DataFrame:
    """(ok, bad, ratio): how many citations resolve; the ratio has four places and is 0 without citations."""
    sums = resolved.agg(F.count("resolved").alias("ok"), F.count(F.when(F.col("resolved").isNull(), 1)).alias("bad"))
    return sums.select("ok", "bad", F.bround(F.col("ok") / F.greatest(F.lit(1), F.col("ok") + F.col("bad")), 4).alias("ratio"))


def annotate(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``texts`` (key, repo, text) with ``annotated``: inline ``path::Name`` citations get their lines, or a mark where the path is known but the name isn't.

    Unknown paths stay as they are, and so do texts without citations, nulls among them.
    """
    found = texts.where(F.col("text").rlike(INLINE)).select("key", "repo", F.expr(f"regexp_extract_all(text, r'{INLINE}', 0)").alias("ms"), F.split("text", INLINE, -1).alias("gaps"))
    each = found.select("key", "repo", F.posexplode("ms").alias("k", "ref"))
    done = resolve(each, symbols, files).withColumn("r", F.regexp_replace("ref", "`", ""))
    known = files.where("path IS NOT NULL").select("repo", F.col("path").alias("p"), F.lit(True).alias("known")).distinct()
    done = done.withColumn("p", F.regexp_extract("r", r"^(.*?)::", 1)).join(known, ["repo", "p"], "left")
    as_lines = F.col("r").rlike(LINES)
    text = (
        F.when(as_lines & F.col("known"), F.concat(F.lit("`"), F.expr("regexp_replace(r, r'::L?([0-9]+)(?:-L?([0-9]+))?$', ':L$1-$2')"), F.lit("`")))
        .when(F.col("resolved").isNotNull(), F.concat(F.lit("`"), "r", F.lit("` ("), F.regexp_extract("resolved", r":(L\d+-\d+)$", 1), F.lit(")")))
        .when(F.col("known"), F.concat(F.lit("`"), "r", F.lit("` (unverified)")))
        .otherwise(F.col("ref"))
    )
    text = F.regexp_replace(text, r"-`$", "`")
    lists = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("ts"))
    joined = found.join(lists, "key").select("key", F.expr("concat(array_join(zip_with(slice(gaps, 1, size(gaps) - 1), ts.t, (g, t) -> concat(g, t)), ''), gaps[size(gaps) - 1])").alias("annotated"))
    return texts.join(joined, "key", "left").withColumn("annotated", F.coalesce("annotated", "text"))
