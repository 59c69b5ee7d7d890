"""The link graph between symbols, and spans within files: enclosing containers, sections, definitions of declarations.

All range joins carry the file as an equi-key, so none compares symbols of different files.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx
from mosaiq.runtime import materialise

#: The lines of a body that are read, the candidates a name may have without and with a near one.
BODY_LINES, FEW, MOST = 401, 2, 3


def bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, i, repo, body): the text of each symbol's lines, as far as the file's text is at hand; sections and prose have none."""
    rows = _with_body(symbols).join(_texts(files), "file_id")
    size = f"least(end_line - start_line + 1, {BODY_LINES})"
    rows = rows.where("start_line <= size(lines) AND end_line >= start_line")
    return rows.select("file_id", "i", "repo", F.expr(f"array_join(slice(lines, start_line, {size}), '\\n')").alias("body"))


def _with_body(symbols: DataFrame) -> DataFrame:
    return symbols.where("(kind <> 'section' OR kind IS NULL) AND start_line >= 1").select("file_id", "i", "repo", "start_line", "end_line")


def _texts(files: DataFrame) -> DataFrame:
    """(file_id, lines) of files other than prose."""
    return files.where("head IS NOT NULL AND NOT coalesce(path RLIKE '\\\\.(md|rst|txt)$', false)").select("file_id", F.split("head", "\n").alias("lines"))


def link_targets(symbols: DataFrame) -> DataFrame:
    """The symbols that a name can refer to: no sections, and the last part of the name has three characters and isn't dunder."""
    rows = symbols.where("(kind <> 'section' OR kind IS NULL) AND name IS NOT NULL").withColumn("tail", F.expr(tx.tail("name")))
    return rows.where("length(tail) >= 3 AND NOT (tail LIKE '\\\\_\\\\_%' AND tail LIKE '%\\\\_\\\\_')")


def link_graph(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_file, src_i, dst_file, dst_i): the symbols each symbol's body refers to by name.

    A name with one other symbol links to it; one with several links to those in the same or an imported file (at most ``MOST`` by path and position), or,
    where there is none, to both of two. A frequent name is joined only with the near files, so it never meets all symbols that share it.
    Symbols that contain one another aren't linked.
    """
    near = edges.select(F.col("src").alias("file_id"), F.col("dst").alias("dst_file"))
    near = near.unionByName(files.select("file_id", F.col("file_id").alias("dst_file"))).distinct()
    return _resolved(_words(bodies(symbols, files)), _targets(symbols), near, symbols)


def links_of(seeds: DataFrame, symbols: DataFrame, files: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(src_file, src_i, dst_file, dst_i): the links of :func:`link_graph` from or to one of ``seeds`` (file_id, i).

    How a word is resolved depends on no other word, so only the words of the seeds and the uses of their names are: the texts of all files are read, but nothing of them is shuffled
    but where these names stand. ``edges_of`` gives the import edges of the files (file_id) that have these words.
    """
    named = materialise(_targets(symbols.join(seeds, ["file_id", "i"], "left_semi")).select("repo", "tail").distinct())
    own = _words(bodies(symbols.join(seeds, ["file_id", "i"], "left_semi"), files.join(seeds, "file_id", "left_semi")))
    lines = _texts(files).select("file_id", F.posexplode("lines").alias("k", "text"))
    places = lines.select("file_id", (F.col("k") + 1).alias("line"), F.explode(F.array_distinct(F.expr(tx.matches("text", tx.IDENTIFIER, tx.SPARK)))).alias("tail"))
    places = places.join(named.select("tail"), "tail", "left_semi")
    inside = f"line BETWEEN start_line AND least(end_line, start_line + {BODY_LINES - 1})"
    users = _with_body(symbols).join(places, "file_id").where(inside).join(named, ["repo", "tail"], "left_semi").join(seeds, ["file_id", "i"], "left_anti")
    words = materialise(own.unionByName(users.select("repo", "file_id", "i", "tail").distinct()))
    targets = materialise(_targets(symbols).join(words, ["repo", "tail"], "left_semi"))
    several = targets.groupBy("repo", "tail").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of = materialise(words.join(several, ["repo", "tail"], "left_semi").select("file_id").distinct())  # others need no near file
    near = edges_of(of).select(F.col("src").alias("file_id"), F.col("dst").alias("dst_file"))
    near = materialise(near.unionByName(of.select("file_id", F.col("file_id").alias("dst_file"))).distinct())
    found = materialise(_resolved(words, targets, near, symbols))
    touched = seeds.select(F.col("file_id").alias("dst_file"), F.col("i").alias("dst_i"))
    back = found.join(touched, ["dst_file", "dst_i"], "left_semi")
    out = found.join(seeds.select(F.col("file_id").alias("src_file"), F.col("i").alias("src_i")), ["src_file", "src_i"], "left_semi")
    return out.unionByName(back).distinct()


def _words(rows: DataFrame) -> DataFrame:
    """(repo, file_id, i, tail): the distinct identifiers of each body."""
    return rows.select("repo", "file_id", "i", F.explode(F.array_distinct(F.expr(tx.matches("body", tx.IDENTIFIER, tx.SPARK)))).alias("tail"))


def _targets(symbols: DataFrame) -> DataFrame:
    return link_targets(symbols).select("repo", F.col("file_id").alias("dst_file"), F.col("i").alias("dst_i"), F.col("path").alias("dst_path"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), "tail")


def _resolved(words: DataFrame, targets: DataFrame, near: DataFrame, symbols: DataFrame) -> DataFrame:
    """The links of ``words`` (repo, file_id, i, tail; no row twice), given all targets of their names and the near files (file_id, dst_file) of theirs."""
    near = near.withColumn("near", F.lit(True))
    shared = targets.groupBy("repo", "tail").agg(F.count(F.lit(1)).alias("n_all"))
    words = words.join(shared, ["repo", "tail"])
    rare = words.where(F.col("n_all") <= FEW + 1).join(targets, ["repo", "tail"]).where("NOT (file_id = dst_file AND i = dst_i)")
    rare = rare.join(near, ["file_id", "dst_file"], "left")
    word = Window.partitionBy("file_id", "i", "tail")
    rare = rare.withColumn("n", F.count(F.lit(1)).over(word)).withColumn("some", F.max(F.coalesce("near", F.lit(False))).over(word))
    rare = rare.where("n = 1 OR coalesce(near, false) OR (NOT some AND n <= 2)")
    often = words.where(F.col("n_all") > FEW + 1).join(near, "file_id").join(targets, ["repo", "tail", "dst_file"]).where("NOT (file_id = dst_file AND i = dst_i)")
    keep = ["file_id", "i", "tail", "dst_file", "dst_i", "dst_path", "a", "b"]
    rows = rare.select(*keep).unionByName(often.select(*keep))
    first = F.row_number().over(word.orderBy("dst_path", "dst_file", "dst_i"))
    rows = rows.withColumn("rn", first).where(F.col("rn") <= MOST)
    own = symbols.select("file_id", "i", F.col("start_line").alias("sa"), F.col("end_line").alias("sb"))
    rows = rows.join(own, ["file_id", "i"]).where("NOT (file_id = dst_file AND ((sa <= a AND b <= sb) OR (a <= sa AND sb <= b)))")
    return rows.select(F.col("file_id").alias("src_file"), F.col("i").alias("src_i"), "dst_file", "dst_i").distinct()


def enclosing(symbols: DataFrame) -> DataFrame:
    """(file_id, i, qualified): functions and methods without a dot in their name, with the names of all containers around them, inner ones first.

    One sweep over the symbols of a file in order of their lines, with a stack of the open containers; files without both kinds of symbols aren't looked at.
    """
    inner = F.col("kind").isin("method", "function") & ~F.contains("name", F.lit("."))
    rows = symbols.where("name IS NOT NULL AND start_line IS NOT NULL").withColumn("inner", F.coalesce(inner, F.lit(False)))
    rows = rows.withColumn("outer", F.coalesce(F.col("kind").isin("class", "impl", "type", "module"), F.lit(False))).where("inner OR outer")
    both = rows.groupBy("file_id").agg(F.max("inner").alias("a"), F.max("outer").alias("b")).where("a AND b").select("file_id")
    rows = rows.join(both, "file_id", "left_semi").select("file_id", "i", "name", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "inner", "outer")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        out, open_ = [], []
        for r in pdf.sort_values(["start_line", "i"]).itertuples(index=False):
            open_ = [c for c in open_ if c[1] >= r.start_line]
            around = [c for c in open_ if c[0] < r.start_line and r.end_line <= c[1]]
            if r.inner and around:
                out.append((r.file_id, r.i, ".".join([c[2] for c in reversed(around)] + [r.name])))
            if r.outer:
                open_.append((r.start_line, r.end_line, r.name))
        return pd.DataFrame(out, columns=["file_id", "i", "qualified"])

    return rows.groupBy("file_id").applyInPandas(sweep, "file_id bigint, i int, qualified string")


def sections(headings: DataFrame) -> DataFrame:
    """(file_id, i, start_line, end_line) for headings (file_id, i, line, level, lines): a section ends before the next of its level or above.

    For each of the three levels a window looks for the next heading of that level or above, so no heading meets another in a join.
    """
    after = Window.partitionBy("file_id").orderBy("line", "i").rowsBetween(1, Window.unboundedFollowing)
    following = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in (1, 2, 3)]
    end = F.when(F.col("level") == 1, following[0]).when(F.col("level") == 2, following[1]).otherwise(following[2]) - 1
    return headings.select("file_id", "i", F.col("line").alias("start_line"), F.coalesce(end, "lines").alias("end_line"))


def definitions(symbols: DataFrame) -> DataFrame:
    """(file_id, i, def_file, def_i): the definition of each declared member, by its last two name parts; of several, one in the same folder, then one of
    the same file stem, then the first by path and position."""
    two = lambda c: F.expr(f"array_join(slice({tx.name_parts(c)}, -2, 2), '.')")
    declared = symbols.where("kind = 'declaration'").select("repo", "file_id", "i", "path", two("name").alias("key"))
    defined = symbols.where("kind = 'method' AND contains(name, '::')").select("repo", F.col("file_id").alias("def_file"), F.col("i").alias("def_i"), F.col("path").alias("def_path"), two("name").alias("key"))
    pairs = declared.join(defined, ["repo", "key"])
    same = F.expr(f"{tx.dirname('path')} = {tx.dirname('def_path')}").cast("int")
    stem = F.expr(f"startswith({tx.basename('def_path')}, {tx.without_extension(tx.basename('path'))})").cast("int")
    w = Window.partitionBy("file_id", "i").orderBy(same.desc(), stem.desc(), "def_path", "def_i")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file_id", "i", "def_file", "def_i")
