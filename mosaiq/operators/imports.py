"""Which files of a corpus import which: every language's rule as an equi-join on computed keys.

A rule that tries shorter and shorter names becomes a join on all prefixes, of which the longest that exists is kept; one that
looks for a path ending becomes a join on all suffixes. Where the order of candidates decides, it is that of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx
from mosaiq.operators.corpus import raw_imports

JS, C, JVM = ("javascript", "typescript", "vue", "svelte"), ("c", "cpp", "objc"), ("java", "kotlin", "scala", "csharp")
#: Files that stand for their folder; endings that an import of a script may carry.
FOLDER_FILES = ("index", "__init__", "mod", "lib")
SCRIPT_ENDINGS = r"\.(js|ts|mjs|jsx|tsx)$"


def folded_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` components; ``..`` beyond the root stay."""
    start = F.array().cast("array<string>")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def _joined(folder: Column, rest: Column) -> Column:
    return folded_path(F.concat_ws("/", folder, rest))


def _first(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One candidate for each import."""
    w = Window.partitionBy("src", "imp").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")


def import_edges(files: DataFrame, importers: DataFrame | None = None) -> DataFrame:
    """(src, dst): file ids of distinct edges between the current files of one repository, from all of them or from ``importers`` (file_id); files never import themselves.

    Imports that name nothing in the repository give no edge, nor do files without imports, language or path.
    """
    nodes = files.where("path IS NOT NULL AND path <> ''").select("repo", F.col("file_id").alias("dst"), F.col("path").alias("to"), F.col("lang").alias("to_lang"))
    nodes = nodes.withColumn("stem", F.expr(tx.without_extension("to"))).withColumn("dir", F.expr(tx.dirname("to"))).withColumn("base", F.expr(tx.basename("to")))
    nodes = nodes.withColumn("name", F.expr(tx.basename("stem")))
    by_stem = nodes.select("repo", F.col("stem").alias("key"), "dst", "to")
    by_stem = by_stem.unionByName(nodes.where(F.col("name").isin(*FOLDER_FILES)).select("repo", F.col("dir").alias("key"), "dst", "to")).where("key <> ''").distinct()
    of = files if importers is None else files.join(importers, "file_id", "left_semi")
    imps = raw_imports(of).where("path IS NOT NULL").select("repo", F.col("file_id").alias("src"), F.col("path").alias("from"), "lang", "imp")
    imps = imps.withColumn("d", F.expr(tx.dirname("`from`")))
    out = ["src", "dst"]

    # one key, all files of that stem: relative Python and script imports, rooted script imports, Rust modules
    dots = F.length(F.regexp_extract("imp", r"^(\.+)", 1))
    py = imps.where("lang = 'python' AND imp LIKE '.%'")
    py = py.withColumn("base", F.expr("CASE WHEN d = '' THEN array() ELSE split(d, '/') END")).withColumn("n", dots)
    py = py.withColumn("base", F.expr("slice(base, 1, greatest(size(base) - (n - 1), 0))"))
    py = py.withColumn("key", F.array_join(F.concat("base", F.expr("filter(array(replace(ltrim('.', imp), '.', '/')), x -> x <> '')")), "/"))
    js = imps.where(F.col("lang").isin(*JS))
    near = js.where("imp LIKE '.%'").withColumn("key", F.regexp_replace(_joined(F.col("d"), F.col("imp")), SCRIPT_ENDINGS, ""))
    rooted = js.where("imp LIKE '@/%' OR imp LIKE '~/%' OR imp LIKE 'src/%'")
    rooted = rooted.withColumn("key", F.expr(tx.without_extension("concat('src/', regexp_replace(imp, '^[^/]*/', ''))")))
    mods = imps.where("lang = 'rust' AND NOT contains(imp, '::')").withColumn("key", F.expr("ltrim('/', concat(d, '/', imp))"))
    keyed = py.select("repo", "src", "key")
    for part in (near, rooted, mods):
        keyed = keyed.unionByName(part.select("repo", "src", "key"))
    edges = keyed.distinct().join(by_stem, ["repo", "key"]).select(*out)

    # the longest prefix that exists: absolute Python modules, Rust paths from the crate
    pys = nodes.where("to_lang = 'python'").withColumn("parts", F.split("stem", "/"))
    pys = pys.withColumn("parts", F.expr("CASE WHEN parts[size(parts) - 1] = '__init__' THEN slice(parts, 1, size(parts) - 1) ELSE parts END"))
    suffix = F.expr("explode(transform(sequence(1, size(parts)), k -> array_join(slice(parts, k, size(parts)), '.')))")
    modules = pys.where("size(parts) > 0").select("repo", "dst", "to", suffix.alias("key")).groupBy("repo", "key").agg(F.min(F.struct("to", "dst")).alias("best"))
    absolute = imps.where("lang = 'python' AND imp NOT LIKE '.%'").withColumn("parts", F.split("imp", r"\."))
    absolute = absolute.select("repo", "src", "imp", F.expr("explode(transform(sequence(1, size(parts)), k -> struct(k, array_join(slice(parts, 1, k), '.') AS key)))").alias("p"))
    absolute = absolute.select("repo", "src", "imp", "p.k", "p.key").join(modules, ["repo", "key"])
    edges = edges.unionByName(_first(absolute, [F.desc("k")]).select("src", F.col("best.dst").alias("dst")))
    crate = imps.where("lang = 'rust' AND imp LIKE 'crate::%'").withColumn("parts", F.expr("slice(split(imp, '::'), 2, size(split(imp, '::')))"))
    crate = crate.select("repo", "src", "imp", F.expr("explode(flatten(transform(sequence(1, size(parts)), k -> array(struct(k, 0 AS r, array_join(slice(parts, 1, k), '/') AS key), struct(k, 1 AS r, concat('src/', array_join(slice(parts, 1, k), '/')) AS key)))))").alias("p"))
    crate = crate.select("repo", "src", "imp", "p.*").join(by_stem.select("repo", "key").distinct(), ["repo", "key"])
    crate = _first(crate, [F.desc("k"), F.desc("r")]).select("repo", "src", "key")
    edges = edges.unionByName(crate.join(by_stem, ["repo", "key"]).select(*out))

    # Go: the import ends with a folder; the shortest such ending wins by folder order
    go_dirs = nodes.where("`to` LIKE '%.go' AND dir <> ''")
    go = imps.where("lang = 'go'").withColumn("parts", F.split("imp", "/"))
    go = go.select("repo", "src", "imp", F.expr("explode(transform(sequence(1, size(parts)), k -> array_join(slice(parts, k, size(parts)), '/')))").alias("dir"))
    go = _first(go.join(go_dirs.select("repo", "dir").distinct(), ["repo", "dir"]), [F.asc("dir")]).select("repo", "src", "dir")
    edges = edges.unionByName(go.join(go_dirs, ["repo", "dir"]).select(*out))

    # C: the exact path, else the nearest file of that name whose path ends with the include
    c = imps.where(F.col("lang").isin(*C)).withColumn("key", _joined(F.col("d"), F.col("imp")))
    exact = c.join(nodes.select("repo", F.col("to").alias("key"), "dst"), ["repo", "key"])
    edges = edges.unionByName(exact.select(*out))
    rest = c.join(nodes.select("repo", F.col("to").alias("key")).distinct(), ["repo", "key"], "left_anti")
    # the nearest is the shortest path below the deepest folder that both share: folders are keys, so a frequent name meets no pairs
    wanted = rest.select("repo", "imp").distinct()
    ends = nodes.select("repo", "dst", "to", F.expr("explode(transform(sequence(1, size(split(`to`, '/'))), k -> array_join(slice(split(`to`, '/'), k, size(split(`to`, '/'))), '/')))").alias("imp"))
    below = F.expr("explode(transform(sequence(0, size(split({0}, '/')) - 1), k -> struct(k AS depth, array_join(slice(split({0}, '/'), 1, k), '/') AS folder)))".format("`to`"))
    best = ends.join(wanted, ["repo", "imp"]).select("repo", "imp", "dst", "to", below.alias("a"))
    best = best.groupBy("repo", "imp", "a.folder").agg(F.min(F.struct(F.length("to"), "to", "dst")).alias("best"))
    above = F.expr("explode(transform(sequence(0, size(split({0}, '/')) - 1), k -> struct(k AS depth, array_join(slice(split({0}, '/'), 1, k), '/') AS folder)))".format("`from`"))
    asked = rest.select("repo", "src", "imp", above.alias("a")).select("repo", "src", "imp", "a.depth", "a.folder")
    edges = edges.unionByName(_first(asked.join(best, ["repo", "imp", "folder"]), [F.desc("depth")]).select("src", F.col("best.dst").alias("dst")))

    # Java and its kin: the first file of that name whose path ends with the import
    jvm = imps.where(F.col("lang").isin(*JVM)).withColumn("tail", F.expr("replace(imp, '.', '/')")).withColumn("name", F.expr(tx.basename("tail")))
    named = jvm.select("repo", "tail", "name").distinct().join(nodes.select("repo", "name", "dst", "to", "stem"), ["repo", "name"]).where("endswith(stem, tail)")
    named = named.groupBy("repo", "tail").agg(F.min(F.struct("to", "dst")).alias("best"))
    edges = edges.unionByName(jvm.join(named, ["repo", "tail"]).select("src", F.col("best.dst").alias("dst")))

    # Ruby: relative, else below lib
    ruby = imps.where("lang = 'ruby'").withColumn("key", _joined(F.col("d"), F.col("imp")))
    own = ruby.join(by_stem, ["repo", "key"])
    lib = ruby.join(by_stem.select("repo", "key").distinct(), ["repo", "key"], "left_anti").withColumn("key", F.concat(F.lit("lib/"), "imp"))
    edges = edges.unionByName(own.select(*out)).unionByName(lib.join(by_stem, ["repo", "key"]).select(*out))
    return edges.where("src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """The same edges from imported to importing file."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def module_dependencies(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """(repo, module, depends_on): distinct pairs of different modules of (file_id, repo, module) between which an import runs."""
    a = module_of.select(F.col("file_id").alias("src"), "repo", "module")
    b = module_of.select(F.col("file_id").alias("dst"), F.col("module").alias("depends_on"))
    return edges.join(a, "src").join(b, "dst").where("module <> depends_on").select("repo", "module", "depends_on").distinct()


def module_tests(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, module, test_id): the tests of each module, its own and those that import one of its files."""
    tests = files.where(F.coalesce("is_test", F.lit(False))).select("file_id", "repo", "module")
    a = edges.join(tests.select(F.col("file_id").alias("src")), "src")
    touched = a.join(files.select(F.col("file_id").alias("dst"), "repo", "module"), "dst").select("repo", "module", F.col("src").alias("test_id"))
    return tests.select("repo", "module", F.col("file_id").alias("test_id")).unionByName(touched).where("module IS NOT NULL").distinct()
