"""Session helpers shared by every operator: shared storage, latest rows, ranks and exact quantiles.

Nothing here collects data to the driver; the only actions are writes of slim intermediate tables into the
folder that all executors share (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_LOCAL_DIRS: list[str] = []
_WRITTEN: list[str] = []
_MOUNTED: list[str] = []
_TABLES: dict[str, tuple[str, T.StructType]] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark context, so that their Python workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_mosaiq_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="mosaiq-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/mosaiq_code.zip", "w") as z:
        for where, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(where, n), os.path.relpath(os.path.join(where, n), os.path.dirname(root)))
    context.addPyFile(f"{folder}/mosaiq_code.zip")
    context._mosaiq_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset (tests, a single machine) a temporary folder
    is made and set, so that ``checkpoint()`` works as well.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        for path in _LOCAL_DIRS:
            if os.path.isdir(path):
                there = path
                break
        else:
            there = tempfile.mkdtemp(prefix="mosaiq-")
            _LOCAL_DIRS.append(there)
            atexit.register(shutil.rmtree, there, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def local_path(path: str) -> str:
    """A shared path as the operating system names it."""
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def input_stamp(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of all files below ``paths``: it changes when an input is written again."""
    conf, seen = spark.sparkContext._jsc.hadoopConfiguration(), hashlib.sha256()
    for path in sorted(paths):
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(conf)
        seen.update(fs.makeQualified(there).toString().encode())
        files = fs.listFiles(there, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        seen.update("\n".join(sorted(found)).encode())
    return seen.hexdigest()[:24]


def cached(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table ``name`` of ``inputs``, written once by this process under a stamp of the inputs, and read from there by all later queries.

    Where an input is written again the stamp changes and the table is built anew, as it is where someone has deleted it. Tables belong to the process that wrote them, so processes that share a folder never
    meet in one; they go when it ends, or by :func:`forget`.
    """
    key = f"{shared_dir(spark)} {name} {input_stamp(spark, inputs)}"
    if key not in _TABLES or not _exists(spark, f"{_TABLES[key][0]}/_SUCCESS"):
        df = build()
        path = f"{shared_dir(spark)}/mosaiq-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _note(spark, path)
        _TABLES[key] = (path, df.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may have no scheme, lies in a folder of the operating system as Spark resolves it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: lineage ends there and survives lost executors.

    The files stay until the process ends or :func:`forget` is called, as later queries may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosaiq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _note(spark: SparkSession, path: str) -> None:
    if is_mounted(spark, path):
        written(path)
    else:
        _WRITTEN.append(path)


def written(path: str) -> None:
    """Note a path in a mounted shared folder that this process made: it is deleted when the process ends."""
    if not any(_MOUNTED):
        atexit.register(_sweep, os.getpid())
    _MOUNTED.append(path)
    _WRITTEN.append(path)


def _sweep(process: int) -> None:
    if os.getpid() == process:  # not in forked children
        while _MOUNTED:
            shutil.rmtree(local_path(_MOUNTED.pop()), ignore_errors=True)


def forget(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process from the shared folder; DataFrames built on them can't be read any more. The number of tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    _TABLES.clear()
    _MOUNTED.clear()
    count = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def limit_value(spark: SparkSession, sf_dir: str, name: str, default: int) -> int:
    """One entry of ``task_limits`` (a handful of rows of configuration)."""
    rows = table(spark, sf_dir, "task_limits").where(F.col("limit_name") == name).agg(F.max("limit_value")).collect()
    return default if rows[0][0] is None else int(rows[0][0])


def latest(df: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each ``key`` that is last by ``order``; equal rows collapse, rows without a key are left out.

    Further ties are decided by the kept values, so the result never depends on the order of the input. Rows are
    pre-aggregated before the shuffle, so a key that holds many rows costs one row per task.
    """
    ordinal = [c.alias(f"_order{i}") for i, c in enumerate(order)]
    best = F.max(F.struct(*ordinal, *[F.col(c) for c in keep])).alias("best")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, *[F.col("best")[c].alias(c) for c in keep])


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based position of each row within its ``by`` group, without gathering a group in one task.

    Rows are range-partitioned and sorted by (group, order), so a group that holds a third of all rows spreads over
    many tasks; positions within a task come from ``monotonically_increasing_id`` and are shifted by the number of rows
    of the same group in earlier tasks, a table of at most groups + tasks rows. ``order`` should end in a unique column,
    else equal rows get consecutive positions in arbitrary order. Columns of ``df`` must not be called ``_pos``/``_part``.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    sort = keys + [c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = materialise(placed.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
    out = match(placed, parts.select(*by, "_part", "_shift"), [*by, "_part"])
    return out.select(*df.columns, (F.col("_pos") + F.col("_shift")).alias(name))


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``size`` over the rows before each one in its group; 0 for the first.

    Rows are sorted by range, so a group of any size spreads over tasks: sums within a task are shifted by what earlier tasks hold of the group. Nulls count as 0.
    """
    sort = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    placed = materialise(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()))
    inside = F.sum(size).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy(*by, "_part").agg(F.sum(size).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sums.select(*by, "_part", F.coalesce(earlier, F.lit(0)).alias("_shift"))
    out = match(placed.withColumn("_inside", F.coalesce(inside, F.lit(0))), shift, [*by, "_part"])
    return out.select(*rows.columns, (F.col("_inside") + F.col("_shift")).alias(name))


def match(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``by`` in which null equals null; the result has the columns of ``left``, then the others of ``right``."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    cond = None
    for c in by:
        eq = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in by])


def exact_median(df: DataFrame, by: list[str], value: str, tie: list[str], name: str = "median") -> DataFrame:
    """The exact median of ``value`` in each group (mean of the two middle values of an even number of rows).

    Nulls are left out. Built on :func:`ranked`, so no group is gathered in one task; ``tie`` names columns that make
    equal values distinct, so that even one value that fills a group is spread.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value, *tie)
    rows = ranked(rows, by, [value, *tie], "_rank")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    middle = (F.col("_rank") == F.expr("(_size + 1) div 2")) | (F.col("_rank") == F.expr("_size div 2 + 1"))
    return match(rows, sizes, by).where(middle).groupBy(*by).agg(F.avg(value).alias(name))


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
