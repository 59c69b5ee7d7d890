"""A weighted index over units of several types, and ranked search by BM25.

A unit is a row with several text fields of different weight. Weights are whole tenths, so sums are exact in any order. Search takes many
questions at once: their terms meet the postings in one equi-join, hits are summed before they are shuffled, and the best units of each question are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import text as tx

K1, B = 1.2, 0.6


def units(files: DataFrame, symbols: DataFrame, qa: DataFrame) -> DataFrame:
    """(uid, utype, fields array<struct<text, tenths>>): questions, modules, files and symbols of a corpus.

    Sections (headings of prose) are no units of their own; a unit is one row, so all its terms are counted in one task. Modules whose repository and name make the same uid
    are one unit with the fields of all.
    """
    field = lambda c, w: F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(w).alias("tenths"))
    q = qa.select(
        F.concat(F.lit("qa:"), F.col("qa_id")).alias("uid"), F.lit("qa").alias("utype"),
        F.array(field(F.col("q"), 30), field(F.col("a"), 10), field(F.array_join("refs", " "), 10)).alias("fields"),
    )
    m = files.where("module IS NOT NULL").select("repo", "module").distinct()
    m = m.groupBy(F.concat_ws("", F.lit("module:"), "repo", F.lit("/"), "module").alias("uid")).agg(F.collect_list(field(F.col("module"), 20)).alias("fields"))
    m = m.select("uid", F.lit("module").alias("utype"), "fields")
    f = files.select(F.concat(F.lit("file:"), F.col("file_id")).alias("uid"), F.lit("file").alias("utype"), F.array(field(F.col("path"), 20), field(F.col("head"), 10)).alias("fields"))
    s = symbols.where("kind <> 'section' OR kind IS NULL").select(
        F.concat(F.lit("sym:"), F.col("file_id"), F.lit(":"), F.col("i")).alias("uid"), F.lit("sym").alias("utype"),
        F.array(field(F.col("name"), 30), field(F.col("sig"), 10), field(F.col("path"), 5)).alias("fields"),
    )
    return q.unionByName(m).unionByName(f).unionByName(s)


def flow_units(steps: DataFrame) -> DataFrame:
    """The units of flows (doc_id, name, step, ref, note): their names count twice their steps."""
    whole = steps.groupBy("doc_id").agg(F.max("name").alias("name"), F.array_join(F.expr("transform(array_sort(collect_list(struct(step, ref, note))), x -> concat(x.ref, ' ', x.note))"), " ").alias("steps"))
    fields = F.array(*[F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(w).alias("tenths")) for c, w in ((F.col("name"), 20), (F.col("steps"), 10))])
    return whole.select(F.concat(F.lit("flow:"), "doc_id").alias("uid"), F.lit("flow").alias("utype"), fields.alias("fields"))


def with_texts(units: DataFrame, texts: DataFrame, tenths: int = 10) -> DataFrame:
    """``units`` with one more field for those that (uid, text) has something about: cards of files, notes of symbols. Repeated uids are not allowed."""
    more = F.array(F.struct("text", F.lit(tenths).alias("tenths")))
    rows = units.join(texts.where("text <> ''").select("uid", more.alias("more")), "uid", "left")
    return rows.select("uid", "utype", F.when(F.col("more").isNull(), F.col("fields")).otherwise(F.concat("fields", "more")).alias("fields"))


def terms(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column ``term`` in place of ``text``: one row for each index term of the text, as :func:`mosaiq.functions.text.tokens` gives them.

    Words are rows before they are taken apart, so all of it is compiled code without lambdas over arrays.
    """
    rest = [c for c in rows.columns if c != text]
    raw = rows.select(*rest, F.explode(F.expr(tx.matches(text, tx.WORD, tx.SPARK))).alias("_raw"))
    parts = raw.withColumn("_parts", F.expr(tx.split_identifier("_raw")))
    both = "CASE WHEN size(_parts) > 1 THEN concat(array(trim(BOTH '.' FROM lower(_raw))), _parts) ELSE _parts END"
    each = parts.select(*rest, F.expr("size(_parts) > 1").alias("_compound"), F.posexplode(F.expr(both)).alias("_pos", "_part"))
    each = each.select(*rest, F.expr("_compound AND _pos = 0").alias("_whole"), F.lower("_part").alias("_part"))
    each = each.where(F.col("_whole") | ((F.length("_part") > 1) & ~F.col("_part").isin(tx.STOP_WORDS)))
    return each.select(*rest, F.when(F.col("_whole"), F.col("_part")).otherwise(F.expr(tx.stem("_part"))).alias("term"))


def postings(units: DataFrame) -> DataFrame:
    """(uid, utype, term, tenths, len): the weighted frequency of each term in each unit, and the unit's whole length.

    Units without a term have no row: they don't count as units. Units are spread by their id while they are whole texts; their many terms are then counted and
    summed where they are taken apart, without another shuffle.
    """
    rows = units.select("uid", "utype", "fields").repartition("uid").select("uid", "utype", F.explode("fields").alias("f")).where("f.text <> ''")
    rows = terms(rows.select("uid", "utype", F.col("f.tenths").alias("tenths"), F.col("f.text").alias("text")), "text")
    counted = rows.groupBy("uid", "utype", "term").agg(F.sum("tenths").alias("tenths"))
    whole = F.floor(F.sum("tenths").over(Window.partitionBy("uid")) / 10).cast("bigint")
    return counted.withColumn("len", whole)


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): in how many units a term occurs."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Index:
    """Postings (uid, utype, term, tenths, len, df) with the frequency of their term, and one row (n, avg_len) of statistics over all units."""

    postings: DataFrame
    stats: DataFrame


def indexed(postings: DataFrame) -> DataFrame:
    """``postings`` with ``df``, in each file in order of terms, so that readers can pass over those that no question asks for. The join splits terms that are too frequent for a task."""
    return postings.join(term_frequencies(postings), "term").sortWithinPartitions("term").select("uid", "utype", "term", "tenths", "len", "df")


def statistics(postings: DataFrame) -> DataFrame:
    """(n, avg_len): how many units there are and their mean length."""
    lengths = postings.groupBy("uid").agg(F.max("len").alias("len"))
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def search(index: Index | DataFrame, questions: DataFrame, k: int, types: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """(qid, uid, utype, score, rank): the ``k`` best units for each question of (qid, text).

    The score is BM25 over the distinct terms of the question, times the root of the share of its known terms that a unit has. ``types`` restricts
    the units that can be found, not the statistics. Scores are rounded to 9 places; ties go to the greater uid. Questions without a known term,
    null ones among them, find nothing, nor do those whose best unit has less than ``min_score``.
    """
    if isinstance(index, DataFrame):
        index = Index(index.join(term_frequencies(index), "term"), statistics(index))
    asked = questions.select("qid", F.explode(F.array_distinct(F.expr(tx.tokens("text")))).alias("term"))
    # only the postings of asked terms are joined
    asked_for = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    frequencies = asked_for.groupBy("term").agg(F.max("df").alias("df"))
    known = asked.join(frequencies, "term").crossJoin(F.broadcast(index.stats))  # one row
    known = known.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = known.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("qid"))).drop("df")
    found = asked_for if types is None else asked_for.where(F.col("utype").isin(types))
    tf = F.col("tenths") / 10
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = found.join(known, "term").groupBy("qid", "uid", "utype").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("hit"), F.max("known").alias("known"))
    hits = hits.select("qid", "uid", "utype", F.round(F.col("s") * F.sqrt(F.col("hit") / F.col("known")), 9).alias("score"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("uid")))
    hits = hits.withColumn("rank", best.cast("bigint")).where(F.col("rank") <= k)
    if min_score is not None:
        hits = hits.withColumn("_top", F.max("score").over(Window.partitionBy("qid"))).where(F.col("_top") >= min_score).drop("_top")
    return hits


def _field(text: str, tenths: int) -> str:
    return f"{{'text': coalesce({text}, ''), 'tenths': {tenths}}}"


UNITS_SQL = f"""units AS (
  SELECT concat('qa:', qa_id) AS uid, 'qa' AS utype, [{_field('q', 30)}, {_field('a', 10)}, {_field("array_to_string(refs, ' ')", 10)}] AS fields FROM qa_now
  UNION ALL SELECT concat('module:', repo, '/', module), 'module', [{_field('module', 20)}] FROM (SELECT DISTINCT repo, module FROM files_now WHERE module IS NOT NULL)
  UNION ALL SELECT concat('file:', file_id), 'file', [{_field('path', 20)}, {_field('head', 10)}] FROM files_now
  UNION ALL SELECT concat('sym:', file_id, ':', i), 'sym', [{_field('name', 30)}, {_field('sig', 10)}, {_field('path', 5)}] FROM symbols_one WHERE kind <> 'section' OR kind IS NULL)"""
POSTINGS_SQL = f"""fields AS (SELECT uid, utype, unnest(fields) AS f FROM units),
occurrences AS (SELECT uid, utype, unnest({tx.tokens('f.text', tx.DUCK)}) AS term, f.tenths AS tenths FROM fields),
counted AS (SELECT uid, utype, term, sum(tenths) AS tenths FROM occurrences GROUP BY ALL),
postings AS (SELECT uid, utype, term, CAST(tenths AS BIGINT) AS tenths, CAST(floor(sum(tenths) OVER (PARTITION BY uid) / 10) AS BIGINT) AS len FROM counted),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def search_sql(k: int, types: list[str] | None = None) -> str:
    """CTEs from ``postings``, ``df`` and ``questions`` to ``hits``."""
    only = "" if types is None else "WHERE p.utype IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f"""stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT uid, max(len) AS len FROM postings GROUP BY uid)),
known AS (
  SELECT t.qid, t.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, avg_len, count(*) OVER (PARTITION BY t.qid) AS known
  FROM (SELECT DISTINCT qid, unnest({tx.tokens('text', tx.DUCK)}) AS term FROM questions) t JOIN df USING (term) CROSS JOIN stats),
scored AS (
  SELECT k.qid, p.uid, p.utype, round(sum(idf * (tenths / 10) * 2.2::DOUBLE / (tenths / 10 + 1.2::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * len / avg_len))) * sqrt(count(*) / max(known)), 9) AS score
  FROM postings p JOIN known k USING (term) {only} GROUP BY ALL),
hits AS (SELECT qid, uid, utype, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid DESC) AS rank FROM scored QUALIFY rank <= {k})"""
