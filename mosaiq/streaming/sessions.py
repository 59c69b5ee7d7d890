"""Sessions: what a session has already received isn't sent again. The batch forms use windows, the streaming form keeps keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from mosaiq.functions import text as tx


def session_key(column: str) -> F.Column:
    """A session id of letters, digits, ``-`` and ``_``, at most 80 characters; ``default`` where nothing is left."""
    bare = F.substring(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[^\p{L}\p{N}_-]", ""), 1, 80)
    return F.when(bare == "", "default").otherwise(bare)


def first_sent(events: DataFrame) -> DataFrame:
    """The first event of each (session, unit) of (session, unit, ts, event_id): repeats are dropped, null units too.

    A minimum per key, aggregated before the shuffle, so a session with many repeats costs one row per task.
    """
    rows = events.where("unit IS NOT NULL").groupBy("session", "unit").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return rows.select("session", "unit", "f.ts", "f.event_id")


def read_guard(reads: DataFrame, least: int = 500) -> DataFrame:
    """``reads`` (session, path, lines, whole, stale, ts, event_id) with ``decision``: the first whole read of a file of over ``least`` lines that isn't stale is denied, all else allowed."""
    guarded = F.coalesce(F.col("whole") & (F.col("lines") > least) & ~F.coalesce("stale", F.lit(False)), F.lit(False))
    w = Window.partitionBy("session", "path", "guarded").orderBy("ts", "event_id")
    rows = reads.withColumn("guarded", guarded).withColumn("n", F.row_number().over(w))
    return rows.withColumn("decision", F.when(F.col("guarded") & (F.col("n") == 1), "deny").otherwise("allow")).drop("n", "guarded")


def card_once(reads: DataFrame, least: int = 150) -> DataFrame:
    """The partial reads of files of at least ``least`` lines that get a card: the first for each (session, path), unless a guarded whole read came before."""
    part = reads.where(F.col("whole") | (F.col("lines") >= least))
    w = Window.partitionBy("session", "path").orderBy("ts", "event_id")
    return part.withColumn("n", F.row_number().over(w)).where("n = 1 AND NOT whole").drop("n")


def prompt_gate(prompts: DataFrame) -> DataFrame:
    """Prompts that are questions: neither blank nor commands."""
    return prompts.where("prompt IS NOT NULL AND prompt <> '' AND NOT startswith(ltrim(prompt), '/')")


def grep_names(patterns: DataFrame) -> DataFrame:
    """(event_id, pos, name): up to three identifiers of a search pattern that may name definitions."""
    names = r"filter(regexp_extract_all(coalesce(pattern, ''), r'[A-Za-z_][\p{L}\p{N}_.]{2,}', 0), n -> lower(n) NOT IN ('def', 'class', 'function', 'func', 'const'))"
    return patterns.select("event_id", F.posexplode(F.expr(f"slice({names}, 1, 3)")).alias("pos", "name"))


def definitions(names: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """``names`` (event_id, pos, name) with the symbols each may mean: (event_id, pos, name, n, file_id, i, path, start_line, end_line, kind, symbol, exact).

    A symbol matches by its full name or the last part of it; dots at the end of a name don't count. ``n`` numbers the symbols of a name: full matches first, then by file and
    position; with ``most`` only so many of each name are given. Names without a symbol give no row. Each name is looked up once, however often it is asked.
    """
    asked = names.withColumn("want", F.expr("trim(TRAILING '.' FROM name)")).where("want <> ''")
    wanted = asked.select("want").distinct().withColumn("last", F.expr(tx.last_part("want")))
    s = symbols.where("name IS NOT NULL").select("file_id", "i", "path", "start_line", "end_line", "kind", F.col("name").alias("symbol"), F.expr(tx.last_part("name")).alias("last"))
    found = wanted.join(s, "last").withColumn("exact", F.col("symbol") == F.col("want"))
    n = F.row_number().over(Window.partitionBy("want").orderBy(F.desc("exact"), "file_id", "i")).cast("bigint")
    found = found.withColumn("n", n)
    found = found if most is None else found.where(F.col("n") <= most)
    return asked.join(found, "want").select("event_id", "pos", "name", "n", "file_id", "i", "path", "start_line", "end_line", "kind", "symbol", "exact")


def requests(lines: DataFrame) -> DataFrame:
    """(id, method, params, line) of lines of text (value), each a JSON request; blank and broken lines, and those without a method, fall out. The same for streams."""
    parsed = F.from_json("value", "id bigint, method string, params struct<k: string>", {"mode": "PERMISSIVE"})
    rows = lines.select(parsed.alias("r"), F.col("value").alias("line")).where("r.method IS NOT NULL")
    return rows.select("r.id", "r.method", F.col("r.params.k").alias("params"), "line")


def dispatched(calls: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """(id, line): what each request (id, method, params) hands to its handler, as a line of JSON; methods without a handler give nothing. The same for streams."""
    table = F.create_map(*[F.lit(x) for kv in handlers.items() for x in kv])
    rows = calls.select("id", F.try_element_at(table, F.col("method")).alias("handler"), F.col("params").alias("unit")).where("handler IS NOT NULL")
    return rows.select("id", F.to_json(F.struct("id", "handler", "unit")).alias("line"))


def _judged_stream(events: DataFrame, judge: Callable[[Any, Callable[[str, str], bool]], tuple | None], out: str, idle_ms: int, delay: str) -> DataFrame:
    """What ``judge`` makes of each row of a stream with session, ts and event_id, given a function that says whether the session has a unit of some kind for the first time.

    State is dropped once event time has passed the session's last event by ``idle_ms``, so a run over available data ends.
    """
    columns = [c.split()[0] for c in out.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        units, last = state.get if state.exists else ([], 0)
        seen = set(units)

        def first(kind: str, unit: str) -> bool:
            entry = f"{kind} {unit}"
            fresh = entry not in seen
            seen.add(entry)
            return fresh

        rows = []
        for pdf in frames:
            for row in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
                if row.ts is not pd.NaT:
                    last = max(last, int(row.ts.timestamp() * 1000))
                verdict = judge(row, first)
                if verdict is not None:
                    rows.append((key[0], *verdict))
        state.update((sorted(seen), last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=columns)

    held = "seen array<string>, last bigint"
    return events.withWatermark("ts", delay).groupBy("session").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_first_sent(events: DataFrame, idle_ms: int = 7_200_000, delay: str = "10 minutes") -> DataFrame:
    """:func:`first_sent` over a stream of (session, unit, ts, event_id): state holds the units each session has received.

    It is dropped once event time has passed the session's last event by ``idle_ms``; events later than ``delay`` behind the newest may be judged without it.
    """

    def judge(row: Any, first: Callable[[str, str], bool]) -> tuple | None:
        return (row.unit, row.ts, row.event_id) if row.unit is not None and first("sent", row.unit) else None

    return _judged_stream(events, judge, "session string, unit string, ts timestamp, event_id bigint", idle_ms, delay)


def stream_reads(reads: DataFrame, guard: int = 500, card: int = 150, idle_ms: int = 7_200_000, delay: str = "10 minutes") -> DataFrame:
    """:func:`read_guard` and :func:`card_once` over a stream of (session, path, lines, whole, stale, ts, event_id): (session, event_id, decision, card).

    The first whole read of a long file that isn't stale is denied, and its card counts as given; the first partial read of a file of some length gets the card.
    """

    def judge(row: Any, first: Callable[[str, str], bool]) -> tuple | None:
        if row.path is None:
            return row.event_id, "allow", False
        if row.whole and (row.lines or 0) > guard and not row.stale:
            denied = first("guard", row.path)
            first("card", row.path)
            return row.event_id, "deny" if denied else "allow", False
        return row.event_id, "allow", bool(not row.whole and (row.lines or 0) >= card and first("card", row.path))

    return _judged_stream(reads, judge, "session string, event_id bigint, decision string, card boolean", idle_ms, delay)


def gap_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user with no gap of ``gap`` or more; the same expression serves streams (with a watermark)."""
    rows = events.where("ts IS NOT NULL").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
