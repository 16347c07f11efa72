"""Admission by sliding windows, and the streaming forms of ingest.

A call is admitted when fewer than ``limit`` admitted calls of its session, and fewer than ``total`` of all sessions, lie
within their windows; calls that are turned away leave no trace, so a decision depends on the decisions before it and no
count over a frame can stand in for it.  Without the common limit every session is its own fold: rows are partitioned by
session and sorted, and a fold over the sorted rows keeps no more than ``limit`` times of one session.  The common limit makes
one sequence of all calls, which falls apart where no call comes for longer than the windows: nothing is remembered there.
Each such stretch is a sorted fold of its own that keeps ``total`` times and the open sessions.

Calls without a session share one; calls without a time are turned away.  A stamp leaves a window when it is older than the
window, not when it is exactly as old.  Ties are taken in the order of the call's id.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.session import table

# Calls and seconds, of a session and of all sessions.
SESSION_LIMIT, SESSION_WINDOW = 30, 600
TOTAL_LIMIT, TOTAL_WINDOW = 200, 3600


class Log:
    """Times of the calls admitted, of one session or of all."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window, self.stamps = limit, window, deque()

    def full(self, now: float) -> bool:
        while self.stamps and now - self.stamps[0] > self.window:
            self.stamps.popleft()
        return len(self.stamps) >= self.limit

    def wait(self, now: float) -> int:
        """Minutes until the oldest call leaves the window."""
        return int((self.window - (now - self.stamps[0])) / 60) + 1


def admit(calls: DataFrame, limit: int = SESSION_LIMIT, window: float = SESSION_WINDOW, total: int | None = None, total_window: float = TOTAL_WINDOW) -> DataFrame:
    """``call_id, session, allowed, wait`` of ``call_id, session, ts``; ``wait`` in minutes, -1 where all sessions together are at their limit."""
    c = calls.select("call_id", F.coalesce(F.col("session").cast("string"), F.lit("anon")).alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone: Log | None = None
        sessions: dict[str, Log] = {}
        last = None
        for batch in batches:
            out = []
            for session, at, part in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if at is None:
                    out.append((False, 0))
                    continue
                if part != last:
                    everyone = Log(total, total_window) if total else None
                    sessions.clear()
                    last = part
                own = sessions.get(session)
                if own is None:
                    own = sessions[session] = Log(limit, window)
                if everyone and everyone.full(at):
                    out.append((False, -1))
                elif own.full(at):
                    out.append((False, own.wait(at)))
                else:
                    own.stamps.append(at)
                    if everyone:
                        everyone.stamps.append(at)
                    out.append((True, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int32())], names=["call_id", "session", "allowed", "wait"])

    if total:
        rows = stretches(c, max(window, total_window))
    else:
        rows = c.withColumn("part", F.col("session"))
    return rows.repartition("part").sortWithinPartitions("part", "at", "call_id").mapInArrow(fold, "call_id long, session string, allowed boolean, wait int")


def stretches(calls: DataFrame, longest: float) -> DataFrame:
    """Calls with ``part``: the stretch they belong to, between gaps of more than ``longest`` seconds; calls without a time are spread.

    Gaps are looked for between cells of that length, of which there are as many as the time holds, not as there are calls.
    """
    cell = F.floor(F.col("at") / longest)
    cells = calls.filter("at is not null").groupBy(cell.alias("cell")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.orderBy("cell")
    begins = (F.col("lo") - F.lag("hi").over(order) > longest).cast("int")
    parts = cells.select(F.col("cell").alias("of"), F.coalesce(begins, F.lit(0)).alias("begins"), "cell").select("of", F.sum("begins").over(order).alias("part"))
    spread = -1 - F.pmod(F.xxhash64("call_id"), F.lit(64))
    return calls.join(parts, cell == F.col("of"), "left").select(*calls.columns, F.coalesce("part", spread).alias("part"))


def admit_stream(calls: DataFrame, limit: int = SESSION_LIMIT, window: float = SESSION_WINDOW, delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``admit`` without the common limit; ``ts`` gets a watermark, and a session's state ends with its window."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = Log(limit, window)
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            log.stamps.extend(state.get[0])
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "call_id"])
            allowed = []
            for at in pdf["ts"].map(lambda t: t.timestamp()):
                ok = not log.full(at)
                if ok:
                    log.stamps.append(at)
                allowed.append(ok)
            yield pd.DataFrame({"call_id": pdf["call_id"], "session": key[0], "allowed": allowed})
        state.update((list(log.stamps),))
        if log.stamps:
            state.setTimeoutTimestamp(max(int((log.stamps[-1] + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    c = calls.select("call_id", F.coalesce(F.col("session").cast("string"), F.lit("anon")).alias("session"), "ts").withWatermark("ts", delay)
    return c.groupBy("session").applyInPandasWithState(decide, "call_id long, session string, allowed boolean", "stamps array<double>", "append", "EventTimeTimeout")


def new_documents(stream: DataFrame, key: str = "doc_id") -> DataFrame:
    """Streaming form of the manifest check: each key once, remembered in the checkpoint."""
    return stream.dropDuplicates([key])


def _calls(spark, root):
    return table(spark, root, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session"), "ts")


def limiter_sessions(spark, root: str) -> DataFrame:
    """Admission of every event with at most 2 of a user in a day."""
    return admit(_calls(spark, root), 2, 86400).select("call_id", "allowed", "wait")


def limiter_total(spark, root: str) -> DataFrame:
    """Admission of every event with at most 3 of a user and 20 of all in an hour."""
    return admit(_calls(spark, root), 3, 3600, 20, 3600).select("call_id", "allowed", "wait")


def limiter_stats(spark, root: str) -> DataFrame:
    """Calls admitted in the hour up to the last call, with at most 2 of a user in a day, and sessions ever seen."""
    c = _calls(spark, root)
    end = c.agg(F.max("ts").alias("end"))  # one row
    d = admit(c, 2, 86400).join(c.select("call_id", "ts"), "call_id").crossJoin(end)
    return d.agg(F.count_if(F.col("allowed") & (F.col("ts") >= F.col("end") - F.expr("interval 1 hour"))).alias("last_hour"), F.countDistinct("session").alias("sessions"))


QUERIES = {"limiter_sessions": limiter_sessions, "limiter_total": limiter_total, "limiter_stats": limiter_stats}
# The fold of one user by recursion: the state is the list of admitted times.
_SESSIONS = """with recursive e as (select event_id, user_id, ts, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by ts, event_id) i from events),
r(user_id, i, event_id, ts, s, allowed, wait) as (
 select user_id, i, event_id, ts, [t], true, 0 from e where i = 1
 union all
 select e.user_id, e.i, e.event_id, e.ts, case when len(k) < 2 then list_append(k, t) else k end, len(k) < 2, case when len(k) < 2 then 0 else cast(trunc((86400 - (t - k[1])) / 60) as int) + 1 end
 from (select r.user_id, e.i, e.event_id, e.ts, e.t, list_filter(r.s, lambda x: e.t - x <= 86400) k from r join e on e.user_id = r.user_id and e.i = r.i + 1) e)
"""
ORACLES = {
    "limiter_sessions": _SESSIONS + "select event_id call_id, allowed, wait from r",
    "limiter_stats": _SESSIONS + "select count_if(allowed and ts >= (select max(ts) from events) - interval 1 hour) last_hour, count(distinct user_id) sessions from r",
}
