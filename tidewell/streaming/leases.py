"""Jobs with leases as a stream (T01, T03, T05, T06, T08): claims, heartbeats, expiry, retries, cancellation.

Events (job, at, what, writer) may come late, twice or in any order. Each job keeps the events that the
watermark has not reached and its own small state; when the watermark passes an event or the
end of a lease, what is due is worked through in order of time, so the stream tells the transitions that
``history`` tells of the whole table. The state of a job that has ended is kept for ``KEEP`` and then cleared,
so there is state for jobs that live, not for all that ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE, MOST_ATTEMPTS, KEEP = 300, 3, 3600  # seconds, failures, seconds
EVENTS = ("queue", "claim", "beat", "finish", "fail", "cancel")  # in this order at the same moment
TRANSITIONS = "job string, at timestamp, state string, writer string, failures int"
NEW = ("queued", None, 0, None)  # until: the end of a lease or of a retry's delay, in milliseconds


def advance(state: tuple, due: list[tuple], upto: int, lease: int = LEASE, most: int = MOST_ATTEMPTS) -> tuple[tuple, list[tuple]]:
    """The state after the events ``due`` (at, what, writer) and all leases and delays that end by ``upto``; the transitions.

    Only the writer that holds a running job may beat, finish or fail it; a claim takes a queued job only.
    A failure, or a lease that runs out, makes the job wait 2 ** failures seconds, or ends it after ``most``
    failures. A cancelled, done or dead job does not change again.
    """
    told: list[tuple] = []

    def become(at: int, kind: str, writer, failures: int, until) -> None:
        nonlocal state
        if kind != state[0]:
            told.append((at, kind, writer, failures))
        state = (kind, writer, failures, until)

    def failed(at: int) -> None:
        failures = state[2] + 1
        if failures >= most:
            become(at, "dead", state[1], failures, None)
        else:
            become(at, "waiting", None, failures, at + 1000 * 2**failures)

    def time_passes(to: int) -> None:
        while state[3] is not None and state[3] <= to:
            if state[0] == "running":
                failed(state[3])
            else:
                become(state[3], "queued", None, state[2], None)

    for at, what, writer in sorted(due, key=lambda e: (e[0], EVENTS.index(e[1]), e[2] or "")):
        time_passes(at)
        kind, owner, failures, _ = state
        if kind in ("done", "dead", "cancelled"):
            continue
        if what == "cancel":
            become(at, "cancelled", owner, failures, None)
        elif what == "claim" and kind == "queued":
            become(at, "running", writer, failures, at + 1000 * lease)
        elif kind == "running" and writer == owner:
            if what == "beat":
                become(at, "running", owner, failures, at + 1000 * lease)
            elif what == "finish":
                become(at, "done", owner, failures, None)
            elif what == "fail":
                failed(at)
    time_passes(upto)
    return state, told


def _rows(job, told: list[tuple]) -> pd.DataFrame:
    columns = ["job", "at", "state", "writer", "failures"]
    return pd.DataFrame([(job, pd.Timestamp(at, unit="ms"), *rest) for at, *rest in told], columns=columns)


def history(events: DataFrame, lease: int = LEASE, most: int = MOST_ATTEMPTS) -> DataFrame:
    """All transitions of a finished table of events, up to its latest moment; repeated events count once.

    A group is one job: its queueing, claims and heartbeats.
    """
    upto = F.max(F.unix_millis("at")).alias("upto")
    known = events.where("job IS NOT NULL AND at IS NOT NULL").where(F.col("what").isin(*EVENTS))
    timed = known.select("job", F.unix_millis("at").alias("at"), "what", "writer").distinct().join(F.broadcast(known.agg(upto)))  # one row

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        due = list(zip(rows["at"].tolist(), rows["what"], [w if isinstance(w, str) else None for w in rows["writer"]], strict=True))
        return _rows(key[0], advance(NEW, due, int(rows["upto"].iloc[0]), lease, most)[1])

    return timed.groupBy("job").applyInPandas(run, TRANSITIONS)


class _Jobs(StatefulProcessor):
    def __init__(self, lease: int, most: int, keep: int):
        self.lease, self.most, self.keep = lease, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, writer string, failures int, until long")
        self.ahead = handle.getMapState("ahead", "at long, what string, writer string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, what, writer in zip(frame["ms"].tolist(), frame["what"], frame["writer"], strict=True):
                self.ahead.updateValue((int(at), what, writer if isinstance(writer, str) else ""), (1,))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        state = self.state.get() if self.state.exists() else NEW
        state = tuple(None if pd.isna(x) else x for x in state)
        due = sorted(tuple(k) for k in self.ahead.keys() if k[0] <= upto)
        after, told = advance((state[0], state[1], int(state[2]), None if state[3] is None else int(state[3])), [(at, what, writer or None) for at, what, writer in due], upto, self.lease, self.most)
        for k in due:
            self.ahead.removeKey(k)
        ended = after[0] in ("done", "dead", "cancelled")
        if ended and not told and not due and not list(self.ahead.keys()):
            self.state.clear()  # it ended long ago: this is the timer that was set then
            return iter(())
        self.state.update(after)
        if after[3] is not None:
            self.handle.registerTimer(after[3])
        elif ended and told:
            self.handle.registerTimer(upto + 1000 * self.keep)
        return iter([_rows(key[0], told)]) if told else iter(())


def transitions(events: DataFrame, late: str = "10 minutes", lease: int = LEASE, most: int = MOST_ATTEMPTS, keep: int = KEEP) -> DataFrame:
    """The same transitions from a stream of events, each told when the watermark, ``late`` behind, has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    known = events.where("job IS NOT NULL AND at IS NOT NULL").where(F.col("what").isin(*EVENTS)).withWatermark("at", late)
    timed = known.select("job", "at", F.unix_millis("at").alias("ms"), "what", "writer")
    return timed.groupBy("job").transformWithStateInPandas(_Jobs(lease, most, keep), TRANSITIONS, "Append", "EventTime")


def silent_jobs(starts: DataFrame, beats: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Job, at of starts that no heartbeat followed ``within`` the time; streams or tables.

    On streams an outer join by job and interval: a start is told once, when the watermark shows that no beat can come any more.
    """
    s = starts.select("job", "at").withWatermark("at", late)
    b = beats.select(F.col("job").alias("b_job"), F.col("at").alias("b_at")).withWatermark("b_at", late)
    follows = (F.col("job") == F.col("b_job")) & (F.col("b_at") > F.col("at")) & (F.col("b_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return s.join(b, follows, "left_outer").where("b_job IS NULL").select("job", "at")
