"""Keyed state machines on transformWithState: interviews, task feeds with heartbeats, statuses that expire, first answers.

The same operators run on a stream and on a batch. State lives in the RocksDB state store (one per shuffle partition), so
a key costs what its state holds and a restart goes on from the checkpoint. Event-time timers fire when the watermark
passes them; a batch has no watermark, so :func:`task_feed` adds a clock row per task there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

INTERVIEW_OUT = "session_id long, turn_no int, topic_idx int, depth int, action string, cost_micros long"
FEED_OUT = "task_id string, at_us long, event string, data string"
STATUS_OUT = "provider string, ask_id long, known boolean, reason string"


def stateful(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store, and the coordinator that the stream manager starts."""
    spark.conf.set(PROVIDER, ROCKSDB)
    _ = spark.streams


class Interview(StatefulProcessor):
    """topic, depth, turns and cost so far; the turns' events as a list, from which a lost checkpoint is made again."""

    def __init__(self, topics: int, max_followup: int, limit_micros: int) -> None:
        self.topics, self.max_followup, self.limit = topics, max_followup, limit_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "topic int, depth int, turn int, cost long, finished boolean, last long")
        self.history = handle.getListState("history", "event_id long, turn int, action string")

    def _advance(self, key: Any, rows: Iterator[Row], told: bool) -> Iterator[Row]:  # noqa: ANN401
        topic, depth, turn, cost, finished, last = self.at.get() if self.at.exists() else (0, 0, 0, 0, False, -1)
        for e in sorted(rows, key=lambda r: r["event_id"]):
            if finished or e["event_id"] <= last:
                continue  # a replay, or an answer after the end
            last, turn, cost = e["event_id"], turn + 1, cost + e["cost_micros"]
            if cost >= self.limit:
                action = "finish"
            elif not e["skipped"] and e["decision"] == "followup" and depth < self.max_followup:
                action = "followup"
            else:
                action = "next" if topic + 1 < self.topics else "finish"
            finished = action == "finish"
            self.history.appendValue((last, turn, action))
            if told:
                yield Row(session_id=key[0], turn_no=turn, topic_idx=topic, depth=depth, action=action, cost_micros=cost)
            topic, depth = (topic, depth + 1) if action == "followup" else (topic + (action == "next"), 0)
        self.at.update((topic, depth, turn, cost, finished, last))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        yield from self._advance(key, rows, True)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: ANN401, N802, N803
        for _ in self._advance(key, iter(sorted(initialState["events"], key=lambda e: e["event_id"])), False):
            pass

    def close(self) -> None:
        pass


def interviews(events: DataFrame, topics: int = 5, max_followup: int = 1, limit_micros: int = 300_000, stored: DataFrame | None = None) -> DataFrame:
    """Next action per answered turn: followup, next, finish. Events whose id is not above the last one of their session
    change nothing, so a replay stores no turn twice; events of one micro-batch are taken by id.

    events: session_id, event_id, skipped, decision, cost_micros; ``stored`` (streams only): earlier events of the same columns, from
    which each session's state is rebuilt silently where a checkpoint is lost.
    """
    stateful(events.sparkSession)
    columns = ("session_id", "event_id", "skipped", "decision", "cost_micros")
    initial = None
    if stored is not None:
        each = stored.groupBy("session_id").agg(F.collect_list(F.struct(*columns[1:])).alias("events"))
        initial = each.groupBy("session_id")
    return events.select(*columns).groupBy("session_id").transformWithState(Interview(topics, max_followup, limit_micros), INTERVIEW_OUT, "append", "None", initial)


class TaskFeed(StatefulProcessor):
    """What a reader of a task sees: progress, a heartbeat after ``idle`` microseconds without an event, one end."""

    def __init__(self, idle: int, longest: int, live: bool) -> None:
        self.idle, self.longest, self.live = idle, longest, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "started long, sent long, ended boolean, timer long")

    def _until(self, key: Any, state: list, now: int) -> Iterator[Row]:  # noqa: ANN401
        """Heartbeats and the timeout that are due before ``now``."""
        started, sent, ended, _ = state
        while not ended and min(sent + self.idle, started + self.longest) < now:
            if sent + self.idle < started + self.longest:
                sent += self.idle
                yield Row(task_id=key[0], at_us=sent, event="heartbeat", data=None)
            else:
                ended = True
                yield Row(task_id=key[0], at_us=started + self.longest, event="error", data="timeout")
        state[1], state[2] = sent, ended

    def _keep(self, state: list) -> None:
        started, sent, ended, timer = state
        due = -1 if ended else min(sent + self.idle, started + self.longest) // 1000 + 1  # timers count milliseconds
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        state[3] = due
        self.at.update(tuple(state))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        state = list(self.at.get()) if self.at.exists() else None
        for e in sorted(rows, key=lambda r: (r["ts_us"], r["event"] == "clock", r["event"], r["data"] or "")):
            ts = now if self.live else e["ts_us"]
            if state is None:
                state = [ts, ts, False, -1]
            yield from self._until(key, state, ts)
            if state[2]:
                break
            if e["event"] in ("done", "error"):
                state[2] = True
            if e["event"] in ("done", "error", "progress"):
                state[1] = max(state[1], ts)
                yield Row(task_id=key[0], at_us=ts, event=e["event"], data=e["data"])
        self._keep(state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        if not self.at.exists():
            return
        state = list(self.at.get())
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        yield from self._until(key, state, 1000 * max(now, expiredTimerInfo.getExpiryTimeInMs()))
        state[3] = -1  # this timer is gone
        self._keep(state)

    def close(self) -> None:
        pass


def task_feed(events: DataFrame, idle: int = 15, longest: int = 600, live: bool = False, until: dt.datetime | None = None, late: str = "1 minute") -> DataFrame:
    """task_id, at (timestamp), event, data: what a reader of each task sees.

    events: task_id, ts timestamp, event (start, progress, done, error), data. Progress is passed on; ``idle`` seconds
    without any event give a heartbeat; done or error ends the feed, as does a timeout ``longest`` seconds after its
    first row; what comes after the end is not told. Times are event time, heartbeats come as the watermark (``late``
    behind) passes them, or processing time if ``live``. In a batch, heartbeats are told up to ``until`` (none: up to each task's last row).
    """
    stateful(events.sparkSession)
    d = events.select(F.col("task_id").cast("string").alias("task_id"), "ts", "event", "data")
    if not d.isStreaming and until is not None:
        d = d.unionByName(d.select("task_id").distinct().select("task_id", F.lit(until).cast("timestamp").alias("ts"), F.lit("clock").alias("event"), F.lit(None).cast("string").alias("data")))
    if not live:
        d = d.withWatermark("ts", late)
    d = d.withColumn("ts_us", F.unix_micros("ts"))
    out = d.groupBy("task_id").transformWithState(TaskFeed(idle * 1_000_000, longest * 1_000_000, live), FEED_OUT, "append", "ProcessingTime" if live else "EventTime")
    return out.select("task_id", F.timestamp_micros("at_us").alias("at"), "event", "data")


class Status(StatefulProcessor):
    """One flag per provider, forgotten by the state store when its time to live is over."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reason = handle.getValueState("reason", "reason string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        for e in sorted(rows, key=lambda r: r["id"]):
            if e["kind"] == "mark":
                self.reason.update((e["reason"] or "",))
            elif e["kind"] == "forget":
                self.reason.clear()
            else:
                known = self.reason.exists()
                yield Row(provider=key[0], ask_id=e["id"], known=known, reason=(self.reason.get()[0] or None) if known else None)

    def close(self) -> None:
        pass


def statuses(rows: DataFrame, ttl: int = 60) -> DataFrame:
    """Per ask: provider, ask_id, known (a mark not older than ``ttl`` seconds of processing time exists), reason (null: available).

    rows: provider, id, kind (mark, forget, ask), reason; rows of one micro-batch are taken by id.
    """
    stateful(rows.sparkSession)
    return rows.select("provider", "id", "kind", "reason").groupBy("provider").transformWithState(Status(ttl * 1000), STATUS_OUT, "append", "ProcessingTime")


def statuses_at(rows: DataFrame, ttl: int = 60) -> DataFrame:
    """The batch form of :func:`statuses` over a log with times: each ask sees the last mark or forget before it (by ts, then
    id), if that is younger than ``ttl`` seconds. rows: provider, id, ts, kind, reason."""
    before = Window.partitionBy("provider").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("kind") != "ask", F.struct("ts", "kind", "reason")), ignorenulls=True).over(before)
    d = rows.withColumn("_said", said).filter("kind = 'ask'")
    known = (F.col("_said.kind") == "mark") & (F.unix_micros("ts") - F.unix_micros("_said.ts") < ttl * 1_000_000)
    known = F.coalesce(known, F.lit(False))
    return d.select("provider", F.col("id").alias("ask_id"), known.alias("known"), F.when(known & (F.col("_said.reason") != ""), F.col("_said.reason")).alias("reason"))


class First(StatefulProcessor):
    """The least row of a key, told once the watermark says that no lesser one can come."""

    def __init__(self, names: list[str], schema: str) -> None:
        self.names, self.schema = names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", f"at_us long, rank long, {self.schema}")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        if self.told.exists():
            return
        best = tuple(self.best.get()) if self.best.exists() else None
        old = best
        for e in rows:
            if best is None or (e["_at"], e["_rank"]) < best[:2]:
                best = (e["_at"], e["_rank"], *[e[c] for c in self.names])
        if best != old:
            if old is not None:
                self.handle.deleteTimer(old[0] // 1000 + 1)
            self.best.update(best)
            self.handle.registerTimer(best[0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        if self.best.exists() and not self.told.exists():
            yield Row(**dict(zip(self.names, tuple(self.best.get())[2:], strict=True)))
            self.told.update((True,))
            self.best.clear()

    def close(self) -> None:
        pass


def first_answers(answers: DataFrame, *keys: str, order: str = "answer_id", late: str = "1 hour") -> DataFrame:
    """The first answer to each question, whole: least ts, then least ``order`` (a number); replays of a row change nothing.

    In a batch a partial aggregate, so a key that many rows share is reduced before the shuffle. In a stream a row is told
    when the watermark (``late`` behind) passes it, so what is told is never taken back.
    """
    if not answers.isStreaming:
        best = answers.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in answers.columns]), F.struct("ts", order)).alias("_b"))
        return best.select("_b.*")
    stateful(answers.sparkSession)
    names, schema = answers.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)
    d = answers.withWatermark("ts", late).withColumns({"_at": F.unix_micros("ts"), "_rank": F.col(order).cast("long")})
    return d.groupBy(*keys).transformWithState(First(names, schema), schema, "append", "EventTime")


def reader_ends(readers: DataFrame, states: DataFrame, longest: int = 600, kept: str = "1 day", late: str = "1 minute") -> DataFrame:
    """How each reader's feed ends: reader columns and end_at, event (done, error), status.

    A left outer join, of streams or of tables: a reader that comes after the task's end (at most ``kept`` later) is told
    at once, one whose task does not end within ``longest`` seconds gets a timeout. readers: reader_id, task_id, opened_at;
    states: task_id, ended_at, status, one row per ended task.
    """
    r = readers.withWatermark("opened_at", late)
    s = states.select(F.col("task_id").alias("_task"), "ended_at", "status").withWatermark("ended_at", late)
    limit = F.col("opened_at") + F.expr(f"INTERVAL {longest} SECONDS")
    near = (F.col("ended_at") >= F.col("opened_at") - F.expr(f"INTERVAL {kept}")) & (F.col("ended_at") < limit)
    d = r.join(s, (F.col("task_id") == F.col("_task")) & near, "left_outer")
    event = F.when(F.col("status").isNull() | (F.col("status") == "failed"), "error").otherwise("done")
    return d.select("reader_id", "task_id", "opened_at", F.when(F.col("ended_at").isNull(), limit).otherwise(F.greatest("opened_at", "ended_at")).alias("end_at"), event.alias("event"), F.coalesce("status", F.lit("timeout")).alias("status"))


def relayed(readers: DataFrame, events: DataFrame, states: DataFrame, longest: int = 600, kept: str = "1 day", late: str = "1 minute") -> DataFrame:
    """reader_id, task_id, at, event, data: the progress events a reader sees, from its opening to the end, and the end.

    Progress joins readers by task and time; an end in the channel is not passed on, the stored state decides. events:
    task_id, ts, event, data. Tables in, table out; for streams, :func:`reader_ends` and :func:`seen` are two queries.
    """
    ends = reader_ends(readers, states, longest, kept, late)
    shown = seen(readers, events, longest, late).join(ends.select("reader_id", "end_at"), "reader_id").filter("at < end_at")
    end = ends.select("reader_id", "task_id", F.col("end_at").alias("at"), "event", F.col("status").alias("data"))
    return shown.select("reader_id", "task_id", "at", "event", "data").unionByName(end)


def seen(readers: DataFrame, events: DataFrame, longest: int = 600, late: str = "1 minute") -> DataFrame:
    """Progress events while a reader may listen: an inner join of streams or tables by task and time."""
    r = readers.withWatermark("opened_at", late)
    e = events.filter("event = 'progress'").select(F.col("task_id").alias("_task"), F.col("ts").alias("at"), "event", "data").withWatermark("at", late)
    within = (F.col("at") >= F.col("opened_at")) & (F.col("at") < F.col("opened_at") + F.expr(f"INTERVAL {longest} SECONDS"))
    return r.join(e, (F.col("task_id") == F.col("_task")) & within).select("reader_id", "task_id", "at", "event", "data")
