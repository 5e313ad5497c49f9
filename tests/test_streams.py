"""The stream operators as streams: they give the batch result, go on after a restart, and forget in time."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from inkspan.plans import stream_queries
from inkspan.streaming import sessions

START = datetime.datetime(2024, 1, 1, 12)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    """Every micro-batch starts a Python worker for each partition of its state."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def played(spark, batches, operator, tmp_path, name, **options):
    """Rows of ``operator`` over a stream of the batches, one micro-batch each, restarted from its checkpoint after each."""
    folder, schema = str(tmp_path / name), batches[0].schema
    out = spark.createDataFrame([], operator(batches[0]).schema)
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = operator(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        # with processing-time timers there is always a next batch, so those streams run one at a time
        trigger = {"once": True} if options else {"availableNow": True}
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(**trigger).start()
        assert q.awaitTermination(180)
        if options.get("wait"):
            time.sleep(options["wait"][i])
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def same(a, b):
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def parts(df, n, order="ts"):
    """``df`` in n pieces of rising order."""
    bounds = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0]
    cuts = [None, *bounds, None]
    return [df.filter((F.lit(True) if a is None else F.col(order) >= a) & (F.lit(True) if b is None else F.col(order) < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_interviews_as_a_stream_with_restarts_and_replays(spark, events, tmp_path):
    turns = stream_queries.interview_events(events)
    some = parts(turns, 2, "event_id")
    replay = some[0].unionByName(some[1])  # the second batch repeats the first one
    same(played(spark, [some[0], replay], sessions.interviews, tmp_path, "machine"), sessions.interviews(turns).collect())


def test_a_lost_checkpoint_is_rebuilt_from_stored_turns(spark, tmp_path):
    schema = "session_id long, event_id long, skipped boolean, decision string, cost_micros long"
    rows = [(1, 1, False, "followup", 10), (1, 2, False, "followup", 10), (1, 3, False, "next", 10), (2, 1, True, "followup", 10), (1, 4, True, "next", 400_000), (1, 5, False, "next", 1)]
    stored, fresh = spark.createDataFrame(rows[:4], schema), spark.createDataFrame([rows[2], *rows[4:]], schema)
    got = played(spark, [fresh], lambda s: sessions.interviews(s, stored=stored) if s.isStreaming else sessions.interviews(s), tmp_path, "rebuilt")
    assert [(r["session_id"], r["turn_no"], r["topic_idx"], r["depth"], r["action"], r["cost_micros"]) for r in got] == [(1, 4, 2, 0, "finish", 400_030)]


def test_task_feed_as_a_stream_equals_the_batch(spark, events, tmp_path):
    tasks = stream_queries.task_events(events)
    last = events.agg(F.max("ts")).first()[0]
    feed = lambda e: sessions.task_feed(e, 6 * 3600, 5 * 86400, until=last, late="0 seconds")
    same(played(spark, parts(tasks, 2), feed, tmp_path, "feed"), feed(tasks).collect())


def test_a_silent_task_gets_heartbeats_and_a_timeout(spark, tmp_path):
    schema = "task_id string, ts timestamp, event string, data string"
    first = spark.createDataFrame([("a", at(0), "start", None), ("b", at(0), "progress", "x"), ("b", at(3), "done", None), ("b", at(4), "progress", "too late")], schema)
    clock = spark.createDataFrame([("other", at(100), "progress", None)], schema)  # moves the watermark, not task a
    feed = lambda e: sessions.task_feed(e, 15, 50, late="0 seconds")
    got = played(spark, [first, clock], feed, tmp_path, "silent")
    told = lambda task: [(r["at"], r["event"], r["data"]) for r in sorted(got, key=lambda r: r["at"]) if r["task_id"] == task]
    assert told("a") == [(at(15), "heartbeat", None), (at(30), "heartbeat", None), (at(45), "heartbeat", None), (at(50), "error", "timeout")]
    assert told("b") == [(at(0), "progress", "x"), (at(3), "done", None)]


def test_live_heartbeats_come_by_the_clock(spark, tmp_path):
    """A session opens and nothing else happens: a heartbeat by processing time, also after a restart."""
    schema = "task_id string, ts timestamp, event string, data string"
    opened = spark.createDataFrame([("a", at(0), "start", None)], schema)
    other = spark.createDataFrame([("b", at(0), "start", None)], schema)
    got = played(spark, [opened, other], lambda e: sessions.task_feed(e, 1, 600, live=True), tmp_path, "live", wait=[2, 0])
    assert {r["event"] for r in got if r["task_id"] == "a"} == {"heartbeat"}


def test_status_expires_and_stays_gone_after_a_restart(spark, tmp_path):
    schema = "provider string, id long, kind string, reason string"
    batches = [[("p", 1, "mark", "no balance"), ("q", 1, "mark", ""), ("r", 1, "mark", "x"), ("r", 2, "forget", None)], [("p", 2, "ask", None), ("q", 2, "ask", None), ("r", 3, "ask", None)], [("p", 3, "ask", None), ("q", 3, "ask", None)]]
    got = played(spark, [spark.createDataFrame(b, schema) for b in batches], lambda e: sessions.statuses(e, 30), tmp_path, "status", wait=[0, 31, 0])
    assert {(r["provider"], r["ask_id"]): (r["known"], r["reason"]) for r in got} == {("p", 2): (True, "no balance"), ("q", 2): (True, None), ("r", 3): (False, None), ("p", 3): (False, None), ("q", 3): (False, None)}


def test_first_answers_as_a_stream(spark, tmp_path):
    schema = "question long, ts timestamp, answer_id long, text string"
    rows = [(1, at(5), 2, "later"), (1, at(1), 4, "tie, higher id"), (1, at(1), 3, "first"), (2, at(2), 9, "only"), (1, at(1), 3, "first")]
    more = [(1, at(8000), 1, "much later"), (2, at(2), 9, "only"), (3, at(8000), 5, "other"), (3, at(7999), 6, "earlier")]
    end = [(9, at(40_000), 1, "moves the watermark")]
    frames = [spark.createDataFrame(x, schema) for x in (rows, more, end)]
    first = lambda e: sessions.first_answers(e, "question")
    want = [tuple(r) for r in first(frames[0].unionByName(frames[1])).collect()]
    assert sorted(want) == [(1, at(1), 3, "first"), (2, at(2), 9, "only"), (3, at(7999), 6, "earlier")]
    same(played(spark, frames, first, tmp_path, "once"), want)


def test_ends_of_readers_join_two_streams(spark, tmp_path):
    """Late readers get the end at once, readers of a task without a state a timeout when the watermarks have passed."""
    readers = [(1, "a", at(0)), (2, "a", at(500)), (3, "never", at(10)), (4, "slow", at(0)), (5, "failed", at(0))]
    states = [("a", at(100), "success"), ("slow", at(700), "success"), ("failed", at(30), "failed")]
    far = at(400_000)
    r1, r2 = (spark.createDataFrame(x, "reader_id long, task_id string, opened_at timestamp") for x in (readers, [(6, "z", far)]))
    s1, s2 = (spark.createDataFrame(x, "task_id string, ended_at timestamp, status string") for x in (states, [("y", far, "success")]))
    want = {1: (at(100), "done", "success"), 2: (at(500), "done", "success"), 3: (at(610), "error", "timeout"), 4: (at(600), "error", "timeout"), 5: (at(30), "error", "failed")}
    shaped = lambda rows: {r["reader_id"]: (r["end_at"], r["event"], r["status"]) for r in rows}
    assert shaped(sessions.reader_ends(r1, s1).collect()) == want
    base = str(tmp_path / "join")
    for i, (r, s) in enumerate(((r1, s1), (r2, s2))):
        r.coalesce(1).write.mode("append").parquet(f"{base}/readers")
        s.coalesce(1).write.mode("append").parquet(f"{base}/states")
        ends = sessions.reader_ends(spark.readStream.schema(r1.schema).parquet(f"{base}/readers"), spark.readStream.schema(s1.schema).parquet(f"{base}/states"))
        q = ends.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    assert shaped(spark.read.parquet(f"{base}/out").collect()) == want


def test_progress_is_told_until_the_stored_state_ends_it(spark):
    readers = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(60)), (3, "a", at(300))], "reader_id long, task_id string, opened_at timestamp")
    events = spark.createDataFrame([("a", at(20), "progress", "20 %"), ("a", at(50), "done", "not passed on"), ("a", at(95), "progress", "95 %"), ("a", at(101), "progress", "after the end")], "task_id string, ts timestamp, event string, data string")
    states = spark.createDataFrame([("a", at(100), "success")], "task_id string, ended_at timestamp, status string")
    got = {}
    for r in sorted(sessions.relayed(readers, events, states).collect(), key=lambda r: r["at"]):
        got.setdefault(r["reader_id"], []).append((r["at"], r["event"], r["data"]))
    assert got == {
        1: [(at(20), "progress", "20 %"), (at(95), "progress", "95 %"), (at(100), "done", "success")],
        2: [(at(95), "progress", "95 %"), (at(100), "done", "success")],
        3: [(at(300), "done", "success")],
    }
