"""Queries of the stream operators, run as batches over the event log, with DuckDB SQL.

Users stand for sessions, tasks and providers; an event's type says what happened. tests/test_streams.py runs the same
operators as streams and compares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.plans.bindings import table
from inkspan.plans.queries import query
from inkspan.streaming import sessions


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def interview_events(events: DataFrame) -> DataFrame:
    """Errors as skipped questions, clicks as answers that ask for a follow-up; the counter in props is the cost."""
    return events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        (F.col("event_type") == "error").alias("skipped"),
        F.when(F.col("event_type").isin("click", "view"), "followup").otherwise("next").alias("decision"),
        (F.get_json_object("props", "$.k").cast("long") * 1000).alias("cost_micros"),
    )


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type = 'error' AS skipped, event_type IN ('click', 'view') AS wants, CAST(json_extract(props, '$.k') AS BIGINT) * 1000 AS c FROM events),
 m AS (SELECT DISTINCT user_id, 0::BIGINT AS turn_no, 0 AS at_topic, 0 AS at_depth, NULL::INTEGER AS topic_idx, NULL::INTEGER AS depth, ''::VARCHAR AS action, 0::BIGINT AS cost_micros FROM e
 UNION ALL SELECT user_id, n, CASE action WHEN 'next' THEN at_topic + 1 ELSE at_topic END, CASE action WHEN 'followup' THEN at_depth + 1 ELSE 0 END, at_topic, at_depth, action, cost FROM
 (SELECT m.user_id, e.n, at_topic, at_depth, cost_micros + c AS cost, CASE WHEN cost_micros + c >= 300000 THEN 'finish' WHEN NOT skipped AND wants AND at_depth < 1 THEN 'followup' WHEN at_topic + 1 < 5 THEN 'next' ELSE 'finish' END AS action
 FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.turn_no + 1 WHERE m.action <> 'finish'))
 SELECT user_id AS session_id, CAST(turn_no AS INTEGER) AS turn_no, topic_idx, depth, action, cost_micros FROM m WHERE turn_no > 0""")
def st_interview(spark: SparkSession, d: str) -> DataFrame:
    return sessions.interviews(interview_events(_events(spark, d)))


def task_events(events: DataFrame) -> DataFrame:
    ends = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("progress")
    return events.select(F.col("user_id").cast("string").alias("task_id"), "ts", ends.alias("event"), F.col("event_type").alias("data"))


IDLE, LONGEST = 6 * 3600, 5 * 86400


@query(f"""WITH e AS (SELECT user_id, ts, event_type, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'progress' END AS event FROM events),
 s AS (SELECT user_id, min(ts) + INTERVAL {LONGEST} SECOND AS lim FROM e GROUP BY 1), r AS (SELECT e.*, lim, sum(CASE WHEN event = 'progress' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e JOIN s USING (user_id)),
 told AS (SELECT * FROM r WHERE coalesce(ended, 0) = 0 AND ts <= lim), g AS (SELECT user_id, ts, lim, event, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event, event_type) AS nxt FROM told),
 b AS (SELECT user_id, unnest(generate_series(ts + INTERVAL {IDLE} SECOND, least(coalesce(nxt, (SELECT max(ts) FROM events)), lim) - INTERVAL 1 MICROSECOND, INTERVAL {IDLE} SECOND)) AS beat FROM g WHERE nxt IS NOT NULL OR event = 'progress'),
 x AS (SELECT user_id, any_value(lim) AS lim FROM told GROUP BY 1 HAVING bool_and(event = 'progress'))
 SELECT CAST(user_id AS VARCHAR) AS task_id, ts AS at, event, event_type AS data FROM told UNION ALL SELECT CAST(user_id AS VARCHAR), beat, 'heartbeat', NULL FROM b
 UNION ALL SELECT CAST(user_id AS VARCHAR), lim, 'error', 'timeout' FROM x WHERE lim < (SELECT max(ts) FROM events)""")
def st_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    events = task_events(_events(spark, d))
    return _ntz(sessions.task_feed(events, IDLE, LONGEST, until=events.agg(F.max("ts")).first()[0]), "at")


@query("""WITH s AS (SELECT user_id % 20 AS provider, event_id, ts, CASE event_type WHEN 'error' THEN 'mark' WHEN 'purchase' THEN 'mark' WHEN 'signup' THEN 'forget' ELSE 'ask' END AS kind, CASE event_type WHEN 'error' THEN 'down ' || event_id ELSE '' END AS reason FROM events),
 p AS (SELECT a.provider, a.event_id, a.ts, max((m.ts, m.event_id)) AS last FROM s a LEFT JOIN s m ON m.provider = a.provider AND m.kind <> 'ask' AND (m.ts, m.event_id) < (a.ts, a.event_id) WHERE a.kind = 'ask' GROUP BY ALL),
 k AS (SELECT p.*, coalesce(m.kind = 'mark' AND p.ts - m.ts < INTERVAL 6 HOURS, false) AS known, m.reason FROM p LEFT JOIN s m ON m.event_id = p.last[2])
 SELECT provider, event_id AS ask_id, known, CASE WHEN known AND reason <> '' THEN reason END AS reason FROM k""")
def st_status_ttl(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "purchase"), "mark").when(F.col("event_type") == "signup", "forget").otherwise("ask")
    reason = F.when(F.col("event_type") == "error", F.concat(F.lit("down "), "event_id")).otherwise("")
    rows = _events(spark, d).select((F.col("user_id") % 20).alias("provider"), F.col("event_id").alias("id"), "ts", kind.alias("kind"), reason.alias("reason"))
    return sessions.statuses_at(rows, 6 * 3600)


@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, event_id, value FROM events ORDER BY user_id, event_type, date_trunc('day', ts), event_id""")
def st_once(spark: SparkSession, d: str) -> DataFrame:
    """Days as times, so that ties are usual; a third of the rows comes twice."""
    e = _events(spark, d).select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts"), "event_id", "value")
    return _ntz(sessions.first_answers(e.unionByName(e.filter("event_id % 3 = 0")), "user_id", "event_type", order="event_id"), "ts")


def watched(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readers (signups), progress (views, clicks) and ended tasks (the first purchase or error of each user)."""
    task = F.col("user_id").alias("task_id")
    readers = events.filter("event_type = 'signup'").select(F.col("event_id").alias("reader_id"), task, F.col("ts").alias("opened_at"))
    progress = events.select(task, "ts", F.when(F.col("event_type").isin("view", "click"), "progress").otherwise("done").alias("event"), F.col("event_type").alias("data"))
    first = F.min_by(F.col("event_type"), F.struct("ts", "event_id"))
    ends = events.filter("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.min("ts").alias("ended_at"), first.alias("kind"))
    return readers, progress, ends.select(task, "ended_at", F.when(F.col("kind") == "error", "failed").otherwise("success").alias("status"))


@query(f"""WITH r AS (SELECT event_id AS reader_id, user_id AS task_id, ts AS opened_at, ts + INTERVAL {LONGEST} SECOND AS lim FROM events WHERE event_type = 'signup'),
 s AS (SELECT user_id AS task_id, min(ts) AS ended_at, arg_min(event_type, (ts, event_id)) AS kind FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
 x AS (SELECT r.*, s.ended_at, CASE WHEN s.kind = 'error' THEN 'failed' WHEN s.kind = 'purchase' THEN 'success' ELSE 'timeout' END AS status, CASE WHEN ended_at IS NULL THEN lim ELSE greatest(opened_at, ended_at) END AS end_at FROM r LEFT JOIN s ON s.task_id = r.task_id AND ended_at >= opened_at - INTERVAL 1 DAY AND ended_at < lim)
 SELECT reader_id, task_id, end_at AS at, CASE status WHEN 'success' THEN 'done' ELSE 'error' END AS event, status AS data FROM x
 UNION ALL SELECT x.reader_id, x.task_id, e.ts, 'progress', e.event_type FROM x JOIN events e ON e.user_id = x.task_id AND e.event_type IN ('view', 'click') AND e.ts >= opened_at AND e.ts < end_at""")
def st_progress(spark: SparkSession, d: str) -> DataFrame:
    readers, progress, ends = watched(_events(spark, d))
    return _ntz(sessions.relayed(readers, progress, ends, longest=LONGEST), "at")
