"""Queries over streams that stop and go on: keyed state, sliding windows with late rows, a task queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.registry import register
from quillspark.session import shared_folder, table
from quillspark.streaming import events as ev
from quillspark.streaming import recurrence, sinks, tasks

#: Steps in which the table arrives; the stream is stopped and started again between them.
STEPS = 2


@register(
    "recurrence_stream",
    """WITH s AS (SELECT event_type || ':' || (floor(value)::BIGINT % 5) AS signature, user_id AS node FROM events)
    SELECT signature, count(DISTINCT node) AS nodes, count(*) AS n, count(DISTINCT node) >= 2 OR count(*) >= 3 AS grows FROM s GROUP BY 1""",
)
def recurrence_stream(spark, d):
    """AGG-25 as a stream: signatures in keyed state, half of the events before a restart and half after it."""
    rows = table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", F.floor("value") % 5).alias("signature"), F.col("user_id").cast("string").alias("node"))
    folder = shared_folder(spark, "recurrence")
    sinks.feed(rows, F.col("event_id") % STEPS, STEPS, lambda stream: recurrence.start_recurrence(stream.select("signature", "node"), folder))
    return recurrence.recurrence_table(spark, folder)


#: Days of the month by which events arrive; every seventh comes one step behind its day.
_ARRIVAL = "least(dayofmonth(ts) / 11 + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END, 3)"


@register(
    "events_sliding_late",
    f"""WITH e AS (SELECT event_id, ts, event_type, value, {_ARRIVAL.replace("dayofmonth(ts) / 11", "dayofmonth(ts) // 11")} AS step FROM events),
    marks AS (SELECT s.step, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 12 HOUR FROM e WHERE e.step < s.step) AS mark FROM (SELECT DISTINCT step FROM e) s),
    last AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 12 HOUR AS mark FROM e),
    w AS (SELECT e.*, mark, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 12 HOUR AS start FROM e JOIN marks USING (step), (SELECT unnest([0, 1]) AS k))
    SELECT start, start + INTERVAL 24 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w
    WHERE (mark IS NULL OR start + INTERVAL 24 HOUR > mark) AND start + INTERVAL 24 HOUR <= (SELECT mark FROM last) GROUP BY 1, 2, 3""",
)
def events_sliding_late(spark, d):
    """Streaming: windows of a day every half day; a seventh of the events comes a step late, and counts only where its window is open."""
    rows = table(spark, d, "events").withColumn("step", F.expr(_ARRIVAL.replace("dayofmonth(ts) / 11", "dayofmonth(ts) div 11")))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(spark, "sliding")
    sinks.feed(rows, F.col("step"), 4, lambda stream: ev.start_epochs(ev.sliding_counts(stream, "24 hours", "12 hours", "12 hours"), folder))
    out = ev.epoch_rows(spark, folder)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


def _doubled(payload: str) -> str:
    return str(2 * int(payload))


def _not_sevenfold(payload: str) -> str:
    if int(payload) % 7 == 0:
        raise tasks.PartialFailure(f"bad payload {payload}", payload)
    return payload


@register(
    "task_runs",
    """WITH t AS (SELECT event_id AS task_id, event_type AS type, floor(value)::BIGINT AS p, event_id % 22 = 0 AND event_type IS NOT NULL AS stopped FROM events),
    r AS (SELECT task_id, type, p, CASE WHEN stopped THEN 'canceled' WHEN type = 'error' THEN 'failed' WHEN type = 'view' AND p % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM t)
    SELECT task_id, type, status, CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END::DOUBLE AS progress,
      CASE WHEN status = 'canceled' OR type = 'error' THEN NULL WHEN type = 'view' THEN p ELSE 2 * p END::VARCHAR AS result,
      CASE WHEN status = 'failed' THEN CASE WHEN type = 'error' THEN 'No handler for task type: error' ELSE 'bad payload ' || p END END AS error FROM r""",
)
def task_runs(spark, d):
    """Task queue: requests in three steps with a restart after each; cancels come with their task, or when it has run."""
    events = table(spark, d, "events")
    submits = events.select(F.col("event_id").alias("task_id"), F.col("event_type").alias("type"), F.floor("value").cast("string").alias("payload"), F.lit("submit").alias("action"), (F.col("event_id") % 3).alias("step"))
    # even tasks are cancelled in time, odd ones a step after they ran
    cancels = submits.where("task_id % 11 = 0").withColumns({"action": F.lit("cancel"), "step": F.when(F.col("task_id") % 2 == 0, F.col("step")).otherwise(F.col("step") + 1)})
    folder = shared_folder(spark, "tasks")
    handlers = {"purchase": _doubled, "click": _doubled, "signup": _doubled, "view": _not_sevenfold}
    requests = submits.unionByName(cancels)
    sinks.feed(requests, F.col("step"), 4, lambda stream: tasks.start_queue(stream.drop("step"), handlers, folder))
    return tasks.task_table(spark, folder).drop("payload")
