"""Streaming queries on the event log, run to the end of what is there, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .streaming import trace, tracer

_START = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT {_START.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS start, event_type, COUNT(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    """Events an hour and type."""
    return _stamped(trace.settled(trace.tumbling(t.stream("events"), "ts", "1 hour", "2 hours", "event_type")))


@query(f"SELECT {_START.format('b - INTERVAL (15 * k) MINUTE')} AS start, COUNT(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) b, unnest(range(4)) k FROM events) GROUP BY ALL")
def stream_sliding(t):
    """Events an hour, each quarter of an hour."""
    return _stamped(trace.settled(trace.sliding(t.stream("events"), "ts", "1 hour", "15 minutes", "2 hours")))


@query(f"WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events), r AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) k FROM m) SELECT {_START.format('MIN(ts)')} AS start, user_id, COUNT(*)::BIGINT AS n FROM r GROUP BY user_id, k")
def stream_sessions(t):
    """Sessions of a thread: no gap of six hours."""
    return _stamped(trace.settled(trace.sessions(t.stream("events"), "ts", "6 hours", "1 day", "user_id")))


@query("SELECT event_id, SUM(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth FROM events")
def stream_lock_depth(t):
    """Locks held after each event, from state kept by thread."""
    return trace.settled(trace.open_brackets(t.stream("events"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase"), "append")


@query(f"SELECT {_START.format('h')} AS start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, COUNT(*)::BIGINT AS n FROM events GROUP BY ALL) WHERE h + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events)")
def stream_closed_windows(t):
    """Windows that the watermark has closed: each is given out once, and its state goes."""
    return _stamped(trace.settled(trace.tumbling(t.stream("events"), "ts", "1 hour", "2 hours", "event_type"), "append"))


_PASSED = "SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS k FROM events WHERE epoch_us(ts) <= (SELECT epoch_ms(MAX(ts)) - 7200000 FROM events) * 1000"


def _traced(t) -> DataFrame:
    kind = F.col("event_type")
    rec = F.when(kind == "view", "READ").when(kind == "click", "WRITE").when(kind == "signup", "CALL").when(kind == "purchase", "RETURN").when(F.col("event_id") % 2 == 0, "LOCK").otherwise("UNLOCK")
    return trace.replayed(t.events, "ts").select((F.col("user_id") % 10).alias("part"), "ts", F.col("event_id").alias("seq"), rec.alias("kind"), (F.col("user_id") % 4).alias("name"), (F.col("event_id") % 3).alias("item"))


@query(f"""WITH r AS ({_PASSED}), s AS (SELECT *, user_id % 10 AS part, event_type NOT IN ('view', 'click') AS other FROM r), n AS (SELECT *, SUM(other::INT) OVER (PARTITION BY part ORDER BY k) AS seg, SUM(other::INT) OVER (PARTITION BY part) AS last FROM s),
  p AS (SELECT *, user_id % 4 AS name, first_value(user_id % 4) OVER (PARTITION BY part, seg ORDER BY k) AS context FROM n WHERE NOT other AND seg < last)
  SELECT part::VARCHAR AS part, seg::BIGINT AS seg, context::VARCHAR AS context, (event_id % 3)::VARCHAR AS item, COUNT(*) FILTER (event_type = 'view')::BIGINT AS reads, COUNT(*) FILTER (event_type = 'click')::BIGINT AS writes, arg_min(event_id, k) FILTER (event_type = 'view') AS first_read, arg_min(event_id, k) FILTER (event_type = 'click') AS first_write FROM p WHERE name = context GROUP BY ALL""")
def stream_compacted(t):
    """A trace compacted as it comes: segments that have ended among the events that the watermark has passed."""
    return trace.settled(tracer.compacted(_traced(t), "part", "ts", "2 hours"), "append", tracer.STORE)


@query(f"""WITH r AS ({_PASSED}), s AS (SELECT *, user_id % 10 AS part, SUM(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY k) AS d, event_type NOT IN ('view', 'click', 'signup', 'purchase') AS lock FROM r),
  n AS (SELECT *, d - least(0, MIN(d) OVER (PARTITION BY part ORDER BY k)) AS depth, {", ".join(f"last_value(CASE WHEN lock AND event_id % 3 = {i} THEN event_id % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY part ORDER BY k) AS l{i}" for i in range(3))} FROM s)
  SELECT event_id AS seq, depth::INT AS depth, concat_ws('|', CASE WHEN l0 THEN '0' END, CASE WHEN l1 THEN '1' END, CASE WHEN l2 THEN '2' END) AS held FROM n WHERE event_type IN ('view', 'click')""")
def stream_accesses(t):
    """Accesses as they come, with the calls open around them and the locks held."""
    got = trace.settled(tracer.accesses(_traced(t), "part", "ts", "2 hours"), "append", tracer.STORE)
    return got.select("seq", "depth", F.array_join("held", "|").alias("held"))
