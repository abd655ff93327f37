"""Event logs: latest status, lanes, stalls, throttling, timelines; over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import events as E
from folio.plans.registry import Registry

REG = Registry()
W = "PARTITION BY user_id ORDER BY ts, event_id"


@REG.query("events", sql=f"""WITH r AS (SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type AS status, value, epoch_us(ts) AS at_us FROM r WHERE k = 1""")
def latest_status(events):
    """The last event of each user; a view keeps the value of the event before."""
    return E.latest(events, "user_id", ("ts", "event_id"), "event_type", "value", keeps="view").select("user_id", F.col("event_type").alias("status"), "value", E.micros(F.col("ts")).alias("at_us"))


@REG.query("events", sql="SELECT event_type, user_id % 10 AS lane, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10, event_type), ())")
def event_counts_sets(events):
    rows = events.select("event_type", "user_id", (F.col("user_id") % 10).alias("lane"))
    return rows.groupingSets([["event_type"], ["lane", "event_type"], []], "event_type", "lane").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@REG.query("events", sql=f"""WITH g AS (SELECT user_id % 10 AS lane, epoch_us(ts) AS us, epoch_us(lead(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id)) - epoch_us(ts) AS gap, event_type FROM events)
SELECT lane, round(sum(CASE WHEN gap < 600000000 THEN gap ELSE 0 END) / 1000000, 3) AS busy_s, round((max(us) - min(us)) / 1000000, 3) AS span_s, count(CASE WHEN gap >= 600000000 THEN 1 END)::BIGINT AS pauses FROM g GROUP BY lane""")
def lanes_busy(events):
    return E.busy(events.withColumn("lane", F.col("user_id") % 10), "lane", ("ts", "event_id"), 600)


@REG.query("events", sql=f"""WITH g AS (SELECT user_id, event_id, ts, lag(ts) OVER ({W}) AS before FROM events)
SELECT user_id, event_id, round((epoch_us(ts) - epoch_us(before)) / 1000000, 3) AS idle_s FROM g WHERE epoch_us(ts) - epoch_us(before) > 3600000000""")
def stall_idle(events):
    return E.stalls(events, "user_id", ("ts", "event_id"), 3600).select("user_id", "event_id", "idle_s")


@REG.query("events", sql=f"""WITH g AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER ({W}) AS last_type, lag(ts) OVER ({W}) AS last_ts FROM events)
SELECT event_id FROM g WHERE last_type IS NULL OR last_type <> event_type OR epoch_us(ts) - epoch_us(last_ts) >= 1800000000""")
def throttled(events):
    return E.throttle(events, "user_id", ("ts", "event_id"), "event_type", 1800).select("event_id")


@REG.query("events", sql="""SELECT user_id, count(*)::BIGINT AS n, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 50 GROUP BY user_id""")
def timelines(events):
    """The first fifty events of each user in order; the limit is the feature's."""
    return E.timeline(events, "user_id", ("ts", "event_id"), "event_type", 50)


@REG.query("events", sql="""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_counts(events):
    return E.windowed(events, "1 hour").select(E.micros(F.col("start")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@REG.query("events", sql=f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER ({W}) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER ({W})) > 1800000000 THEN 1 ELSE 0 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER ({W}) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY 1, 2""")
def sessions(events):
    return E.sessions(events, "user_id", ("ts", "event_id"), 1800)


@REG.query("events", sql="""SELECT user_id, n, event_type AS status, epoch_us(ts) AS at_us FROM (SELECT *, count(*) OVER (PARTITION BY user_id)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def stream_latest(events):
    """The latest status through Structured Streaming: the table's files as a stream, run to its end."""
    from folio.streaming.events import replay_latest

    return replay_latest(events).select("user_id", "n", "status", E.micros(F.col("ts")).alias("at_us"))


@REG.query("events", sql="""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_counts(events):
    from folio.streaming.events import replay_counts

    return replay_counts(events).select(E.micros(F.col("start")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES, SQL = REG.queries, REG.sql
