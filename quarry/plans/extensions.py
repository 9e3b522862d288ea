"""Streams run to completion over the events table, each equal to its batch form (section I)."""

from __future__ import annotations

from ..streaming import jobs
from .registry import query


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return jobs.drained(spark, jobs.tumbling(jobs.events_stream(spark, d), "1 hour"), "complete")


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1""")
def stream_sliding(spark, d):
    return jobs.drained(spark, jobs.sliding(jobs.events_stream(spark, d), "2 hours", "1 hour"), "complete")


@query("""SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def stream_sessions(spark, d):
    return jobs.drained(spark, jobs.sessions(jobs.events_stream(spark, d), "6 hours"), "complete")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def ingress_accept(spark, d):
    """Received records that pass verification."""
    return jobs.drained(spark, jobs.accepted(jobs.events_stream(spark, d), "event_type = 'error'").select("event_id", "user_id"), "append")


@query("SELECT event_id AS id, event_type AS action FROM events")
def outbox_relay(spark, d):
    """Outbox rows delivered once each, though half of them are sent twice."""
    return jobs.relay(spark, d)
