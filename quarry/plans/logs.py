"""Approvals, events and logs (sections C, E, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from ..operators import tools
from ..sources import frames as fr
from ..sources.storage import table
from .registry import query

QUEUE_SQL = """q AS (SELECT event_id AS id, user_id::VARCHAR AS requested_by, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'purchase' THEN 'approved' ELSE 'pending' END AS status, event_type AS action, ts,
CASE WHEN event_id % 3 = 0 THEN [] WHEN event_id % 3 = 1 THEN ['manager'] ELSE ['auditor'] END AS approver_roles, CASE WHEN event_id % 4 = 0 THEN ['g1'] ELSE [] END AS approver_groups,
event_id % 5 = 0 AS escalated, ['7'] AS escalate_to FROM events)"""


def queue(spark, d):
    """Approval requests made of events."""
    e = table(spark, d, "events")
    none = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("requested_by"), F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "approved").otherwise("pending").alias("status"),
        F.col("event_type").alias("action"), "ts", F.when(F.col("event_id") % 3 == 0, none).when(F.col("event_id") % 3 == 1, F.array(F.lit("manager"))).otherwise(F.array(F.lit("auditor"))).alias("approver_roles"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.lit("g1"))).otherwise(none).alias("approver_groups"), (F.col("event_id") % 5 == 0).alias("escalated"), F.array(F.lit("7")).alias("escalate_to"),
    )


@query(f"WITH {QUEUE_SQL} SELECT id, action FROM q WHERE status = 'pending' AND (action ILIKE '%ic%' OR requested_by ILIKE '%ic%') AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, id LIMIT 30")
def approvals_list(spark, d):
    found = lg.approvals(queue(spark, d), status="pending", search="ic", since=F.lit("2024-01-05").cast("timestamp_ntz"))
    return found.limit(30).select("id", "action")


@query(f"WITH {QUEUE_SQL} SELECT id FROM q WHERE status = 'pending' AND requested_by IS DISTINCT FROM '7' AND ((len(approver_roles) = 0 AND len(approver_groups) = 0) OR list_has_any(approver_roles, ['manager']) OR list_has_any(approver_groups, ['g1']) OR (escalated AND list_contains(escalate_to, '7')))")
def approvals_pending_for(spark, d):
    return lg.approvals_for(queue(spark, d), "7", ["manager"], ["g1"]).select("id")


@query(f"WITH {QUEUE_SQL} SELECT count(*) AS n FROM q WHERE status = 'pending' AND action = 'view'")
def approvals_count(spark, d):
    return queue(spark, d).where("status = 'pending' and action = 'view'").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT user_id % 40 AS key, event_type, (event_id % 7)::VARCHAR AS voter, (user_id % 40 % 7)::VARCHAR AS requester, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'reject' ELSE 'approve' END AS vote, ts, event_id FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, voter ORDER BY ts, event_id) AS n FROM v WHERE voter <> requester) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k, sum((vote = 'approve')::INT) OVER (PARTITION BY key ORDER BY ts, event_id) AS a, sum((vote = 'reject')::INT) OVER (PARTITION BY key ORDER BY ts, event_id) AS j FROM f),
t AS (SELECT key, min(CASE WHEN a >= 3 OR j >= 1 THEN k END) AS stop FROM r GROUP BY key),
s AS (SELECT r.key, max(a) AS a, max(j) AS j FROM r JOIN t USING (key) WHERE k <= coalesce(stop, k) GROUP BY r.key)
SELECT key, CASE WHEN j > 0 THEN 'rejected' WHEN a >= 3 THEN 'approved' ELSE 'pending' END AS status, coalesce(a, 0)::BIGINT AS approvals FROM (SELECT DISTINCT key FROM v) LEFT JOIN s USING (key)""")
def approval_quorum(spark, d):
    e = table(spark, d, "events")
    key = F.col("user_id") % 40
    votes = e.select(key.alias("key"), (F.col("event_id") % 7).cast("string").alias("voter"), (key % 7).cast("string").alias("requester"),
                     F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "reject").otherwise("approve").alias("vote"), "ts", F.col("event_id").alias("id"))
    return lg.approval_status(votes, 3)


@query(f"WITH {QUEUE_SQL} SELECT id, CASE WHEN status = 'pending' AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-11' THEN 'expired' ELSE status END AS effective FROM q")
def approval_status(spark, d):
    """A pending request past its time counts as expired."""
    q = queue(spark, d).withColumn("expires_at", F.col("ts") + F.expr("interval 1 day"))
    return q.select("id", lg.expired(q, F.lit("2024-01-11").cast("timestamp_ntz")).alias("effective"))


EVENTS_SQL = "ev AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'audit' WHEN 'signup' THEN 'schema.changed' ELSE 'record.updated' END AS type, CASE WHEN event_type = 'purchase' THEN 'orders' ELSE 'customer' END AS object, user_id::VARCHAR AS actor_id, 't' || (user_id % 3) AS scope_id FROM events)"


def live_events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "audit").when(F.col("event_type") == "signup", "schema.changed").otherwise("record.updated").alias("type"),
                    F.when(F.col("event_type") == "purchase", "orders").otherwise("customer").alias("object"), F.col("user_id").cast("string").alias("actor_id"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("scope_id"))


@query(f"WITH {EVENTS_SQL} SELECT seq, type FROM ev WHERE (type LIKE 'record.%' AND object = 'orders') OR (type = 'audit' AND actor_id = '7' AND scope_id = 't1') OR type = 'schema.changed'")
def event_visibility(spark, d):
    return lg.visible_events(live_events(spark, d), ["orders"], "7", "t1", False).select("seq", "type")


@query(f"WITH {EVENTS_SQL} SELECT seq, type, (SELECT max(seq) FROM ev) - 1000 > 20 AS gap FROM ev WHERE seq > greatest(20, (SELECT max(seq) FROM ev) - 1000)")
def event_replay(spark, d):
    return lg.replay(live_events(spark, d), 20, 1000).select("seq", "type", "gap")


@query("SELECT user_id, arg_max(props, (ts, event_id)) AS state FROM events GROUP BY user_id")
def audit_replay_state(spark, d):
    return lg.latest_state(table(spark, d, "events").withColumn("id", F.col("event_id")), "user_id", "props")


@query(fr.with_frames("audit", "SELECT id, row_number() OVER (ORDER BY ts, id) AS audit_id, action FROM audit"))
def audit_append(spark, d):
    """A batch of new log rows, numbered in order."""
    return lg.appended(fr.audit_events(spark, d), ["ts", "id"], "audit_id").select("id", "audit_id", "action")


@query("SELECT event_id AS id, '{\"stage\":\"execute\",\"outcome\":\"' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END || '\"}' AS stage FROM events")
def evidence_append(spark, d):
    calls = table(spark, d, "events").withColumn("id", F.col("event_id"))
    return lg.evidence(calls, "execute", F.when(F.col("event_type") == "error", "failed").otherwise("ok"))


@query("""WITH c AS (SELECT user_id % 200 AS key, ts, event_id AS id FROM events), d AS (SELECT DISTINCT key, CASE WHEN key % 5 = 0 THEN 'rejected' ELSE 'approved' END AS status, CASE WHEN key % 3 <> 0 THEN TIMESTAMP '2024-01-05' END AS due FROM c),
j AS (SELECT c.*, status, due, row_number() OVER (PARTITION BY c.key ORDER BY ts, id) AS k, row_number() OVER (PARTITION BY c.key, coalesce(ts >= due, false) ORDER BY ts, id) AS n FROM c JOIN d USING (key))
SELECT key, id, CASE WHEN due IS NULL OR ts < due THEN CASE WHEN k = 1 THEN 'enqueue' ELSE 'wait' END WHEN status = 'rejected' THEN 'deny:rejected'
  WHEN n = 1 THEN CASE WHEN ts < TIMESTAMP '2024-01-07' THEN 'consume' ELSE 'deny:expired' END WHEN min(ts) FILTER (ts >= due) OVER (PARTITION BY key) < TIMESTAMP '2024-01-07' THEN 'deny:consumed' ELSE 'deny:expired' END AS outcome FROM j""")
def approval_outcomes(spark, d):
    """What each call that needs approval comes to: asked for, waiting, used once, or denied."""
    calls = table(spark, d, "events").select((F.col("user_id") % 200).alias("key"), "ts", F.col("event_id").alias("id"))
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp_ntz")
    decisions = calls.select("key").distinct().select("key", F.when(F.col("key") % 5 == 0, "rejected").otherwise("approved").alias("status"), F.when(F.col("key") % 3 != 0, day(5)).alias("decided_at"), day(7).alias("expires_at"))
    return tools.call_outcomes(calls, decisions)
