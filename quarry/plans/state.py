"""Stateful operators in batch form (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as st
from ..operators import workflow as wf
from ..sources.storage import table
from .registry import query


def hits(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("key"), "ts", F.col("event_id").alias("id"))


@query("""WITH RECURSIVE h AS (SELECT 'u' || (user_id % 50) AS key, epoch_us(ts) AS t, event_id AS id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
f(key, k, id, accepted, kept) AS (
  SELECT key, k, id, true, [t] FROM h WHERE k = 1
  UNION ALL SELECT h.key, h.k, h.id, len(list_filter(kept, lambda x: x > h.t - 86400000000)) < 3,
    CASE WHEN len(list_filter(kept, lambda x: x > h.t - 86400000000)) < 3 THEN list_append(list_filter(kept, lambda x: x > h.t - 86400000000), h.t) ELSE list_filter(kept, lambda x: x > h.t - 86400000000) END
  FROM f JOIN h ON h.key = f.key AND h.k = f.k + 1)
SELECT key, id, accepted FROM f""")
def rate_limit(spark, d):
    return st.rate_limit(hits(spark, d), "1d", 3)


@query("SELECT 't' || (user_id % 3) || ':' || user_id AS key, '2024-01-01' AS period_start, least(count(*), 8) AS used, greatest(count(*) - 8, 0) AS denied, greatest(8 - count(*), 0) AS remaining FROM events GROUP BY user_id")
def quota_monthly(spark, d):
    uses = table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 3, F.lit(":"), "user_id").alias("key"), "ts")
    return st.quota(uses, "month", 8)


@query("""WITH RECURSIVE h AS (SELECT 't' || (user_id % 3) || ':' || user_id AS key, strftime(date_trunc('month', ts), '%Y-%m-%d') AS p, event_id AS id, event_id % 5 AS a, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS k FROM events),
f(key, p, k, id, allowed, value) AS (
  SELECT key, p, k, id, true, a FROM h WHERE k = 1
  UNION ALL SELECT h.key, h.p, h.k, h.id, a <= 0 OR value + a <= 12, CASE WHEN value + a <= 12 THEN value + a ELSE value END FROM f JOIN h ON h.key = f.key AND h.p = f.p AND h.k = f.k + 1)
SELECT key, id, p AS period_start, allowed, value::DOUBLE AS value, (12 - value)::DOUBLE AS remaining FROM f""")
def quota_amounts(spark, d):
    e = table(spark, d, "events")
    key = st.scoped_key(F.col("user_id"), F.concat(F.lit("t"), F.col("user_id") % 3))
    return st.consumed(e.select(key.alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("amount")), "month", 12)


NODES = (wf.Node("review", ("a", "b")), wf.Node("told", ("z",), "notify"), wf.Node("sign", ("c", "d"), mode="all", on_reject="review"))
#: remainder of the event's id by 16 -> (action, actor, argument)
ACTIONS = [("submit", "o", None)] * 2 + [("approve", "a", None)] * 2 + [("approve", "b", None)] + [("approve", "c", None)] * 2 + [
    ("approve", "d", None), ("reject", "c", None), ("withdraw", "o", None), ("forward", "c", "e"), ("approve", "e", None), ("cancel", "o", None), ("reactivate", "r", "sign"), ("jump", "r", "review"), ("terminate", "r", "finished"),
]


@query(f"""WITH RECURSIVE acts(m, a, u) AS (VALUES {", ".join(f"({i}, '{a}', '{u}')" for i, (a, u, _) in enumerate(ACTIONS))}),
w AS (SELECT user_id AS key, a, u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events JOIN acts ON event_id % 16 = m),
j AS (SELECT key, k, a, u FROM w),
f(key, k, s) AS (
  SELECT DISTINCT key, 0::BIGINT, {{'st': 'draft', 'node': NULL::VARCHAR, 'w': []::VARCHAR[], 't': 0, 'og': NULL::VARCHAR, 'ap': NULL::VARCHAR, 'ok': 0::BIGINT, 'no': 0::BIGINT}} FROM w
  UNION ALL SELECT j.key, j.k, CASE
    WHEN a = 'submit' AND NOT (s.st = 'running' AND s.node <> '') THEN {{'st': 'running', 'node': 'review', 'w': ['a', 'b'], 't': s.t, 'og': coalesce(s.og, u), 'ap': NULL, 'ok': s.ok + 1, 'no': s.no}}
    WHEN a = 'terminate' AND s.og IS NOT NULL THEN {{'st': 'finished', 'node': NULL, 'w': [], 't': s.t, 'og': s.og, 'ap': 'approved', 'ok': s.ok + 1, 'no': s.no}}
    WHEN a = 'jump' AND s.og IS NOT NULL THEN {{'st': 'running', 'node': 'review', 'w': ['a', 'b'], 't': s.t, 'og': s.og, 'ap': NULL, 'ok': s.ok + 1, 'no': s.no}}
    WHEN a = 'reactivate' AND s.og IS NOT NULL AND s.st <> 'running' THEN {{'st': 'running', 'node': 'sign', 'w': ['c', 'd'], 't': s.t, 'og': s.og, 'ap': NULL, 'ok': s.ok + 1, 'no': s.no}}
    WHEN s.st <> 'running' OR a IN ('submit', 'terminate', 'jump', 'reactivate') THEN {{'st': s.st, 'node': s.node, 'w': s.w, 't': s.t, 'og': s.og, 'ap': s.ap, 'ok': s.ok, 'no': s.no + 1}}
    WHEN a = 'withdraw' THEN {{'st': 'running', 'node': '', 'w': [], 't': s.t, 'og': s.og, 'ap': s.ap, 'ok': s.ok + 1, 'no': s.no}}
    WHEN a = 'cancel' THEN {{'st': 'canceled', 'node': NULL, 'w': [], 't': s.t, 'og': s.og, 'ap': 'rejected', 'ok': s.ok + 1, 'no': s.no}}
    WHEN NOT list_contains(s.w, u) THEN {{'st': s.st, 'node': s.node, 'w': s.w, 't': s.t, 'og': s.og, 'ap': s.ap, 'ok': s.ok, 'no': s.no + 1}}
    WHEN a = 'forward' THEN {{'st': 'running', 'node': s.node, 'w': list_transform(s.w, lambda x: CASE WHEN x = u THEN 'e' ELSE x END), 't': s.t, 'og': s.og, 'ap': s.ap, 'ok': s.ok + 1, 'no': s.no}}
    WHEN a = 'reject' THEN {{'st': 'running', 'node': 'review', 'w': ['a', 'b'], 't': s.t, 'og': s.og, 'ap': NULL, 'ok': s.ok + 1, 'no': s.no}}
    WHEN s.node = 'review' THEN {{'st': 'running', 'node': 'sign', 'w': ['c', 'd'], 't': s.t + 1, 'og': s.og, 'ap': NULL, 'ok': s.ok + 1, 'no': s.no}}
    WHEN len(s.w) > 1 THEN {{'st': 'running', 'node': 'sign', 'w': list_filter(s.w, lambda x: x <> u), 't': s.t, 'og': s.og, 'ap': s.ap, 'ok': s.ok + 1, 'no': s.no}}
    ELSE {{'st': 'finished', 'node': NULL, 'w': [], 't': s.t, 'og': s.og, 'ap': 'approved', 'ok': s.ok + 1, 'no': s.no}} END
  FROM f JOIN j ON j.key = f.key AND j.k = f.k + 1)
SELECT key, s.st AS state, s.node AS node, array_to_string(s.w, ',') AS waiting, s.t AS n_told, s.og AS originator, s.ap AS approval, s.ok AS accepted, s.no AS refused FROM (SELECT key, arg_max(s, k) AS s FROM f GROUP BY key)""")
def workflow_runs(spark, d):
    """All actions: quorums, notified nodes, forwards, rejections to a node, withdrawals, reactivation and an administrator's jumps and ends."""
    e = table(spark, d, "events")
    at = (F.col("event_id") % len(ACTIONS) + 1).cast("int")
    part = lambda i: F.element_at(F.array(*(F.lit(a[i]) for a in ACTIONS)), at)
    log = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), part(0).alias("action"), part(1).alias("actor"), part(2).alias("arg"), (part(1) == "r").alias("admin"))
    found = wf.runs(log, (wf.Version(NODES, "v1"),))
    n_told = F.when(F.col("told") == "", 0).otherwise(F.size(F.split("told", ",")))
    return found.select("key", "state", "node", "waiting", n_told.alias("n_told"), "originator", "approval", "accepted", "refused")


@query("""WITH w AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'cancel' ELSE 'reactivate' END AS a FROM events)
SELECT key, s.status, s.node, s.n AS accepted FROM (
WITH RECURSIVE f(key, k, s) AS (
  SELECT DISTINCT key, 0::BIGINT, {'status': 'draft', 'node': 0, 'n': 0::BIGINT} FROM w
  UNION ALL SELECT w.key, w.k, CASE
    WHEN a = 'submit' AND s.status = 'draft' THEN {'status': 'running', 'node': 0, 'n': s.n + 1}
    WHEN a = 'approve' AND s.status = 'running' AND s.node = 1 THEN {'status': 'effective', 'node': 1, 'n': s.n + 1}
    WHEN a = 'approve' AND s.status = 'running' THEN {'status': 'running', 'node': s.node + 1, 'n': s.n + 1}
    WHEN a = 'reject' AND s.status = 'running' AND s.node = 0 THEN {'status': 'draft', 'node': 0, 'n': s.n + 1}
    WHEN a = 'reject' AND s.status = 'running' THEN {'status': 'running', 'node': s.node - 1, 'n': s.n + 1}
    WHEN a = 'cancel' AND s.status IN ('draft', 'running') THEN {'status': 'canceled', 'node': s.node, 'n': s.n + 1}
    WHEN a = 'reactivate' AND s.status = 'canceled' THEN {'status': 'draft', 'node': 0, 'n': s.n + 1} ELSE s END
  FROM f JOIN w ON w.key = f.key AND w.k = f.k + 1)
SELECT key, arg_max(s, k) AS s FROM f GROUP BY key)""")
def workflow_state(spark, d):
    action = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "cancel").otherwise("reactivate")
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), action.alias("action"))
    return st.workflow_state(log, nodes=2)


@query("SELECT user_id AS key, bool_or(event_type = 'purchase') AS any_done, count(*) FILTER (event_type IN ('view', 'click')) = 0 AS all_done FROM events GROUP BY user_id")
def workflow_quorum(spark, d):
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type").isin("view", "click"), "open").otherwise("done")
    return st.node_quorum(table(spark, d, "events").select(F.col("user_id").alias("key"), status.alias("status")))


@query("SELECT user_id AS item, h AS holder FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS h, max(ts) AS t FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id) WHERE t + INTERVAL 12 HOUR > TIMESTAMP '2024-01-20'")
def locks_active(spark, d):
    leases = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("holder"), "ts", F.col("event_id").alias("id"))
    return st.active_locks(leases, F.lit("2024-01-20").cast("timestamp_ntz"), "12h")


@query("SELECT user_id AS assignee, event_id AS id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-25'")
def workflow_todos(spark, d):
    items = table(spark, d, "events").select(F.col("user_id").alias("participant"), F.col("event_id").alias("id"), F.when((F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")), "active").otherwise("done").alias("state"))
    return st.todos(items)


@query("SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ordinal, event_type AS step FROM events")
def workflow_history(spark, d):
    steps = table(spark, d, "events").select(F.col("user_id").alias("record"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("step"))
    return st.history(steps).select("record", "ordinal", "step")


@query("SELECT sha256('{\"nodes\":[{\"mode\":\"any\",\"name\":\"review\"},{\"mode\":\"all\",\"name\":\"sign\"}]}') AS hash")
def workflow_hash(spark, d):
    from ..operators.tooling import canonical_json

    definition = {"nodes": [{"name": "review", "mode": "any"}, {"name": "sign", "mode": "all"}]}  # whatever the order of keys
    return spark.createDataFrame([(canonical_json(definition),)], "text string").select(F.sha2("text", 256).alias("hash"))


@query("SELECT o_orderkey, 'O-' || year(o_orderdate) || '-' || lpad(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)::VARCHAR, 6, '0') AS seq_no FROM orders")
def seq_no(spark, d):
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    return st.sequence_numbers(o, year, ["o_orderdate", "o_orderkey"], F.concat(F.lit("O-"), year.cast("string"), F.lit("-")), 6).select("o_orderkey", "seq_no")
