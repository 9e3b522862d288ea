"""Audit, evidence, approvals and events as frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError
from .state import numbered

AUDIT_COLUMNS = ("actor_type", "actor_id", "action", "object", "object_id", "is_error", "error_code", "scope_id", "ts")
BROADCASTS = ("schema.changed", "schema.drift", "lifecycle")


def audit_filter(log: DataFrame, filter: dict) -> DataFrame:
    """By whitelisted columns; unknown ones are ignored and boolean ones take eq and ne only."""

    def part(f: dict):
        out = []
        for k, v in f.items():
            if k == "$or":
                groups = [g for g in map(part, v) if g is not None]
                out += [reduce(lambda a, b: a | b, groups)] if groups else []
            elif k in AUDIT_COLUMNS and k in log.columns:
                c = F.col(k)
                for op, x in (v if isinstance(v, dict) else {"eq": v}).items():
                    if k == "is_error" and op not in ("eq", "ne"):
                        continue
                    out.append({"eq": lambda: c == x, "ne": lambda: c != x, "gt": lambda: c > x, "gte": lambda: c >= x, "lt": lambda: c < x, "lte": lambda: c <= x, "in": lambda: c.isin(x), "like": lambda: c.ilike(f"%{x}%")}[op]())
        return reduce(lambda a, b: a & b, out) if out else None

    where = part(filter)
    return log if where is None else log.where(where)


def page_before(log: DataFrame, before: tuple | None, limit: int) -> DataFrame:
    """Newest first by (ts, id), rows strictly before the given pair."""
    if before:
        ts, last = F.lit(before[0]).cast(log.schema["ts"].dataType), F.lit(before[1])
        log = log.where((F.col("ts") <= ts) & (F.struct("ts", "id") < F.struct(ts.alias("ts"), last.cast(log.schema["id"].dataType).alias("id"))))
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def approval_status(votes: DataFrame, required: int) -> DataFrame:
    """(key, status, approvals): votes (key, voter, vote, ts, id, requester) in order. A requester's vote and a voter's second do not count; a reject ends it, as do ``required`` approvals, whichever is first."""
    seat = Window.partitionBy("key", "voter").orderBy("ts", "id")
    valid = votes.where("voter <> requester").withColumn("_n", F.row_number().over(seat)).where("_n = 1")
    order = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = valid.withColumns({"_a": F.sum((F.col("vote") == "approve").cast("int")).over(order), "_r": F.sum((F.col("vote") == "reject").cast("int")).over(order)})
    until = run.where((F.col("_a") - (F.col("vote") == "approve").cast("int") < required) & (F.col("_r") - (F.col("vote") == "reject").cast("int") < 1))
    done = until.groupBy("key").agg(F.max("_a").alias("approvals"), F.max("_r").alias("_r"))
    counted = votes.select("key").distinct().join(done, "key", "left")
    status = F.when(F.col("_r") > 0, "rejected").when(F.col("approvals") >= required, "approved").otherwise("pending")
    return counted.select("key", status.alias("status"), F.coalesce("approvals", F.lit(0)).cast("long").alias("approvals"))


def approvals_for(queue: DataFrame, user: str, roles: list[str], groups: list[str]) -> DataFrame:
    """Pending requests the user may vote on: not their own, and open to all, or to a role or group of theirs, or escalated to them."""
    none_named = (F.coalesce(F.size("approver_roles"), F.lit(0)) <= 0) & (F.coalesce(F.size("approver_groups"), F.lit(0)) <= 0)
    named = F.arrays_overlap("approver_roles", F.array(*map(F.lit, roles))) | F.arrays_overlap("approver_groups", F.array(*map(F.lit, groups)))
    escalated = F.col("escalated") & F.array_contains("escalate_to", user)
    return queue.where((F.col("status") == "pending") & ~F.col("requested_by").eqNullSafe(user) & (none_named | F.coalesce(named, F.lit(False)) | F.coalesce(escalated, F.lit(False))))


def visible_events(events: DataFrame, objects: list[str], actor: str, scope: str | None, admin: bool) -> DataFrame:
    """Record events of readable objects; audit events of the actor in their scope, or all for an admin; broadcasts for everyone."""
    record = F.col("type").startswith("record.") & F.col("object").isin(objects)
    audit = (F.col("type") == "audit") & (F.lit(admin) | ((F.col("actor_id") == actor) & (F.lit(scope is None) | (F.col("scope_id") == scope))))
    return events.where(record | audit | F.col("type").isin(*BROADCASTS))


def replay(events: DataFrame, after: int, ring: int) -> DataFrame:
    """Events after a sequence number that the newest ``ring`` still hold, and whether older ones are gone."""
    last = events.agg(F.max("seq")).first()[0] or 0
    return events.where(F.col("seq") > max(after, last - ring)).withColumn("gap", F.lit(after < last - ring))


def latest_state(log: DataFrame, key: str, after: str) -> DataFrame:
    """(key, state): the last snapshot of each key by (ts, id)."""
    return log.groupBy(key).agg(F.max_by(after, F.struct("ts", "id")).alias("state"))


def appended(batch: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """A batch of new log rows with consecutive numbers in order, going on from ``base``."""
    return numbered(batch, F.lit(0), [F.col(c) for c in order], name, base)


def evidence(calls: DataFrame, stage: str, outcome: Column) -> DataFrame:
    """(id, stage): a piece of evidence of each call (id, ...) as canonical JSON."""
    return calls.select("id", F.to_json(F.struct(F.lit(stage).alias("stage"), outcome.alias("outcome"))).alias("stage"))


def expired(requests: DataFrame, now: Column) -> Column:
    """The status a request (status, expires_at) has now: pending ones past their time are expired."""
    return F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status"))


def approvals(queue: DataFrame, status: str | None = None, action: str | None = None, key: str | None = None, search: str | None = None, since=None, expires_before=None, by: str = "ts", descending: bool = True) -> DataFrame:
    """Requests by any of: status, action, key, a text within action or requester, first time, time they run out by; sorted by one whitelisted column."""
    if by not in ("ts", "status", "action", "expires_at") or by not in queue.columns:
        raise ModelError("approval.sort", by)
    for name, value in (("status", status), ("action", action), ("key", key)):
        if value is not None:
            queue = queue.where(F.col(name) == value)
    if search is not None:
        queue = queue.where(F.col("action").ilike(f"%{search}%") | F.col("requested_by").ilike(f"%{search}%"))
    if since is not None:
        queue = queue.where(F.col("ts") >= since)
    if expires_before is not None:
        queue = queue.where(F.col("expires_at") < expires_before)
    c = F.col(by)
    return queue.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), "id")
