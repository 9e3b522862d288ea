"""Limits, quotas, sequences, workflows, timers and locks in batch form."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import saved

SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(duration: str) -> float:
    """``15m``, ``500ms``, ``2d`` and so on."""
    unit = duration.lstrip("0123456789")
    return int(duration[: len(duration) - len(unit)]) * SECONDS[unit]


class Limiter:
    """Accepted hits of one key within a sliding window; refused hits are not recorded."""

    def __init__(self, window: float, limit: int, hits: list[float] = ()):
        self.window, self.limit, self.hits = window, limit, deque(hits)

    def hit(self, at: float) -> bool:
        while self.hits and self.hits[0] <= at - self.window:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False
        self.hits.append(at)
        return True


def rate_limit(hits: DataFrame, window: str, limit: int) -> DataFrame:
    """(key, id, accepted) of hits (key, ts, id), each key in order of (ts, id). Keys are independent groups; Spark streams a key's hits in sorted batches of bounded size."""
    span = seconds(window) * 1e6

    def fold(batches):
        key, limiter = object(), None
        for rows in batches:
            out = []
            for k, t in zip(rows["key"], rows["t"]):
                if k != key:
                    key, limiter = k, Limiter(span, limit)
                out.append(limiter.hit(t))
            yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "accepted": out})

    timed = hits.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(fold, f"key {dict(hits.dtypes)['key']}, id long, accepted boolean")


def quota(uses: DataFrame, period: str, limit: int) -> DataFrame:
    """(key, period_start, used, denied, remaining) of single uses (key, ts) against a limit for each period."""
    counted = uses.groupBy("key", F.date_trunc(period, "ts").alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.select("key", F.date_format("_start", "yyyy-MM-dd").alias("period_start"), F.least("_n", F.lit(limit)).alias("used"), F.greatest(F.col("_n") - limit, F.lit(0)).alias("denied"), F.greatest(F.lit(limit) - F.col("_n"), F.lit(0)).alias("remaining"))


def scoped_key(key: Column, *scopes: Column) -> Column:
    """``scope:key``; a scope that is null or empty leaves the key as it is."""
    return F.concat_ws(":", *(F.nullif(s.cast("string"), F.lit("")) for s in scopes), key.cast("string"))


def tool_key(roles: Column, tool: Column) -> Column:
    """The rate-limit key of a custom tool: sorted roles, then its name."""
    return F.concat_ws(":", F.array_join(F.array_sort(roles), ","), tool)


def consumed(uses: DataFrame, period: str, limit: float) -> DataFrame:
    """(key, id, period_start, allowed, value, remaining) of uses (key, ts, id, amount), each key and period in order of (ts, id).

    A use is allowed if the value after it stays within ``limit``; a denied one leaves the value, and an
    amount of 0 or less is allowed and adds nothing. ``period``: day or month, UTC.
    """

    def fold(batches):
        key, value = object(), 0.0
        for rows in batches:
            ok, after = [], []
            for k, p, a in zip(rows["key"], rows["period_start"], rows["amount"]):
                if (k, p) != key:
                    key, value = (k, p), 0.0
                allowed = a <= 0 or value + a <= limit
                value += a if allowed and a > 0 else 0
                ok.append(allowed)
                after.append(value)
            yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "period_start": rows["period_start"], "allowed": ok, "value": after, "remaining": [max(0.0, limit - v) for v in after]})

    timed = uses.select("key", F.date_format(F.date_trunc(period, "ts"), "yyyy-MM-dd").alias("period_start"), "ts", "id", F.col("amount").cast("double").alias("amount"))
    ordered = timed.repartition("key", "period_start").sortWithinPartitions("key", "period_start", "ts", "id")
    return ordered.mapInPandas(fold, f"key {dict(uses.dtypes)['key']}, id long, period_start string, allowed boolean, value double, remaining double")


def numbered(rows: DataFrame, bucket: Column, order: list, name: str, base: int = 0) -> DataFrame:
    """``rows`` with consecutive numbers within each bucket, in order.

    Rows are ranged by bucket and order, so that a bucket of any size fills as many tasks as it needs;
    what a bucket has in earlier ranges is added to the place within the range.
    """
    ranged = rows.withColumn("_bucket", bucket).repartitionByRange("_bucket", *order).sortWithinPartitions("_bucket", *order)
    placed = saved(ranged).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_bucket", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("_bucket").alias("_b"), F.col("_part").alias("_p"), "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    joined = placed.join(parts, F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1 + base).drop("_bucket", "_at", "_part", "_b", "_p", "_first", "_before")


def sequence_numbers(rows: DataFrame, bucket: Column, order: list, template: Column, width: int, base: int = 0) -> DataFrame:
    """``rows`` with ``seq_no``: ``template`` followed by the zero-padded number within the bucket, in order of arrival."""
    n = F.col("_n").cast("string")
    padded = F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    return numbered(rows, bucket, order, "_n", base).withColumn("seq_no", F.concat(template, padded)).drop("_n")


def sequence_field(rows: DataFrame, name: str, template: str, at: Column, order: list, cycle: str | None = None, base: int = 0) -> DataFrame:
    """``rows`` with a field numbered by a template of ``{seq[:N]}``, ``{year}``, ``{month}`` and ``{day}``; ``cycle`` year starts anew each year, if the year stands before the number."""
    parts = re.split(r"(\{(?:seq(?::\d+)?|year|month|day)\})", template)
    date = {"{year}": F.year(at).cast("string"), "{month}": F.month(at).cast("string"), "{day}": F.dayofmonth(at).cast("string")}
    bucket = F.year(at) if cycle == "year" and "{year}" in template.partition("{seq")[0] else F.lit(0)
    n = F.col("_seq").cast("string")

    def text(part: str) -> Column:
        if part.startswith("{seq"):
            width = int(part[5:-1]) if ":" in part else 0
            return F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
        return date.get(part, F.lit(part))

    return numbered(rows, bucket, order, "_seq", base).withColumn(name, F.concat(*map(text, filter(None, parts)))).drop("_seq")


#: action -> (states it applies to, resulting move)
START, RUNNING, DONE, CANCELED = "draft", "running", "effective", "canceled"


def workflow_step(state: tuple[str, int, int], action: str, nodes: int) -> tuple[str, int, int]:
    """(status, node, accepted actions) after one action on a chain of ``nodes`` nodes; what does not apply changes nothing."""
    status, node, n = state
    if action == "submit" and status == START:
        return RUNNING, 0, n + 1
    if action == "approve" and status == RUNNING:
        return (DONE, node, n + 1) if node + 1 == nodes else (RUNNING, node + 1, n + 1)
    if action == "reject" and status == RUNNING:
        return (START, 0, n + 1) if node == 0 else (RUNNING, node - 1, n + 1)
    if action == "withdraw" and status == RUNNING:
        return START, 0, n + 1
    if action == "cancel" and status in (START, RUNNING):
        return CANCELED, node, n + 1
    if action == "reactivate" and status == CANCELED:
        return START, 0, n + 1
    return state


def workflow_state(log: DataFrame, nodes: int) -> DataFrame:
    """(key, status, node, accepted) after each key's actions (key, ts, id, action) in order; a key's state is all that is kept in memory."""

    def fold(batches):
        key, state = None, None
        for rows in batches:
            done = []
            for k, action in zip(rows["key"], rows["action"]):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, *state))
                    key, state = k, (START, 0, 0)
                state = workflow_step(state, action, nodes)
            yield pd.DataFrame(done, columns=["key", "status", "node", "accepted"])
        if state is not None:
            yield pd.DataFrame([(key, *state)], columns=["key", "status", "node", "accepted"])

    ordered = log.select("key", "ts", "id", "action").repartition("key").sortWithinPartitions("key", "ts", "id")
    return ordered.mapInPandas(fold, f"key {dict(log.dtypes)['key']}, status string, node int, accepted long")


def node_quorum(items: DataFrame) -> DataFrame:
    """(key, any_done, all_done) of work items (key, status): whether one approval, or all, let a node pass."""
    done = F.col("status") == "approved"
    return items.groupBy("key").agg(F.bool_or(done).alias("any_done"), (F.count_if(F.col("status") == "open") == 0).alias("all_done"))


def todos(items: DataFrame) -> DataFrame:
    """(assignee, id) of open work items (participant, id, state)."""
    return items.where("state = 'active'").select(F.col("participant").alias("assignee"), "id")


def history(steps: DataFrame) -> DataFrame:
    """``steps`` (record, ts, id, ...) with each record's ``ordinal`` from 1, in order of (ts, id)."""
    return steps.withColumn("ordinal", F.row_number().over(Window.partitionBy("record").orderBy("ts", "id")))


def due(timers: DataFrame, now: Column, limit: int) -> DataFrame:
    """The timers to fire next: due ones, earliest first."""
    return timers.where(F.col("due_at") <= now).orderBy("due_at", "id").limit(limit)


def active_locks(leases: DataFrame, now: Column, ttl: str = "60s") -> DataFrame:
    """(item, holder): each item's latest lease, if it has not run out."""
    last = leases.where(F.col("ts") <= now).groupBy("item").agg(F.max_by(F.struct("holder", "ts"), F.struct("ts", "id")).alias("_l"))
    alive = F.unix_micros(F.col("_l.ts").cast("timestamp")) + int(seconds(ttl) * 1e6) > F.unix_micros(now.cast("timestamp"))
    return last.where(alive).select("item", F.col("_l.holder").alias("holder"))
