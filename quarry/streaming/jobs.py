"""Streams over events: windows, verification, outbox relay, rate limits with kept state."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import START, Limiter, seconds, workflow_step
from ..sources.storage import shared_dir, table


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table, a file or a folder of them, as a stream, one file a trigger, with event time."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")  # a pattern may name a file as well as a folder
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", "n", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"))


def accepted(received: DataFrame, rule: str) -> DataFrame:
    """Records that pass verification; the rest go nowhere."""
    return received.where(rule)


class Buffered:
    """A best-effort sink in front of a slower one: at most ``cap`` rows wait, the newest beyond that are dropped and counted; ``size`` rows or ``every`` seconds make a flush. ``mode`` durable or transactional keeps nothing back."""

    MODES = ("best-effort", "transactional", "durable")

    def __init__(self, write: Callable[[list[dict]], None], mode: str = "best-effort", size: int = 50, every: float = 0.1, cap: int = 10_000):
        if mode not in self.MODES:
            raise ValueError(f"audit.mode: {mode}")
        self.write, self.mode, self.size, self.every, self.cap = write, mode, size, every, cap
        self.waiting: list[dict] = []
        self.dropped, self.since = 0, None

    def add(self, rows: list[dict], now: float) -> None:
        if self.mode != "best-effort":
            self.write(rows)
            return
        room = max(0, self.cap - len(self.waiting))
        self.dropped += len(rows[room:])
        self.waiting += rows[:room]
        if self.waiting and self.since is None:
            self.since = now
        if len(self.waiting) >= self.size or self.since is not None and now - self.since >= self.every:
            self.flush()

    def flush(self) -> None:
        """Hands over what waits; if that fails it stays for the next time."""
        if self.waiting:
            self.write(self.waiting[: self.cap])
        self.waiting, self.since = [], None


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now; returns what its sink then holds, in the shared folder."""
    out, name = shared_folder(spark, "sink"), shared_folder(spark, "progress")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'epoch={epoch}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", name).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    kept = spark.read.schema(stream.schema)
    return kept.parquet(f"{out}/all" if mode == "complete" else f"{out}/*")


def relay(spark: SparkSession, d: str) -> DataFrame:
    """At-least-once delivery, however late a row comes; readers see each id once. An epoch's files are overwritten when it is replayed."""
    sent = events_stream(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), "ts")
    twice = sent.select("*", F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_try")).drop("_try")
    return drained(spark, twice.select("id", "action"), "append").dropDuplicates(["id"])


def limited(hits: DataFrame, window: str, limit: int) -> DataFrame:
    """(key, id, accepted) of a stream of hits (key, ts, id) with a watermark on ts: a key's accepted times are its state, which goes once the watermark has passed the window of the last. A key's hits of one trigger are sorted in memory."""
    span = seconds(window)

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        limiter = Limiter(span, limit, state.get[0] if state.exists else [])
        out = [limiter.hit(t) for t in rows["t"]]
        state.update((list(limiter.hits),))
        state.setTimeoutTimestamp(max(int((limiter.hits[-1] + span) * 1000), state.getCurrentWatermarkMs() + 1) if limiter.hits else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "accepted": out})

    timed = hits.select("key", "id", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("key").applyInPandasWithState(fold, "key string, id long, accepted boolean", "hits array<double>", "append", "EventTimeTimeout")


def workflow_states(log: DataFrame, nodes: int) -> DataFrame:
    """(key, status, node, accepted) of each key after each trigger of a stream of actions (key, ts, id, action). A record's state stays as long as the record does."""

    def fold(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        now = tuple(state.get) if state.exists else (START, 0, 0)
        for action in rows["action"]:
            now = workflow_step(now, action, nodes)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["key", "status", "node", "accepted"])

    kind = dict(log.dtypes)["key"]
    return log.groupBy("key").applyInPandasWithState(fold, f"key {kind}, status string, node int, accepted long", "status string, node int, accepted long", "append", "NoTimeout")
