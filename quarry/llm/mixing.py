r"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words ``[^\x20\x09-\x0D]+``. Sources, in code-point
order with null last, get repeating weights of all sizes; a target stops at ``cap`` times
its source's size and the excess is reshared by weight. A target of, say, 2.3 sizes takes
every document twice and those below a hash threshold a third time. The threshold comes
from histograms: sizes summed by source and hash bucket, then only the bucket where the
budget ends is split again, to the last bit. Nothing is sorted by hash and reruns agree.

Rows of equal hash (the same doc_id) stand or fall together. The rows taken are the
prefix in order of hash whose sum ends nearest to the budget.

Rows of one source may be a third of all: sums are made before any exchange, and the sources'
targets and thresholds are broadcast where there are up to ``MAX_BROADCAST_SOURCES`` of them.
Targets need all sources in one task, a row each.

Defined results: a null text has size 0; null doc_id and null source are values like any
other; repeated rows count each; an empty table gives an empty result; only doc_id, text
and source are read, so clashing names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

BITS, LEVEL = 60, 12
MAX_BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column, seed: int = 0) -> Column:
    """60 bits of an MD5 of the id and seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(_key, source_size, target) by source: capped sources are those whose cap is below their share of what sources with a smaller cap per weight leave."""
    by_name, all_rows = Window.orderBy("_key"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("_key").agg(F.sum("size").alias("source_size")).withColumn("_w", weight.cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * cap).cast("double")).withColumn("_total", F.sum("source_size").over(all_rows).cast("double"))
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_share", F.col("_left") * F.col("_w") / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_full", F.col("_share") >= F.col("_cap"))
    open_w, used = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_rows), F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_rows), F.lit(0.0))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - used) * F.col("_w") / open_w)
    return s.select("_key", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame, few: bool = False) -> DataFrame:
    """(_key, _below): hashes up to ``_below`` hold the prefix of each source nearest to its ``_budget``. ``few``: the sources are few enough for broadcasts."""
    side = F.broadcast if few else lambda df: df
    # _done: sum of what lies below the boundary bucket; _prefix: that bucket
    state = budgets.select("_key", "_budget", F.lit(0).cast("long").alias("_done"), F.lit(0).cast("long").alias("_prefix"), F.lit(False).alias("_all"))
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        inside = sizes.join(side(state.select("_key", "_prefix")), "_key").where(F.shiftrightunsigned("_hash", shift + LEVEL) == F.col("_prefix"))
        histogram = inside.groupBy("_key", F.shiftrightunsigned("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_size"))
        running = Window.partitionBy("_key").orderBy("_bucket")
        found = (
            histogram.join(side(state), "_key").withColumn("_cum", F.col("_done") + F.sum("_size").over(running))
            .where(F.col("_cum") > F.col("_budget"))
            .groupBy("_key").agg(F.min(F.struct("_bucket", (F.col("_cum") - F.col("_size")).alias("_done"), "_cum")).alias("_at"))
        )
        state = saved(state.join(found, "_key", "left").select(
            "_key", "_budget", F.coalesce("_at._done", "_done").alias("_done"),
            F.coalesce("_at._bucket", F.shiftleft("_prefix", LEVEL)).alias("_prefix"),
            (F.col("_all") | F.col("_at").isNull()).alias("_all"), F.col("_at._cum").alias("_cum"),
        ))
        last = state
        state = state.drop("_cum")
    take_last = F.col("_cum") + F.col("_done") <= 2 * F.col("_budget")
    return last.select("_key", F.when(F.col("_all"), F.lit(1 << BITS).cast("long")).when(take_last, F.col("_prefix")).otherwise(F.col("_prefix") - 1).alias("_below"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; see the module."""
    key = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))
    sizes = saved(docs.select(F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), key.alias("_key"), hash60(F.col(doc_id), seed).alias("_hash")))
    targets = saved(source_targets(sizes, weights, cap))
    few = targets.count() <= MAX_BROADCAST_SOURCES
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_times", times).withColumn("_budget", F.col("target") - F.col("_times") * F.col("source_size"))
    limits = targets.join(thresholds(sizes, targets, few), "_key")
    if few:
        limits = F.broadcast(limits)
    taken = F.col("size") * (F.col("_times") + (F.col("_hash") <= F.col("_below")).cast("long"))
    return sizes.join(limits, "_key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))
