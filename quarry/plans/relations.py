"""Joins and nested reads (section D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import record_key
from ..operators import links as lk
from ..operators import scope as sc
from ..operators import write as wr
from ..sources import frames as fr
from ..sources import identity
from ..sources.storage import table
from . import objects as ob
from .registry import query


@query(fr.with_frames("meta", "SELECT o_orderkey, status FROM orders LEFT JOIN meta ON record_key = strlen(o_orderkey::VARCHAR) || ':' || o_orderkey"))
def join_record_meta(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("record_key", record_key(o, "o_orderkey")).join(fr.meta_orders(spark, d), "record_key", "left").select("o_orderkey", "status")


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0")
def expand_relation(spark, d):
    readable = table(spark, d, "customer").where("c_acctbal >= 0")
    out = lk.expand_relation(table(spark, d, "orders"), "o_custkey", readable, "c_custkey", ["c_name", "c_nationkey"], "customer")
    return out.select("o_orderkey", "customer.c_name", "customer.c_nationkey")


@query(fr.with_frames("lines", "SELECT o_orderkey, coalesce((SELECT string_agg(parent_idx || '/' || l_partkey, ' ' ORDER BY parent_idx) FROM lines WHERE l_orderkey = o_orderkey), '') AS lines FROM orders"))
def expand_details(spark, d):
    o = table(spark, d, "orders")
    out = lk.expand_details(o, fr.order_lines(spark, d), record_key(o, "o_orderkey"), ["l_partkey"], "lines")
    shown = F.transform("lines", lambda x: F.concat_ws("/", x["parent_idx"].cast("string"), x["l_partkey"].cast("string")))
    return out.select("o_orderkey", F.array_join(shown, " ").alias("lines"))


@query(fr.with_frames("lines links", "SELECT o_orderkey, (SELECT string_agg(p_name, ',' ORDER BY idx) FROM links JOIN part ON p_partkey = target_p_partkey WHERE owner_o_orderkey = o_orderkey AND p_size > 5) AS names FROM orders"))
def expand_multirel(spark, d):
    readable = table(spark, d, "part").where("p_size > 5")
    out = lk.expand_links(table(spark, d, "orders"), fr.order_parts(spark, d), readable, "o_orderkey", "owner_o_orderkey", "target_p_partkey", "p_partkey", ["p_name"], "parts")
    return out.select("o_orderkey", F.array_join("parts.p_name", ",").alias("names"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size >= 10)")
def orphan_refs(spark, d):
    return wr.orphans(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size >= 10"), "p_partkey").select("l_orderkey", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 10 UNION SELECT event_id FROM events WHERE user_id = 10 AND event_id IN (SELECT o_orderkey FROM orders)")
def workflow_visible(spark, d):
    """Orders in the subject's own scope, or in whose workflow they took part."""
    o = table(spark, d, "orders")
    own = sc.readable(o, ob.PLAIN_ORDERS, ob.SALES).select("o_orderkey")
    part = table(spark, d, "events").where("user_id = 10").select(F.col("event_id").alias("o_orderkey"))
    return o.select("o_orderkey").join(own.unionByName(part).distinct(), "o_orderkey", "left_semi")


@query("SELECT n_nationkey AS ext_id, 'n' || n_nationkey AS id, 'r' || r_regionkey AS parent FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 4")
def identity_link(spark, d):
    """External parents resolved to internal ids; an unknown parent is null."""
    known = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("external_id"), F.concat(F.lit("r"), "r_regionkey").alias("id"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("ext_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("parent"))
    return identity.resolved(rows, known, "parent")
