"""Sorting, paging and counting (sections E and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import encode_cursor
from ..operators import find as fd
from ..operators import logs as lg
from ..operators import state as st
from ..operators import write as wr
from ..operators.closure import in_cycles, subtree
from ..sources import frames as fr
from ..sources.storage import table
from .objects import PLAIN_ORDERS
from .registry import query


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def count_exact(spark, d):
    return fd.total(table(spark, d, "orders"), PLAIN_ORDERS, {"o_orderstatus": "O", "o_totalprice": {"gt": 100000}})


@query("SELECT count(*) AS total FROM orders")
def count_estimate(spark, d):
    """The whole table's rows, without filter or scope; Parquet footers answer it."""
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"))


@query("SELECT count(*) = 26 AS has_more, least(count(*), 25) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' LIMIT 26)")
def page_probe(spark, d):
    probe = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey").limit(26)
    return probe.agg((F.count(F.lit(1)) == 26).alias("has_more"), F.least(F.count(F.lit(1)), F.lit(25)).alias("n"))


@query(fr.with_frames("norders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM norders ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 500"))
def sort_multi(spark, d):
    options = fd.Find(sort=[("o_orderpriority", "desc"), ("o_totalprice", "asc"), ("o_orderkey", "asc")], limit=500, fields=["o_orderkey", "o_orderpriority", "o_totalprice"])
    return fd.find(fr.nullable_orders(spark, d), PLAIN_ORDERS, options)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 40")
def page_offset(spark, d):
    return fd.find(table(spark, d, "orders"), PLAIN_ORDERS, fd.Find(sort=[("o_totalprice", "desc"), ("o_orderkey", "asc")], offset=40, fields=["o_orderkey", "o_totalprice"]))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def page_cursor(spark, d):
    return fd.find(table(spark, d, "orders"), PLAIN_ORDERS, fd.Find(filter={"o_orderstatus": "F"}, cursor=encode_cursor([500]), limit=50, fields=["o_orderkey", "o_totalprice"]))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def page_clamped(spark, d):
    return fd.find(table(spark, d, "orders"), PLAIN_ORDERS, fd.Find(sort=[("o_orderkey", "asc")], limit=5000, fields=["o_orderkey"]))


@query(fr.with_frames("audit", "SELECT id, action FROM audit WHERE (ts, id) < (TIMESTAMP '2024-01-15', 500) ORDER BY ts DESC, id DESC LIMIT 50"))
def audit_page(spark, d):
    return lg.page_before(fr.audit_events(spark, d), ("2024-01-15", 500), 50).select("id", "action")


@query(fr.with_frames("dept", "SELECT id, name FROM dept ORDER BY name ASC NULLS LAST, id"))
def directory_list(spark, d):
    return fr.departments(spark, d).orderBy(F.col("name").asc_nulls_last(), "id").select("id", "name")


@query("SELECT event_id AS id, user_id FROM events WHERE ts + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-12' ORDER BY ts, event_id LIMIT 50")
def timers_due(spark, d):
    timers = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("ts") + F.expr("interval 2 hours")).alias("due_at"))
    return st.due(timers, F.lit("2024-01-12").cast("timestamp_ntz"), 50).select("id", "user_id")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def enum_values_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct()


@query(fr.with_frames("dept", ", sub(id) AS (SELECT 'r1' UNION SELECT d.id FROM dept d JOIN sub ON d.parent_id = sub.id) SELECT id FROM sub", recursive=True))
def department_subtree(spark, d):
    dept = fr.departments(spark, d)
    return subtree(dept, dept.where("id = 'r1'").select("id"))


@query("SELECT 'r2' AS id UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2")
def department_cycles(spark, d):
    """Departments on or below a cycle, after region 2 is moved under one of its nations."""
    dept = fr.departments(spark, d)
    return in_cycles(dept.withColumn("parent_id", F.when(F.col("id") == "r2", "n7").otherwise(F.col("parent_id"))))


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS next_idx FROM lineitem GROUP BY l_orderkey")
def next_ordinal(spark, d):
    return wr.next_ordinals(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").withColumnRenamed("next", "next_idx")
