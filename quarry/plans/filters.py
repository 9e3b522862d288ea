"""Filters and predicates (section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import find as fd
from ..operators import links as lk
from ..operators import logs as lg
from ..operators import write as wr
from ..sources import frames as fr
from ..sources.storage import table
from .objects import CUSTOMER, LINE, ORDERS
from .registry import query


def _filter(name: str, filter: dict, where: str, frame=fr.tagged_orders, sql: str = "torders"):
    """Registers a filter over orders."""

    def run(spark, d):
        return fd.filtered(frame(spark, d), ORDERS, filter).select("o_orderkey", "o_orderstatus", "o_totalprice")

    run.__name__ = name
    query(fr.with_frames(sql, f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {sql} WHERE {where}"))(run)


_filter("filter_eq", {"o_orderstatus": {"eq": "O"}}, "o_orderstatus = 'O'")
_filter("filter_bare", {"o_orderstatus": "F", "o_custkey": 10}, "o_orderstatus = 'F' AND o_custkey = 10")
_filter("filter_ne", {"o_orderpriority": {"ne": "1-URGENT"}}, "o_orderpriority <> '1-URGENT'", fr.nullable_orders, "norders")
_filter("filter_cmp", {"o_totalprice": {"gt": 100000}, "o_custkey": {"lte": 700}}, "o_totalprice > 100000 AND o_custkey <= 700")
_filter("filter_in", {"o_orderstatus": {"in": ["O", "P"]}}, "o_orderstatus IN ('O', 'P')")
_filter("filter_in_empty", {"o_orderstatus": {"in": []}}, "false")
_filter("filter_contains", {"tags": {"contains": ["O", "1-URGENT"]}}, "list_has_all(tags, ['O', '1-URGENT'])")
_filter("filter_contains_scalar", {"o_orderstatus": {"contains": ["O"]}, "o_custkey": {"lt": 20}}, "o_custkey < 20")
_filter("filter_like", {"o_orderpriority": {"like": "urg"}}, "o_orderpriority ILIKE '%urg%'")
_filter("filter_range", {"o_totalprice": {"gte": 50000, "lt": 60000}}, "o_totalprice >= 50000 AND o_totalprice < 60000")
_filter("filter_or", {"$or": [{"o_orderstatus": "P"}, {"o_custkey": {"lt": 50}, "o_totalprice": {"gt": 200000}}]}, "o_orderstatus = 'P' OR (o_custkey < 50 AND o_totalprice > 200000)")
_filter("filter_and", {"$or": [{"o_orderstatus": "P"}, {"o_orderstatus": "F"}], "o_totalprice": {"lt": 30000}, "o_custkey": {"gt": 5}}, "(o_orderstatus = 'P' OR o_orderstatus = 'F') AND o_totalprice < 30000 AND o_custkey > 5")
_filter("filter_null", {"o_orderpriority": {"eq": None}}, "false", fr.nullable_orders, "norders")


@query(fr.with_frames("meta", "SELECT o_orderkey, coalesce(status, 'draft') AS meta_status FROM orders LEFT JOIN meta ON record_key = strlen(o_orderkey::VARCHAR) || ':' || o_orderkey WHERE coalesce(status, 'draft') IN ('draft', 'canceled')"))
def filter_meta_status(spark, d):
    o = fd.with_virtual(table(spark, d, "orders"), ORDERS, fr.meta_orders(spark, d), {"meta_status"})
    return fd.filtered(o, ORDERS, {"meta_status": {"in": ["draft", "canceled"]}}).select("o_orderkey", "meta_status")


@query(fr.with_frames("lines", "SELECT l_orderkey, l_partkey, parent_idx FROM lines WHERE parent_id = '2:33' OR parent_idx > 6"))
def filter_parent(spark, d):
    return fd.filtered(fr.order_lines(spark, d), LINE, {"$or": [{"parent_id": "2:33"}, {"parent_idx": {"gt": 6}}]}).select("l_orderkey", "l_partkey", "parent_idx")


def _links(name: str, op: str, values: list, sql: str, filter: dict | None = None):
    def run(spark, d):
        links = {"part_ids": lk.Links(fr.order_parts(spark, d), "owner_o_orderkey", "target_p_partkey")}
        return fd.filtered(table(spark, d, "orders"), ORDERS, filter or {"part_ids": {op: values}}, links).select("o_orderkey")

    run.__name__ = name
    query(fr.with_frames("lines links", f"SELECT o_orderkey FROM orders WHERE {sql}"))(run)


_mine = "SELECT DISTINCT target_p_partkey FROM links WHERE owner_o_orderkey = o_orderkey"
_links("multirel_contains", "contains", [51, 60], f"(SELECT count(*) FROM ({_mine} AND target_p_partkey IN (51, 60))) = 2")
_links("multirel_or", "", [], f"o_custkey < 30 AND (o_orderstatus = 'P' OR o_orderkey IN (SELECT owner_o_orderkey FROM links WHERE target_p_partkey IN (1, 2, 3)) OR (o_totalprice > 300000 AND NOT ((SELECT count(*) FROM ({_mine})) = 1 AND (SELECT count(*) FROM ({_mine} AND target_p_partkey = 50)) = 1)))",
       {"o_custkey": {"lt": 30}, "$or": [{"o_orderstatus": "P"}, {"part_ids": {"in": [1, 2, 3]}}, {"o_totalprice": {"gt": 300000}, "part_ids": {"ne": [50], "like": "x"}}]})
_links("multirel_in", "in", [1, 2, 3], "o_orderkey IN (SELECT owner_o_orderkey FROM links WHERE target_p_partkey IN (1, 2, 3))")
_links("multirel_eq", "eq", [50], f"(SELECT count(*) FROM ({_mine})) = 1 AND (SELECT count(*) FROM ({_mine} AND target_p_partkey = 50)) = 1")
_links("multirel_ne", "ne", [50], f"NOT ((SELECT count(*) FROM ({_mine})) = 1 AND (SELECT count(*) FROM ({_mine} AND target_p_partkey = 50)) = 1)")
_links("multirel_eq_empty", "eq", [], f"(SELECT count(*) FROM ({_mine})) = 0")


@query(fr.with_frames("audit", "SELECT id, actor_id, action FROM audit WHERE (action = 'error' OR object = 'orders') AND is_error <> true AND ts >= TIMESTAMP '2024-01-10'"))
def audit_filter(spark, d):
    filter = {"$or": [{"action": "error"}, {"object": "orders"}], "is_error": {"ne": True, "gt": False}, "ts": {"gte": "2024-01-10"}, "secret": 1}
    return lg.audit_filter(fr.audit_events(spark, d), filter).select("id", "actor_id", "action")


@query(fr.with_frames("audit", "SELECT id, actor_id, action FROM audit WHERE action = 'purchase' AND object = 'orders' AND scope_id = 't1' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"))
def audit_query(spark, d):
    return lg.audit_filter(fr.audit_events(spark, d), {"action": "purchase", "object": "orders", "scope_id": "t1", "ts": {"gte": "2024-01-05", "lte": "2024-01-20"}}).select("id", "actor_id", "action")


@query(fr.with_frames("audit", "SELECT id, object_id FROM audit WHERE is_error AND object = 'customer' AND actor_type = 'user'"))
def evidence_query(spark, d):
    return lg.audit_filter(fr.audit_events(spark, d), {"is_error": True, "object": "customer", "actor_type": "user"}).select("id", "object_id")


@query(fr.with_frames("users", "SELECT id FROM users WHERE coalesce(enabled, true) AND list_has_any(roles, ['manager', 'building'])"))
def assignees_by_role(spark, d):
    u = fr.users(spark, d)
    return u.where(F.coalesce("enabled", F.lit(True)) & F.arrays_overlap("roles", F.array(F.lit("manager"), F.lit("building")))).select("id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '4')")
def enum_options_from(spark, d):
    o = table(spark, d, "orders")
    options = o.where("o_orderstatus = 'P' and o_orderpriority < '4'").select("o_orderpriority").distinct()
    return o.join(options, "o_orderpriority", "left_anti").select("o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, 'c_acctbal' AS field, 'min' AS rule FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_name', 'maxLength' FROM customer WHERE length(c_name) > 25 UNION ALL SELECT c_custkey, 'c_name', 'pattern' FROM customer WHERE NOT regexp_matches(c_name, '^Customer')
UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')""")
def validate_records(spark, d):
    return wr.violations(table(spark, d, "customer"), CUSTOMER)
