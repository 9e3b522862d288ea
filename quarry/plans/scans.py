"""Scans, identity sources, projections (sections A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import record_key
from ..operators import find as fd
from ..operators import hooks as hk
from ..operators import links as lk
from ..operators import write as wr
from ..sources import frames as fr
from ..sources import identity
from ..sources.storage import table
from .objects import CUSTOMER, LINE, PLAIN_ORDERS
from .registry import query

RK = "strlen(o_orderkey::VARCHAR) || ':' || o_orderkey"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT '1:7' AS meta_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 7")
def find_one_by_key(spark, d):
    return fd.find_one(table(spark, d, "orders"), PLAIN_ORDERS, "1:7")


@query(fr.with_frames("meta", "SELECT record_key, status FROM meta WHERE record_key IN ('1:3', '1:6', '1:9', '2:12', '1:5')"))
def record_meta_lookup(spark, d):
    return wr.meta_of(fr.meta_orders(spark, d), ["1:3", "1:6", "1:9", "2:12", "1:5"]).select("record_key", "status")


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, array_to_string(list_filter(list_transform(string_split(lower(c_mktsegment) || ', ,' || CASE WHEN c_acctbal > 5000 THEN 'manager' ELSE '' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS roles,
CASE WHEN c_custkey % 5 IN (1, 4) THEN NULL ELSE c_custkey % 5 IN (0, 2) END AS enabled FROM customer""")
def identity_source_map(spark, d):
    c = table(spark, d, "customer").withColumns({
        "groups": F.concat(F.lower("c_mktsegment"), F.lit(", ,"), F.when(F.col("c_acctbal") > 5000, "manager").otherwise("")),
        "active": F.element_at(F.array(*map(F.lit, ["Yes", "off", "1", "FALSE", "unknown"])), (F.col("c_custkey") % 5 + 1).cast("int")),
    })
    mapped = identity.mapped_users(c, {"id": "c_custkey", "name": "c_name", "roles": "groups", "enabled": "active"})
    return mapped.withColumn("roles", F.array_join("roles", "|"))


@query("SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE 'timestamp_ntz' END AS type, ordinal_position::INTEGER AS position FROM information_schema.columns WHERE table_name = 'orders'")
def schema_columns(spark, d):
    s = table(spark, d, "orders").schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(s)], "name string, type string, position int")


@query(fr.with_frames("torders", "SELECT DISTINCT unnest(tags) AS tag FROM torders ORDER BY tag LIMIT 20"))
def distinct_unnest(spark, d):
    return fr.tagged_orders(spark, d).select(F.explode("tags").alias("tag")).distinct().orderBy("tag").limit(20)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def project_default(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.select(*fd.projection(PLAIN_ORDERS, None))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def project_fields(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(*fd.projection(PLAIN_ORDERS, ["o_orderkey", "o_totalprice"]))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def project_exclude(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(*fd.projection(PLAIN_ORDERS, ["o_orderkey", "o_totalprice", "o_orderstatus"], ("o_totalprice",)))


@query("SELECT c_custkey, c_name, 'n' || c_nationkey AS dept_id, c_mktsegment FROM customer")
def project_sensitive(spark, d):
    c = table(spark, d, "customer").withColumn("dept_id", F.concat(F.lit("n"), "c_nationkey"))
    hidden = [f.name for f in CUSTOMER.fields if f.sensitive]
    return c.select(*CUSTOMER.stored).drop(*hidden)


@query("SELECT c_custkey, '***' AS c_name, 0.0::DOUBLE AS c_acctbal FROM customer")
def project_mask(spark, d):
    hide = lambda **masks: lambda context: hk.Decision(masks=masks)
    decision = hk.decide([hide(c_name="hidden", c_acctbal=0.0), hide(c_name="***")], {})  # a later policy wins
    return hk.masked(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), decision)


@query("SELECT l_orderkey, strlen(l_orderkey::VARCHAR) || ':' || l_orderkey || strlen(l_partkey::VARCHAR) || ':' || l_partkey || strlen(l_suppkey::VARCHAR) || ':' || l_suppkey || strlen(l_linenumber::VARCHAR) || ':' || l_linenumber AS meta_id FROM lineitem")
def project_record_id(spark, d):
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", record_key(l, *LINE.keys).alias("meta_id"))


@query(fr.with_frames("meta", f"SELECT o_orderkey, {RK} AS meta_id, coalesce(status, 'draft') AS meta_status, strftime(created_time, '%Y-%m-%d') AS meta_created FROM orders LEFT JOIN meta ON record_key = {RK}"))
def project_meta_fields(spark, d):
    o = fd.with_virtual(table(spark, d, "orders"), PLAIN_ORDERS, fr.meta_orders(spark, d), {"meta_status", "meta_created_time"})
    return o.select("o_orderkey", "meta_id", "meta_status", F.date_format("meta_created_time", "yyyy-MM-dd").alias("meta_created"))


@query(fr.with_frames("lines links", "SELECT o_orderkey, (SELECT string_agg(target_p_partkey::VARCHAR, ',' ORDER BY idx) FROM links WHERE owner_o_orderkey = o_orderkey AND target_p_partkey % 3 = 0) AS part_ids FROM orders"))
def multirel_array(spark, d):
    parts = table(spark, d, "part").where("p_partkey % 3 = 0")
    links = lk.visible_links(fr.order_parts(spark, d), parts, "target_p_partkey", "p_partkey")
    out = lk.link_arrays(table(spark, d, "orders"), links, "o_orderkey", "owner_o_orderkey", "target_p_partkey", "part_ids")
    return out.select("o_orderkey", F.array_join(F.col("part_ids").cast("array<string>"), ",").alias("part_ids"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', true), ('o_custkey', 'bigint', false), ('o_orderstatus', 'enum', false), ('o_orderdate', 'timestamp', false), ('o_orderpriority', 'string', false)) t(field, type, is_key)")
def describe_object(spark, d):
    hidden = PLAIN_ORDERS.permissions["clerk"].exclude
    rows = [(f.name, f.type, f.primary) for f in PLAIN_ORDERS.fields if not f.virtual and f.name not in hidden]
    return spark.createDataFrame(rows, "field string, type string, is_key boolean")
