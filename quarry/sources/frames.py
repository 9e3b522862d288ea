"""Frames derived from the star schema: directory, details, links, side table, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import record_key
from .storage import table


def departments(spark: SparkSession, d: str) -> DataFrame:
    """(id, parent_id, name): a root, a department for each region, below them one for each nation."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    root = spark.createDataFrame([("all", None, "all")], "id string, parent_id string, name string")
    return root.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("all").alias("parent_id"), F.col("r_name").alias("name"))).unionByName(
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))


def users(spark: SparkSession, d: str) -> DataFrame:
    """(id, external_id, department_id, roles, enabled): customers as users."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("external_id"), F.concat(F.lit("n"), "c_nationkey").alias("department_id"),
        F.array(F.lower("c_mktsegment"), F.when(F.col("c_acctbal") > 5000, "manager").otherwise("member")).alias("roles"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal") >= 0).alias("enabled"),
    )


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as details of orders: parent_id, parent_type, parent_idx from 1."""
    l = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return l.withColumns({"parent_id": record_key(l, "l_orderkey"), "parent_type": F.lit("orders"), "parent_idx": F.row_number().over(w)})


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    """(owner_o_orderkey, target_p_partkey, idx): an order's distinct parts, first line first, from 0."""
    w = Window.partitionBy("owner_o_orderkey").orderBy("first")
    first = order_lines(spark, d).groupBy(F.col("l_orderkey").alias("owner_o_orderkey"), F.col("l_partkey").alias("target_p_partkey")).agg(F.min("parent_idx").alias("first"))
    return first.select("owner_o_orderkey", "target_p_partkey", (F.row_number().over(w) - 1).alias("idx"))


def meta_orders(spark: SparkSession, d: str) -> DataFrame:
    """(record_key, status, created_time): the side table, for every third order."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    status = F.create_map(*map(F.lit, ["O", "running", "F", "effective", "P", "canceled"]))
    return o.select(record_key(o, "o_orderkey").alias("record_key"), status[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("created_time"))


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """events as an audit log."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("user_id") % 5 == 0, "system").otherwise("user").alias("actor_type"), F.col("user_id").cast("string").alias("actor_id"),
        F.col("event_type").alias("action"), F.when(F.col("event_type") == "purchase", "orders").otherwise("customer").alias("object"), F.col("user_id").cast("string").alias("object_id"),
        (F.col("event_type") == "error").alias("is_error"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("scope_id"), F.col("props").alias("meta"), "value",
    )


def nullable_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders, priority and price null for every seventh."""
    o = table(spark, d, "orders")
    return o.withColumns({c: F.when(F.col("o_orderkey") % 7 != 0, F.col(c)) for c in ("o_orderpriority", "o_totalprice")})


def tagged_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders with an array field of priority and status."""
    return table(spark, d, "orders").withColumn("tags", F.array("o_orderpriority", "o_orderstatus"))


#: the same frames as SQL common table expressions
SQL = {
    "dept": "dept(id, parent_id, name) AS (SELECT 'all', CAST(NULL AS VARCHAR), 'all' UNION ALL SELECT 'r' || r_regionkey, 'all', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)",
    "users": "users AS (SELECT c_custkey::VARCHAR AS id, c_name AS external_id, 'n' || c_nationkey AS department_id, [lower(c_mktsegment), CASE WHEN c_acctbal > 5000 THEN 'manager' ELSE 'member' END] AS roles, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal >= 0 END AS enabled FROM customer)",
    "lines": "lines AS (SELECT *, strlen(l_orderkey::VARCHAR) || ':' || l_orderkey AS parent_id, 'orders' AS parent_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS parent_idx FROM lineitem)",
    "links": "links AS (SELECT l_orderkey AS owner_o_orderkey, l_partkey AS target_p_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY min(parent_idx)) - 1)::INTEGER AS idx FROM lines GROUP BY l_orderkey, l_partkey)",
    "meta": "meta AS (SELECT strlen(o_orderkey::VARCHAR) || ':' || o_orderkey AS record_key, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'effective' ELSE 'canceled' END AS status, o_orderdate AS created_time FROM orders WHERE o_orderkey % 3 = 0)",
    "audit": "audit AS (SELECT event_id AS id, ts, CASE WHEN user_id % 5 = 0 THEN 'system' ELSE 'user' END AS actor_type, user_id::VARCHAR AS actor_id, event_type AS action, CASE WHEN event_type = 'purchase' THEN 'orders' ELSE 'customer' END AS object, user_id::VARCHAR AS object_id, event_type = 'error' AS is_error, 't' || (user_id % 3) AS scope_id, props AS meta, value FROM events)",
    "norders": "norders AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders)",
    "torders": "torders AS (SELECT *, [o_orderpriority, o_orderstatus] AS tags FROM orders)",
}


def with_frames(names: str, body: str, recursive: bool = False) -> str:
    """SQL ``body`` over the named frames."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in names.split())} {body}"
