"""Write path (sections A and M): what tables are after a write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..model import Field, ObjectDef, Subject
from ..operators import links as lk
from ..operators import records as rc
from ..operators import write as wr
from ..sources import frames as fr
from ..sources import identity
from ..sources.storage import table
from . import objects as ob
from .registry import query

NEW_SQL = "new AS (SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')"


def new_orders(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", "o_totalprice")


@query(f"WITH {NEW_SQL} SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'O', NULL FROM new")
def write_create(spark, d):
    out = wr.create(table(spark, d, "orders"), new_orders(spark, d), ob.PLAIN_ORDERS, {"o_orderstatus": F.lit("O")})
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 10 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def write_update(spark, d):
    """Within the subject's scope only."""
    from ..operators import scope as sc

    o = table(spark, d, "orders")
    changes = sc.manageable(o, ob.PLAIN_ORDERS, ob.SALES).select("o_orderkey", F.lit("1-URGENT").alias("o_orderpriority"))
    return wr.update(o, ["o_orderkey"], changes).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000")
def write_delete(spark, d):
    o = table(spark, d, "orders")
    return wr.delete(o, ["o_orderkey"], o.where("o_totalprice < 20000")).select("o_orderkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 20000)")
def write_delete_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_totalprice < 20000")
    return wr.cascade(fr.order_lines(spark, d), gone, ["o_orderkey"]).select("l_orderkey", "l_partkey")


@query(fr.with_frames("meta", ", ch AS (SELECT strlen(o_orderkey::VARCHAR) || ':' || o_orderkey AS record_key, CASE WHEN o_orderkey % 4 = 0 THEN 'running' END AS status FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(m.record_key, ch.record_key) AS record_key, coalesce(ch.status, m.status, 'draft') AS status, m.created_time IS NULL AS is_new FROM meta m FULL JOIN ch ON m.record_key = ch.record_key"))
def record_meta_upsert(spark, d):
    from ..functions.keys import record_key

    o = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    changes = o.select(record_key(o, "o_orderkey").alias("record_key"), F.when(F.col("o_orderkey") % 4 == 0, "running").alias("status"), F.lit(None).cast("timestamp_ntz").alias("created_time"), F.lit(None).cast("timestamp_ntz").alias("modified_time"))
    return wr.upsert_meta(fr.meta_orders(spark, d), changes).select("record_key", "status", F.col("created_time").isNull().alias("is_new"))


@query("""WITH v AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem)
SELECT l_orderkey AS owner, l_partkey AS target, (row_number() OVER (PARTITION BY l_orderkey ORDER BY min(p)) - 1)::INTEGER AS idx FROM v GROUP BY l_orderkey, l_partkey""")
def link_write(spark, d):
    arrays = fr.order_lines(spark, d).groupBy(F.col("l_orderkey").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("parent_idx", "l_partkey"))).alias("_l"))
    return lk.write_links(arrays.select("owner", F.col("_l.l_partkey").alias("parts")), "owner", "parts", "target")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, d):
    return wr.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'record.deleted' WHEN o_orderkey % 5 = 0 THEN 'record.updated' END AS type FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey + 1000000000, 'record.created' FROM orders WHERE o_orderkey % 50 = 1""")
def change_feed(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changed = before.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1.0).otherwise(0.0))
    after = changed.unionByName(before.where("o_orderkey % 50 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    return wr.change_feed(before, after, ["o_orderkey"], ["o_totalprice"])


@query("""SELECT o_orderkey + 1000000000 AS l_orderkey, o_custkey, (coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS idx FROM orders LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey % 97) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = o_custkey WHERE o_orderstatus = 'P'""")
def write_child_index(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 97).alias("idx"))
    new = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1000000000).alias("l_orderkey"), "o_custkey")
    return wr.next_index(old, new, "o_custkey", ["l_orderkey"], "idx").select("l_orderkey", "o_custkey", F.col("idx").cast("long").alias("idx"))


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 7 = 0 THEN 'create' WHEN c_custkey % 11 = 0 THEN 'update' END AS change FROM customer WHERE c_custkey % 13 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0)
UNION ALL SELECT c_custkey::VARCHAR, 'disable' FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 7 <> 0 AND coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal >= 0 END, true)""")
def identity_sync_diff(spark, d):
    u = fr.users(spark, d)
    n = F.col("id").cast("long")
    source = u.where(n % 13 != 0).withColumn("department_id", F.when(n % 11 == 0, "moved").otherwise(F.col("department_id")))
    return identity.sync(source, u.where(n % 7 != 0), ["external_id", "department_id"])


@query("SELECT r_name AS object, CASE WHEN r_regionkey = 0 THEN 'removed' WHEN r_regionkey < 3 THEN 'updated' ELSE 'unchanged' END AS change FROM region UNION ALL SELECT 'NEW', 'updated'")
def metadata_sync(spark, d):
    """The metadata cache against definitions: updated where new or of another hash, removed where gone."""
    from ..operators.tooling import cache_sync

    r = table(spark, d, "region")
    cache = r.select(F.col("r_name").alias("object"), F.sha2("r_name", 256).alias("hash"))
    current = r.where("r_regionkey <> 0").select(F.col("r_name").alias("object"), F.sha2(F.concat("r_name", F.when(F.col("r_regionkey") < 3, "2").otherwise("")), 256).alias("hash"))
    return cache_sync(cache, current.unionByName(spark.createDataFrame([("NEW", "x")], "object string, hash string")))


WORDER = ObjectDef("orders", (
    Field("o_orderkey", "bigint", primary=True), Field("o_custkey", "bigint"), Field("o_totalprice", "double", min=20000), Field("o_orderstatus", default="O"), Field("number", "seq_no", template="N-{seq:6}-{year}"),
    Field("region", scope=True), Field("lines", "details", target="line"), Field("part_ids", "multiRelation", target="part"), Field("qty", "double", formula="SUM(lines.l_quantity)"),
    Field("size", formula="IF(qty > 100, 'big', 'small') & ':' & o_orderstatus"),
))
WLINE = ObjectDef("line", (Field("line_id", primary=True), Field("l_quantity", "double", min=1, max=49)), parent="orders")
WRITER = Subject(7, ("sales",), scope="north")


@query(f"""WITH n AS (SELECT o_orderkey + 1000000000 AS k, * FROM orders WHERE o_orderstatus = 'P'), bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49),
g AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM n WHERE o_totalprice >= 20000 AND o_orderkey NOT IN (SELECT l_orderkey FROM bad)),
l AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS c, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT strlen(k::VARCHAR) || ':' || k AS object_id, false AS is_error, NULL AS error_code, 'N-' || lpad(i::VARCHAR, 6, '0') || '-2024' AS number, 'north' AS region, q AS qty, CASE WHEN coalesce(q, 0) > 100 THEN 'big' ELSE 'small' END || ':O' AS size,
  coalesce(c, 0)::BIGINT AS n_lines, coalesce(p, 0)::BIGINT AS n_parts, 'draft' AS status, 'record.created' AS event FROM g LEFT JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT strlen(k::VARCHAR) || ':' || k, true, CASE WHEN o_totalprice < 20000 THEN 'o_totalprice:min' ELSE 'lines:l_quantity:max' END, NULL, NULL, NULL, NULL, 0, 0, NULL, NULL FROM n WHERE o_totalprice < 20000 OR o_orderkey IN (SELECT l_orderkey FROM bad)""")
def write_record(spark, d):
    """New orders with their lines and parts as one operation; each log row beside what became of its record."""
    l = fr.order_lines(spark, d)
    nested = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("parent_idx", "l_quantity", "l_partkey"))), lambda x: x).alias("_l"))
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").join(nested, "o_orderkey", "left")
    lines = F.transform("_l", lambda x: F.struct(F.concat_ws("/", F.col("o_orderkey").cast("string"), x["parent_idx"].cast("string")).alias("line_id"), x["l_quantity"].alias("l_quantity")))
    new = o.select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", "o_totalprice", lines.alias("lines"), F.col("_l.l_partkey").alias("part_ids"))
    none = lambda schema: spark.createDataFrame([], schema)
    store = rc.Store(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), fr.meta_orders(spark, d).withColumn("modified_time", F.col("created_time")),
        {"lines": (none("line_id string, l_quantity double, parent_id string, parent_type string, parent_idx int"), WLINE)}, {"part_ids": lk.Links(none("o bigint, p bigint, idx int"), "o", "p")})
    done = rc.create(store, WORDER, new, WRITER, datetime(2024, 3, 5))
    lines, parts = (x.groupBy(k).agg(F.count(F.lit(1)).alias(n)) for x, k, n in ((done.store.children["lines"][0], F.col("parent_id").alias("object_id"), "n_lines"), (done.store.links["part_ids"].rows, F.col("o").alias("o_orderkey"), "n_parts")))
    records = done.records.select(F.col("meta_id").alias("object_id"), "o_orderkey", "number", "region", "qty", "size").join(parts, "o_orderkey", "left").drop("o_orderkey")
    out = done.audit.select("object_id", "is_error", "error_code").join(records, "object_id", "left").join(lines, "object_id", "left")
    out = out.join(done.store.meta.select(F.col("record_key").alias("object_id"), "status"), "object_id", "left").join(done.events.select("object_id", F.col("type").alias("event")), "object_id", "left")
    return out.select("object_id", "is_error", "error_code", "number", "region", "qty", "size", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_parts")), "status", "event")


@query("""SELECT o_orderkey, CASE WHEN o_custkey = 10 AND o_orderkey % 2 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_custkey = 10 AND o_orderkey % 2 = 0 THEN 'ok' WHEN o_orderkey % 1000 = 0 AND o_custkey <> 10 THEN 'data.recordNotFound' END AS outcome FROM orders""")
def write_record_update(spark, d):
    """An update within the subject's scope; what lies outside is refused as not found."""
    o = table(spark, d, "orders")
    changes = o.where("(o_custkey = 10 and o_orderkey % 2 = 0) or (o_custkey <> 10 and o_orderkey % 1000 = 0)").select("o_orderkey", F.lit("9-NEW").alias("o_orderpriority"))
    done = rc.update(rc.Store(o), ob.PLAIN_ORDERS, changes, ob.SALES, datetime(2024, 3, 5))
    outcome = done.records.select("o_orderkey", F.lit("ok").alias("outcome")).unionByName(done.refused.select("o_orderkey", F.col("error_code").alias("outcome")))
    return done.store.rows.select("o_orderkey", "o_orderpriority").join(outcome, "o_orderkey", "left")
