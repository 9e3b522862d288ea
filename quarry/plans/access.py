"""Access control (section H and its joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Permission
from ..operators import find as fd
from ..operators import links as lk
from ..operators import scope as sc
from ..operators import write as wr
from ..sources import frames as fr
from ..sources.storage import table
from . import objects as ob
from .registry import query


def directory(spark, d):
    return sc.Directory(fr.users(spark, d), fr.departments(spark, d))


def owned_by_name(spark, d):
    """orders that name their owner by the source's own id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner_name"))
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "owner_name", "o_totalprice")


def people(spark, d):
    return table(spark, d, "customer").withColumn("dept_id", F.concat(F.lit("n"), "c_nationkey"))


@query("SELECT strlen(o_orderkey::VARCHAR) || ':' || o_orderkey AS meta_id, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def scope_own(spark, d):
    mine = sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SALES)
    options = fd.Find(filter={"o_totalprice": {"gte": 1000}}, sort=[("o_totalprice", "desc"), ("o_orderkey", "asc")], fields=["meta_id", "o_orderkey", "o_totalprice"], limit=20)
    return fd.find(mine, ob.PLAIN_ORDERS, options)


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 10")
def scope_own_external(spark, d):
    return sc.readable(owned_by_name(spark, d), ob.EXTERNAL_ORDERS, ob.SALES, directory(spark, d)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def scope_department(spark, d):
    return sc.readable(people(spark, d), ob.CUSTOMER, ob.REGION, directory(spark, d)).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def scope_department_leaf(spark, d):
    return sc.readable(people(spark, d), ob.CUSTOMER, ob.NATION, directory(spark, d)).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def scope_department_owner(spark, d):
    return sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.REGION, directory(spark, d)).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders")
def scope_all(spark, d):
    return sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.ADMIN).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def scope_tenant(spark, d):
    return sc.readable(people(spark, d), ob.CUSTOMER, ob.TENANT).select("c_custkey")


@query("SELECT count(*) AS n FROM orders")
def scope_system(spark, d):
    return sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SYSTEM).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 10")
def scope_manage(spark, d):
    return sc.manageable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.REGION, directory(spark, d)).select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 10")
def scope_details_parent(spark, d):
    parents = sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SALES)
    return sc.children_of(fr.order_lines(spark, d), parents, ["o_orderkey"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query(fr.with_frames("lines links", "SELECT o_orderkey, (SELECT count(*) FROM links JOIN part ON p_partkey = target_p_partkey WHERE owner_o_orderkey = o_orderkey AND p_size < 20) AS n FROM orders WHERE o_custkey = 10"))
def multirel_scoped(spark, d):
    mine = sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SALES)
    visible = lk.visible_links(fr.order_parts(spark, d), table(spark, d, "part").where("p_size < 20"), "target_p_partkey", "p_partkey")
    out = lk.link_arrays(mine, visible, "o_orderkey", "owner_o_orderkey", "target_p_partkey", "part_ids")
    return out.select("o_orderkey", F.coalesce(F.size("part_ids"), F.lit(0)).cast("long").alias("n"))


@query("SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> 10 AND l_linenumber = 1")
def child_parent_scope(spark, d):
    """New children whose parent the subject may not read."""
    lines = fr.order_lines(spark, d).where("l_linenumber = 1")
    allowed = sc.children_of(lines, sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SALES), ["o_orderkey"])
    return wr.delete(lines, ob.LINE.keys, allowed).select("l_orderkey", "l_partkey")


@query("SELECT * FROM (VALUES ('sales+region', 'department', 'own', 'o_orderpriority'), ('sales+clerk', 'all', 'own', 'o_orderpriority'), ('nobody', 'denied', NULL, NULL), ('admin', 'all', 'all', '*')) t(roles, read_scope, manage_scope, may_update)")
def rbac_merge(spark, d):
    rows = []
    for name in ("sales+region", "sales+clerk", "nobody", "admin"):
        p = sc.resolve(ob.PLAIN_ORDERS, ob.Subject(10, tuple(name.split("+"))))
        rows.append((name, p.read if p else "denied", p.manage if p else None, ("*" if p.update is None else ",".join(p.update)) if p else None))
    return spark.createDataFrame(rows, "roles string, read_scope string, manage_scope string, may_update string")


@query("SELECT * FROM (VALUES ('own'), ('denied')) t(read_scope)")
def rbac_details(spark, d):
    both = sc.child_permission(Permission("all", exclude=("a",)), Permission("own", exclude=("b",)))
    none = sc.child_permission(None, Permission("all"))
    return spark.createDataFrame([(both.read,), ("denied" if none is None else none.read,)], "read_scope string")


@query("SELECT 0::BIGINT AS differing")
def scope_parity(spark, d):
    """Rows that only one of the find path and the SQL path over the secured view gives: none."""
    from ..operators.secured_sql import run_sql

    rows = sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.REGION, directory(spark, d)).select("o_orderkey")
    other = run_sql(spark, "SELECT o_orderkey FROM orders", {"orders": rows}, max_rows=None)
    a, b = rows.exceptAll(other), other.exceptAll(rows)
    return a.unionByName(b).agg(F.count(F.lit(1)).alias("differing"))


@query("SELECT * FROM (VALUES ('orders', 'find'), ('orders', 'create'), ('customer', 'find')) t(object, tool)")
def capabilities(spark, d):
    who = ob.Subject(1, ("sales", "region"))
    rows = []
    for o in (ob.PLAIN_ORDERS, ob.CUSTOMER):
        p = sc.resolve(o, who)
        rows += [(o.name, tool) for tool, ok in (("find", p and p.read), ("create", p and p.create), ("delete", p and p.delete)) if ok]
    return spark.createDataFrame(rows, "object string, tool string")


@query("SELECT o_orderkey, o_custkey = 10 AS managed FROM orders WHERE o_custkey = 10 OR o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)")
def scope_roles(spark, d):
    """Each role by its own predicate: read and manage scopes together for reads, manage scopes for changes."""
    who = ob.Subject(ob.OWNER, ("sales", "region"), department="r1")
    o = table(spark, d, "orders")
    read = sc.by_role(o, ob.PLAIN_ORDERS, who, directory(spark, d)).select("o_orderkey")
    managed = sc.by_role(o, ob.PLAIN_ORDERS, who, directory(spark, d), manage=True).select("o_orderkey", F.lit(True).alias("managed"))
    return read.join(managed, "o_orderkey", "left").select("o_orderkey", F.coalesce("managed", F.lit(False)).alias("managed"))
