"""SQL over secured views, and the relational operations reached through it (section K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope as sc
from ..operators.secured_sql import relations, run_sql
from ..sources.storage import table
from . import objects as ob
from .registry import query

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _sql(name: str, text: str, oracle: str | None = None):
    """Registers a SELECT that both engines run."""

    def run(spark, d):
        named, _ = relations(spark, text)
        return run_sql(spark, text, {n: table(spark, d, n) for n in TABLES if n in named}, max_rows=None)

    run.__name__ = name
    query(oracle or text)(run)


_sql("sql_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000")
_sql("sql_join_inner", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0")
_sql("sql_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("sql_join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("sql_join_full", "SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey AND b.c_acctbal > 0")
_sql("sql_join_theta", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 300")
_sql("sql_join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("sql_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
_sql("sql_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_sql("sql_groupby", "SELECT l_returnflag, l_linestatus, floor(sum(l_quantity) * 100 + 0.5) / 100 AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("sql_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
_sql("sql_agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY o_orderpriority")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders",
     "SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS r, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus))::INTEGER AS dr, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS rn FROM orders")
_sql("sql_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
_sql("sql_running_sum", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_orderkey, (sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM orders")
_sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("sql_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_sql("sql_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
_sql("sql_correlated_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
_sql("sql_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
_sql("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_sql("sql_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS size FROM part")
_sql("sql_string_fns", "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 1, 3) AS s, replace(p_name, 'e', '3') AS r, length(p_name) AS n, lpad(p_brand, 12, '*') AS l FROM part",
     "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 1, 3) AS s, replace(p_name, 'e', '3') AS r, length(p_name)::INTEGER AS n, lpad(p_brand, 12, '*') AS l FROM part")
_sql("sql_date_fns", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(last_day(o_orderdate)) AS d, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS diff FROM orders",
     "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(last_day(o_orderdate))::INTEGER AS d, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INTEGER AS diff FROM orders")
_sql("sql_math_fns", "SELECT p_partkey, abs(p_size - 25) AS a, sqrt(p_size) AS s, floor(p_retailprice) AS f, p_size % 7 AS m, sign(p_size - 25) AS g FROM part",
     "SELECT p_partkey, abs(p_size - 25) AS a, sqrt(p_size) AS s, floor(p_retailprice)::BIGINT AS f, p_size % 7 AS m, sign(p_size - 25)::DOUBLE AS g FROM part")
_sql("sql_json_fns", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
_sql("sql_array_fns", "SELECT doc_id, size(split(text, ' ')) AS n, element_at(split(text, ' '), 1) AS first FROM documents", "SELECT doc_id, len(string_split(text, ' '))::INTEGER AS n, string_split(text, ' ')[1] AS first FROM documents")
_sql("sql_aggregates", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mean, bool_or(o_custkey = 10) AS any10 FROM orders GROUP BY o_orderstatus")
_sql("sql_lateral", "SELECT doc_id, w FROM documents LATERAL VIEW explode(split(lang, '')) t AS w", "SELECT doc_id, unnest(string_split(lang, '')) AS w FROM documents")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def sql_params(spark, d):
    return run_sql(spark, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = :who AND o_orderstatus = :status", {"orders": table(spark, d, "orders")}, {"who": 10, "status": "O"}, max_rows=None)


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 1000)")
def sql_capped(spark, d):
    return run_sql(spark, "SELECT o_orderkey FROM orders", {"orders": table(spark, d, "orders")}).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = 10 GROUP BY o_orderstatus")
def sql_scoped_view(spark, d):
    view = sc.readable(table(spark, d, "orders"), ob.PLAIN_ORDERS, ob.SALES)
    return run_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", {"orders": view}, max_rows=None)


@query("SELECT * FROM (VALUES ('customer'), ('orders')) t(name)")
def sql_refs(spark, d):
    named, _ = relations(spark, "WITH x AS (SELECT * FROM orders) SELECT count(*) FROM x JOIN customer c ON x.o_custkey = c.c_custkey WHERE EXISTS (SELECT 1 FROM orders)")
    return spark.createDataFrame([(n,) for n in sorted(named)], "name string")
