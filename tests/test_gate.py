"""What the SQL gate refuses, whatever the spelling."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.model import ModelError, Subject
from quarry.operators import secured_sql as gate
from quarry.operators.scope import Directory
from quarry.plans import objects as ob
from quarry.sources.storage import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def views(spark):
    return {"orders": table(spark, SF, "orders").select("o_orderkey", "o_custkey")}


def refused(spark, sql, views, code):
    with pytest.raises(ModelError) as e:
        gate.run_sql(spark, sql, views)
    assert e.value.code == code, (sql, e.value)


def test_functions_by_any_spelling(spark, views):
    for call in ("reflect('java.lang.System', 'lineSeparator')", "`reflect`('java.lang.System', 'lineSeparator')", "reflect/**/('java.lang.System', 'lineSeparator')", "ReFlEcT ('a', 'b')", "java_method('a', 'b')", "`try_reflect`('a', 'b')",
                 "input_file_name()", "builtin.reflect('a', 'b')", "system.builtin.reflect('a', 'b')", "other.f(1)", "nobody_knows(1)", "upper(concat('x', reflect('a', 'b')))", "current_user()", "current_user"):
        refused(spark, f"SELECT {call} AS x FROM orders", views, "script.query.function")
    for where in ("WHERE o_orderkey IN (SELECT reflect('a', 'b') FROM orders)", "ORDER BY reflect('a', 'b')", "GROUP BY reflect('a', 'b')", "WHERE EXISTS (SELECT 1 FROM orders HAVING max(reflect('a', 'b')) = 1)"):
        refused(spark, f"SELECT 1 FROM orders {where}", views, "script.query.function")
    refused(spark, "WITH x AS (SELECT reflect('a', 'b') AS r) SELECT * FROM x", views, "script.query.function")
    refused(spark, "SELECT * FROM orders LATERAL VIEW reflect('a', 'b') t AS w", views, "script.query.function")
    refused(spark, "SELECT * FROM sql_keywords()", views, "script.query.function")
    spark.udf.register("mine", lambda: 1)
    refused(spark, "SELECT mine() FROM orders", views, "script.query.function")


def test_statements_that_are_no_query(spark, views, tmp_path):
    out = tmp_path / "out"
    for sql in (f"WITH a AS (SELECT * FROM orders) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM a", f"INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT 1", "CREATE TABLE t AS SELECT 1", "CREATE TEMP VIEW v AS SELECT 1",
                "DROP TABLE orders", "SHOW TABLES", "DESCRIBE orders", "EXPLAIN SELECT 1", "SET a = 1", "USE x", "CACHE TABLE orders", "FROM orders INSERT INTO x SELECT *", "MERGE INTO orders USING orders o ON true WHEN MATCHED THEN DELETE",
                "UPDATE orders SET o_custkey = 1", "DELETE FROM orders", "TRUNCATE TABLE orders", "SELECT TRANSFORM(o_custkey) USING 'cat' AS (x) FROM orders", "SELECT 1; SELECT 2", "", "REFRESH TABLE orders", "ADD JAR 'x'"):
        refused(spark, sql, views, "script.query.invalid")
    assert not out.exists()


def test_tables_outside_the_views(spark, views):
    spark.range(1).createOrReplaceTempView("secret")
    for sql in ("SELECT * FROM secret", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "SELECT * FROM global_temp.secret", "SELECT 1 FROM orders WHERE EXISTS (SELECT 1 FROM secret)", "SELECT (SELECT max(id) FROM secret)",
                "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1) SELECT * FROM secret)", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT * FROM orders, LATERAL (SELECT * FROM secret)"):
        refused(spark, sql, views, "script.query.table")
    spark.catalog.dropTempView("secret")


def test_bounds(spark, views):
    began = time.time()
    refused(spark, "SELECT " + " + ".join(["1"] * 4000), views, "script.query.invalid")
    refused(spark, "SELECT 1 " + " " * 20_000, views, "script.query.too_long")
    refused(spark, "SELECT 1 FROM orders " + "JOIN orders ON true " * 9, views, "script.query.joins")
    refused(spark, "SELECT 1 FROM orders WHERE o_custkey IN (SELECT a.o_custkey FROM orders a " + "CROSS JOIN orders " * 9 + ")", views, "script.query.joins")
    assert time.time() - began < 60


def test_what_passes(spark, views):
    for sql, n in (("SELECT count(*) AS n FROM orders", 1500), ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT count(*) FROM t", 5), ("SELECT count(*) FROM ORDERS o WHERE 'reflect(1)' <> ''", 1500),
                   ("SELECT sum(x) FROM (SELECT explode(array(1, 2)) AS x)", 3), ("SELECT count(*) FROM range(7)", 7), ("SELECT max(x) FROM VALUES (1), (2) AS t(x)", 2)):
        assert gate.run_sql(spark, sql, views).first()[0] == n
    assert gate.run_sql(spark, "SELECT o_orderkey FROM orders", views).count() == 1000


def test_the_callers_views_stay(spark, views):
    spark.range(3).createOrReplaceTempView("orders")
    assert gate.run_sql(spark, "SELECT count(*) FROM orders", views).first()[0] == 1500
    assert spark.table("orders").count() == 3
    out = gate.run_sql(spark, "SELECT o_orderkey FROM orders", views, max_rows=None)
    assert out.join(views["orders"], "o_orderkey").count() == 1500
    spark.catalog.dropTempView("orders")
    assert out.count() == 1500


def test_scoped_sql(spark):
    objects = {"orders": (table(spark, SF, "orders"), ob.PLAIN_ORDERS), "customer": (table(spark, SF, "customer").withColumn("dept_id", F.lit("x")), ob.CUSTOMER)}
    directory = Directory(spark.createDataFrame([("10", "x", "r1")], "id string, external_id string, department_id string"), spark.createDataFrame([("r1", None)], "id string, parent_id string"))
    run = lambda sql, who: gate.run_scoped(spark, sql, objects, who, directory, max_rows=None)
    mine = table(spark, SF, "orders").where("o_custkey = 10").count()
    assert run("SELECT count(*) FROM orders", ob.SALES).first()[0] == mine
    for sql, who, code in (("SELECT 1 FROM orders", Subject(1, ("nobody",)), "rbac.denied"), ("SELECT 1 FROM nation", ob.ADMIN, "script.query.table"), ("SELECT 1 FROM orders", Subject(10, ("region",)), "rbac.scope.department")):
        with pytest.raises(ModelError) as e:
            run(sql, who)
        assert e.value.code == code
    with pytest.raises(Exception, match="o_totalprice"):
        run("SELECT o_totalprice FROM orders", Subject(10, ("clerk",)))


def test_time_limit(spark):
    assert len(gate.rows_within(spark.range(5), 60)) == 5
    slow = spark.range(0, 10**12, 1, 2).where(F.sha2(F.col("id").cast("string"), 256) == "x")
    with pytest.raises(ModelError, match="script.query.timeout"):
        gate.rows_within(slow, 2)
