"""State, logs, closure, SQL gate, streams and plans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.model import ModelError
from quarry.operators import closure, find as fd, links as lk, logs as lg, state as st, tooling as tl, write as wr
from quarry.operators.secured_sql import run_sql
from quarry.plans import objects as ob
from quarry.sources import identity
from quarry.sources.storage import table
from quarry.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_limiter_forgets_and_does_not_count_refusals():
    limiter = st.Limiter(10, 2)
    assert [limiter.hit(t) for t in (0, 1, 2, 9, 10, 10.5, 11, 12)] == [True, True, False, False, True, False, True, False]
    assert st.seconds("500ms") == 0.5 and st.seconds("2d") == 172800


def test_rate_limit_in_sorted_batches(spark):
    at = datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", at + timedelta(seconds=i // 3 * 7), i) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {r["id"]: r["accepted"] for r in st.rate_limit(spark.createDataFrame(rows, "key string, ts timestamp, id long"), "1m", 5).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for k in range(3):
        limiter = st.Limiter(60, 5)
        for key, ts, i in rows:
            if key == f"k{k}":
                expected[i] = limiter.hit(ts.timestamp())
    assert got == expected


def test_workflow():
    state = (st.START, 0, 0)
    for action in ("approve", "submit", "approve", "reject", "approve", "approve", "cancel"):
        state = st.workflow_step(state, action, 2)
    assert state == (st.DONE, 1, 5)


def test_limited_stream_equals_batch(spark):
    hits = jobs.events_stream(spark, SF).select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("key"), "ts", F.col("event_id").alias("id"))
    got = {(r["key"], r["id"], r["accepted"]) for r in jobs.drained(spark, jobs.limited(hits, "1d", 3), "append").collect()}
    batch = table(spark, SF, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("key"), "ts", F.col("event_id").alias("id"))
    assert got == {tuple(r) for r in st.rate_limit(batch, "1d", 3).collect()}


def test_workflow_stream_equals_batch(spark):
    action = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "purchase", "approve").otherwise("reject")
    log = lambda e: e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), action.alias("action"))
    got = {tuple(r) for r in jobs.drained(spark, jobs.workflow_states(log(jobs.events_stream(spark, SF)), 2), "append").collect()}
    assert got == {tuple(r) for r in st.workflow_state(log(table(spark, SF, "events")), 2).collect()}


@pytest.mark.parametrize("small", [50_000, 0])
def test_subtree_and_cycles(spark, small, monkeypatch):
    monkeypatch.setattr(closure, "SMALL_TREE", small)
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("lost", "gone")], "id string, parent_id string")
    assert sorted(r[0] for r in closure.subtree(tree, tree.where("id = 'b'").select("id")).collect()) == ["b", "c"]
    assert sorted(r[0] for r in closure.subtree(tree, tree.where("id = 'x'").select("id")).collect()) == ["x", "y", "z"]
    assert sorted(r[0] for r in closure.in_cycles(tree).collect()) == ["x", "y", "z"]


def test_links(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    links = spark.createDataFrame([(1, 7, 1), (1, 5, 0), (2, 5, 0)], "o long, t long, idx int")
    names = lambda op, v: sorted(r[0] for r in lk.linked_to(owners, links, "k", "o", "t", op, v).select("k").collect())
    assert {r["k"]: r["ts"] for r in lk.link_arrays(owners, links, "k", "o", "t", "ts").collect()} == {1: [5, 7], 2: [5], 3: None}
    assert [names(*x) for x in (("contains", []), ("contains", [5, 7, 7]), ("in", []), ("in", [7]), ("eq", [5]), ("eq", []), ("ne", [5]), ("ne", []))] == [[1, 2, 3], [1], [], [1], [2], [3], [1, 3], [1, 2]]
    made = lk.write_links(spark.createDataFrame([(1, [3, 3, None, 2])], "o long, v array<long>"), "o", "v", "t")
    assert sorted(map(tuple, made.collect())) == [(1, 2, 1), (1, 3, 0)]


def test_approvals(spark):
    votes = [("a", "x", "approve", 1, 1, "r"), ("a", "x", "approve", 2, 2, "r"), ("a", "r", "approve", 3, 3, "r"), ("b", "x", "approve", 1, 1, "r"), ("b", "y", "approve", 2, 2, "r"), ("b", "z", "reject", 3, 3, "r"), ("c", "x", "reject", 1, 1, "r"), ("c", "y", "approve", 2, 2, "r"), ("d", "r", "approve", 1, 1, "r")]
    got = {r["key"]: (r["status"], r["approvals"]) for r in lg.approval_status(spark.createDataFrame(votes, "key string, voter string, vote string, ts long, id long, requester string"), 2).collect()}
    assert got == {"a": ("pending", 1), "b": ("approved", 2), "c": ("rejected", 0), "d": ("pending", 0)}


def test_replay_gap(spark):
    events = spark.range(1, 101).withColumnRenamed("id", "seq")
    kept = lg.replay(events, 10, 20).collect()
    assert len(kept) == 20 and all(r["gap"] for r in kept)
    assert [r["gap"] for r in lg.replay(events, 90, 20).collect()] == [False] * 10


def test_sql_gate(spark):
    view = {"orders": table(spark, SF, "orders").select("o_orderkey")}
    assert run_sql(spark, "WITH x AS (SELECT * FROM orders) SELECT count(*) AS n FROM x", view).first()["n"] == 1500
    assert run_sql(spark, "SELECT * FROM orders", view).count() == 1000
    bad = {
        "DROP TABLE orders": "script.query.invalid", "SELECT 1; SELECT 2": "script.query.invalid", "INSERT INTO orders VALUES (1)": "script.query.invalid", "SELEC": "script.query.invalid",
        "SELECT * FROM secret": "script.query.table", "SELECT * FROM parquet.`/tmp/x`": "script.query.table", "SELECT reflect('java.lang.System', 'exit') FROM orders": "script.query.function",
        "SELECT * FROM orders " + "JOIN orders ON true " * 9: "script.query.joins", "SELECT 1 " + " " * 20_000: "script.query.too_long",
    }
    for sql, code in bad.items():
        with pytest.raises(ModelError) as e:
            run_sql(spark, sql, view)
        assert e.value.code == code, sql
    with pytest.raises(Exception, match="o_totalprice"):  # a hidden column is not in the view
        run_sql(spark, "SELECT o_totalprice FROM orders", view)
    assert "orders" not in [t.name for t in spark.catalog.listTables()]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(map(tuple, wr.update(old, ["k"], spark.createDataFrame([(1, None)], "k long, v string")).collect()), key=str) == [(1, None), (2, None)]
    feed = wr.change_feed(old, spark.createDataFrame([(2, None), (3, "c")], "k long, v string"), ["k"], ["v"])
    assert sorted(map(tuple, feed.collect())) == [(1, "record.deleted"), (3, "record.created")]
    made = wr.create(old, spark.createDataFrame([(5,)], "k long"), ob.PLAIN_ORDERS, {"v": F.lit("d")}, ("t", "x"))
    assert {r["k"]: (r["v"], r["t"]) for r in made.collect()} == {1: ("a", None), 2: (None, None), 5: ("d", "x")}
    assert wr.orphans(old.withColumn("fk", F.when(F.col("k") == 1, 9)), "fk", old, "k").count() == 1


def test_identity_coercion(spark):
    df = spark.createDataFrame([("1", ["a", " b ", ""], True), ("2", None, None)], "i string, r array<string>, e boolean")
    rows = identity.mapped_users(df, {"id": "i", "roles": "r", "enabled": "e"}).collect()
    assert rows[0]["roles"] == ["a", "b"] and rows[0]["enabled"] is True and rows[1]["roles"] is None


def test_tooling():
    assert tl.canonical_json({"b": 1, "a": [1, {"d": None}]}) == '{"a":[1,{"d":null}],"b":1}'
    assert tl.impact([ob.ORDERS, ob.CUSTOMER, ob.LINE], "part") == ["orders"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(fd.find(table(spark, SF, "orders"), ob.PLAIN_ORDERS, fd.Find(filter={"o_orderstatus": "O", "o_totalprice": {"gte": 10}}, fields=["o_orderkey"], sort=[("o_orderkey", "asc")])))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text and "TakeOrderedAndProject" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quarry.sources.storage import shared_dir

    sc = SimpleNamespace(master="spark://x:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc))


def test_events_in_a_folder_and_late_rows(spark, tmp_path):
    table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    sent = jobs.relay(spark, str(tmp_path))
    assert sent.count() == table(spark, SF, "events").count() == sent.select("id").distinct().count()


def test_scopes_take_the_columns_type(spark):
    from quarry.operators import scope as sc
    from quarry.sources import frames as fr

    rows = sc.scoped(table(spark, SF, "orders"), ob.PLAIN_ORDERS, ob.REGION, "department", sc.Directory(fr.users(spark, SF), fr.departments(spark, SF)))
    assert "cast(o_custkey" not in plan(rows)


def test_side_table_is_joined_only_when_used(spark):
    from quarry.sources import frames as fr

    o, meta = table(spark, SF, "orders"), fr.meta_orders(spark, SF)
    assert "Join" not in plan(fd.find(o, ob.PLAIN_ORDERS, fd.Find(), meta))
    assert "Join" in plan(fd.find(o, ob.PLAIN_ORDERS, fd.Find(filter={"meta_status": "draft"}, fields=["o_orderkey", "meta_status"]), meta))


def test_no_query_multiplies_tables(spark):
    from quarry import plans

    for name, f in plans.queries().items():
        if not name.startswith("stream_"):
            assert "CartesianProduct" not in plan(f(spark, SF)), name
