"""Runs of records over nodes, timers, versions, quotas, numbers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.model import ModelError
from quarry.operators import state as st
from quarry.operators import workflow as wf
from quarry.sources.definitions import load_workflows, parse_workflow

NODES = (wf.Node("review", ("a", "b"), timeout="1d"), wf.Node("cc", ("z",), "notify"), wf.Node("sign", ("c", "d"), mode="all", on_reject="review", on_withdraw="review", timeout="2d", on_timeout="reject"))
DAY = 86400.0


def play(*actions, nodes=NODES, versions=None):
    flow, run, refused = wf.Flow(versions or (wf.Version(nodes, "v1"),)), wf.Run(), []
    for i, (name, actor, *rest) in enumerate(actions):
        at = rest[0] if rest else float(i)
        run = flow.fired(run, at)
        after = flow.act(run, wf.Action(name, actor, at, rest[1] if len(rest) > 1 else None, actor == "admin"))
        if after is None:
            refused.append(i)
        run = after or run
    return run, refused


def test_quorums_and_notified_nodes():
    run, refused = play(("submit", "o"), ("approve", "x"), ("approve", "a"), ("approve", "c"), ("approve", "c"), ("approve", "d"))
    assert (run.state, run.approval, run.told, refused) == ("finished", "approved", ("z",), [1, 4])


def test_forward_reject_withdraw():
    run, refused = play(("submit", "o"), ("forward", "a", 1.0, "e"), ("approve", "a"), ("approve", "e"), ("reject", "d"), ("withdraw", "x"), ("withdraw", "o"), ("approve", "a"), ("submit", "o"))
    assert (run.state, run.node, run.waiting, run.originator, refused) == ("running", "review", ("a", "b"), "o", [2, 5, 7])
    run, _ = play(("submit", "o"), ("approve", "b"), ("withdraw", "o"))
    assert run.node == "review"  # a node says where a withdrawal leads
    run, refused = play(("submit", "o"), ("submit", "o"), ("forward", "a", 2.0, "b"))
    assert run.waiting == ("b",) and refused == [1]  # whom it goes to waits once


def test_ends_and_admins():
    run, refused = play(("cancel", "o"), ("submit", "o"), ("cancel", "o"), ("approve", "a"), ("reactivate", "o", 4.0, "sign"), ("reactivate", "admin", 5.0, "nope"), ("reactivate", "admin", 6.0, "sign"), ("jump", "admin", 7.0, "review"), ("terminate", "admin", 8.0, "finished"))
    assert (run.state, run.approval, refused) == ("finished", "approved", [0, 3, 4, 5])
    assert play(("submit", "o"), ("terminate", "admin", 1.0, "running"))[1] == [1]
    assert play(("submit", "o"), nodes=(wf.Node("x"),))[1] == [0]  # nobody to act
    assert play(("submit", "o"), nodes=(wf.Node("n", ("z",), "notify"),))[0].state == "finished"
    assert play(("submit", "o"), nodes=())[1] == [0]


def test_timers():
    flow = wf.Flow((wf.Version(NODES),))
    run, _ = play(("submit", "o"))
    assert run.due == DAY
    run = flow.fired(run, 1.5 * DAY)
    assert (run.node, run.due, run.told) == ("sign", 3 * DAY, ("z",))  # approved by time, the next node armed from then
    run = flow.fired(run, 3 * DAY)
    assert (run.node, run.due) == ("review", 4 * DAY)  # rejected by time, armed again
    assert flow.fired(run, 3.5 * DAY) == run
    left, _ = play(("submit", "o"), ("approve", "a", 0.5 * DAY))
    assert left.due == 2.5 * DAY  # the timer of the node that was left is gone
    assert play(("submit", "o"), ("cancel", "o"))[0].due is None


def test_a_run_keeps_its_version():
    old, new = wf.Version((wf.Node("x", ("a",)),), "old"), wf.Version((wf.Node("y", ("b",)),), "new", 10.0)
    run, _ = play(("submit", "o", 1.0), ("approve", "b", 11.0), versions=(old, new))
    assert (run.version, run.node) == (0, "x")
    run, _ = play(("submit", "o", 1.0), ("withdraw", "o", 11.0), ("submit", "o", 12.0), versions=(old, new))
    assert (run.version, run.node) == (1, "y")


def test_runs_in_sorted_batches(spark):
    at = datetime(2024, 1, 1)
    steps = [("submit", "o", None), ("approve", "a", None), ("approve", "c", None), ("approve", "d", None)]
    rows = [(f"k{k}", at + timedelta(minutes=i), 10 * k + i, *s, None) for k in range(50) for i, s in enumerate(steps[: 1 + k % 4])]
    log = spark.createDataFrame(rows, "key string, ts timestamp, id long, action string, actor string, arg string, admin boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    found = {r["key"]: r for r in wf.runs(log, (wf.Version(NODES, "v1"),)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 50 and {k: found[k]["state"] for k in ("k0", "k3")} == {"k0": "running", "k3": "finished"}
    assert (found["k2"]["waiting"], found["k2"]["accepted"], found["k2"]["definition"]) == ("d", 3, "v1")
    late = wf.runs(log, (wf.Version(NODES, "v1"),), until=(at + timedelta(days=1, hours=1)).timestamp())
    assert {r["key"]: r["node"] for r in wf.armed(late).collect()}["k0"] == "sign"
    assert wf.runs(log.limit(0), (wf.Version(NODES),)).count() == 0


def test_steps_and_their_hooks(spark):
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame([("k", at, 1, "submit", "o", None, None), ("k", at, 2, "approve", "x", None, None), ("k", at + timedelta(days=2), 3, "approve", "c", None, None), ("k", at + timedelta(days=2), 4, "approve", "d", None, None)],
                                "key string, ts timestamp, id long, action string, actor string, arg string, admin boolean")
    found = wf.steps(log, (wf.Version(NODES),))
    assert [(r["id"], r["action"], r["accepted"], r["from_node"], r["to_node"], r["state"]) for r in found.collect()] == [
        (1, "submit", True, None, "review", "running"), (2, "approve", False, "review", "review", "running"), (None, "timeout", True, "review", "sign", "running"), (3, "approve", True, "sign", "sign", "running"), (4, "approve", True, "sign", None, "finished")]
    seen = {}
    keep = lambda name: lambda d: seen.setdefault(name, d.count())
    assert wf.after_steps(found, keep("exit"), keep("enter"), keep("after"), lambda d: 1 / 0) == ["ZeroDivisionError: division by zero"]
    assert seen == {"exit": 2, "enter": 2, "after": 4}


def test_definitions(spark, tmp_path):
    users = spark.createDataFrame([("u1", ["m"], True), ("u2", ["m", "x"], None), ("u3", ["m"], False), ("u4", ["x"], True)], "id string, roles array<string>, enabled boolean")
    text = '{"nodes": [{"id": "a", "assign": {"roles": ["m"], "mode": "all"}, "onTimeout": {"after": "2h", "action": "reject"}}, {"id": "b", "kind": "notify", "assign": {"roles": ["x", "m"]}, "onReject": "a"}]}'
    a, b = parse_workflow(text, users)
    assert (a.assignees, a.mode, a.timeout, a.on_timeout) == (("u1", "u2"), "all", "2h", "reject") and (b.assignees, b.kind, b.on_reject) == (("u2", "u4", "u1"), "notify", "a")
    for bad in ("{", "{}", '{"nodes": [{"id": "a", "assign": {}}, {"id": "a", "assign": {}}]}', '{"nodes": [{"id": "a", "assign": {}, "onReject": "z"}]}', '{"nodes": [{"id": "a", "kind": "x", "assign": {}}]}'):
        with pytest.raises(ModelError):
            parse_workflow(bad, users)
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "workflow.json").write_text(text)
    loaded = load_workflows(spark, str(tmp_path), users)
    assert loaded["o"].nodes == (a, b) and len(loaded["o"].hash) == 64


def test_quota_amounts(spark):
    at = datetime(2024, 1, 31, 23)
    rows = [("k", at + timedelta(minutes=40 * i), i, a) for i, a in enumerate([3, 3, 0, 2, -1, 9])]
    got = {r["id"]: (r["period_start"], r["allowed"], r["value"], r["remaining"]) for r in st.consumed(spark.createDataFrame(rows, "key string, ts timestamp, id long, amount int"), "day", 5).collect()}
    a, b = "2024-01-31", "2024-02-01"
    assert got == {0: (a, True, 3, 2), 1: (a, False, 3, 2), 2: (b, True, 0, 5), 3: (b, True, 2, 3), 4: (b, True, 2, 3), 5: (b, False, 2, 3)}
    keys = spark.createDataFrame([("t", "u"), (None, "u"), ("", "u")], "s string, k string").select(st.scoped_key(F.col("k"), F.col("s")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["t:u", "u", "u"]
    assert spark.range(1).select(st.tool_key(F.array(F.lit("b"), F.lit("a")), F.lit("x")).alias("k")).first()["k"] == "a,b:x"


def test_numbers(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("b"), ((F.col("id") * 7919) % 1000).alias("o")).withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    got = st.numbered(rows.repartition(5), F.col("b"), ["o"], "n", base=10).collect()
    for b in (None, 1, 2):
        mine = sorted((r["o"], r["n"]) for r in got if r["b"] == b)
        assert [n for _, n in mine] == list(range(11, 11 + len(mine)))
    assert st.numbered(rows.limit(0), F.col("b"), ["o"], "n").count() == 0
    at = F.to_date(F.when(F.col("o") < 2, "2023-12-31").otherwise("2024-01-02"))
    named = st.sequence_field(rows.where("b = 1").orderBy("o").limit(4).select("o"), "no", "R{year}-{seq:3}/{month}/{day}", at, ["o"], cycle="year")
    assert [r["no"] for r in named.orderBy("o").collect()][-1].startswith("R2024-00")
