"""Writes as one operation, formulas as text, tools, approvals, filters over links."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import formula_text as ft
from quarry.model import Field, ModelError, ObjectDef, Permission, Subject
from quarry.operators import find as fd
from quarry.operators import hooks as hk
from quarry.operators import links as lk
from quarry.operators import records as rc
from quarry.operators import scope as sc
from quarry.operators import tools
from quarry.operators import tooling as tl
from quarry.operators import write as wr
from quarry.sources import identity
from quarry.streaming import jobs

AT = datetime(2024, 5, 6)
LINE = ObjectDef("line", (Field("id", "bigint", primary=True), Field("amount", "double", min=0)), parent="doc")
DOC = ObjectDef("doc", (
    Field("id", "bigint", primary=True), Field("title", required=True), Field("state", default="new"), Field("day", "timestamp", default="now"), Field("tenant", scope=True), Field("owner", "bigint", ownership="internal"),
    Field("no", "seq_no", template="D{seq:3}"), Field("lines", "details", target="line"), Field("tags", "multiRelation", target="tag"), Field("total", "double", formula="SUM(lines.amount)"), Field("twice", "double", formula="total * 2"),
), {"user": Permission("own", "own", True, True, ("title",)), "admin": Permission("all", "all", True, True, None)})
ME = Subject(7, ("user",), scope="t1")


def store(spark):
    none = lambda s: spark.createDataFrame([], s)
    rows = spark.createDataFrame([(1, "old", "t1", 7), (2, "other", "t1", 8)], "id long, title string, tenant string, owner long")
    return rc.Store(rows, none("record_key string, status string, created_time timestamp_ntz, modified_time timestamp_ntz"), {"lines": (none("id long, amount double, parent_id string, parent_type string, parent_idx int"), LINE)}, {"tags": lk.Links(none("d long, t long, idx int"), "d", "t")})


def test_create(spark):
    new = spark.createDataFrame(
        [(3, "a", 7, [(31, 2.0), (32, 5.0)], [9, 9, 8]), (4, None, 7, None, None), (1, "again", 7, [], []), (5, "b", 7, [(51, -1.0)], None), (6, "c", 7, [], None)],
        "id long, title string, owner long, lines array<struct<id: long, amount: double>>, tags array<long>")
    done = rc.create(store(spark), DOC, new, ME, AT)
    rows = {r["id"]: r for r in done.store.rows.collect()}
    assert set(rows) == {1, 2, 3, 6} and rows[1]["title"] == "old"
    r = rows[3]
    assert (r["state"], r["tenant"], r["total"], r["twice"], r["day"]) == ("new", "t1", 7.0, 14.0, AT) and rows[6]["total"] is None
    assert sorted(rows[i]["no"] for i in (3, 6)) == ["D001", "D002"]
    assert {x["id"]: x["error_code"] for x in done.refused.collect()} == {4: "title:required", 1: "data.unique", 5: "lines:amount:min"}
    assert sorted((x["id"], x["parent_id"], x["parent_type"], x["parent_idx"]) for x in done.store.children["lines"][0].collect()) == [(31, "1:3", "doc", 1), (32, "1:3", "doc", 2)]
    assert sorted((x["d"], x["t"], x["idx"]) for x in done.store.links["tags"].rows.collect()) == [(3, 8, 1), (3, 9, 0)]
    assert {x["record_key"]: x["status"] for x in done.store.meta.collect()} == {"1:3": "draft", "1:6": "draft"}
    assert sorted((x["object_id"], x["is_error"], x["scope_id"]) for x in done.audit.collect()) == [("1:1", True, "t1"), ("1:3", False, "t1"), ("1:4", True, "t1"), ("1:5", True, "t1"), ("1:6", False, "t1")]
    assert sorted(x["object_id"] for x in done.events.collect()) == ["1:3", "1:6"]
    saved = []
    loaded, warnings = rc.commit(done, saved.append, [lambda d: 1 / 0], lambda d: d.withColumn("seen", F.lit(True)))
    assert len(saved) == 1 and "seen" in loaded.columns and warnings == ["ZeroDivisionError: division by zero"]
    with pytest.raises(ModelError):
        rc.create(store(spark), DOC, new, ME, AT, before=[lambda d: (_ for _ in ()).throw(ModelError("no"))])


def test_children_go_on_counting(spark):
    have = spark.createDataFrame([(1, 1.0, "1:9", "doc", 4)], "id long, amount double, parent_id string, parent_type string, parent_idx int")
    done = rc.create(rc.Store(have), LINE, spark.createDataFrame([(2, 1.0), (3, 2.0)], "id long, amount double"), ME, AT, parent_key=F.lit("1:9"))
    assert sorted(r["parent_idx"] for r in done.store.rows.collect()) == [4, 5, 6]


def test_update_and_remove(spark):
    s = store(spark)
    changes = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "id long, title string")
    done = rc.update(s, DOC, changes, ME, AT)
    assert {r["id"]: r["title"] for r in done.store.rows.collect()} == {1: "x", 2: "other"}
    assert {r["id"]: r["error_code"] for r in done.refused.collect()} == {2: "data.recordNotFound", 9: "data.recordNotFound"}
    assert {r["id"] for r in rc.update(s, DOC, spark.createDataFrame([(1, None)], "id long, title string"), ME, AT).refused.collect()} == {1}
    admin = Subject(1, ("admin",), scope="t1")
    for columns, code in (("id long, tenant string", "object.scope.immutable"), ("id long, nope string", "data.field.unknown")):
        with pytest.raises(ModelError) as e:
            rc.update(s, DOC, spark.createDataFrame([(1, "a")], columns), admin, AT)
        assert e.value.code == code
    with pytest.raises(ModelError, match="object.primary.mutable"):
        sc.check_changes(DOC, admin, ["id"])
    gone = rc.remove(s, DOC, spark.createDataFrame([(1,), (2,)], "id long"), ME, AT)
    assert [r["id"] for r in gone.store.rows.collect()] == [2] and [r["type"] for r in gone.events.collect()] == ["record.deleted"]


def test_formula_text(spark):
    parse = lambda t: ft.parse(spark, t)
    assert ft.references(parse("IF(a > 1, rel.b, SUM(kids.c)) & COUNT(kids)")) == (["a", "rel.b"], [("sum", "kids.c"), ("count", "kids")])
    for bad in ("a +", "nope(a)", "SUM(a)", "a[0]", "CASE WHEN a THEN 1 END", "(SELECT 1)", "a AS b", "reflect('x', 'y')"):
        with pytest.raises(ModelError, match="formula.syntax"):
            parse(bad)
    kinds = {"n": "number", "s": "string", "b": "boolean"}
    for text, kind in (("n + 1", "number"), ("n & s", "string"), ("not b", "boolean"), ("COUNT(k)", "integer"), ("IF(b, s, n)", "string"), ("NOW()", "datetime"), ("COALESCE(n, s)", "number"), ("x", "any"), ("-n", "number"), ("n != 1", "boolean")):
        assert ft.kind_of(parse(text), kinds) == kind, text
    for text, code in (("s + 1", "formula.operandType"), ("not n", "formula.operandType"), ("b > 1", "formula.operandType"), ("n and b", "formula.operandType"), ("IF(n, 1, 2)", "formula.operandType"), ("ROUND(s)", "formula.operandType"), ("-s", "formula.operandType"), ("IF(b, 1)", "formula.syntax"), ("LOWER(s, s)", "formula.syntax")):
        with pytest.raises(ModelError) as e:
            ft.check(parse(text), kinds)
        assert e.value.code == code, text
    with pytest.raises(ModelError, match="formula.cycle"):
        ft.order({"a": {"b"}, "b": {"c"}, "c": {"a"}})
    assert ft.order({"c": {"b", "x"}, "a": set(), "b": {"a"}}) == ["a", "b", "c"]


def test_formula_definitions(spark):
    key = Field("id", primary=True)
    for fields, code in (
        ((Field("a", "double", formula="b"),), "formula.refMissing"), ((Field("a", "double", formula="'x'"),), "formula.typeMismatch"), ((Field("a", "double", formula="b * 1"), Field("b", "double", formula="a * 1")), "formula.cycle"),
        ((Field("a", "double", formula="l"), Field("l", "details", target="x")), "formula.refType"), ((Field("a", "double", formula="SUM(b.c)"), Field("b")), "formula.refType"),
    ):
        with pytest.raises(ModelError) as e:
            ft.validate(spark, ObjectDef("o", (key, *fields)))
        assert e.value.code == code
    one = ObjectDef("one", (key, Field("two", "relation", target="two"), Field("a", "double", formula="two.b * 1")))
    two = ObjectDef("two", (key, Field("one", "relation", target="one"), Field("b", "double", formula="one.a * 1")))
    with pytest.raises(ModelError, match="formula.cycle"):
        ft.validate_all(spark, [one, two])


def test_formula_values(spark):
    df = spark.createDataFrame([(1, 7.0, "ab", True), (2, 0.0, "", None), (3, None, None, False)], "id long, n double, s string, b boolean")
    kinds = {"n": "number", "s": "string", "b": "boolean"}
    value = lambda t: [r[0] for r in df.orderBy("id").select(ft.column(ft.parse(spark, t), F.col, kinds, AT).alias("x")).collect()]
    assert value("n / 0") == [None] * 3 and value("n == 7") == [True, False, False] and value("s & '-' & n") == ["ab-7", "-0", "-"]
    assert value("IF(b and n > 1, 'y', 'n')") == ["y", "n", "n"] and value("not b") == [False, True, True] and value("SUBSTR(s, 1)") == ["b", "", None]
    assert value("REPLACE(s, 'a', 'x')") == ["xb", "", None] and value("ROUND(n / 2, 1)") == [3.5, 0.0, None]
    assert value("COALESCE(s, 'z')") == ["ab", "", "z"] and value("SUBSTR(s, -2, 1)") == ["a", "", None] and value("n % 4") == [3.0, 0.0, None]


def test_tools(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 5}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "string"}}}}
    for args, wrong in (({"n": 1}, ""), ({}, "args.n: missing"), ({"n": 0}, "args.n: below 1"), ({"n": 6}, "args.n: above 5"), ({"n": 1.5}, "args.n: not of type integer"), ({"n": 2.0}, ""), ({"n": True}, "args.n: not of type integer"),
                        ({"n": 1, "k": "c"}, "args.k: none of a, b"), ({"n": 1, "x": 1}, "args.x: not expected"), ({"n": 1, "l": ["a", 2]}, "args.l[1]: not of type string"), ([], "args: not of type object")):
        assert tools.check_args(args, schema) == wrong, args
    t = tools.Tool("rows", lambda n: spark.range(n).withColumn("secret", F.lit("s")), schema, ("user",))
    hide = lambda c: hk.Decision(masks={"secret": "*"})
    ask = lambda c: hk.Decision("requireApproval") if c["args"]["n"] > 2 else None
    ok = tools.call(t, {"n": 2}, ME, [hide, ask])
    assert [r["secret"] for r in ok.rows.collect()] == ["*", "*"] and ok.evidence[-1] == ("execute", "ok")
    assert tools.call(t, {"n": 2}, Subject(1, ("x",))).evidence == [("authorize", "denied")]
    assert tools.call(t, {}, ME).evidence[-1] == ("validate", "args.n: missing")
    assert tools.call(t, {"n": 2}, ME, [lambda c: hk.Decision("deny")]).evidence[-1] == ("policy", "deny")
    wait = tools.call(t, {"n": 3}, ME, [ask])
    assert wait.rows is None and wait.evidence[-1] == ("approval", "enqueue") and wait.approval == tools.approval_key("7", "rows", {"n": 3})
    assert tools.call(t, {"n": 3}, ME, [ask], {"status": "approved", "expires_at": 9}, 5).rows.count() == 3
    assert tools.approval_key("a", "b", {}) == tools.approval_key("a", "b", {}) != tools.approval_key("a", "b", {}, "r")


def test_filters_over_links(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, title string")
    links = {"tags": lk.Links(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "d long, t long"), "d", "t")}
    keep = lambda f: sorted(r["id"] for r in fd.filtered(df, DOC, f, links).collect())
    assert keep({"tags": {"contains": [5, 6]}}) == [1] and keep({"tags": {"in": [6, 7]}}) == [1] and keep({"tags": [5]}) == [2] and keep({"tags": {"ne": [5]}}) == [1, 3] and keep({"tags": {"eq": []}}) == [3]
    assert keep({"tags": {"gt": 1}}) == [1, 2, 3] and keep({"tags": {"contains": []}}) == [1, 2, 3] and keep({"tags": {"in": []}}) == []
    assert keep({"$or": [{"title": "c"}, {"tags": {"contains": [6]}}]}) == [1, 3] and keep({"$or": [{"tags": {"in": []}}, {"title": "b"}], "tags": 5}) == [2]
    assert fd.find(df, DOC, fd.Find(filter={"tags": {"in": [5]}}, sort=fd.parse_sort("title:desc"), fields=["id"]), links=links).collect()[0]["id"] == 2
    with pytest.raises(ModelError, match="data.field.links"):
        fd.filtered(df, DOC, {"tags": 1})
    assert [r["id"] for r in lk.linked_to(df, links["tags"].rows, "id", "d", "t", "like", [1]).orderBy("id").collect()] == [1, 2, 3]


def test_requests_are_read_and_bounded():
    assert fd.parse_sort(" a:desc, b ,,c : asc") == [("a", "desc"), ("b", "asc"), ("c", "asc")]
    for bad in (":desc", "a:", "a:up"):
        with pytest.raises(ModelError):
            fd.parse_sort(bad)
    deep = {"a": {"limit": 1}}
    for _ in range(10):
        deep = {"a": {"limit": 1, "expand": deep}}
    with pytest.raises(ModelError, match="data.expand.depth"):
        fd.check_depth(deep)
    with pytest.raises(ModelError, match="data.expand.weight"):
        fd.check_depth({"a": {"limit": 100, "expand": {"b": {"limit": 1000}}}})
    assert fd.check_depth({"a": {"limit": 10, "expand": {"b": {"limit": 5}}}, "c": {}}) == 160


def test_roles_each_by_their_own_predicate(spark):
    rows = spark.createDataFrame([(1, "t", 7), (2, "t", 8)], "id long, title string, owner long")
    obj = ObjectDef("doc", (Field("id", "bigint", primary=True), Field("title"), Field("owner", "bigint", ownership="internal")), {"reads": Permission("own", None), "manages": Permission(None, "all"), "none": Permission()})
    ids = lambda roles, **kw: sorted(r["id"] for r in sc.by_role(rows, obj, Subject(7, roles), **kw).collect())
    assert ids(("reads",)) == [1] and ids(("manages",)) == [1, 2] and ids(("reads", "manages"), manage=True) == [1, 2] and ids(("reads",), manage=True) == [] and ids(("none",)) == [] and ids(("x",)) == []


def test_identity(spark):
    df = spark.createDataFrame([("", 0.0, 1), ("on", 2.5, 0), (" Active ", None, None)], "a string, b double, c int")
    rows = df.select(*(identity.as_flag(df, c).alias(c) for c in df.columns)).collect()
    assert [tuple(r) for r in rows] == [(False, False, True), (None, True, False), (True, None, None)]
    users, departments = identity.from_function(lambda: (spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("d", None)], "id string, parent_id string")))
    assert users.columns == list(identity.USER) and departments.columns == list(identity.DEPARTMENT)


def test_types_and_revisions(spark):
    for a, b, same in (("string", "varchar(9)", True), ("decimal", "decimal(12,2)", True), ("decimal(12,2)", "decimal(10,2)", False), ("bigint", "int", False), ("array<string>", "array<varchar(3)>", True), ("array<int>", "int", False), ("integer", "int", True), ("timestamp", "timestamp_ntz", False)):
        assert tl.type_matches(a, b) == same, (a, b)
    other = ObjectDef("doc", DOC.fields, {"user": Permission("all")})
    assert tl.schema_hash([DOC, LINE]) == tl.schema_hash([LINE, DOC]) != tl.schema_hash([other, LINE])
    assert wr.error_code(ValueError()) == "data.failed"
    with pytest.raises(Exception) as e:
        spark.range(1).select("nope").collect()
    assert wr.error_code(e.value) == "data.schema.drift"


def test_budgets_and_json(spark):
    assert fd.Budget.of(rows=10, sorts=0, filters=-1, seconds=0.5, joins="x", depth=float("nan")) == fd.Budget(rows=10, seconds=0.5)
    obj = ObjectDef("o", (Field("id", primary=True), Field("a", "json"), Field("b", "jsonb"), Field("c", "json")))
    df = spark.createDataFrame([("1", [1, 2], 5, "{}")], "id string, a array<int>, b int, c string")
    assert tuple(wr.json_bound(df, obj).first()) == ("1", "[1,2]", "5", "{}")


def test_buffered_sink():
    out = []
    sink = jobs.Buffered(out.append, size=3, every=10, cap=5)
    sink.add([1, 2], 0.0)
    assert out == []
    sink.add([3], 1.0)
    assert out == [[1, 2, 3]] and sink.waiting == []
    sink.add([4], 2.0)
    sink.add([], 12.5)
    assert out[-1] == [4]
    full = jobs.Buffered(out.append, size=99, cap=2)
    full.add([1, 2, 3], 0.0)
    assert (full.waiting, full.dropped) == ([1, 2], 1)
    jobs.Buffered(out.append, "durable").add([7], 0.0)
    assert out[-1] == [7]
    with pytest.raises(ValueError):
        jobs.Buffered(out.append, "maybe")
