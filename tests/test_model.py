"""Requests and definitions that are refused, codecs, merging."""

import pytest

from quarry.functions.keys import decode_cursor, decode_key, encode_cursor, record_key
from quarry.model import Field, ModelError, ObjectDef, Permission, Subject
from quarry.operators import find as fd
from quarry.operators import scope as sc
from quarry.plans import objects as ob


def refused(code, f, *args, **kw):
    with pytest.raises(ModelError) as e:
        f(*args, **kw)
    assert e.value.code == code


def test_record_keys(spark):
    df = spark.createDataFrame([("O-1001", "3"), ("é", ""), (None, "x")], "a string, b string")
    keys = [r[0] for r in df.select(record_key(df, "a", "b")).collect()]
    assert keys == ["6:O-10011:3", "2:é0:", None]
    assert [decode_key(k) for k in keys[:2]] == [["O-1001", "3"], ["é", ""]]
    for bad in ("x", "5:abc", "-1:", "3abc"):
        refused("record.key.invalid", decode_key, bad)


def test_temporal_keys_keep_microseconds(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-02 03:04:05.000001' AS a, timestamp '2024-01-02 03:04:05.000002' AS b")
    assert df.select(record_key(df, "a", "b")).first()[0] == "26:2024-01-02T03:04:05.00000127:2024-01-02T03:04:05.000002Z"


def test_cursors():
    assert decode_cursor(encode_cursor([1, "é"])) == [1, "é"]
    for bad in ("", "????", "e30", encode_cursor([1])[:-3]):
        refused("http.param.invalid", decode_cursor, bad)


def test_definitions_are_checked():
    key = Field("id", primary=True)
    refused("object.key.missing", ObjectDef, "o", (Field("a"),))
    refused("object.field.duplicate", ObjectDef, "o", (key, key))
    refused("object.field.type", ObjectDef, "o", (key, Field("a", "blob")))
    refused("object.key.type", ObjectDef, "o", (Field("id", "json", primary=True),))
    refused("object.field.reserved", ObjectDef, "o", (key, Field("meta_x")))


def test_find_refuses(spark):
    df = spark.createDataFrame([(1, 1, "O", 1.0, None, "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    for options in (fd.Find(filter={"nope": 1}), fd.Find(sort=[("nope", "asc")]), fd.Find(fields=["nope"]), fd.Find(filter={"lines": 1}), fd.Find(filter={"parent_id": "1"})):
        refused("data.field.unknown", fd.find, df, ob.PLAIN_ORDERS, options)
    refused("data.budget.filters", fd.check_budget, fd.Find(filter={"$or": [{"o_custkey": {"gt": i, "lt": i}} for i in range(26)]}))
    refused("data.budget.sorts", fd.check_budget, fd.Find(sort=[("o_orderkey", "asc")] * 9))
    refused("data.field.denied", fd.find, df, ob.PLAIN_ORDERS, fd.Find(filter={"o_totalprice": 1.0}, exclude=("o_totalprice",)))
    assert fd.find(df, ob.PLAIN_ORDERS, fd.Find(filter={"o_totalprice": 1.0}, exclude=("o_totalprice",)), strict=False).columns == [c for c in df.columns if c != "o_totalprice"]
    refused("record.key.invalid", fd.find_one, df, ob.PLAIN_ORDERS, "1:11:2")


def test_filter_shapes():
    assert fd.is_operators({"gt": 1, "lt": 2}) and not fd.is_operators({"gt": 1, "x": 2}) and not fd.is_operators({})
    assert fd.condition(ob.ORDERS, {"$or": [{"o_custkey": {"contains": [1]}}]}) is None
    assert fd.count_conditions({"a": 1, "b": {"gt": 1, "lt": 3}, "$or": [{"c": 1}, {"d": {"in": []}}]}) == 5


def test_permissions():
    assert sc.resolve(ObjectDef("o", (Field("id", primary=True),)), Subject(1)).read == "all"
    assert sc.resolve(ob.PLAIN_ORDERS, Subject(1, ("x",))) is None and sc.resolve(ob.PLAIN_ORDERS, ob.SYSTEM).update is None
    both = sc.resolve(ob.PLAIN_ORDERS, Subject(1, ("sales", "admin")))
    assert (both.read, both.manage, both.create, both.delete, both.update) == ("all", "all", True, True, None)
    sales = sc.resolve(ob.PLAIN_ORDERS, ob.SALES)
    sc.check_fields(ob.PLAIN_ORDERS, sales, ["o_orderpriority"], creating=False)
    refused("rbac.field.denied", sc.check_fields, ob.PLAIN_ORDERS, sales, ["o_totalprice"], creating=False)
    refused("rbac.field.denied", sc.check_fields, ob.PLAIN_ORDERS, Permission("all", update=None), ["o_orderkey"], creating=False)
    sc.check_fields(ob.PLAIN_ORDERS, sales, ["o_orderkey", "o_totalprice"], creating=True)


def test_scopes_without_markers(spark):
    df = spark.createDataFrame([(1,)], "id long")
    bare = ObjectDef("o", (Field("id", "bigint", primary=True),), {"r": Permission("own"), "d": Permission("department"), "w": Permission()})
    refused("rbac.scope.owner", sc.readable, df, bare, Subject(1, ("r",)))
    refused("rbac.scope.department", sc.readable, df, bare, Subject(1, ("d",)))
    refused("rbac.denied", sc.readable, df, bare, Subject(1, ("none",)))
    assert sc.readable(df, bare, Subject(1, ("w",))).count() == 0
