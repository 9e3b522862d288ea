"""Definitions, registered types, hooks and policies."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import types as ty
from quarry.model import ModelError
from quarry.operators import hooks as hk
from quarry.sources.definitions import load_objects, parse_object


def write(folder, name, data):
    (folder / name).mkdir()
    (folder / name / "schema.json").write_text(data if isinstance(data, str) else json.dumps(data))


def test_definitions(spark, tmp_path):
    write(tmp_path, "order", {"name": "order", "fields": [
        {"name": "id", "primary": True}, {"name": "owner", "ownership": True, "ownershipSource": "external"}, {"name": "team", "type": "department", "department": True}, {"name": "mail", "type": "email", "maxLength": 9},
        {"name": "status", "type": "enum", "values": ["a", "b"]}, {"name": "lines", "type": "details", "object": "line"}], "permissions": {"r": {"read": "own", "update": True, "exclude": ["mail"]}}})
    write(tmp_path, "line", {"name": "line", "parent": "order", "fields": [{"name": "id", "primary": True}, {"name": "qty", "type": "integer", "min": 1}]})
    found = load_objects(spark, str(tmp_path))
    o = found["order"]
    assert o.keys == ["id"] and o.marked("ownership").ownership == "external" and o.marked("department").department == "internal" and o.get("mail").max_length == 9 and o.get("mail").type == "string"
    assert o.get("lines").target == "line" and o.permissions["r"].update is None and o.permissions["r"].read == "own" and found["line"].stored == ["id", "qty", "parent_id", "parent_type", "parent_idx"]
    write(tmp_path, "bad", {"name": "bad", "fields": [{"name": "id", "primary": True}, {"name": "x", "type": "relation", "object": "none"}]})
    with pytest.raises(ModelError, match="object.relation.target"):
        load_objects(spark, str(tmp_path))
    for text in ("{", "{}", json.dumps({"name": "x", "fields": [{"name": "a", "type": "blob", "primary": True}]})):
        with pytest.raises(ModelError):
            parse_object(text)


def test_registered_types(spark):
    df = spark.createDataFrame([("a@b.c", "+49 123456"), ("a@b", None), (None, "12")], "m string, p string")
    assert sorted(map(str, (r["m"] for r in ty.broken(df, {"m": "email", "p": "phone"}).collect()))) == ["None", "a@b"]
    for args in (("email", "string"), ("new", "relation")):
        with pytest.raises(ModelError):
            ty.register(*args)


def test_on_load(spark):
    df = spark.range(10).withColumn("v", F.lit(1))
    assert hk.on_load(df, lambda r: r.assign(v=r["id"] * 2).astype({"v": "int32"})).agg(F.sum("v")).first()[0] == 90
    with pytest.raises(Exception, match="script.onload.length"):
        hk.on_load(df, lambda r: r[:0]).collect()


def test_write_hooks(spark):
    done = []
    hooks = hk.Hooks([lambda d: d.where("id > 2")], [lambda d: 1 / 0])
    assert hooks.write(spark.range(5), lambda d: done.append(d.count())) == ["ZeroDivisionError: division by zero"] and done == [2]
    with pytest.raises(ModelError):
        hk.Hooks([lambda d: (_ for _ in ()).throw(ModelError("no"))]).write(spark.range(1), done.append)
    assert done == [2]


def test_policies(spark):
    mask = lambda **m: lambda c: hk.Decision(masks=m)
    d = hk.decide([mask(a=1, b=1), lambda c: None, mask(b=2)], {})
    assert d.kind == "allow" and d.masks == {"a": 1, "b": 2}
    assert hk.decide([mask(a=1), lambda c: hk.Decision("requireApproval"), lambda c: 1 / 0], {}).kind == "requireApproval"
    assert hk.decide([lambda c: c["x"]], {}).kind == "deny"
    assert hk.masked(spark.range(1).withColumn("a", F.lit(5)), d).first()["a"] == 1
    with pytest.raises(ModelError):
        hk.masked(spark.range(1), hk.Decision("deny"))
    assert [hk.next_status(r, 10) for r in (None, {"expires_at": 5, "status": "approved"}, {"expires_at": 50, "status": "approved"}, {"expires_at": 50, "status": "pending"}, {"expires_at": 50, "status": "consumed"})] == ["enqueue", "deny", "consume", "wait", "deny"]
