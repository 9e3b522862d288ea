"""Schemas as data: introspection, drift, diffs, hashes."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SPARK_TYPES, Field, ObjectDef, Permission


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical(obj: ObjectDef) -> dict:
    """A whole definition as plain data: all that a field or a role says, without what it leaves at its default."""
    said = lambda x, kind: {f.name: v for f in dataclasses.fields(kind) if (v := getattr(x, f.name)) != f.default}
    out = {"name": obj.name, "fields": [said(f, Field) for f in obj.fields]}
    if obj.permissions is not None:
        out["permissions"] = {r: said(p, Permission) for r, p in obj.permissions.items()}
    return out | ({"parent": obj.parent} if obj.parent else {})


def schema_hash(objects: list[ObjectDef]) -> str:
    """Of all that the definitions say, whatever their order."""
    texts = sorted(canonical_json(canonical(o)) for o in objects)
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()


def append_revision(revisions: DataFrame, digest: str, at) -> DataFrame:
    """Revisions (id, parent, hash, at) after a schema of this hash: one more, whose parent is the latest, unless that has it already."""
    last = revisions.orderBy(F.desc("id")).limit(1)
    new = revisions.sparkSession.range(1).select(F.lit(digest).alias("hash"), F.lit(at).cast(revisions.schema["at"].dataType).alias("at"))
    new = new.join(last.select(F.col("id").alias("parent"), F.col("hash").alias("_last")), F.lit(True), "left").where(~F.col("_last").eqNullSafe(F.col("hash")))
    return revisions.unionByName(new.select((F.coalesce("parent", F.lit(0)) + 1).cast("long").alias("id"), "parent", "hash", "at"))


_SNAKE = re.compile(r"[a-z][a-z0-9_]*")
_WHOLE = ("smallint", "integer", "bigint")
_NUMBERS = (*_WHOLE, "number", "real", "double", "currency")


def definition_errors(obj: ObjectDef) -> list[tuple[str, str]]:
    """(code, where) of what is wrong with a definition beyond what it cannot be made with at all. The codes are fixed values."""
    out, names = [], {f.name: f for f in obj.fields}

    def need(ok, code: str, where: str) -> None:
        if not ok:
            out.append((code, where))

    need(_SNAKE.fullmatch(obj.name), "object.name.snake", obj.name)
    for f in obj.fields:
        need(_SNAKE.fullmatch(f.name), "field.name.snake", f.name)
        need(f.min is None or f.max is None or f.min <= f.max, "field.minGtMax", f.name)
        need(f.type not in _WHOLE or all(x is None or x == int(x) for x in (f.min, f.max)), "field.min.integer", f.name)
        need(f.min_length is None or f.max_length is None or f.min_length <= f.max_length, "field.minLengthGtMaxLength", f.name)
        if f.pattern is not None:
            try:
                re.compile(f.pattern)
            except re.error:
                out.append(("field.regex.invalid", f.name))
        need(len(set(f.values)) == len(f.values), "field.enum.options.duplicate", f.name)
        need(not (f.multiple and f.primary), "field.enum.multiple.primary", f.name)
        need(not f.virtual and f.type != "relation" or f.target, "field.target.required", f.name)
        need(not f.formula or not (f.primary or f.required or f.default is not None), "formula.excludedAttr", f.name)
        if f.default is not None:
            whole = isinstance(f.default, int) and not isinstance(f.default, bool)
            kind = "integer" if f.type in _WHOLE else "number" if f.type in _NUMBERS else "boolean" if f.type == "boolean" else "string"
            fits = {"integer": whole, "number": whole or isinstance(f.default, float), "boolean": isinstance(f.default, bool), "string": isinstance(f.default, str)}[kind]
            need(fits, f"field.default.{kind}", f.name)
            need(not f.values or f.default in f.values, "field.default.inOptions", f.name)
    for mark in ("ownership", "department", "scope"):
        need(sum(bool(getattr(f, mark)) for f in obj.fields) <= 1, f"field.{mark}.many", obj.name)
    for role, p in (obj.permissions or {}).items():
        scopes = {s for s in (p.read, p.manage) if s is not None}
        need(scopes <= {"own", "department", "all"}, "permission.scope.invalid", role)
        need("own" not in scopes or obj.marked("ownership") or obj.parent, "permission.own.ownershipField", role)
        need("department" not in scopes or obj.marked("department") or obj.marked("ownership") or obj.parent, "permission.department.missingField", role)
        for name in p.create_fields or ():
            need(name in names, "permission.createFields.unknown", f"{role}.{name}")
        if p.create_fields is not None:
            for f in obj.fields:
                need(not f.required or f.primary or f.formula or f.type == "seq_no" or f.name in p.create_fields, "permission.createFields.missingRequired", f"{role}.{f.name}")
    return out


#: type names that stand for each other
_SAME = {"varchar": "string", "char": "string", "integer": "int", "long": "bigint", "short": "smallint", "real": "float", "numeric": "decimal", "timestamp_ltz": "timestamp"}


def type_matches(expected: str, actual: str) -> bool:
    """Whether a live column type fits a declared one: names that stand for each other, any length of text, precision and scale only if declared."""

    def parts(text: str) -> tuple[str, str]:
        base, _, size = text.strip().lower().rstrip(")").partition("(")
        return _SAME.get(base.strip(), base.strip()), "".join(size.split())

    if expected.lower().startswith("array<") or actual.lower().startswith("array<"):
        both = [x.strip().lower() for x in (expected, actual)]
        return all(x.startswith("array<") for x in both) and type_matches(*(x[6:-1] for x in both))
    (a, size), (b, live) = parts(expected), parts(actual)
    return a == b and (a != "decimal" or not size or size == live or "," not in size and live.split(",")[0] == size)


def expected_columns(obj: ObjectDef, keys: dict[str, str] | None = None) -> dict[str, str]:
    """Stored column -> Spark type; ``keys``: target object -> its key's type."""
    out = {f.name: (SPARK_TYPES[f.type].simpleString() if SPARK_TYPES[f.type] else (keys or {}).get(f.target, "string")) for f in obj.fields if not f.virtual}
    return {n: f"array<{t}>" if obj.get(n).multiple else t for n, t in out.items()}


def drift(obj: ObjectDef, schema: T.StructType) -> list[tuple[str, str]]:
    """(column, ok | missing | type | extra) of a table against its object."""
    actual, wanted = {f.name: f.dataType.simpleString() for f in schema}, expected_columns(obj)
    rows = [(n, "missing" if n not in actual else "ok" if type_matches(t, actual[n]) else "type") for n, t in wanted.items()]
    return rows + [(n, "extra") for n in actual if n not in wanted]


def additions(obj: ObjectDef, schema: T.StructType) -> list[tuple[str, str]]:
    """(column, type) to add; nothing is ever dropped or changed."""
    wanted = expected_columns(obj)
    return [(n, wanted[n]) for n, s in drift(obj, schema) if s == "missing"]


_BACK = {"bigint": "bigint", "int": "integer", "smallint": "smallint", "double": "double", "float": "real", "string": "string", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}


def introspect(name: str, schema: T.StructType, keys: list[str]) -> ObjectDef:
    """A draft object from a table's schema."""
    fields = []
    for f in schema:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        kind = "currency" if isinstance(inner, T.DecimalType) else _BACK.get(inner.simpleString(), "jsonb")
        fields.append(Field(f.name, "enum" if isinstance(f.dataType, T.ArrayType) else kind, primary=f.name in keys, multiple=isinstance(f.dataType, T.ArrayType)))
    return ObjectDef(name, tuple(fields))


def metadata_changes(old: list[ObjectDef], new: list[ObjectDef]) -> list[tuple[str, str, str]]:
    """(object, field or '', added | removed | changed)."""
    a, b = {o.name: o for o in old}, {o.name: o for o in new}
    rows = [(n, "", "added") for n in b if n not in a] + [(n, "", "removed") for n in a if n not in b]
    for n in a.keys() & b.keys():
        fa, fb = {f.name: f for f in a[n].fields}, {f.name: f for f in b[n].fields}
        rows += [(n, f, "added") for f in fb if f not in fa] + [(n, f, "removed") for f in fa if f not in fb]
        rows += [(n, f, "changed") for f in fa.keys() & fb.keys() if fa[f] != fb[f]]
    return sorted(rows)


def relation_edges(objects: list[ObjectDef]) -> list[tuple[str, str, str, str]]:
    """(from, field, to, kind) of each relation, and the reverse of each that has one."""
    kinds = {"details": ("hasMany", "belongsTo"), "multiRelation": ("multiRelation", "multiRelation")}
    out = []
    for o in objects:
        for f in o.fields:
            if f.target:
                there, back = kinds.get(f.type, ("belongsTo", "hasMany"))
                out += [(o.name, f.name, f.target, there), (f.target, f"{f.name}^", o.name, back)]
    return sorted(out)


def impact(objects: list[ObjectDef], name: str, field: str | None = None) -> list[str]:
    """Objects whose relations point to an object that changes, nearest first."""
    pointing = {o.name: {f.target for f in o.fields if f.target} for o in objects}
    found, level = [], [name]
    while level:
        level = sorted(n for n, targets in pointing.items() if n not in found and n != name and targets & set(level))
        found += level
    return found


def cache_sync(cache: DataFrame, current: DataFrame) -> DataFrame:
    """(object, change) of the metadata cache (object, hash) against current definitions."""
    j = cache.select("object", F.col("hash").alias("_a")).join(current.select("object", F.col("hash").alias("_b")), "object", "full")
    return j.select("object", F.when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated").alias("change"))
