"""Object definitions from JSON files: ``<folder>/<object>/schema.json``, and ``workflow.json`` beside it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula_text import validate_all
from ..functions.types import TYPES
from ..model import SPARK_TYPES, Field, ModelError, ObjectDef, Permission
from ..operators.tooling import canonical_json, definition_errors
from ..operators.workflow import Node, Version

MAX_ASSIGNEES = 1000

#: JSON attribute -> field attribute, where the names differ
_NAMES = {"minLength": "min_length", "maxLength": "max_length", "object": "target", "format": "template"}
_FLAGS = ("primary", "required", "multiple", "scope", "sensitive")


def parse_field(data: dict) -> Field:
    """A field; a registered type takes its base type's place."""
    kind = data.get("type", "string")
    if kind in TYPES:
        kind = TYPES[kind].base
    known = {_NAMES.get(k, k): v for k, v in data.items() if k not in ("type", "values", "ownership", "department") and _NAMES.get(k, k) in Field.__dataclass_fields__}
    for flag in _FLAGS:
        known[flag] = bool(known.get(flag, False))
    marked = {m: data.get(f"{m}Source", "internal") if data.get(m) is True else data.get(m) for m in ("ownership", "department") if data.get(m)}
    if kind not in SPARK_TYPES and kind not in ("details", "multiRelation"):
        raise ModelError("object.field.type", str(kind))
    return Field(**(known | marked | {"type": kind, "values": tuple(data.get("values", ()))}))


def parse_permission(data: dict) -> Permission:
    """``update`` and ``createFields``: a list, or true for all fields."""
    listed = lambda v: None if v is True else tuple(v or ())
    fields = data.get("createFields")
    return Permission(data.get("read"), data.get("manage"), bool(data.get("create")), bool(data.get("delete")), listed(data.get("update")), None if fields is None else listed(fields), tuple(data.get("exclude", ())))


def parse_object(text: str) -> ObjectDef:
    try:
        data = json.loads(text)
        roles = data.get("permissions")
        return ObjectDef(data["name"], tuple(parse_field(f) for f in data["fields"]), None if roles is None else {r: parse_permission(p) for r, p in roles.items()}, data.get("parent"))
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ModelError("object.definition.invalid", str(e)) from None


def parse_workflow(text: str, users: DataFrame) -> tuple[Node, ...]:
    """The nodes of ``{"nodes": [{"id", "kind", "assign": {"roles", "mode"}, "onReject", "onWithdraw", "onTimeout": {"after", "action"}}]}``.

    Roles become the ids of enabled users (id, roles, enabled) who have one; a node with more than MAX_ASSIGNEES is refused.
    """
    try:
        nodes = json.loads(text)["nodes"]
        ids = [n["id"] for n in nodes]
        wanted = sorted({r for n in nodes for r in n["assign"].get("roles", ())})
    except (json.JSONDecodeError, KeyError, TypeError, AttributeError) as e:
        raise ModelError("workflow.definition.invalid", str(e)) from None
    if len(set(ids)) < len(ids) or any(n.get("kind", "approve") not in ("approve", "notify") or n["assign"].get("mode", "any") not in ("any", "all") for n in nodes):
        raise ModelError("workflow.definition.invalid", "node")
    for n in nodes:
        for target in (n.get("onReject"), n.get("onWithdraw")):
            if target is not None and target not in ids:
                raise ModelError("workflow.node.unknown", target)
    who: dict[str, list[str]] = {}
    if wanted:
        found = users.where(F.coalesce("enabled", F.lit(True))).select(F.explode("roles").alias("role"), F.col("id").cast("string").alias("id")).where(F.col("role").isin(wanted)).distinct()
        rows = found.limit(MAX_ASSIGNEES * len(wanted) + 1).collect()
        if len(rows) > MAX_ASSIGNEES * len(wanted):
            raise ModelError("workflow.assignee.many", ", ".join(wanted))
        for role, user in sorted(map(tuple, rows)):
            who.setdefault(role, []).append(user)
    return tuple(
        Node(n["id"], tuple(dict.fromkeys(u for r in n["assign"].get("roles", ()) for u in who.get(r, ()))), n.get("kind", "approve"), n["assign"].get("mode", "any"), n.get("onReject"), n.get("onWithdraw"),
             (n.get("onTimeout") or {}).get("after"), (n.get("onTimeout") or {}).get("action", "approve"))
        for n in nodes
    )


def load_workflows(spark: SparkSession, folder: str, users: DataFrame) -> dict[str, Version]:
    """Object -> the definition in its ``workflow.json``, under the hash of its content, where it has one."""
    files = spark.read.text(f"{folder.rstrip('/')}/*/workflow*.json", wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("name")).collect()
    return {name: Version(parse_workflow(text, users), hashlib.sha256(canonical_json(json.loads(text)).encode()).hexdigest()) for text, name in files}


def load_objects(spark: SparkSession, folder: str) -> dict[str, ObjectDef]:
    """Every definition below ``folder``, from any store that Spark reads; a name may occur once."""
    out: dict[str, ObjectDef] = {}
    for (text,) in spark.read.text(f"{folder.rstrip('/')}/*/schema.json", wholetext=True).collect():
        obj = parse_object(text)
        if obj.name in out:
            raise ModelError("object.duplicate", obj.name)
        out[obj.name] = obj
    for o in out.values():
        for code, where in definition_errors(o):
            raise ModelError(code, f"{o.name}: {where}")
        for f in o.fields:
            if f.target and f.target not in out:
                raise ModelError("object.relation.target", f"{o.name}.{f.name}: {f.target}")
    validate_all(spark, list(out.values()))
    return out
