"""Custom tools: Python functions that return DataFrames, behind roles, argument checks, policies and approvals."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError, Subject
from .hooks import Decision, decide, masked, next_status

_TYPES = {
    "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v - v == 0, "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) if isinstance(v, int) or isinstance(v, float) and v - v == 0 else False,
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None,
}


def check_args(value, schema: dict, path: str = "args") -> str:
    """What is wrong with arguments under a JSON schema of type, enum, minimum, maximum, items, required, properties and additionalProperties; '' if nothing is."""
    kind = schema.get("type")
    if kind in _TYPES and not _TYPES[kind](value):
        return f"{path}: not of type {kind}"
    if "enum" in schema and not any(type(value) is type(v) and value == v for v in schema["enum"]):
        return f"{path}: none of {', '.join(map(str, schema['enum']))}"
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{path}: below {schema['minimum']}"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{path}: above {schema['maximum']}"
    if isinstance(value, list) and "items" in schema:
        return next(filter(None, (check_args(v, schema["items"], f"{path}[{i}]") for i, v in enumerate(value))), "")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        missing = [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        extra = [f"{path}.{k}: not expected" for k in value if k not in properties] if schema.get("additionalProperties") is False else []
        inner = (check_args(value[k], sub, f"{path}.{k}") for k, sub in properties.items() if k in value)
        return next(filter(None, [*missing, *extra, *inner]), "")
    return ""


def approval_key(actor: str, action: str, args: dict, request_id: str | None = None) -> str:
    """The same for the same call: a 32-bit hash of its JSON text, in base 36."""
    raw = json.dumps([actor, action, args, *([request_id] if request_id is not None else [])], separators=(",", ":"), ensure_ascii=False).encode("utf-16-be")
    h = 0
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2])) & 0xFFFFFFFF
    n, out = abs(h - (1 << 32) if h >> 31 else h), ""
    while n or not out:
        n, digit = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return f"ap-{out}"


@dataclass(frozen=True)
class Tool:
    name: str
    handler: Callable[..., DataFrame]
    schema: dict = field(default_factory=dict, hash=False)
    roles: tuple[str, ...] | None = None


@dataclass
class Called:
    """``rows`` is None where the call did not run; ``evidence``: what each stage found, in order."""

    rows: DataFrame | None
    evidence: list[tuple[str, str]]
    approval: str | None = None


def call(tool: Tool, args: dict, subject: Subject, policies: list[Callable[[dict], Decision | None]] = (), request: dict | None = None, now: float = 0.0) -> Called:
    """Authorize, check the arguments, ask the policies, resolve the approval, run, mask.

    ``request``: the approval request of this call's key, if there is one: status and expires_at.
    """
    done: list[tuple[str, str]] = []
    if not subject.system and tool.roles is not None and not set(tool.roles) & set(subject.roles):
        return Called(None, [("authorize", "denied")])
    done.append(("authorize", "ok"))
    if wrong := check_args(args, tool.schema):
        return Called(None, [*done, ("validate", wrong)])
    done.append(("validate", "ok"))
    context = {"action": tool.name, "args": args, "actor": subject.id, "roles": subject.roles}
    d = decide(list(policies), context)
    done.append(("policy", d.kind))
    if d.kind == "deny":
        return Called(None, done)
    if d.kind == "requireApproval":
        status = next_status(request, now)
        done.append(("approval", status))
        if status != "consume":
            return Called(None, done, approval_key(str(subject.id), tool.name, args))
    try:
        rows = masked(tool.handler(**args), Decision(masks=d.masks))
    except ModelError as e:
        return Called(None, [*done, ("execute", e.code)])
    return Called(rows, [*done, ("execute", "ok")])


def call_outcomes(calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, id, outcome) of calls (key, ts, id) that need approval, given decisions (key, status, decided_at, expires_at).

    The first call of a key enqueues the request, later ones wait until it is decided. An approval
    is used by the first call that finds it in time, once; what comes after it or too late is denied.
    """
    order = Window.partitionBy("key").orderBy("ts", "id")
    j = calls.join(decisions, "key", "left")
    open_ = F.col("decided_at").isNull() | (F.col("ts") < F.col("decided_at"))
    usable: Column = ~open_ & (F.col("status") == "approved") & (F.col("ts") < F.col("expires_at"))
    used = F.coalesce(F.sum(usable.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    outcome = (
        F.when(open_ & (F.row_number().over(order) == 1), "enqueue").when(open_, "wait").when(F.col("status") != "approved", "deny:rejected")
        .when(used, "deny:consumed").when(usable, "consume").otherwise("deny:expired")
    )
    return j.select("key", "id", outcome.alias("outcome"))
