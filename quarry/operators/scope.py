"""Access control: permission merging and row scopes as filters and semi-joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import record_key
from ..model import ModelError, ObjectDef, Permission, Subject
from .closure import subtree

_RANK = {None: 0, "own": 1, "department": 2, "all": 3}

@dataclass(frozen=True)
class Directory:
    """users (id, external_id, department_id) and departments (id, parent_id, optionally external_id)."""

    users: DataFrame
    departments: DataFrame


def wider(a: str | None, b: str | None) -> str | None:
    return max(a, b, key=_RANK.__getitem__)


def _union(a: tuple | None, b: tuple | None) -> tuple | None:
    return None if a is None or b is None else tuple(dict.fromkeys(a + b))


def resolve(obj: ObjectDef, subject: Subject) -> Permission | None:
    """What the subject may do: everything where nothing is declared, None where no role matches, else the roles' union."""
    if subject.system or obj.permissions is None:
        return Permission("all", "all", True, True, None)
    found = [obj.permissions[r] for r in subject.roles if r in obj.permissions]
    if not found:
        return None
    out = found[0]
    for p in found[1:]:
        out = Permission(wider(out.read, p.read), wider(out.manage or out.read, p.manage or p.read) if out.manage or p.manage else None, out.create or p.create, out.delete or p.delete,
                         _union(out.update, p.update), _union(out.create_fields, p.create_fields), tuple(dict.fromkeys(out.exclude + p.exclude)))
    return out


def child_permission(child: Permission | None, parent: Permission | None) -> Permission | None:
    """A details child's: no more than its parent's, denied if either is."""
    if child is None or parent is None:
        return None
    narrow = lambda a, b: min(a, b, key=_RANK.__getitem__)
    return Permission(narrow(child.read, parent.read), narrow(child.manage or child.read, parent.manage or parent.read), child.create and parent.create, child.delete and parent.delete,
                      child.update, child.create_fields, tuple(dict.fromkeys(child.exclude + parent.exclude)))


def _members(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``keys`` (one column), which takes the column's type, so that filters and buckets of ``df`` stay usable; Spark picks the join by the sizes it finds."""
    key = F.col(keys.columns[0]).try_cast(df.schema[column].dataType).alias(column)
    return df.join(keys.select(key).distinct(), column, "left_semi").select(*df.columns)


def department_ids(directory: Directory, department: str) -> DataFrame:
    """(id) of a department and all below it."""
    top = directory.departments.where(F.col("id") == department).select("id")
    return subtree(directory.departments, top)


def scoped(df: DataFrame, obj: ObjectDef, subject: Subject, scope: str | None, directory: Directory | None = None) -> DataFrame:
    """The rows of one scope, within the subject's tenant."""
    if subject.system:
        return df
    tenant = obj.marked("scope")
    if tenant and subject.scope is not None:
        df = df.where(F.col(tenant.name) == subject.scope)
    if scope == "all":
        return df
    if scope is None:
        return df.where(F.lit(False))
    owner, dept = obj.marked("ownership"), obj.marked("department")
    if scope == "own":
        if owner is None:
            raise ModelError("rbac.scope.owner", obj.name)
        if owner.ownership == "external":
            return _members(df, owner.name, directory.users.where(F.col("id") == str(subject.id)).select("external_id"))
        return df.where(F.col(owner.name) == subject.id)
    if subject.department is None:
        raise ModelError("rbac.scope.department", obj.name)
    ids = department_ids(directory, subject.department)
    if dept is not None:
        if dept.department == "external":
            ids = directory.departments.join(ids, "id", "left_semi").select("external_id")
        return _members(df, dept.name, ids)
    if owner is None:
        raise ModelError("rbac.scope.department", obj.name)
    people = _members(directory.users, "department_id", ids)
    return _members(df, owner.name, people.select("external_id" if owner.ownership == "external" else "id"))


def readable(df: DataFrame, obj: ObjectDef, subject: Subject, directory: Directory | None = None) -> DataFrame:
    """The rows a subject may read, without hidden columns."""
    p = resolve(obj, subject)
    if p is None:
        raise ModelError("rbac.denied", obj.name)
    return scoped(df, obj, subject, p.read, directory).drop(*p.exclude)


def manageable(df: DataFrame, obj: ObjectDef, subject: Subject, directory: Directory | None = None) -> DataFrame:
    """The rows a subject may change: the manage scope, or else the read scope."""
    p = resolve(obj, subject)
    if p is None or p.read is None:
        raise ModelError("rbac.denied", obj.name)
    return scoped(df, obj, subject, p.manage or p.read, directory)


def by_role(df: DataFrame, obj: ObjectDef, subject: Subject, directory: Directory | None = None, manage: bool = False) -> DataFrame:
    """The rows that any role of the subject alone would give, by its own predicate: of reads, the union of read and manage scopes; of changes, the manage scopes.

    Nothing declared means one open scope; a subject whose roles give nothing sees nothing.
    """
    if subject.system or obj.permissions is None:
        return scoped(df, obj, subject, "all", directory)
    found = [obj.permissions[r] for r in subject.roles if r in obj.permissions]
    scopes = {s for p in found for s in ((p.manage,) if manage else (p.read, p.manage)) if s}
    if "all" in scopes or len(scopes) < 2:
        return scoped(df, obj, subject, "all" if "all" in scopes else next(iter(scopes), None), directory)
    keys = [scoped(df, obj, subject, s, directory).select(*obj.keys) for s in sorted(scopes)]
    return df.join(reduce(DataFrame.unionByName, keys).distinct(), obj.keys, "left_semi").select(*df.columns)


def check_changes(obj: ObjectDef, subject: Subject, names: list[str]) -> None:
    """Refuses an update of a key, or of the tenant column by a subject that is bound to a tenant."""
    for n in names:
        if n in obj.keys:
            raise ModelError("object.primary.mutable", f"{obj.name}.{n}")
    tenant = obj.marked("scope")
    if tenant and subject.scope is not None and not subject.system and tenant.name in names:
        raise ModelError("object.scope.immutable", f"{obj.name}.{tenant.name}")


def children_of(children: DataFrame, parents: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Details rows whose parent is among ``parents``."""
    keys = parents.select(record_key(parents, *parent_keys).alias("parent_id"))
    return children.join(keys, "parent_id", "left_semi")


def check_fields(obj: ObjectDef, permission: Permission, names: list[str], creating: bool) -> None:
    """Refuses fields that the subject may not set; a key may be set on create only."""
    allowed = permission.create_fields if creating else permission.update
    for n in names:
        key = n in obj.keys
        if key and not creating or not key and allowed is not None and n not in allowed:
            raise ModelError("rbac.field.denied", n)
