"""Creating and changing records as one operation over frames.

Each step is a transformation; nothing is written. What comes back is every table as it is
after the write, with the rows of its logs, for the caller to commit together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula_text as ft
from ..functions.keys import record_key
from ..model import SPARK_TYPES, Field, ModelError, ObjectDef, Subject
from . import links as lk
from . import scope as sc
from . import write as wr
from .hooks import Hooks
from .state import sequence_field


@dataclass
class Store:
    """The frames around an object: its rows, the side table, children by details field with their definition, links by multiRelation field, relations for formulas."""

    rows: DataFrame
    meta: DataFrame | None = None
    children: dict[str, tuple[DataFrame, ObjectDef]] = field(default_factory=dict)
    links: dict[str, lk.Links] = field(default_factory=dict)
    relations: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


@dataclass
class Written:
    """After a write: the tables, and what it adds to the audit log and the events."""

    records: DataFrame
    refused: DataFrame
    store: Store
    audit: DataFrame
    events: DataFrame


Hook = Callable[[DataFrame], DataFrame | None]


def _defaults(new: DataFrame, obj: ObjectDef, at: datetime) -> DataFrame:
    """Fields that the records lack altogether; a null that is given stays."""
    for f in obj.fields:
        if f.default is not None and not f.virtual and f.name not in new.columns:
            value = at if f.default == "now" and f.type in ("date", "timestamp", "timestamptz") else f.default
            new = new.withColumn(f.name, F.lit(value).cast(SPARK_TYPES[f.type] or "string"))
    return new


def _log(rows: DataFrame, key: Column, obj: ObjectDef, action: str, subject: Subject, at: datetime, error: Column | None = None) -> DataFrame:
    """Audit rows of one action."""
    return rows.select(
        F.lit("system" if subject.system else "user").alias("actor_type"), F.lit(None if subject.id is None else str(subject.id)).alias("actor_id"), F.lit(action).alias("action"), F.lit(obj.name).alias("object"),
        key.alias("object_id"), F.lit(error is not None).alias("is_error"), (F.lit(None).cast("string") if error is None else error).alias("error_code"), F.lit(subject.scope).cast("string").alias("scope_id"), F.lit(at).alias("ts"),
    )


def _events(keys: DataFrame, obj: ObjectDef, kind: str) -> DataFrame:
    return keys.select(F.lit(f"record.{kind}").alias("type"), F.lit(obj.name).alias("object"), F.col("meta_id").alias("object_id"))


def _hooked(rows: DataFrame, hooks: list[Hook]) -> DataFrame:
    for hook in hooks:
        rows = hook(rows) or rows
    return rows


def _meta_changes(keys: DataFrame, at: datetime, created: bool) -> DataFrame:
    moment = F.lit(at).cast("timestamp_ntz")
    return keys.select(F.col("meta_id").alias("record_key"), F.lit(None).cast("string").alias("status"), (moment if created else F.lit(None).cast("timestamp_ntz")).alias("created_time"), moment.alias("modified_time"))


def _child_errors(new: DataFrame, obj: ObjectDef, details: list, store: Store) -> DataFrame | None:
    """(keys, code) of records one of whose children breaks a rule."""
    found = None
    for f in details:
        child = store.children[f.name][1]
        mine = {k: f"_p{i}" for i, k in enumerate(obj.keys)}
        rows = new.select(*(F.col(k).alias(p) for k, p in mine.items()), F.explode(f.name).alias("_child")).select(*mine.values(), "_child.*")
        flat = ObjectDef(child.name, tuple(Field(p, obj.get(k).type, primary=True) for k, p in mine.items()) + tuple(replace(x, primary=False) for x in child.fields))
        broken = wr.violations(rows, flat).select(*(F.col(p).alias(k) for k, p in mine.items()), F.concat_ws(":", F.lit(f.name), "field", "rule").alias("error_code"))
        found = broken if found is None else found.unionByName(broken)
    return None if found is None else found.groupBy(*obj.keys).agg(F.array_join(F.array_sort(F.collect_set("error_code")), ",").alias("error_code"))


def _checked(new: DataFrame, obj: ObjectDef) -> tuple[DataFrame, DataFrame]:
    """(records without broken rules, (keys, codes) of the others)."""
    broken = wr.violations(new, obj).groupBy(*obj.keys).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "field", "rule"))), ",").alias("error_code"))
    same = [new[k].eqNullSafe(broken[k]) for k in obj.keys]
    good = new.join(broken, wr.all_of(same), "left_anti")
    return good, broken


def create(store: Store, obj: ObjectDef, new: DataFrame, subject: Subject, at: datetime, before: list[Hook] = (), seq_from: int = 0, parent_key: Column | None = None) -> Written:
    """``new`` records, with details children as arrays of structs and links as arrays under their fields' names.

    Validate, hooks, defaults, tenant, numbers, parent index, insert, children, links, formulas
    (which see the children), side table, audit, events. Records that break a rule, or whose key
    is there already, are refused one by one and logged as errors.
    """
    details = [f for f in obj.fields if f.type == "details" and f.name in new.columns]
    multi = [f for f in obj.fields if f.type == "multiRelation" and f.name in new.columns]
    new = _hooked(new, list(before))
    good, refused = _checked(new, obj)
    if (broken := _child_errors(good, obj, details, store)) is not None:
        good, refused = good.join(broken, obj.keys, "left_anti"), refused.unionByName(broken)
    taken = good.join(store.rows.select(*obj.keys), obj.keys, "left_semi").select(*obj.keys, F.lit("data.unique").alias("error_code"))
    twice = wr.duplicates(good, *obj.keys).select(*obj.keys, F.lit("data.unique").alias("error_code"))
    clash = taken.unionByName(twice).distinct()
    good, refused = good.join(clash, obj.keys, "left_anti"), refused.unionByName(clash)
    rows = wr.json_bound(_defaults(good, obj, at), obj)
    if (tenant := obj.marked("scope")) and subject.scope is not None:
        rows = rows.withColumn(tenant.name, F.lit(subject.scope))
    for f in obj.fields:
        if f.type == "seq_no" and f.template:
            rows = sequence_field(rows, f.name, f.template, F.lit(at), [F.col(k) for k in obj.keys], base=seq_from)
    if obj.parent and parent_key is not None and "parent_idx" not in rows.columns:
        rows = rows.withColumns({"parent_id": parent_key, "parent_type": F.lit(obj.parent)})
        rows = wr.next_index(store.rows, rows, "parent_id", obj.keys, "parent_idx")
    rows = rows.withColumn("meta_id", record_key(rows, *obj.keys))
    children = dict(store.children)
    for f in details:
        table, child = store.children[f.name]
        each = rows.select(F.col("meta_id").alias("parent_id"), F.posexplode(f.name).alias("_at", "_child")).select("_child.*", "parent_id", F.lit(obj.name).alias("parent_type"), (F.col("_at") + 1).alias("parent_idx"))
        children[f.name] = table.unionByName(each, allowMissingColumns=True), child
    links = dict(store.links)
    for f in multi:
        old = store.links[f.name]
        made = lk.write_links(rows.select(F.col(obj.keys[0]).alias(old.owner), F.col(f.name)), old.owner, f.name, old.target)
        links[f.name] = lk.Links(old.rows.unionByName(made, allowMissingColumns=True), old.owner, old.target)
    terms = ft.validate(new.sparkSession, obj)
    if terms:
        rows = ft.computed(rows, obj, terms, at, store.relations, {n: (df, F.col("meta_id")) for n, (df, _) in children.items()})
    stored = rows.select("meta_id", *(c for c in obj.stored if c in rows.columns))
    meta = None if store.meta is None else wr.upsert_meta(store.meta, _meta_changes(stored, at, True))
    after = Store(store.rows.unionByName(stored.drop("meta_id"), allowMissingColumns=True), meta, children, links, store.relations)
    bad = refused.withColumn("_id", record_key(refused, *obj.keys))
    audit = _log(stored, F.col("meta_id"), obj, "create", subject, at).unionByName(_log(bad, F.col("_id"), obj, "create", subject, at, F.col("error_code")))
    return Written(stored, refused, after, audit, _events(stored, obj, "created"))


def commit(written: Written, save: Callable[[Written], None], after: list[Callable[[DataFrame], None]] = (), load: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """(records as loaded, warnings): saves, then runs the hooks that follow a write, whose failures become warnings."""
    warnings = Hooks(after=list(after)).write(written.records, lambda _: save(written))
    return (load(written.records) if load else written.records), warnings


def update(store: Store, obj: ObjectDef, changes: DataFrame, subject: Subject, at: datetime, directory: sc.Directory | None = None, before: list[Hook] = ()) -> Written:
    """``changes``: keys, then new values of the records the subject may change; keys and the tenant column stay. Others are refused as not found."""
    values = [c for c in changes.columns if c not in obj.keys]
    if unknown := [c for c in values if obj.get(c) is None or obj.get(c).virtual]:
        raise ModelError("data.field.unknown", ", ".join(unknown))
    p = sc.resolve(obj, subject)
    if p is None:
        raise ModelError("rbac.denied", obj.name)
    sc.check_fields(obj, p, values, creating=False)
    sc.check_changes(obj, subject, values)
    changes = _hooked(changes, list(before))
    if moved := [c for c in changes.columns if c not in obj.keys and c not in values]:
        sc.check_changes(obj, subject, moved)
    mine = sc.manageable(store.rows, obj, subject, directory).select(*obj.keys)
    found = changes.join(mine, obj.keys, "left_semi")
    missing = changes.join(mine, obj.keys, "left_anti").select(*obj.keys, F.lit("data.recordNotFound").alias("error_code"))
    found = wr.json_bound(found, obj)
    whole = wr.update(store.rows.join(found.select(*obj.keys), obj.keys, "left_semi").select(*store.rows.columns), obj.keys, found)
    good, refused = _checked(whole, obj)
    refused = refused.unionByName(missing)
    good = good.withColumn("meta_id", record_key(good, *obj.keys))
    terms = ft.validate(changes.sparkSession, obj)
    if terms:
        good = ft.computed(good, obj, terms, at, store.relations, {n: (df, F.col("meta_id")) for n, (df, _) in store.children.items()})
    stored = good.select("meta_id", *(c for c in obj.stored if c in good.columns))
    kept = wr.delete(store.rows, obj.keys, stored)
    meta = None if store.meta is None else wr.upsert_meta(store.meta, _meta_changes(stored, at, False))
    after = Store(kept.unionByName(stored.drop("meta_id"), allowMissingColumns=True), meta, store.children, store.links, store.relations)
    bad = refused.withColumn("_id", record_key(refused, *obj.keys))
    audit = _log(stored, F.col("meta_id"), obj, "update", subject, at).unionByName(_log(bad, F.col("_id"), obj, "update", subject, at, F.col("error_code")))
    return Written(stored, refused, after, audit, _events(stored, obj, "updated"))


def remove(store: Store, obj: ObjectDef, gone: DataFrame, subject: Subject, at: datetime, directory: sc.Directory | None = None) -> Written:
    """Deletes the records of ``gone`` (keys) that the subject may change, with their children, links and side rows."""
    p = sc.resolve(obj, subject)
    if p is None or not p.delete:
        raise ModelError("rbac.denied", obj.name)
    mine = sc.manageable(store.rows, obj, subject, directory).select(*obj.keys)
    found = gone.select(*obj.keys).distinct().join(mine, obj.keys, "left_semi")
    missing = gone.select(*obj.keys).distinct().join(mine, obj.keys, "left_anti").withColumn("error_code", F.lit("data.recordNotFound"))
    keyed = found.withColumn("meta_id", record_key(found, *obj.keys))
    children = {n: (wr.cascade(df, found, obj.keys), child) for n, (df, child) in store.children.items()}
    links = {n: lk.Links(x.rows.join(found.select(F.col(obj.keys[0]).alias(x.owner)), x.owner, "left_anti"), x.owner, x.target) for n, x in store.links.items()}
    meta = None if store.meta is None else store.meta.join(keyed.select(F.col("meta_id").alias("record_key")), "record_key", "left_anti")
    bad = missing.withColumn("_id", record_key(missing, *obj.keys))
    audit = _log(keyed, F.col("meta_id"), obj, "delete", subject, at).unionByName(_log(bad, F.col("_id"), obj, "delete", subject, at, F.col("error_code")))
    return Written(keyed, missing, Store(wr.delete(store.rows, obj.keys, found), meta, children, links, store.relations), audit, _events(keyed, obj, "deleted"))
