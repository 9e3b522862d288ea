"""Reads of one object: filter, sort, project, page and count.

A filter is ``{field: value | {op: value}, "$or": [filter, ...]}`` with the operators eq, ne, gt, gte,
lt, lte, in, contains and like. Everything becomes Columns, so Catalyst pushes filters and
prunes columns; scope is applied to the frame beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import decode_cursor, decode_key, record_key
from ..model import META_FIELDS, PREFIX, ModelError, ObjectDef
from .links import LINK_OPERATORS, Links, link_marks, linked_to

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "like")
DEFAULT_LIMIT, MAX_ROWS, MAX_FILTERS, MAX_SORTS = 100, 1000, 50, 8
VIRTUAL = [f"{PREFIX}id", *(f"{PREFIX}{m}" for m in META_FIELDS)]


@dataclass(frozen=True)
class Budget:
    """What one request may ask for."""

    rows: int = MAX_ROWS
    depth: int = 10
    joins: int = 8
    filters: int = MAX_FILTERS
    sorts: int = MAX_SORTS
    sql_length: int = 20_000
    seconds: float = 5.0

    @classmethod
    def of(cls, **partial) -> Budget:
        """The given limits; those that are absent or no positive number stay at their default."""
        ok = {k: v if k == "seconds" else int(v) for k, v in partial.items() if k in cls.__dataclass_fields__ and isinstance(v, (int, float)) and v == v and v not in (float("inf"),) and v > 0}
        return cls(**ok)


@dataclass(frozen=True)
class Find:
    filter: dict = field(default_factory=dict)
    sort: list[tuple[str, str]] = field(default_factory=list)
    fields: list[str] | None = None
    exclude: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    cursor: str | None = None


def is_operators(value) -> bool:
    """A dict is a set of operators only if all its keys are; anything else is a value to equal."""
    return isinstance(value, dict) and bool(value) and all(k in OPERATORS for k in value)


def count_conditions(filter: dict) -> int:
    return sum(sum(map(count_conditions, v)) if k == "$or" else len(v) if is_operators(v) else 1 for k, v in filter.items())


def check_budget(find: Find, max_filters: int = MAX_FILTERS, max_sorts: int = MAX_SORTS) -> None:
    if count_conditions(find.filter) > max_filters:
        raise ModelError("data.budget.filters")
    if len(find.sort) > max_sorts:
        raise ModelError("data.budget.sorts")


def _check_field(obj: ObjectDef, name: str) -> None:
    f = obj.get(name)
    known = f is not None and f.type != "details" or name in VIRTUAL or obj.parent and name in ("parent_id", "parent_type", "parent_idx")
    if not known:
        raise ModelError("data.field.unknown", name)


def _one(obj: ObjectDef, name: str, op: str, value) -> Column | None:
    c, f = F.col(name), obj.get(name)
    if op == "contains":  # on other than array fields the condition is left out
        if f is None or not f.multiple:
            return None
        return c.isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, value)), c)) == 0) if value else c.isNotNull()
    if op == "in":
        return c.isin(list(value)) if value else F.lit(False)
    if op == "like":
        return c.ilike(f"%{value}%")
    if value is None:
        return F.lit(None).cast("boolean")
    return {"eq": c == value, "ne": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def condition(obj: ObjectDef, filter: dict, marks: dict | None = None) -> Column | None:
    """The filter as one Column, or None if nothing restricts. ``marks``: the columns that stand for multiRelation conditions, by field, operator and values."""
    parts = []
    for name, value in filter.items():
        if name == "$or":
            groups = [g for g in (condition(obj, x, marks) for x in value) if g is not None]
            if groups:
                parts.insert(0, reduce(lambda a, b: a | b, groups))
            continue
        _check_field(obj, name)
        if (f := obj.get(name)) is not None and f.type == "multiRelation":
            parts += [F.col(marks[x]) for x in link_conditions(name, value) if marks and x in marks]
            continue
        ops = value if is_operators(value) else {"eq": value}
        columns = [_one(obj, name, op, v) for op, v in ops.items()]
        if all(c is not None for c in columns):
            parts += columns
    return reduce(lambda a, b: a & b, parts) if parts else None


def link_conditions(name: str, value) -> list[tuple]:
    """(field, operator, values) of a multiRelation filter; operators it does not know are dropped."""
    ops = value if is_operators(value) else {"eq": value}
    return [(name, op, tuple(v) if isinstance(v, (list, tuple)) else (v,)) for op, v in ops.items() if op in LINK_OPERATORS]


def parse_sort(text: str) -> list[tuple[str, str]]:
    """``a:desc,b`` as sort keys; ascending where nothing is said."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        name, colon, direction = (x.strip() for x in part.partition(":"))
        if colon and (not name or direction not in ("asc", "desc")):
            raise ModelError("api.param.invalid", f"sort: {part}")
        out.append((name, direction or "asc"))
    return out


def check_depth(tree: dict, limit: int = 10, max_weight: int = 10_000) -> int:
    """The weight of a nested read ``{field: {"limit": n, "expand": {...}}}``: rows it may make of one; refused beyond ``limit`` levels or ``max_weight``."""

    def weigh(level: dict, depth: int) -> int:
        if level and depth > limit:
            raise ModelError("data.expand.depth", str(limit))
        return sum((x.get("limit") or DEFAULT_LIMIT) * (1 + weigh(x.get("expand") or {}, depth + 1)) for x in level.values())

    if (weight := weigh(tree, 1)) > max_weight:
        raise ModelError("data.expand.weight", str(weight))
    return weight


def names_used(find: Find) -> set[str]:
    def walk(f: dict) -> set[str]:
        return {n for k, v in f.items() for n in (set().union(*map(walk, v)) if k == "$or" and v else {k})}

    return walk(find.filter) | {n for n, _ in find.sort} | set(find.fields or ())


def with_virtual(df: DataFrame, obj: ObjectDef, meta: DataFrame | None, used: set[str]) -> DataFrame:
    """Adds ``meta_id``, and the side table's fields only when one is used: no join otherwise."""
    df = df.withColumn("meta_id", record_key(df, *obj.keys))
    wanted = [m for m in META_FIELDS if f"{PREFIX}{m}" in used]
    if meta is None or not wanted:
        return df
    side = meta.select(F.col("record_key").alias("meta_id"), *(F.col(m).alias(f"{PREFIX}{m}") for m in wanted))
    joined = df.join(side, "meta_id", "left")
    return joined.withColumn("meta_status", F.coalesce("meta_status", F.lit("draft"))) if "status" in wanted else joined


def projection(obj: ObjectDef, fields: list[str] | None, exclude: tuple[str, ...] = ()) -> list[str]:
    for f in fields or ():
        _check_field(obj, f)
    return [f for f in (obj.stored if fields is None else fields) if f not in exclude]


def order(sort: list[tuple[str, str]]) -> list[Column]:
    """Ascending puts nulls last, descending first."""
    return [F.col(n).desc_nulls_first() if d == "desc" else F.col(n).asc_nulls_last() for n, d in sort]


def filtered(df: DataFrame, obj: ObjectDef, filter: dict, links: dict[str, Links] | None = None) -> DataFrame:
    """The rows a filter keeps. ``links``: the link rows of each multiRelation field that it names."""
    links, columns = links or {}, df.columns

    def linked(f: dict) -> list[tuple]:
        found = []
        for name, value in f.items():
            if name == "$or":
                found += [x for g in value for x in linked(g)]
            elif (field := obj.get(name)) is not None and field.type == "multiRelation":
                if name not in links:
                    raise ModelError("data.field.links", name)
                found += link_conditions(name, value)
        return found

    top = linked({k: v for k, v in filter.items() if k != "$or"})
    for name, op, values in top:
        df = linked_to(df, links[name].rows, obj.keys[0], links[name].owner, links[name].target, op, list(values))
    marks = {x: f"_link{i}" for i, x in enumerate(dict.fromkeys(linked({"$or": filter.get("$or") or []})))}
    for (name, op, values), mark in marks.items():
        df = link_marks(df, links[name], obj.keys[0], mark, op, list(values))
    plain = {k: v for k, v in filter.items() if k == "$or" or (f := obj.get(k)) is None or f.type != "multiRelation"}
    where = condition(obj, plain, marks)
    return (df if where is None else df.where(where)).select(*columns) if marks or top else df if where is None else df.where(where)


def find(df: DataFrame, obj: ObjectDef, options: Find, meta: DataFrame | None = None, strict: bool = True, links: dict[str, Links] | None = None) -> DataFrame:
    """One page. ``strict``: hidden fields cannot be filtered or sorted on either. A sorted page keeps ``offset`` + ``limit`` rows in each task; deep pages take the cursor."""
    check_budget(options)
    used = names_used(options)
    for n, _ in options.sort:
        _check_field(obj, n)
    if strict and (hidden := ({n for n, _ in options.sort} | names_used(Find(options.filter))) & set(options.exclude)):
        raise ModelError("data.field.denied", ", ".join(sorted(hidden)))
    df = filtered(with_virtual(df, obj, meta, used), obj, options.filter, links)
    columns = projection(obj, options.fields, options.exclude)
    limit, sort = max(0, min(options.limit, MAX_ROWS)), options.sort
    if options.cursor is not None and len(obj.keys) == 1:
        key = obj.keys[0]
        return df.where(F.col(key) > decode_cursor(options.cursor)[0]).orderBy(F.col(key)).limit(limit).select(*columns)
    if sort:
        df = df.orderBy(*order(sort))
    return (df.offset(options.offset) if options.offset > 0 else df).limit(limit).select(*columns)


def find_one(df: DataFrame, obj: ObjectDef, key: str) -> DataFrame:
    values = decode_key(key)
    if len(values) != len(obj.keys):
        raise ModelError("record.key.invalid", key)
    kinds = dict(df.dtypes)
    where = reduce(lambda a, b: a & b, (F.col(k) == F.lit(v).cast(kinds[k]) for k, v in zip(obj.keys, values)))
    return df.where(where).limit(1).withColumn("meta_id", F.lit(key)).select("meta_id", *obj.stored)


def total(df: DataFrame, obj: ObjectDef, filter: dict) -> DataFrame:
    """(total): the exact count; the page's cursor has no part in it."""
    return filtered(df, obj, filter).agg(F.count(F.lit(1)).alias("total"))
