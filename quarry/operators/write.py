"""Writes as frames: what a table is after an insert, update or delete, and what is wrong with records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import record_key
from ..model import ObjectDef


def violations(df: DataFrame, obj: ObjectDef) -> DataFrame:
    """(key columns, field, rule) of every broken rule: required, min, max, minLength, maxLength, pattern, enum."""
    checks = []
    for f in obj.fields:
        if f.virtual or f.name not in df.columns:
            continue
        c = F.col(f.name)
        rules = {
            "required": c.isNull() if f.required else None, "min": c < f.min if f.min is not None else None, "max": c > f.max if f.max is not None else None,
            "minLength": F.length(c) < f.min_length if f.min_length is not None else None, "maxLength": F.length(c) > f.max_length if f.max_length is not None else None,
            "pattern": ~c.rlike(f.pattern) if f.pattern else None, "enum": (~F.forall(c, lambda x: x.isin(list(f.values))) if f.multiple else ~c.isin(list(f.values))) if f.values else None,
        }
        checks += [F.when(broken, F.struct(F.lit(f.name).alias("field"), F.lit(rule).alias("rule"))) for rule, broken in rules.items() if broken is not None]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(*obj.keys, F.explode(found).alias("_v")).select(*obj.keys, "_v.field", "_v.rule")


def json_bound(df: DataFrame, obj: ObjectDef) -> DataFrame:
    """json fields that hold structs, arrays, maps or numbers as JSON text; texts are taken to be JSON already."""
    kinds = {f.name: f.type for f in obj.fields}
    found = {c: F.to_json(F.col(c)) if isinstance(t := df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c).cast("string") for c in df.columns if kinds.get(c) in ("json", "jsonb") and not isinstance(df.schema[c].dataType, T.StringType)}
    return df.withColumns(found) if found else df


def create(table: DataFrame, new: DataFrame, obj: ObjectDef, defaults: dict[str, Column] | None = None, tenant: tuple[str, str] | None = None) -> DataFrame:
    """``table`` with the new rows: defaults where a field is absent, the tenant forced."""
    for name, value in (defaults or {}).items():
        if name not in new.columns:
            new = new.withColumn(name, value)
    if tenant:
        new = new.withColumn(tenant[0], F.lit(tenant[1]))
    return table.unionByName(new, allowMissingColumns=True)


def update(table: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """``table`` with the changed values of ``changes`` (keys, then new values); rows without a change stay as they are."""
    values = [c for c in changes.columns if c not in keys]
    side = changes.select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in values))
    joined = table.join(side, keys, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def delete(table: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(children: DataFrame, gone: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Details rows without those of deleted parents."""
    return children.join(gone.select(record_key(gone, *parent_keys).alias("parent_id")).distinct(), "parent_id", "left_anti")


def meta_of(side: DataFrame, keys: list[str]) -> DataFrame:
    """The side rows of some records."""
    return side.where(F.col("record_key").isin(keys))


def upsert_meta(side: DataFrame, changes: DataFrame) -> DataFrame:
    """The side table after changes (record_key, status, created_time, modified_time): what was created stays, a status defaults to draft."""
    old, new = side.alias("o"), changes.alias("n")
    joined = old.join(new, F.col("o.record_key") == F.col("n.record_key"), "full")
    first = lambda *c: F.coalesce(*(F.col(x) for x in c))
    return joined.select(
        first("o.record_key", "n.record_key").alias("record_key"), F.coalesce("n.status", "o.status", F.lit("draft")).alias("status"),
        first("o.created_time", "n.created_time").alias("created_time"), F.col("n.modified_time").alias("modified_time"),
    )


def next_index(existing: DataFrame, new: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """``new`` with ``index`` going on from the largest that each key has."""
    last = existing.groupBy(key).agg(F.max(index).alias("_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(last, key, "left").withColumn(index, F.coalesce("_last", F.lit(0)) + n).drop("_last")


def next_ordinals(existing: DataFrame, key: str, index: str) -> DataFrame:
    """(key, next): one more than the largest index each key has."""
    return existing.groupBy(key).agg((F.max(index) + 1).alias("next"))


#: what a failed write means to its caller
ERRORS = {"UNRESOLVED_COLUMN": "data.schema.drift", "FIELD_NOT_FOUND": "data.schema.drift", "INCOMPATIBLE_COLUMN_TYPE": "data.schema.drift", "CAST_INVALID_INPUT": "data.field.type", "NOT_NULL_ASSERT_VIOLATION": "data.required", "PATH_NOT_FOUND": "data.schema.drift"}


def error_code(e: Exception) -> str:
    """The library's code of a Spark failure."""
    found = (e.getCondition() if hasattr(e, "getCondition") else None) or ""
    return ERRORS.get(found.split(".")[0], "data.failed")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of key tuples that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, fk: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no target row."""
    return df.where(F.col(fk).isNotNull()).join(targets.select(F.col(key).alias(fk)), fk, "left_anti")


def change_feed(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, type) of records created, updated or deleted between two states."""
    a = before.select(*keys, F.struct(*columns).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.struct(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, keys, "full")
    kind = F.when(F.col("_in_a").isNull(), "record.created").when(F.col("_in_b").isNull(), "record.deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "record.updated")
    return joined.select(*keys, kind.alias("type")).where(F.col("type").isNotNull())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
