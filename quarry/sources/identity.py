"""A customer's own user table mapped onto the directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: texts that mean yes or no
YES = ["1", "t", "true", "y", "yes", "active", "enabled"]
NO = ["0", "f", "false", "n", "no", "inactive", "disabled", ""]


USER = {"id": "string", "external_id": "string", "department_id": "string", "roles": "array<string>", "enabled": "boolean"}
DEPARTMENT = {"id": "string", "parent_id": "string", "name": "string"}


def as_list(df: DataFrame, name: str) -> Column:
    """An array column as it is; a text split at commas, blanks and empty parts left out."""
    c = F.col(name)
    parts = c if isinstance(df.schema[name].dataType, T.ArrayType) else F.split(c, ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def as_flag(df: DataFrame, name: str) -> Column:
    """A boolean as it is; a number is true unless it is 0; a text by the words above; null otherwise."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name)
    if isinstance(kind, T.NumericType):
        return F.col(name) != 0
    c = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(c.isin(YES), True).when(c.isin(NO), False)


def from_function(load: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(users, departments) of a caller's own source, in the directory's columns; missing ones are null."""
    users, departments = load()
    need = lambda df, columns: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
    return need(users, USER), need(departments, DEPARTMENT)


def resolved(rows: DataFrame, known: DataFrame, ref: str, external: str = "external_id", key: str = "id") -> DataFrame:
    """``rows`` with an external reference replaced by the key of the row that has it; null where nobody has."""
    side = known.select(F.col(external).alias(ref), F.col(key).alias("_key"))
    return rows.join(side, ref, "left").withColumn(ref, F.col("_key")).drop("_key").select(*rows.columns)


def mapped_users(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``columns``: directory field -> source column; roles and enabled are coerced, ids become text."""
    out = {k: F.col(v).cast("string") for k, v in columns.items()}
    if "roles" in columns:
        out["roles"] = as_list(df, columns["roles"])
    if "enabled" in columns:
        out["enabled"] = as_flag(df, columns["enabled"])
    return df.select(*(c.alias(k) for k, c in out.items()))


def sync(source: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(id, change): what a sync would create, update, or disable because the source no longer has it."""
    s = source.select("id", F.struct(*columns).alias("_s"), F.lit(True).alias("_in_s"))
    c = current.select("id", F.struct(*columns).alias("_c"), F.lit(True).alias("_in_c"), F.coalesce("enabled", F.lit(True)).alias("_on"))
    j = s.join(c, "id", "full")
    change = F.when(F.col("_in_c").isNull(), "create").when(F.col("_in_s").isNull() & F.col("_on"), "disable").when(F.col("_in_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_c")), "update")
    return j.select("id", change.alias("change")).where(F.col("change").isNotNull())
