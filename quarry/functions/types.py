"""Registered field types: a base type and a check as a Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SPARK_TYPES, ModelError


@dataclass(frozen=True)
class FieldType:
    """``valid``: value column -> whether it holds; a null value is always fine."""

    name: str
    base: str
    valid: Callable[[Column], Column] | None = None


TYPES: dict[str, FieldType] = {}


def register(name: str, base: str, valid: Callable[[Column], Column] | None = None) -> FieldType:
    """Adds a type for definitions to use."""
    if name in SPARK_TYPES or name in TYPES:
        raise ModelError("type.duplicate", name)
    if SPARK_TYPES.get(base) is None:
        raise ModelError("type.base", base)
    TYPES[name] = FieldType(name, base, valid)
    return TYPES[name]


def broken(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows with a value that its registered type refuses; ``kinds``: column -> type name."""
    bad = F.lit(False)
    for column, kind in kinds.items():
        if (valid := TYPES[kind].valid) is not None:
            bad = bad | (F.col(column).isNotNull() & ~F.coalesce(valid(F.col(column)), F.lit(False)))
    return df.where(bad)


for _name, _pattern in {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^\+?[0-9 ()-]{5,}$"}.items():
    register(_name, "string", lambda c, p=_pattern: c.rlike(p))
register("firstName", "string")
register("lastName", "string")
