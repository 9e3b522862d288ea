"""Objects: typed fields, keys, markers and permissions declared over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: field type -> Spark type
SPARK_TYPES = {
    "string": T.StringType(), "text": T.StringType(), "char": T.StringType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "number": T.DoubleType(), "real": T.FloatType(), "double": T.DoubleType(), "currency": T.DecimalType(12, 2), "boolean": T.BooleanType(),
    "date": T.DateType(), "time": T.StringType(), "timetz": T.StringType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "interval": T.StringType(),
    "uuid": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "enum": T.StringType(), "image": T.StringType(),
    "relation": None, "user": T.StringType(), "department": T.StringType(), "seq_no": T.StringType(),
}
#: types whose values have a canonical text, and so can be part of a key
KEY_TYPES = {"string", "text", "char", "smallint", "integer", "bigint", "number", "currency", "boolean", "date", "time", "timetz", "timestamp", "timestamptz", "uuid", "enum"}
#: fields of the side table, readable on every object that has one
PREFIX = "meta_"  # of the virtual fields: meta_id is the record key, the rest come from the side table
META_FIELDS = ["status", "owner_id", "created_by", "modified_by", "created_time", "modified_time", "workflow_instance_id"]


class ModelError(ValueError):
    """A request or definition that the model refuses; ``code`` names the reason."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class Field:
    """One field. ``target``: the object a relation, details or multiRelation field points to."""

    name: str
    type: str = "string"
    primary: bool = False
    required: bool = False
    multiple: bool = False
    values: tuple[str, ...] = ()
    target: str | None = None
    ownership: str | None = None  # None, "internal" or "external": how it names its owner
    department: str | None = None
    scope: bool = False
    sensitive: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    default: object = None  # for a field that a new record lacks; "now" for dates and times
    formula: str | None = None
    template: str | None = None  # of a seq_no: text with {seq[:N]}, {year}, {month}, {day}

    @property
    def virtual(self) -> bool:
        return self.type in ("details", "multiRelation")


@dataclass(frozen=True)
class Permission:
    """What a role may do. Scopes: None (nothing), "own", "department" or "all"; lists: None is unrestricted."""

    read: str | None = None
    manage: str | None = None
    create: bool = False
    delete: bool = False
    update: tuple[str, ...] | None = ()
    create_fields: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class ObjectDef:
    name: str
    fields: tuple[Field, ...]
    permissions: dict[str, Permission] | None = field(default=None, hash=False)
    parent: str | None = None

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ModelError("object.field.duplicate", self.name)
        for f in self.fields:
            if f.type not in SPARK_TYPES and not f.virtual:
                raise ModelError("object.field.type", f"{self.name}.{f.name}: {f.type}")
            if f.primary and f.type not in KEY_TYPES:
                raise ModelError("object.key.type", f"{self.name}.{f.name}: {f.type}")
            if f.name.startswith(PREFIX):
                raise ModelError("object.field.reserved", f.name)
        if not self.keys:
            raise ModelError("object.key.missing", self.name)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.primary]

    @property
    def stored(self) -> list[str]:
        """Columns of the object's table; a child also has its parent's."""
        return [f.name for f in self.fields if not f.virtual] + (["parent_id", "parent_type", "parent_idx"] if self.parent else [])

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def marked(self, marker: str) -> Field | None:
        return next((f for f in self.fields if getattr(f, marker)), None)


@dataclass(frozen=True)
class Subject:
    """Who asks. ``system`` subjects are not scoped."""

    id: str | int | None = None
    roles: tuple[str, ...] = ()
    department: str | None = None
    scope: str | None = None
    system: bool = False
