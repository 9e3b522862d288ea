"""Formulas written as text: read by Spark's own expression parser, checked, and made into Columns.

``price * qty & ' EUR'``, ``IF(total > 100, 'big', 'small')``, ``customer.name``, ``SUM(lines.amount)``.
The parser is Spark's; this module only maps what it returns onto the functions of
:mod:`.formula`, whose rules differ from SQL's. ``&`` joins texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelError, ObjectDef
from . import formula as fm

AGGREGATES = {"sum", "avg", "min", "max", "count"}
#: function -> least and most arguments, result type (None: that of an argument)
FUNCTIONS = {
    "if": (3, 3, None), "round": (1, 2, "number"), "now": (0, 0, "datetime"), "concat": (0, 99, "string"), "lower": (1, 1, "string"), "upper": (1, 1, "string"), "trim": (1, 1, "string"),
    "length": (1, 1, "integer"), "substr": (2, 3, "string"), "replace": (3, 3, "string"), "abs": (1, 1, "number"), "floor": (1, 1, "number"), "ceil": (1, 1, "number"), "pow": (2, 2, "number"), "coalesce": (1, 99, None),
}
ARITHMETIC, ORDERED, LOGIC = {"+", "-", "*", "/", "%"}, {">", "<", ">=", "<="}, {"and", "or"}
_BINARY = {
    "Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "Remainder": "%", "EqualTo": "==", "GreaterThan": ">", "LessThan": "<", "GreaterThanOrEqual": ">=", "LessThanOrEqual": "<=",
    "And": "and", "Or": "or", "BitwiseAnd": "&",
}
#: field type -> formula type
KINDS = {t: "string" for t in ("string", "text", "char", "uuid", "enum")} | {t: "number" for t in ("smallint", "integer", "bigint", "number", "real", "double", "currency")} | {"boolean": "boolean"}


@dataclass(frozen=True)
class Term:
    """``kind``: literal, field, aggregate, call, unary or binary; ``name``: value, field, function or operator."""

    kind: str
    name: object = None
    args: tuple[Term, ...] = ()


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _term(e) -> Term:
    kind = e.getClass().getSimpleName()
    children = _seq(e.children())
    if kind == "Literal":
        value = e.value()
        name = e.dataType().typeName()
        if name == "string":
            value = value.toString()
        elif name not in ("boolean", "void") and value is not None:
            value = float(str(value))
        return Term("literal", value)
    if kind == "UnresolvedAttribute":
        return Term("field", ".".join(_seq(e.nameParts())))
    if kind == "Not" and children[0].getClass().getSimpleName() == "EqualTo":
        return Term("binary", "!=", tuple(map(_term, _seq(children[0].children()))))
    if kind in ("Not", "UnaryMinus"):
        return Term("unary", "not" if kind == "Not" else "-", (_term(children[0]),))
    if kind in _BINARY:
        return Term("binary", _BINARY[kind], tuple(map(_term, children)))
    if kind == "Substring":
        args = tuple(map(_term, children))
        return Term("call", "substr", args[:2] if args[2] == Term("literal", float(2**31 - 1)) else args)
    if kind == "UnresolvedFunction":
        name = ".".join(_seq(e.nameParts())).lower()
        args = tuple(map(_term, children))
        if name in AGGREGATES:
            if len(args) != 1 or args[0].kind != "field" or (name != "count" and "." not in args[0].name):
                raise ModelError("formula.syntax", f"{name} takes one child field")
            return Term("aggregate", (name, args[0].name))
        if name not in FUNCTIONS:
            raise ModelError("formula.syntax", f'unknown function "{name}"')
        return Term("call", name, args)
    raise ModelError("formula.syntax", f"{kind} is not part of a formula")


def parse(spark: SparkSession, text: str) -> Term:
    try:
        return _term(spark._jsparkSession.sessionState().sqlParser().parseExpression(text))
    except ParseException as e:
        raise ModelError("formula.syntax", str(e).splitlines()[0]) from None


def references(t: Term) -> tuple[list[str], list[tuple[str, str]]]:
    """(fields, aggregates): ``a`` or ``relation.a``, and (function, ``child.a``), in order of place."""
    if t.kind == "field":
        return [t.name], []
    if t.kind == "aggregate":
        return [], [t.name]
    found = [references(a) for a in t.args]
    return [f for fs, _ in found for f in fs], [a for _, xs in found for a in xs]


def kind_of(t: Term, fields: dict[str, str]) -> str:
    """string, number, integer, boolean, datetime or any."""
    if t.kind == "literal":
        return "any" if t.name is None else "boolean" if isinstance(t.name, bool) else "string" if isinstance(t.name, str) else "number"
    if t.kind == "field":
        return fields.get(t.name, "any")
    if t.kind == "aggregate":
        return "integer" if t.name[0] == "count" else "number"
    if t.kind == "unary":
        return "boolean" if t.name == "not" else "number"
    if t.kind == "binary":
        return "number" if t.name in ARITHMETIC else "string" if t.name == "&" else "boolean"
    result = FUNCTIONS[t.name][2]
    return result or kind_of(t.args[1 if t.name == "if" else 0], fields)


def check(t: Term, fields: dict[str, str]) -> None:
    """Refuses operands of the wrong type and wrong numbers of arguments."""
    kinds = [kind_of(a, fields) for a in t.args]
    is_number, is_text, is_flag = ([k in (*x, "any") for k in kinds] for x in (("number", "integer"), ("string",), ("boolean",)))

    def need(ok: bool, expected: str) -> None:
        if not ok:
            raise ModelError("formula.operandType", f"{t.name}: {expected}, not {'/'.join(kinds)}")

    if t.kind == "call":
        least, most, _ = FUNCTIONS[t.name]
        if not least <= len(t.args) <= most:
            raise ModelError("formula.syntax", f"{t.name} takes {least} to {most} arguments")
        need(t.name != "if" or is_flag[0], "a boolean condition")
        need(t.name != "round" or is_number[0], "a number")
    elif t.name in ARITHMETIC or t.kind == "unary" and t.name == "-":
        need(all(is_number), "numbers")
    elif t.kind == "binary" and t.name in ORDERED:
        need(all(is_number) or all(is_text), "two numbers or two texts")
    elif t.kind == "unary" or t.kind == "binary" and t.name in LOGIC:
        need(all(is_flag), "booleans")
    for a in t.args:
        check(a, fields)


def order(graph: dict[str, set[str]]) -> list[str]:
    """Formula names, each after those it refers to; ``graph``: name -> names referred to. Names may be ``object.field``."""
    try:
        return [n for n in TopologicalSorter({k: v & graph.keys() for k, v in graph.items()}).static_order()]
    except CycleError as e:
        raise ModelError("formula.cycle", " -> ".join(e.args[1])) from None


def field_kinds(obj: ObjectDef) -> dict[str, str]:
    return {f.name: KINDS.get(f.type, "any") for f in obj.fields}


_FITS = {"string": {"string"}, "number": {"number", "integer"}, "boolean": {"boolean"}}


def validate(spark: SparkSession, obj: ObjectDef) -> dict[str, Term]:
    """The object's formulas, read and checked: references exist and may be referred to, operands and result fit, none refers to itself."""
    terms, kinds = {f.name: parse(spark, f.formula) for f in obj.fields if f.formula}, field_kinds(obj)
    for name, t in terms.items():
        fields, aggregates = references(t)
        for ref in fields:
            head, _, inner = ref.partition(".")
            f = obj.get(head)
            if f is None:
                raise ModelError("formula.refMissing", ref)
            if (f.type not in ("relation", "details") and f.target is None) if inner else f.type in ("relation", "details", "multiRelation", "seq_no"):
                raise ModelError("formula.refType", f"{ref}: {f.type}")
        for _, ref in aggregates:
            f = obj.get(ref.partition(".")[0])
            if f is None:
                raise ModelError("formula.refMissing", ref)
            if f.type != "details":
                raise ModelError("formula.refType", f"{ref}: {f.type}")
        check(t, kinds)
        kind, own = kind_of(t, kinds), KINDS.get(obj.get(name).type, "any")
        if kind != "any" and kind not in _FITS.get(own, set()):
            raise ModelError("formula.typeMismatch", f"{name}: {kind}, not {obj.get(name).type}")
    order({n: set(references(t)[0]) for n, t in terms.items()})
    return terms


def validate_all(spark: SparkSession, objects: list[ObjectDef]) -> dict[str, dict[str, Term]]:
    """Every object's formulas; also no cycle through relations and children of other objects."""
    terms, by_name, graph = {o.name: validate(spark, o) for o in objects}, {o.name: o for o in objects}, {}
    for o in objects:
        for name, t in terms[o.name].items():
            fields, aggregates = references(t)
            graph[f"{o.name}.{name}"] = found = set()
            for ref in [*fields, *(r for _, r in aggregates)]:
                head, _, inner = ref.partition(".")
                target = o.get(head).target if inner else o.name
                if inner and target in by_name and by_name[target].get(inner) is None:
                    raise ModelError("formula.refMissing", f"{target}.{inner}")
                found.add(f"{target}.{inner or head}")
    order(graph)
    return terms


def column(t: Term, of: Callable[[str], Column], fields: dict[str, str], at: datetime) -> Column:
    """The Column of a checked formula; ``of``: the Column of a field, ``relation.field`` or ``sum(child.field)``."""
    build = lambda x: column(x, of, fields, at)
    kinds = [k if k in ("boolean", "number", "string") else "number" if k == "integer" else "string" for k in (kind_of(a, fields) for a in t.args)]
    text = lambda i: fm.number_text(build(t.args[i])) if kinds[i] == "number" else build(t.args[i])
    if t.kind == "literal":
        return F.lit(t.name)
    if t.kind == "field":
        return of(t.name)
    if t.kind == "aggregate":
        return of("{}({})".format(*t.name))
    if t.kind == "unary":
        return fm.negation(build(t.args[0]), kinds[0]) if t.name == "not" else -build(t.args[0])
    if t.kind == "binary":
        if t.name == "&":
            return fm.concat(text(0), text(1))
        a, b = (build(x) for x in t.args)
        if t.name in LOGIC:
            x, y = fm.truthy(a, kinds[0]), fm.truthy(b, kinds[1])
            return x & y if t.name == "and" else x | y
        if t.name in ORDERED:
            return fm.compare(a, t.name, b)
        both_null = a.isNull() & b.isNull()
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: fm.divide(a, b), "%": lambda: fm.modulo(a, b),
            "==": lambda: fm.equals(a, b) if "any" not in (kind_of(x, fields) for x in t.args) else F.coalesce(a == b, both_null),
            "!=": lambda: ~(fm.equals(a, b) if "any" not in (kind_of(x, fields) for x in t.args) else F.coalesce(a == b, both_null)),
        }[t.name]()
    n, args = t.name, [build(a) for a in t.args]
    whole = lambda i: int(t.args[i].name if t.args[i].kind == "literal" else -t.args[i].args[0].name)  # noqa: E731  literal places
    return {
        "if": lambda: fm.choose(args[0], kinds[0], args[1], args[2]), "round": lambda: fm.round_up(args[0], whole(1) if len(args) > 1 else 0), "now": lambda: fm.now(at),
        "concat": lambda: fm.concat(*(text(i) for i in range(len(args)))), "lower": lambda: F.lower(args[0]), "upper": lambda: F.upper(args[0]), "trim": lambda: fm.trim(args[0]),
        "length": lambda: fm.length(args[0]), "substr": lambda: fm.substring(args[0], whole(1), whole(2) if len(args) > 2 else None), "replace": lambda: fm.replace(args[0], t.args[1].name, t.args[2].name),
        "abs": lambda: F.abs(args[0]), "floor": lambda: F.floor(args[0]), "ceil": lambda: F.ceil(args[0]), "pow": lambda: F.pow(args[0], args[1]), "coalesce": lambda: F.coalesce(*args),
    }[n]()


def computed(
    df: DataFrame, obj: ObjectDef, terms: dict[str, Term], at: datetime, relations: dict[str, tuple[DataFrame, str]] | None = None, children: dict[str, tuple[DataFrame, Column]] | None = None,
) -> DataFrame:
    """``df`` with its formula fields.

    ``relations``: relation field -> (readable rows, their key), one left join each; ``children``: details
    field -> (readable rows with parent_id, the parent's record key), one pre-aggregated left join each.
    """
    kinds, names = field_kinds(obj), {}
    every = [references(t) for t in terms.values()]
    for field, (rows, key) in (relations or {}).items():
        used = sorted({r.partition(".")[2] for fs, _ in every for r in fs if r.startswith(f"{field}.")})
        if used:
            names |= {f"{field}.{u}": f"_{field}_{u}" for u in used}
            df = df.join(rows.select(F.col(key).alias(field), *(F.col(u).alias(f"_{field}_{u}") for u in used)), field, "left")
    for field, (rows, key) in (children or {}).items():
        used = sorted({a for _, xs in every for a in xs if a[1].partition(".")[0] == field})
        if used:
            out = []
            for fn, ref in used:
                names[f"{fn}({ref})"] = alias = f"_{fn}_{ref.replace('.', '_')}"
                c = F.col(ref.partition(".")[2] or "parent_id")
                out.append({"sum": fm.child_sum(c), "avg": F.avg(c), "min": F.min(c), "max": F.max(c), "count": F.count(F.lit(1))}[fn].alias(alias))
            df = df.withColumn("_pid", key).join(rows.groupBy(F.col("parent_id").alias("_pid")).agg(*out), "_pid", "left").drop("_pid")
            zero = {names[f"count({ref})"]: 0 for fn, ref in used if fn == "count"}
            df = df.fillna(zero) if zero else df
    for name in order({n: set(references(t)[0]) for n, t in terms.items()}):
        value = column(terms[name], lambda n: F.col(names.get(n, n)), kinds, at)
        kind, own = kind_of(terms[name], kinds), KINDS.get(obj.get(name).type, "any")
        to = "integer" if obj.get(name).type in ("smallint", "integer") else own
        if own != "any" and kind != "any":
            value = fm.coerce(value, to, "number" if kind == "integer" else kind)
        df = df.withColumn(name, value)
    return df.drop(*names.values())
