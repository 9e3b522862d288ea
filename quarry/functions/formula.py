"""Formula functions as Column builders.

A formula is an ordinary Column expression made of these functions. They keep the formula
language's own rules where Spark's differ: comparisons are two-valued, 0 and '' are false,
division by zero is null, rounding is half up towards +infinity, text counts UTF-16 units
and substrings count from 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F



def number_text(c: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))


def truthy(c: Column, kind: str) -> Column:
    """Whether a value counts as true. ``kind``: boolean, number or string."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != (F.lit(0) if kind == "number" else F.lit("")), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; null for a divisor of 0."""
    return F.when(b != 0, a % F.nullif(b, F.lit(0)))


def equals(a: Column, b: Column) -> Column:
    """False if either is null."""
    return F.coalesce(a == b, F.lit(False))


def compare(a: Column, op: str, b: Column) -> Column:
    """``> < >= <=``; false if either is null."""
    return F.coalesce({">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op], F.lit(False))


def negation(c: Column, kind: str) -> Column:
    return ~truthy(c, kind)


def concat(*parts: Column) -> Column:
    """All parts as text, null as ''."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def choose(condition: Column, kind: str, a: Column, b: Column) -> Column:
    return F.when(truthy(condition, kind), a).otherwise(b)


def round_up(c: Column, digits: int = 0) -> Column:
    """Half towards +infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + 0.5) / scale


def now(at: datetime) -> Column:
    """One moment for a whole write."""
    return F.lit(at)


def trim(c: Column) -> Column:
    """All Unicode white space at both ends."""
    space = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return F.regexp_replace(c, f"^{space}|{space}$", "")


def length(c: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def substring(c: Column, start: int, size: int | None = None) -> Column:
    """From 0; a negative start counts from the end, as does an end that lies before the start of the text."""
    n = F.length(c)
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    first = at(start)
    last = n if size is None else at(start + size)
    return F.substring(c, first + 1, F.greatest(last - first, F.lit(0)))


def replace(c: Column, search: str, by: str) -> Column:
    """Every occurrence; an empty search puts ``by`` between the characters."""
    if search == "":
        return F.array_join(F.split(c, ""), by)
    return F.replace(c, F.lit(search), F.lit(by))


def child_sum(c: Column) -> Column:
    """Null without rows; a null counts as 0."""
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(c), F.lit(0)))


def coerce(c: Column, to: str, kind: str) -> Column:
    """A result as its field's type: string, integer, number or boolean."""
    if to == "string":
        return number_text(c) if kind == "number" else c.cast("string")
    if to == "boolean":
        return truthy(c, kind)
    if kind != "number":
        return F.lit(None).cast("double")
    return F.floor(c + 0.5).cast("long") if to == "integer" else c.cast("double")
