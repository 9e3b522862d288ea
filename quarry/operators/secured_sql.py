"""SQL over secured views: one SELECT, only over the given frames, by Spark's own parser and analyser.

The gate walks the parsed plan, its expressions and subqueries. Only the plan nodes that a
SELECT is made of pass, functions must be Spark's own and not reach outside the query, and
every table must be one of the views. Nothing is decided by the statement's text.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession

from ..model import ModelError, ObjectDef, Subject
from . import scope as sc

MAX_CHARS, MAX_JOINS, MAX_ROWS, MAX_NODES = 20_000, 8, 1000, 5000
#: functions of Spark's own that reach outside the views or the statement
DENIED = {
    "current_catalog", "current_database", "current_schema", "current_user", "input_file_block_length", "input_file_block_start", "input_file_name", "java_method",
    "reflect", "session_user", "try_reflect", "user",
}
TABLE_FUNCTIONS = {"explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack", "variant_explode", "variant_explode_outer"}
#: what the parser makes of a SELECT
PLAN_NODES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample",
    "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedPivot", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
}
#: expressions that hold functions by name, in more than one way
FUNCTIONS = {"UnresolvedFunction", "UnresolvedGenerator"}


@dataclass
class Statement:
    """What a SELECT refers to."""

    tables: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    literals: set[str] = field(default_factory=set)
    joins: int = 0
    nodes: int = 0


def _seq(items) -> Iterator:
    at = items.iterator()
    while at.hasNext():
        yield at.next()


def _refuse(detail: str):
    raise ModelError("script.query.invalid", detail)


def _plan(plan, names: frozenset[str], found: Statement) -> None:
    """Walks one plan; ``names``: common table expressions that it can see."""
    _count(found)
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in PLAN_NODES:
        _refuse(f"{kind} is not part of a query")
    if kind in ("Join", "LateralJoin"):
        found.joins += 1
    elif kind == "UnresolvedRelation":
        parts = list(_seq(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in names:
            found.tables.add(".".join(parts))
    elif kind == "UnresolvedTableValuedFunction":
        _function(list(_seq(plan.name())), TABLE_FUNCTIONS, found)
    elif kind == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            own = pair._1().lower()
            _plan(pair._2(), names | {own} if plan.allowRecursion() else names, found)
            names |= {own}
    for child in _seq(plan.children()):
        _plan(child, names, found)
    for e in _seq(plan.expressions()):
        _expression(e, names, found)
    if kind == "LateralJoin":
        _plan(plan.right().plan(), names, found)


def _expression(e, names: frozenset[str], found: Statement) -> None:
    _count(found)
    kind = e.getClass().getSimpleName().rstrip("$")
    if kind == "UnresolvedFunction":
        _function(list(_seq(e.nameParts())), None, found)
    elif kind == "UnresolvedGenerator":
        _function(list(_seq(e.name().nameParts())), TABLE_FUNCTIONS, found)
    elif kind == "UnresolvedAttribute":
        parts = [p.lower() for p in _seq(e.nameParts())]
        if len(parts) == 1 and parts[0] in DENIED:
            found.literals.add(parts[0])
    elif e.nodeName().lower().replace("_", "") in {d.replace("_", "") for d in DENIED} or kind.startswith("Current") and kind in ("CurrentUser", "CurrentDatabase", "CurrentCatalog"):
        raise ModelError("script.query.function", kind)
    for child in _seq(e.children()):
        _expression(child, names, found)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery", "UnresolvedScalarSubquery"):
        _plan(e.plan() if kind != "InSubquery" else e.query().plan(), names, found)


def _function(parts: list[str], allowed: set[str] | None, found: Statement) -> None:
    lowered = [p.lower() for p in parts]
    if len(lowered) > 1 and lowered[:-1] not in (["builtin"], ["system", "builtin"]):
        raise ModelError("script.query.function", ".".join(parts))
    found.functions.add(lowered[-1])
    if lowered[-1] in DENIED or allowed is not None and lowered[-1] not in allowed:
        raise ModelError("script.query.function", lowered[-1])


def _count(found: Statement) -> None:
    found.nodes += 1
    if found.nodes > MAX_NODES:
        _refuse(f"more than {MAX_NODES} nodes")


def statement(spark: SparkSession, sql: str) -> Statement:
    """What a single SELECT refers to; anything else is refused."""
    if len(sql) > MAX_CHARS:
        raise ModelError("script.query.too_long")
    js = spark._jsparkSession
    try:
        plan = js.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ModelError("script.query.invalid", str(e).splitlines()[0]) from None
    found = Statement()
    _plan(plan, frozenset(), found)
    own = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    generators = spark._jvm.org.apache.spark.sql.catalyst.analysis.TableFunctionRegistry.builtin()
    ident = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name in found.functions:
        if not own.functionExists(ident(name)) and not generators.functionExists(ident(name)):
            raise ModelError("script.query.function", name)
    return found


def relations(spark: SparkSession, sql: str) -> tuple[set[str], int]:
    """(tables named, joins) of a SELECT, common table expressions left out; anything else is refused."""
    found = statement(spark, sql)
    return found.tables, found.joins


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | list | None = None, max_rows: int | None = MAX_ROWS, max_joins: int = MAX_JOINS) -> DataFrame:
    """Runs ``sql`` with ``views`` (already scoped and without hidden columns) as its only tables; ``args`` are Spark's query parameters.

    It runs in a session of its own with the caller's settings, so the caller's views stay as they are.
    """
    found = statement(spark, sql)
    known = {n.lower() for n in views}
    if unknown := {n for n in found.tables if n.lower() not in known}:
        raise ModelError("script.query.table", ", ".join(sorted(unknown)))
    if found.joins > max_joins:
        raise ModelError("script.query.joins")
    columns = {c.lower() for v in views.values() for c in v.columns}
    if outside := found.literals - columns:  # functions that need no brackets, where no column has the name
        raise ModelError("script.query.function", ", ".join(sorted(outside)))
    js = spark._jsparkSession.cloneSession()
    session = SparkSession(spark.sparkContext, js)
    used = {n.lower() for n in found.tables}
    for name, frame in views.items():
        if name.lower() in used:
            spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(js, frame._jdf.logicalPlan()).createOrReplaceTempView(name)
    out = session.sql(sql, args) if args else session.sql(sql)
    return out if max_rows is None else out.limit(max_rows)


def run_scoped(spark: SparkSession, sql: str, objects: dict[str, tuple[DataFrame, ObjectDef]], subject: Subject, directory: sc.Directory | None = None, **options) -> DataFrame:
    """SQL over what ``subject`` may read of ``objects``. A table that is no object, or that no role may read, is refused, as is a department scope without a department."""
    named = {n.lower() for n in statement(spark, sql).tables}
    known = {n.lower(): n for n in objects}
    if unknown := named - known.keys():
        raise ModelError("script.query.table", ", ".join(sorted(unknown)))
    views = {}
    for low in named:
        df, obj = objects[known[low]]
        p = sc.resolve(obj, subject)
        if p is None or p.read is None:
            raise ModelError("rbac.denied", obj.name)
        views[known[low]] = sc.readable(df, obj, subject, directory)
    return run_sql(spark, sql, views, **options)


def rows_within(df: DataFrame, seconds: float = 5.0) -> list[Row]:
    """The rows, if they come within the time; else its jobs are cancelled."""
    sc_, tag, late = df.sparkSession.sparkContext, f"query-{uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc_.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc_.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise ModelError("script.query.timeout", f"{seconds} s") from None
        raise
    finally:
        timer.cancel()
        sc_.removeJobTag(tag)
