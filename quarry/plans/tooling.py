"""Schema tooling (section N)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..model import Field, ObjectDef, Permission
from ..operators import tooling as tl
from ..sources.storage import table
from . import objects as ob
from .registry import query

DRIFTED = ObjectDef("orders", (Field("o_orderkey", "bigint", primary=True), Field("o_custkey", "integer"), Field("o_totalprice", "double"), Field("o_note", "text")))
DRIFT_SQL = "(VALUES ('o_orderkey', 'ok'), ('o_custkey', 'type'), ('o_totalprice', 'ok'), ('o_note', 'missing'), ('o_orderstatus', 'extra'), ('o_orderdate', 'extra'), ('o_orderpriority', 'extra')) t(column_name, status)"


def drift_rows(spark, d):
    return spark.createDataFrame(tl.drift(DRIFTED, table(spark, d, "orders").schema), "column_name string, status string")


@query(f"SELECT * FROM {DRIFT_SQL}")
def schema_drift(spark, d):
    return drift_rows(spark, d)


@query(f"SELECT status, count(*) AS n FROM {DRIFT_SQL} GROUP BY status")
def schema_drift_totals(spark, d):
    return drift_rows(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'o_note' AS column_name, 'string' AS type")
def schema_diff(spark, d):
    return spark.createDataFrame(tl.additions(DRIFTED, table(spark, d, "orders").schema), "column_name string, type string")


@query("SELECT column_name AS field, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'integer' END AS type, column_name = 'p_partkey' AS is_key FROM information_schema.columns WHERE table_name = 'part'")
def introspect_columns(spark, d):
    draft = tl.introspect("part", table(spark, d, "part").schema, ["p_partkey"])
    return spark.createDataFrame([(f.name, f.type, f.primary) for f in draft.fields], "field string, type string, is_key boolean")


@query("SELECT * FROM (VALUES ('customer', 'o_custkey^', 'orders', 'hasMany'), ('lineitem', 'lines^', 'orders', 'belongsTo'), ('orders', 'lines', 'lineitem', 'hasMany'), ('orders', 'o_custkey', 'customer', 'belongsTo'), ('orders', 'part_ids', 'part', 'multiRelation'), ('part', 'part_ids^', 'orders', 'multiRelation')) t(source, field, target, kind)")
def relation_edges(spark, d):
    return spark.createDataFrame(tl.relation_edges([ob.ORDERS, ob.CUSTOMER, ob.LINE]), "source string, field string, target string, kind string")


@query("SELECT * FROM (VALUES ('customer', '', 'added'), ('orders', 'o_custkey', 'changed'), ('orders', 'o_note', 'removed'), ('orders', 'o_orderdate', 'added'), ('orders', 'o_orderpriority', 'added'), ('orders', 'o_orderstatus', 'added'), ('orders', 'o_totalprice', 'changed')) t(object, field, change)")
def metadata_changes(spark, d):
    stored = ObjectDef("orders", tuple(f for f in ob.PLAIN_ORDERS.fields if not f.virtual))
    return spark.createDataFrame(tl.metadata_changes([DRIFTED], [stored, ob.CUSTOMER]), "object string, field string, change string")


WRONG = ObjectDef("wrong", (
    Field("id", "bigint", primary=True), Field("Upper"), Field("n", "integer", min=5, max=1), Field("half", "integer", min=0.5), Field("t", min_length=3, max_length=2), Field("p", pattern="("), Field("e", "enum", values=("a", "a"), default="z"),
    Field("f", "double", formula="n * 2", required=True), Field("must", required=True), Field("o1", ownership="internal"), Field("o2", ownership="internal"),
), {"a": Permission("department"), "b": Permission("some", create_fields=("id", "nope"))})


@query("""SELECT * FROM (VALUES ('field.name.snake', 'Upper'), ('field.minGtMax', 'n'), ('field.min.integer', 'half'), ('field.minLengthGtMaxLength', 't'), ('field.regex.invalid', 'p'), ('field.enum.options.duplicate', 'e'),
('field.default.inOptions', 'e'), ('formula.excludedAttr', 'f'), ('field.ownership.many', 'wrong'), ('permission.scope.invalid', 'b'), ('permission.createFields.unknown', 'b.nope'), ('permission.createFields.missingRequired', 'b.must')) t(code, place)""")
def definition_errors(spark, d):
    return spark.createDataFrame(tl.definition_errors(WRONG), "code string, place string")


NOTE = ObjectDef("note", (Field("id", "bigint", primary=True), Field("text", "text", required=True, max_length=9)), {"r": Permission("own", exclude=("text",))})
PAGE = ObjectDef("page", (Field("id", primary=True), Field("notes", "details", target="note")))
NOTE_TEXT = '{"fields":[{"name":"id","primary":true,"type":"bigint"},{"max_length":9,"name":"text","required":true,"type":"text"}],"name":"note","permissions":{"r":{"exclude":["text"],"read":"own"}}}'
PAGE_TEXT = '{"fields":[{"name":"id","primary":true},{"name":"notes","target":"note","type":"details"}],"name":"page"}'


@query(f"SELECT sha256('{NOTE_TEXT}' || chr(10) || '{PAGE_TEXT}') AS hash")
def schema_hash(spark, d):
    return spark.createDataFrame([(tl.schema_hash([PAGE, NOTE]),)], "hash string")


@query("SELECT * FROM (VALUES (1, NULL, 'a'), (2, 1, 'b'), (3, 2, 'a')) t(id, parent, hash)")
def schema_revisions(spark, d):
    """One revision for each hash that differs from the latest."""
    revisions = spark.createDataFrame([], "id long, parent long, hash string, at timestamp")
    for digest in ("a", "a", "b", "b", "a"):
        revisions = tl.append_revision(revisions, digest, datetime(2024, 1, 2))
    return revisions.select("id", "parent", "hash")


@query("SELECT 'orders' AS object")
def impact(spark, d):
    return spark.createDataFrame([(x,) for x in tl.impact([ob.ORDERS, ob.CUSTOMER, ob.LINE], "customer")], "object string")
