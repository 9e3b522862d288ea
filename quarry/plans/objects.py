"""The objects declared over the tables."""

from __future__ import annotations

from ..model import Field, ObjectDef, Permission, Subject

ORDERS = ObjectDef("orders", (
    Field("o_orderkey", "bigint", primary=True), Field("o_custkey", "bigint", ownership="internal", target="customer"),
    Field("o_orderstatus", "enum", values=("F", "O", "P"), max_length=1), Field("o_totalprice", "double", min=0), Field("o_orderdate", "timestamp"),
    Field("o_orderpriority", "string"), Field("tags", "enum", multiple=True), Field("lines", "details", target="lineitem"), Field("part_ids", "multiRelation", target="part"),
), {
    "sales": Permission("own", None, True, False, ("o_orderpriority",)), "region": Permission("department", "own"), "admin": Permission("all", "all", True, True, None),
    "clerk": Permission("all", "own", exclude=("o_totalprice",)),
})
PLAIN_ORDERS = ObjectDef("orders", tuple(f for f in ORDERS.fields if f.name != "tags"), ORDERS.permissions)
EXTERNAL_ORDERS = ObjectDef("orders", (Field("o_orderkey", "bigint", primary=True), Field("owner_name", ownership="external"), Field("o_totalprice", "double")), {"sales": Permission("own"), "region": Permission("department")})
CUSTOMER = ObjectDef("customer", (
    Field("c_custkey", "bigint", primary=True), Field("c_name", required=True, max_length=25, pattern="^Customer"), Field("dept_id", "department", department="internal"),
    Field("c_acctbal", "double", min=0, sensitive=True), Field("c_mktsegment", "enum", scope=True, values=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
), {"region": Permission("department"), "admin": Permission("all", "all", True, True, None)})
LINE = ObjectDef("lineitem", (
    Field("l_orderkey", "bigint", primary=True), Field("l_partkey", "bigint", primary=True), Field("l_suppkey", "bigint", primary=True), Field("l_linenumber", "integer", primary=True),
    Field("l_quantity", "double", min=1, max=40), Field("l_returnflag", "enum", values=("A", "N")),
), parent="orders")

OWNER = 10
SALES = Subject(OWNER, ("sales",))
REGION = Subject(OWNER, ("region",), department="r1")
NATION = Subject(OWNER, ("region",), department="n7")
ADMIN = Subject(OWNER, ("admin",))
TENANT = Subject(OWNER, ("admin",), scope="BUILDING")
SYSTEM = Subject(system=True)
