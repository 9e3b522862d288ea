"""Formula functions (section F)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions import formula_text as ft
from ..functions.keys import record_key
from ..model import Field, ObjectDef
from ..sources import frames as fr
from ..sources.storage import table
from .registry import query



def _over(name: str, frame: str, key: str, build, sql: str, source: str | None = None):
    def run(spark, d):
        df = getattr(fr, frame)(spark, d) if hasattr(fr, frame) else table(spark, d, frame)
        return df.select(key, build().alias("x"))

    run.__name__ = name
    name_in_sql = source or frame
    query((fr.with_frames(source, "") if source else "") + f"SELECT {key}, {sql} AS x FROM {name_in_sql}")(run)


def _part(name, build, sql):
    _over(name, "part", "p_partkey", build, sql)


def _order(name, build, sql):
    _over(name, "nullable_orders", "o_orderkey", build, sql, "norders")


def c(n):
    return F.col(n)


_part("formula_literals", lambda: fm.concat(F.lit(1), F.lit("a"), F.lit(True), F.lit(None)), "'1atrue'")
_order("formula_field", lambda: c("o_orderpriority"), "o_orderpriority")
_order("formula_arith", lambda: c("o_totalprice") * 2 + 1 - c("o_custkey"), "o_totalprice * 2 + 1 - o_custkey")
_part("formula_div", lambda: fm.divide(c("p_retailprice"), (c("p_size") - 10)), "CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END")
_part("formula_mod", lambda: fm.modulo(c("p_size") - 20, F.lit(7)), "(p_size - 20) % 7")
_order("formula_eq", lambda: fm.equals(c("o_orderpriority"), F.lit("1-URGENT")), "coalesce(o_orderpriority = '1-URGENT', false)")
_order("formula_cmp", lambda: fm.compare(c("o_totalprice"), ">=", F.lit(100000)), "coalesce(o_totalprice >= 100000, false)")
_order("formula_logic", lambda: fm.truthy(c("o_orderpriority"), "string") & fm.truthy(c("o_custkey") - 10, "number"), "coalesce(o_orderpriority <> '', false) AND o_custkey <> 10")
_order("formula_not", lambda: fm.negation(c("o_orderpriority"), "string"), "NOT coalesce(o_orderpriority <> '', false)")
_order("formula_neg", lambda: -c("o_totalprice"), "-o_totalprice")
_order("formula_concat_op", lambda: fm.concat(F.lit("Order-"), fm.number_text(c("o_custkey")), c("o_orderpriority")), "'Order-' || o_custkey || coalesce(o_orderpriority, '')")
_order("formula_if", lambda: fm.choose(c("o_totalprice") > 100000, "boolean", F.lit("big"), F.lit("small")), "CASE WHEN coalesce(o_totalprice > 100000, false) THEN 'big' ELSE 'small' END")
_part("formula_round", lambda: fm.round_up(c("p_retailprice") / 8 - 120, 2), "floor((p_retailprice / 8 - 120) * 100.0 + 0.5) / 100.0")
_part("formula_now", lambda: F.date_format(fm.now(datetime(2024, 1, 2, 3, 4, 5)), "yyyy-MM-dd HH:mm:ss"), "'2024-01-02 03:04:05'")
_order("formula_concat", lambda: fm.concat(c("o_orderstatus"), c("o_orderpriority"), F.lit("!")), "o_orderstatus || coalesce(o_orderpriority, '') || '!'")
_order("formula_case", lambda: F.concat_ws("/", F.lower("o_orderpriority"), F.upper("o_orderstatus")), "concat_ws('/', lower(o_orderpriority), upper(o_orderstatus))")
_part("formula_trim", lambda: fm.trim(F.concat(F.lit("  \t"), c("p_name"), F.lit(" ﻿\n"))), "p_name")
_part("formula_length", lambda: fm.length(F.concat(c("p_name"), F.lit("é😀"))), "(length(p_name) + 3)::INTEGER")
_part("formula_substr", lambda: F.concat_ws("|", fm.substring(c("p_name"), 2, 3), fm.substring(c("p_name"), 4), fm.substring(c("p_name"), -3), fm.substring(c("p_name"), -3, 2)), "concat_ws('|', substr(p_name, 3, 3), substr(p_name, 5), right(p_name, 3), left(right(p_name, 3), 2))")
_part("formula_replace", lambda: F.concat_ws("|", fm.replace(c("p_name"), "e", "E"), fm.replace(F.substring("p_name", 1, 3), "", "-")), "concat_ws('|', replace(p_name, 'e', 'E'), concat_ws('-', p_name[1], p_name[2], p_name[3]))")
_part("formula_absfloorceil", lambda: F.concat_ws("|", F.abs(c("p_size") - 20).cast("string"), F.floor(c("p_retailprice")).cast("string"), F.ceil(c("p_retailprice")).cast("string")), "concat_ws('|', abs(p_size - 20)::VARCHAR, floor(p_retailprice)::BIGINT::VARCHAR, ceil(p_retailprice)::BIGINT::VARCHAR)")
_part("formula_pow", lambda: F.pow(c("p_size"), F.lit(2)), "pow(p_size, 2)")
_order("formula_coalesce", lambda: F.coalesce("o_orderpriority", "o_orderstatus"), "coalesce(o_orderpriority, o_orderstatus)")
_order("formula_coerce", lambda: F.concat_ws("|", fm.coerce(c("o_custkey"), "string", "number"), fm.coerce(c("o_totalprice"), "integer", "number").cast("string"), fm.coerce(c("o_totalprice"), "boolean", "number").cast("string")), "concat_ws('|', o_custkey::VARCHAR, floor(o_totalprice + 0.5)::BIGINT::VARCHAR, (coalesce(o_totalprice <> 0, false))::VARCHAR)")
_part("formula_chain", lambda: fm.concat(F.lit("T"), fm.number_text(fm.round_up((c("p_size") + 1) * 2.5))), "'T' || floor((p_size + 1) * 2.5 + 0.5)::BIGINT")


@query("SELECT o_orderkey, c_name AS owner, c_acctbal * 2 AS doubled FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def formula_ref(spark, d):
    """``rel.field`` is one left join; an unreadable row gives null."""
    ref = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"), (F.col("c_acctbal") * 2).alias("doubled"))
    return table(spark, d, "orders").join(ref, "o_custkey", "left").select("o_orderkey", "owner", "doubled")


def _child(name: str, column, sql: str):
    """A child aggregate is one pre-aggregated left join."""

    def run(spark, d):
        lines = table(spark, d, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")))
        per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*column())
        out = table(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
        return out.withColumn("x", F.coalesce("x", F.lit(0))) if name == "formula_count" else out

    run.__name__ = name
    query(f"WITH l AS (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q FROM lineitem), g AS (SELECT l_orderkey, {sql} FROM l GROUP BY l_orderkey) SELECT o_orderkey, {'coalesce(x, 0) AS x' if name == 'formula_count' else 'g.* EXCLUDE (l_orderkey)'} FROM orders LEFT JOIN g ON o_orderkey = l_orderkey")(run)


_child("formula_count", lambda: [F.count(F.lit(1)).alias("x")], "count(*) AS x")
_child("formula_sum", lambda: [fm.child_sum(F.col("q")).alias("x")], "coalesce(sum(q), 0) AS x")
_child("formula_avg", lambda: [fm.round_up(F.avg("q"), 6).alias("x")], "floor(avg(q) * 1000000.0 + 0.5) / 1000000.0 AS x")
_child("formula_minmax", lambda: [F.min("q").alias("x"), F.max("q").alias("y")], "min(q) AS x, max(q) AS y")


FORMULAS = ObjectDef("orders", (
    Field("o_orderkey", "bigint", primary=True), Field("o_custkey", "relation", target="customer"), Field("o_orderstatus"), Field("o_totalprice", "double"), Field("lines", "details", target="lineitem"),
    Field("net", "double", formula="ROUND(o_totalprice / 1.19, 2)"), Field("grade", formula="IF(net > 100000 and not (o_orderstatus == 'F'), 'big', 'small') & '-' & o_orderstatus"),
    Field("who", formula="UPPER(o_custkey.c_name)"), Field("parts", "integer", formula="COUNT(lines)"), Field("each", "double", formula="net / parts"),
))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1), o AS (SELECT *, floor((o_totalprice / 1.19::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS net FROM orders)
SELECT o_orderkey, net, CASE WHEN net > 100000 AND o_orderstatus <> 'F' THEN 'big' ELSE 'small' END || '-' || o_orderstatus AS grade, upper(c_name) AS who, coalesce(parts, 0)::BIGINT AS parts, net / nullif(coalesce(parts, 0), 0) AS each
FROM o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON l_orderkey = o_orderkey""")
def formula_text(spark, d):
    """Formulas as definitions write them, checked and put in order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = ft.computed(o, FORMULAS, ft.validate(spark, FORMULAS), datetime(2024, 1, 2), {"o_custkey": (table(spark, d, "customer"), "c_custkey")}, {"lines": (fr.order_lines(spark, d), record_key(o, "o_orderkey"))})
    return out.select("o_orderkey", "net", "grade", "who", "parts", "each")
