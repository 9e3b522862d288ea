"""Formula functions against plain Python forms of their rules."""

import math

from pyspark.sql import functions as F

from quarry.functions import formula as fm

VALUES = [("héllo 😀", -2.5, True), ("", 0.0, False), (None, None, None), ("  x ", 7.0, True), ("abcdef", 2.5, None), ("0", -0.4, False)]


def results(spark, **columns):
    df = spark.createDataFrame(VALUES, "s string, n double, b boolean")
    return [tuple(r) for r in df.select(*(c.alias(k) for k, c in columns.items())).collect()]


def test_truth_is_two_valued(spark):
    s, n, b = F.col("s"), F.col("n"), F.col("b")
    got = results(spark, a=fm.truthy(s, "string"), c=fm.truthy(n, "number"), d=fm.truthy(b, "boolean"), e=fm.negation(n, "number"), f=fm.equals(n, F.lit(0.0)), g=fm.compare(n, "<", F.lit(1)))
    assert got == [(bool(s), bool(n), bool(b), not n, n == 0.0, n is not None and n < 1) for s, n, b in VALUES]


def test_numbers(spark):
    n = F.col("n")
    got = results(spark, r=fm.round_up(n), r1=fm.round_up(n, 1), t=fm.number_text(n), d=fm.divide(F.lit(1), n), m=fm.modulo(n, F.lit(2.0)), i=fm.coerce(n, "integer", "number"), z=fm.modulo(n, n - n))
    for (_, v, _), (r, r1, t, d, m, i, z) in zip(VALUES, got):
        if v is None:
            assert (r, r1, t, d, m, i, z) == (None,) * 7
        else:
            assert r == math.floor(v + 0.5) and r1 == math.floor(v * 10 + 0.5) / 10 and d == (1 / v if v else None) and m == math.fmod(v, 2) and i == math.floor(v + 0.5) and z is None
            assert t == (str(int(v)) if v == int(v) else str(v))


def test_texts(spark):
    s = F.col("s")
    got = results(spark, t=fm.trim(s), n=fm.length(s), a=fm.substring(s, 1, 2), b=fm.substring(s, -2), c=fm.substring(s, 2, 0), e=fm.replace(s, "", "-"), x=fm.concat(s, F.col("n"), F.lit("!")))
    for (v, *_), (t, n, a, b, c, e, x) in zip(VALUES, got):
        if v is None:
            assert (t, n, a, b, c, e) == (None,) * 6 and x == "!"
        else:
            assert t == v.strip() and n == len(v.encode("utf-16-be")) // 2 and a == v[1:3] and b == v[-2:] and c == "" and (not v or e == "-".join(v))


def test_sum_of_no_rows_and_of_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "n double")
    assert df.agg(fm.child_sum(F.col("n"))).first()[0] == 0 and df.limit(0).agg(fm.child_sum(F.col("n"))).first()[0] is None


def test_coercion(spark):
    n, s = F.col("n"), F.col("s")
    got = results(spark, a=fm.coerce(n, "string", "number"), b=fm.coerce(s, "number", "string"), c=fm.coerce(s, "boolean", "string"), d=fm.choose(s, "string", F.lit(1), F.lit(2)))
    assert [r[1] for r in got] == [None] * 6 and [r[2] for r in got] == [bool(v[0]) for v in VALUES] and got[0][0] == "-2.5" and got[3][0] == "7" and [r[3] for r in got] == [1 if v[0] else 2 for v in VALUES]
