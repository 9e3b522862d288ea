"""Queries with SQL against DuckDB, those with planted answers against the tables."""

import duckdb
import pytest

from quarry.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    result = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in df.collect()) == sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())


def test_scans_return_every_document(spark):
    from tests.llm import util

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in Q.op2_secret_scan(spark, SF).collect()}
    assert found.keys() == docs.keys()
    for d, t in docs.items():
        assert found[d]["base_sha256"] == util.sha(",".join(f"{k}:{s}:{e}" for k, s, e in util.base_spans(t)))
    marked = {r["doc_id"]: r for r in Q.op4_license_scan(spark, SF).collect()}
    from quarry.llm.license_scan import PHRASES

    for d, t in docs.items():
        n, places = util.phrase_places(t, PHRASES)
        assert (marked[d]["n_words"], marked[d]["base_labels"], marked[d]["n_base"]) == (n, ",".join(sorted(places)), sum(map(len, places.values())))
