import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import queries as Q
from tests.llm import util

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(docs in, docs out) of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out[name] = (docs.toPandas(), after.toPandas())
        docs = after
    return out


def test_stages_keep_the_columns(steps):
    for name, (a, b) in list(steps.items())[:-1]:
        assert list(a.columns) == list(b.columns), name


def test_quality_keeps_clean_documents(steps, spark):
    a, b = steps["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(b["doc_id"])
    good = [d for d in a["doc_id"] if labels.get(d) == 1]
    bad = [d for d in a["doc_id"] if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)


def test_one_document_of_each_group_stays(steps):
    a, b = steps["near duplicates"]
    expected = util.components(dict(zip(a["doc_id"], a["text"])))
    assert sorted(b["doc_id"]) == sorted(d for d, (_, c) in expected.items() if c == d)


def test_leaks_go(steps, spark):
    a, b = steps["decontaminate"]
    items = [util.shingle_set(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = lambda t: any(s and 10 * len(s & util.shingle_set(t)) >= 8 * len(s) for s in items)
    assert sorted(b["doc_id"]) == sorted(d for d, t in zip(a["doc_id"], a["text"]) if not leak(t))


def test_secrets_go_and_documents_stay(steps):
    a, b = steps["secrets"]
    assert sorted(a["doc_id"]) == sorted(b["doc_id"])
    after = b.set_index("doc_id")
    for d, t, n in zip(a["doc_id"], a["text"], a["n_chars"]):
        now = after.loc[d]
        assert not util.base_spans(now["text"])
        if not util.base_spans(t) and P.SECRET not in now["text"]:
            assert (now["text"], now["n_chars"]) == (t, n)


def test_run_equals_the_stages(steps, spark):
    got = P.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    expected = steps["mix"][1].sort_values("doc_id").reset_index(drop=True)[got.columns]
    assert got.equals(expected)


def awkward(spark):
    """Nulls in every column, repeats, ids shared by different texts, names that clash."""
    long = "Some long clean text goes here and on. " * 2000
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words of the same id here"), (2, "A b c d e F"), (None, "a b c d e f"), (None, "no id but a text of its own"), (None, None), (3, None), (4, ""), (4, ""), (5, long), (6, "token: abcdefghijklmnop x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, spans string, _h int, th string, _first int, _score double, leader int, doc int"
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), k, "s", 1, "t", 2, 0.5, None, 3) for k, (i, t) in enumerate(rows)], schema)


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "other words of the same id here"), (None, "a text of its own")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    # no labels: all stay; one of the five alike; both items leave with their own rows only; secrets are replaced
    assert counts == [12, 9, 7, 7]
    left = {(r["doc_id"], (r["text"] or "")[:12]): r for r in docs.collect()}
    assert set(left) == {(1, "a b c d e f"), (None, ""), (3, ""), (4, ""), (5, "Some long cl"), (6, "[SECRET] x")}
    r = left[(6, "[SECRET] x")]
    assert (r["n_chars"], r["spans"], r["_h"], r["th"], r["a.b"], r["_score"]) == (10, "s", 1, "t", 11, 0.5)
    mixed = P.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.count() == 7 and mixed.where("doc_id = 5").first()["size"] == 16000


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = Q.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(Q.oracle_sql()) <= set(names)
