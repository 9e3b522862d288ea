import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import chunks as C
from quarry.llm.decontaminate import contamination
from quarry.llm.jaccard_join import components, jaccard_components
from quarry.llm.mixing import mix_sources, thresholds
from quarry.llm.substring_dedup import substring_dedup
from tests.llm import util


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(C, "BUCKET_BYTES", 9000)


def test_substring_dedup(spark, small_chunks):
    texts = util.corpus()
    texts[90] = texts[83][:9000] + " tail"
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(util.rows(spark, texts)).collect()}
    assert got == {d: (n, m, " ".join(k)) for d, (n, m, k) in util.dedup(texts).items()}


def test_substring_dedup_repeated_rows_and_null_ids(spark):
    text = util.prose(random.Random(1), 40)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect())
    assert got == [(False, 40, 0), (False, 40, 40), (True, 0, 0), (True, 40, 40)]
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(df, window=10)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, small_chunks, seed, monkeypatch):
    from quarry.llm import jaccard_join as J

    monkeypatch.setattr(J, "GROUP", 4)  # many blocks, so that the matrix has work
    texts = util.corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(util.rows(spark, texts)).collect()}
    assert got == util.components(texts)


def test_jaccard_chain_and_edges(spark):
    rng = random.Random(4)
    w = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(12):  # each links with the next only
        texts[i] = " ".join(w)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{i}{rng.random()}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(util.rows(spark, texts)).collect()}
    assert got == util.components(texts)
    df = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (6, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect())
    assert rows == [("5", 1, 5), ("5", 1, 5), ("6", 0, 6), ("None", 1, 5)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components_with_hot_keys(spark, small_chunks, seed, monkeypatch):
    """Every key counts as hot: all broadcast and all split paths are taken."""
    from quarry.llm import jaccard_join as J
    from quarry.llm import shared

    for name, value in (("HOT_ROWS", 2), ("HOT_SHARE", 1000), ("FEW_ROWS", 0)):
        monkeypatch.setattr(shared, name, value)
    for name, value in (("GROUP", 4), ("PART", 3)):
        monkeypatch.setattr(J, name, value)
    texts = util.corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(util.rows(spark, texts)).collect()}
    assert got == util.components(texts)


def test_jaccard_with_thousands_of_equal_empty_and_common_rows(spark):
    same, common = "the same text of eight words once more", "one two three four five"
    data = [(i, same) for i in range(10_000)] + [(i, None if i % 2 else " ") for i in range(10_000, 20_000)]
    data += [(i, f"{common} {i} a{i} b{i} c{i}") for i in range(20_000, 21_000)]  # a shingle of all, too little to link
    got = jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).groupBy("component_id").count().collect()
    by = {r["component_id"]: r["count"] for r in got}
    assert by.pop(0) == 10_000 and set(by) == set(range(10_000, 21_000)) and set(by.values()) == {1}


def test_rows_of_one_id(spark, small_chunks, monkeypatch):
    """Literal repeats, many texts of one id, many without id."""
    monkeypatch.setattr(C, "REPEATS", 3)
    rng = random.Random(5)
    texts = [util.prose(rng, 60) for _ in range(30)]
    data = [(7, t) for t in texts] + [(None, t) for t in texts[:10]] + [(8, texts[0])] * 9 + [(9, "a b")] * 9 + [(None, None)] * 9
    df = spark.createDataFrame(data, "doc_id long, text string")
    removed = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"] == "") for r in substring_dedup(df).collect())
    expected = [("7", 60, 0, False)] * 30 + [("8", 60, 60, True)] * 9 + [("9", 2, 0, False)] * 9 + [("None", 0, 0, True)] * 9 + [("None", 60, 60, True)] * 10
    assert removed == sorted(expected)
    linked = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(df).collect())
    assert linked == sorted([("7", 56, "7")] * 30 + [("8", 56, "7")] * 9 + [("9", 1, "9")] * 9 + [("None", 0, "None")] * 9 + [("None", 56, "7")] * 10)
    with pytest.raises(TypeError, match="integers"):
        jaccard_components(df.withColumn("doc_id", F.lit("x")))
    with pytest.raises(TypeError, match="integers"):
        substring_dedup(df.withColumn("doc_id", F.lit("x")))


def test_spread_join_equals_a_join(spark, monkeypatch):
    from quarry.llm import shared

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("v").alias("top")).where("k <> 7")
    plain = sorted(map(tuple, rows.join(facts, "k").select("k", "v", "top").collect()))
    for few in (10_000, 0):
        monkeypatch.setattr(shared, "FEW_ROWS", few)
        df = shared.spread_join(rows, facts, ["k"], 3000)
        assert sorted(map(tuple, df.select("k", "v", "top").collect())) == plain
        assert ("Union" in df._jdf.queryExecution().toString()) == (few == 0)
    assert shared.spread_join(rows.limit(0), facts, ["k"], 0).count() == 0


def test_a_word_of_half_a_megabyte(spark):
    text = "w" * 600_000 + " " + " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_components(df).collect()] == [1, 1]
    assert sorted(r["n_removed"] for r in substring_dedup(df).collect()) == [0, 41]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 100), (200, 200)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[102] == 100 and 200 not in got


def test_contamination(spark):
    rng = random.Random(8)
    items = {0: util.prose(rng, 30), 1: util.prose(rng, 12), 2: "one two", 3: "", 4: None, 5: util.prose(rng, 200)}
    texts = util.corpus()
    texts[90] = util.prose(rng, 5000) + " " + items[0].upper() + " " + util.prose(rng, 3000)
    w = items[5].split()
    w[100] = "changed"
    texts[91], texts[92] = " ".join(w), items[1][:-1]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in contamination(util.rows(spark, texts), bench).collect()}
    expected = set()
    for d, t in texts.items():
        w = util.words(t, True)
        for i, item in items.items():
            k = min(5, len(util.words(item)))
            own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            s = util.shingle_set(item)
            if s and 10 * len(s & own) >= 8 * len(s):
                expected.add((d, i, len(s & own), len(s)))
    assert got == expected and {d for d, *_ in got} >= {80, 81, 82, 90, 91}
    assert contamination(util.rows(spark, texts), bench.limit(0)).count() == 0
    assert contamination(util.rows(spark, texts).limit(0), bench).count() == 0


def test_contamination_in_blocks(spark, monkeypatch):
    from quarry.llm import decontaminate as D

    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    rng = random.Random(9)
    items = [(i, util.prose(rng, 20)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"{util.prose(rng, 50)} {t}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    live, made = [], []
    broadcast = spark.sparkContext.broadcast

    def watched(value):
        b = broadcast(value)
        made.append(b)
        live.append(sum(not getattr(x, "_gone", False) for x in made))
        destroy = b.destroy

        def gone(*a, **k):
            b._gone = True
            destroy(*a, **k)

        b.destroy = gone
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", watched)
    found = contamination(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i, _ in items}
    assert len(made) > 3 and max(live) == 1  # one block at a time


def test_contamination_with_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "a one two three"), (None, "one two three b"), ("y", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("i", "One two THREE"), (None, "three b")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, bench).collect()}
    assert got == {("x", "i"), (None, "i"), (None, None)}


def test_mixing_reaches_targets(spark):
    rng = random.Random(6)
    data = [(i, util.prose(rng, rng.randrange(0, 40)), ["big"] * 5 + ["mid", "tiny", None]) for i in range(800)]
    df = spark.createDataFrame([(i, t, s[i % 8] if i < 780 else "big") for i, t, s in data], "doc_id long, text string, source string")
    rows = mix_sources(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mix_sources(df.repartition(7)).collect()}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    by = {}
    for r in rows:
        assert again[r["doc_id"]] == r["taken"] and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        a = by.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"], 0])
        a[0] += r["taken"]
        a[3] = max(a[3], r["size"])
    assert sum(a[1] for a in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(a[0] - a[1]) <= a[3] and a[1] <= 3 * a[2] + 1e-6 for a in by.values())


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a b", "x"), (None, "a", "x"), (2, "", "y")], "doc_id long, text string, source string")
    rows = {(r["doc_id"], r["size"]): r for r in mix_sources(df).collect()}
    assert len(rows) == 4 and rows[(1, 2)]["target"] == 3.0 and rows[(2, 0)]["taken"] == 0
    assert mix_sources(df.limit(0)).count() == 0


def test_thresholds_split_equal_prefixes(spark):
    """Hashes that differ in the last bits only."""
    sizes = spark.createDataFrame([("s", 10, (1 << 59) + i) for i in range(20)], "_key string, size long, _hash long")
    budgets = spark.createDataFrame([("s", 73.0)], "_key string, _budget double")
    assert thresholds(sizes, budgets).first()["_below"] == (1 << 59) + 6


def test_mixing_matches_sorted_prefix(spark):
    rng = random.Random(10)
    data = [("s", rng.randrange(1, 50), rng.randrange(1 << 60)) for _ in range(300)]
    for budget in (0.0, 100.0, 3333.3, 1e9):
        got = thresholds(spark.createDataFrame(data, "_key string, size long, _hash long"), spark.createDataFrame([("s", budget)], "_key string, _budget double")).first()["_below"]
        cum, below = 0, set()
        for _, n, h in sorted(data, key=lambda x: x[2]):
            if 2 * cum + n <= 2 * budget:
                below.add(h)
            cum += n
        assert {h for _, _, h in data if h <= got} == below
