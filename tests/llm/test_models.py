import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, quality, toxicity
from quarry.llm.queries import fold_of
from tests.llm import util

SF = "/root/testdata/sf0.01"


def held_out(spark, name, f, n, left_out):
    from quarry.llm import queries as Q

    scores = {r["doc_id"]: r for r in f(spark, SF).collect()}
    labels = {r["doc_id"]: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(labels[d], r["predicted"]) for d, r in scores.items() if r["held_out"] and d in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= Q.PREDICT_AT) for r in scores.values())
    return out


def test_quality_on_held_out_rows(spark):
    from quarry.llm import queries as Q

    pairs = held_out(spark, "quality", Q.op3_quality, 4, 2)
    assert np.mean([a == b for a, b in pairs]) >= 0.97


def test_toxicity_on_held_out_rows(spark):
    from quarry.llm import queries as Q

    pairs = held_out(spark, "toxic", Q.op7_toxicity, 3, 1)
    assert np.mean([a == b for a, b in pairs]) >= 0.88  # 33 toxic texts to learn from
    assert np.mean([b for a, b in pairs if a == 0]) <= 0.03


def test_toxic_documents_are_found(spark):
    """Recall of held-out toxic rows where some hundreds can be learnt from."""
    from quarry.llm import queries as Q

    sf = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    r = Q.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    found = {x["toxic"]: x["p"] for x in r}
    assert found[1] >= 0.85 and found[0] <= 0.03


def plain_toxicity(text, model, segment):
    """The score by definition: whole numbers and lists only."""
    import math
    import re

    from quarry.llm import text as T

    byte, mul, low = [int(x) for x in T._BYTE], [int(x) for x in T._MUL], (1 << 64) - 1
    mix = lambda h: int(T.mix(np.array([h & low], np.uint64))[0])
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    scores = []
    for w in words:
        marked = b"<" + bytes(b + 32 if 65 <= b <= 90 else b for b in w) + b">"
        own = int(T.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), True)[0])
        grams = [own] + [mix(n + sum(byte[c] * mul[j] for j, c in enumerate(marked[i : i + n]))) for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        scores.append(sum(float(model[g >> 47]) for g in grams) / len(grams))
    step = segment or max(1, len(scores))
    gaps = [sum(scores[i : i + step]) / len(scores[i : i + step]) for i in range(0, len(scores), step)]
    return 1 / (1 + math.exp(-(max(gaps, default=0.0) + float(model[-1]))))


@pytest.mark.parametrize("segment", [2, 3, None])
def test_toxicity_scores_by_definition(segment):
    rng = random.Random(2)
    texts = [None, "", "!!", "one", "Ünïcödé WORDS mixed Case", *(util.prose(rng, n) for n in (1, 2, 3, 7, 50)), "x" * 30_000 + " y"]
    model = np.random.default_rng(1).standard_normal(toxicity.BUCKETS + 1).astype(np.float32)
    got = toxicity.score_texts(pa.array(texts), model, segment)
    assert np.allclose(got, [plain_toxicity(t, model, segment) for t in texts], atol=1e-5)


def plain_features(text):
    """Counts of words, runs of punctuation, pairs and repeated pairs, by bucket."""
    import re
    from collections import Counter

    bucket = lambda t: [int(b) for b in quality.features(pa.array([t]))[1]]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text or "")
    punct = re.findall(r"[!-/:-@\[-`{-~]+", text or "")
    out = Counter(bucket(x)[0] for x in words + punct)
    for a, b in zip(words, words[1:]):
        out.update(bucket(f"{a} {b}")[2:])  # the pair, and for equal words that they are
    return out


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """Follow the regularised leader, proximal form, coordinate by coordinate."""
    import math

    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for d in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[d]}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in rows[d].items())))
            for i, x in rows[d].items():
                g = (p - labels[d]) * x
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_model_by_definition(spark):
    rng = random.Random(3)
    texts = {i: util.prose(rng, rng.randrange(1, 30), 40 if i % 2 else 60) + (" w1 w1 !!" if i % 2 else " , x.") for i in range(60)}
    labels = {i: i % 2 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), "quality", F.lit(True))
    rows = []
    for t in texts.values():
        f = plain_features(t)
        rows.append({i: quality.SCALE * c / sum(f.values()) for i, c in f.items()} | {quality.BUCKETS: 1.0})
    plain = plain_ftrl(rows, [labels[i] for i in texts], 4, 0.5, 1.0, 0.02, 0.02)
    assert np.flatnonzero(model).size > 20 and set(np.flatnonzero(model)) <= set(plain)
    assert all(abs(model[i] - w) < 1e-3 for i, w in plain.items())
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    for i, f in enumerate(rows):
        assert abs(got[i] - 1 / (1 + np.exp(-sum(model[b] * x for b, x in f.items())))) < 1e-4


def test_rows_learnt_from(spark):
    """One row an id, however often it stands there and whatever its length; bounded by ids."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "x" * 200_000), (3, None), (None, "n"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "quality", F.lit(True), 10, "doc_id", "text")
    assert sorted((r["_id"], r["_label"], len(r["_text"] or "")) for r in rows.collect()) == [(1, 1, 1), (2, 0, 200_000), (3, 1, 0)]
    assert rows.where("_id = 1").first()["_text"] == "a"
    assert quality.training_rows(docs, labels, "quality", F.lit(True), 1, "doc_id", "text").count() <= 1
    assert quality.training_rows(docs, labels, "quality", F.lit(True), 1, "doc_id", "text", balanced=True).count() <= 2


def test_models_on_empty_tables_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long + " idiot"), (2, long), (3, "short idiot"), (4, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    w, m = quality.train(docs, labels, "quality", F.lit(True)), toxicity.train(docs, labels, "toxic", F.lit(True))
    assert quality.scored(docs, w).count() == 4
    s = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, m).collect()}
    assert s[1] > s[2] and s[3] > s[4]
    assert toxicity.scored(docs.limit(0), m).count() == quality.scored(docs.limit(0), w).count() == 0


def test_unseen_misspellings(spark):
    rng = random.Random(1)
    clean = [util.prose(rng, 40) for _ in range(150)]
    texts = clean + [c.replace(c.split()[9], "horrible idiot", 1) for c in (util.prose(rng, 40) for _ in range(150))]
    model = toxicity.fit(texts, np.array([0] * 150 + [1] * 150))
    s = toxicity.score_texts(pa.array([util.prose(rng, 30) + " idiiot horible " + util.prose(rng, 30), util.prose(rng, 60), "", None]), model)
    assert s[0] > 0.7 and s[1] < 0.3 and s[2] == s[3]


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    w = quality.train(docs, none, "quality", F.lit(True))
    assert {r["score"] for r in quality.scored(docs.withColumn("score", F.lit("x")), w).collect()} == {0.5}
    m = toxicity.train(docs, none, "toxic", F.lit(True))
    assert all(r["score"] < 1e-9 for r in toxicity.scored(docs, m).collect())
    assert quality.scored(docs.limit(0), w).count() == 0


def test_folds(spark):
    import zlib

    got = [r[0] for r in spark.range(50).select(fold_of(F.col("id"), 4)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


def brute(vectors, k=5):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in ok:
        if q % 50 == 0:
            near = [(-float(ann.cosines(ok[q][None], c[None])[0]), i) for i, c in ok.items() if i != q and len(c) == len(ok[q])]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])}
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "STRIPE_BYTES", 60 * 12 * 8)
    monkeypatch.setattr(ann, "QUERY_BYTES", 4 * 12 * 8)
    monkeypatch.setattr(ann, "QUERY_TILE", 2)
    monkeypatch.setattr(ann, "TILE", 16)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, vectors[50][1]) for i in range(300, 310)] + [(310, None), (311, [0.0] * 12), (312, [float("nan")] * 12), (313, [None] * 12), (314, []), (350, [float("inf")] + [1.0] * 11), (400, [1.0, 2.0]), (401, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in vectors], "vec_id long, embedding array<float>, score int, rank string")
    got = {tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(vectors)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "STRIPE_BYTES", 30 * 12 * 8)
    rng = np.random.default_rng(6)
    vectors = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(120)]
    other = rng.standard_normal(12).astype(np.float32).tolist()
    ask = F.col("vec_id") % 50 == 0
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    nearest = lambda rows: sorted(tuple(r) for r in ann.nearest(frame(rows), ask & (F.col("vec_id") == 50)).collect())
    once = nearest(vectors)
    assert len({r[2] for r in once}) == 5 and nearest([*vectors, vectors[50], vectors[50]]) == once
    moved = nearest([(50, other) if i == 50 else (i, v) for i, v in vectors])
    assert nearest([*vectors, (50, other)]) == sorted([*once, *moved])


def test_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 32)
    rng = np.random.default_rng(9)
    one = rng.standard_normal(8).astype(np.float32)
    vectors = [(i, (one if i % 3 == 0 else one + 1e-4 * rng.standard_normal(8).astype(np.float32) if i % 3 == 1 else rng.standard_normal(8).astype(np.float32)).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()} == brute(vectors)
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(twice, F.col("vec_id") == 50).orderBy("rank").collect()] == [1, 1, 2]


def test_contenders():
    ids, v = np.array([5, 1, 1, 1, 9, 7, 3, 2]), np.array([[0.0], [0], [0], [0], [1], [0], [0], [0]])
    assert ann.contenders(ids, v, 2).tolist() == [1, 2, 4, 6, 7]


def test_quantised_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((40, 33)), rng.standard_normal((50, 33)) * 100
    (qx, sx, ax), (qy, sy, ay) = ann.codes(x), ann.codes(y)
    near = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy[None]
    error = sx[:, None] * sy[None] * (0.5 * (ax[:, None] + ay[None]) + 0.25 * 33)
    true = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert (np.abs(near - true) <= error + 1e-9).all()
