"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features are hashed counts, divided by the text's number of them: words, runs of
punctuation, pairs of consecutive words, all in original case, and pairs of the same word
as such. Training walks over
documents with follow-the-regularised-leader (proximal) updates; a score is the logistic of
a sparse dot product over all of a text.

Training rows are those of the ``max_train`` labelled ids with the smallest hash, a documented
bound on fitting, one row an id. They are used whole and every document is scored whole.

Defined results: null and empty texts score the intercept; labels that are null are not
learnt from; an id with several labels counts as the largest, with several texts as the least of
them; without any training row every score is 0.5; repeated rows are scored each; an empty
table gives an empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import quoted, saved, small_batches

BUCKETS = 1 << 18
SCALE = 20.0
_U = np.uint64
REPEATED = _U(0x5EED5EED5EED5EED)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence, and the number of them by row."""
    data, offsets = T.buffers(texts)
    row, start, end = T.spans(data, offsets, T.ALNUM)
    word = T.hashes(data, start, end, False)
    p_row, p_start, p_end = T.spans(data, offsets, T.PUNCT)
    punct = T.hashes(data, p_start, p_end, False)
    at, pair = T.shingles(row, word, 2)
    again = at[word[at] == word[at + 1]]
    rows = np.concatenate([row, p_row, row[at], row[again]])
    bucket = (np.concatenate([word, punct, pair, np.full(len(again), REPEATED)]) >> _U(64 - 18)).astype(np.int64)
    return rows, bucket, np.bincount(rows, minlength=len(texts))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (the intercept last) after FTRL-proximal updates, one document at a time."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(7)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for d in order.permutation(len(rows)):
            i, x = rows[d]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[d]) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(BUCKETS + 1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_train: int, doc_id: str, text: str, balanced: bool = False) -> DataFrame:
    """(_id, _label, _text): one row for each of at most ``max_train`` labelled ids (``balanced``: of each class), chosen by hash; one scan of the documents."""
    rows = labels.where(learn & quoted(label).isNotNull()).select(quoted(doc_id).alias("_id"), quoted(label).cast("int").alias("_label"))
    rows = rows.where("_id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    classes = [rows.where("_label = 1"), rows.where("_label = 0")] if balanced else [rows]
    chosen = saved(reduce(DataFrame.unionByName, [c.orderBy(F.xxhash64("_id"), "_id").limit(max_train) for c in classes]))
    texts = docs.select(quoted(doc_id).alias("_id"), quoted(text).alias("_text")).join(F.broadcast(chosen), "_id")
    return texts.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_train: int = 6000, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The weights: features are made in parallel, the bounded sample is learnt in one task."""
    small_batches(docs)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in T.slices(batch["_text"]):
                row, bucket, total = features(batch["_text"][a:e])
                key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                ends = np.searchsorted(key, np.arange(e - a + 1) * BUCKETS)
                i = [(key[ends[r] : ends[r + 1]] % BUCKETS).astype(np.int32).tobytes() for r in range(e - a)]
                x = [(SCALE * count[ends[r] : ends[r + 1]] / max(1, total[r])).astype(np.float32).tobytes() for r in range(e - a)]
                yield pa.RecordBatch.from_arrays([batch["_id"][a:e], batch["_label"][a:e], pa.array(i, pa.binary()), pa.array(x, pa.binary())], ["_id", "_label", "i", "x"])

    rows = training_rows(docs, labels, label, learn, max_train, doc_id, text)
    rows = rows.mapInArrow(sparse, f"_id {dict(rows.dtypes)['_id']}, _label int, i binary, x binary")

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([pd.DataFrame({"_id": [], "_label": [], "i": [], "x": []}), *parts])
        all_rows = all_rows.sort_values(["_id", "_label"], kind="stable")
        one = np.array([BUCKETS]), np.ones(1)
        x = [(np.concatenate([np.frombuffer(i, np.int32), one[0]]), np.concatenate([np.frombuffer(x, np.float32), one[1]])) for i, x in zip(all_rows["i"], all_rows["x"])]
        yield pd.DataFrame({"w": [ftrl(x, [int(v) for v in all_rows["_label"]]).astype(np.float32).tobytes()]})

    found = rows.repartition(1).mapInPandas(fit, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32).astype(np.float64) if found else np.zeros(BUCKETS + 1)


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for a, e in T.slices(texts):
        row, bucket, total = features(texts[a:e])
        out[a:e] = np.bincount(row, weights[bucket], e - a) * SCALE / np.maximum(total, 1)
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -30, 30)))


def score_of(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """The score of each text of ``docs``, from 0 to 1."""
    shared = small_batches(docs).sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_texts(texts, shared.value))

    return score(quoted(text))


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; a column of that name is replaced."""
    return docs.withColumn(name, score_of(docs, weights, text))
