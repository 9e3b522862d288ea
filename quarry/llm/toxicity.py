"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly.

A word is the mean of the embeddings of its character 3- to 5-grams (with word-end marks)
and of itself, all hashed into buckets, so an unseen misspelling shares most vectors of the
word it distorts. The average over ``segment`` words is taken by a linear softmax, and a text
is as toxic as its worst segment; with ``segment`` None a text is one segment, the average of
all its words. Embeddings and softmax are trained together in numpy on document labels: the
loss pools a document's segments by a soft maximum, whose gradient goes to the segments that
explain the label. The README has the figures of both.

Training rows are those of at most ``max_train`` labelled ids of each class with the smallest hash, a
documented bound on fitting, one row an id. Every document is learnt from and scored over its
whole text.

Defined results: null and empty texts score the intercept; null labels are not learnt from;
an id with several labels counts as the largest, with several texts as the least of them;
without both classes every score is 0; repeated rows are scored each; an empty table gives an
empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .quality import training_rows
from .shared import quoted, small_batches

BUCKETS, DIM, SEGMENT, SIZES = 1 << 17, 4, 2, (3, 4, 5)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the buckets of each word's character n-grams and of the word's hash itself."""
    size = end - start
    ends = np.cumsum(size + 2)
    begin = ends - size - 2
    buf = np.full(int(ends[-1]) if len(ends) else 0, 62, np.uint8)  # '<word>' for each word
    buf[begin] = 60
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buf[np.repeat(begin + 1, size) + inner] = _LOWER[data[np.repeat(start, size) + inner]]
    owner = np.repeat(np.arange(len(size)), size + 2)
    own, grams = [np.arange(len(size))], [word]
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(buf) - n + 1
            if m > 0:
                h = np.full(m, _U(n))
                for j in range(n):
                    h += T._BYTE[buf[j : m + j]] * T._MUL[j]
                ok = np.flatnonzero(owner[:m] == owner[n - 1 :])
                own.append(owner[ok])
                grams.append(T.mix(h[ok]))
    own, grams = np.concatenate(own), np.concatenate(grams)
    order = np.argsort(own, kind="stable")
    return (grams[order] >> _U(64 - 17)).astype(np.int64), np.cumsum(np.bincount(own, minlength=len(size)))


def segments(row: np.ndarray, size: int | None) -> np.ndarray:
    """Each word's segment: consecutive runs of ``size`` words of a row, or its row."""
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    if size is None:
        return np.cumsum(new) - 1
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return np.cumsum(new | (place % size == 0)) - 1


def fit(texts: list[str], labels: np.ndarray, segment: int | None = SEGMENT, epochs: int = 50, rate: float = 0.3, sharp: float = 1.0) -> np.ndarray:
    """The score of each bucket, embedding times softmax, then the intercept."""
    rng = np.random.default_rng(11)
    array = pa.array(texts, pa.large_string())
    data, offsets = T.buffers(array)
    row, start, end = T.spans(data, offsets, T.ALNUM)
    h = T.hashes(data, start, end, True)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    grams, ends = subwords(data, start[first], end[first], distinct)
    begin = np.concatenate([[0], ends[:-1]])
    count = (ends - begin).astype(np.float32)
    seg = segments(row, segment)
    n_seg = int(seg[-1]) + 1
    seg_row = row[np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))]
    seg_size = np.bincount(seg, minlength=n_seg).astype(np.float32)
    seg_at = np.concatenate([[0], np.cumsum(seg_size[:-1]).astype(np.int64)])
    by_word = np.argsort(word, kind="stable")
    word_at = np.searchsorted(word[by_word], np.arange(len(first)))
    by_gram = np.argsort(grams, kind="stable")
    used, gram_at = np.unique(grams[by_gram], return_index=True)
    gram_word = np.repeat(np.arange(len(first)), ends - begin)[by_gram]
    rows_at = np.flatnonzero(np.concatenate([[True], seg_row[1:] != seg_row[:-1]]))
    present = seg_row[rows_at]
    y = labels[present].astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32) * len(y)

    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_soft, seen_bias = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    local = np.repeat(np.arange(len(rows_at)), np.diff(np.append(rows_at, n_seg)))
    # A softmax of two classes depends on the difference of its columns alone, so one number for each
    # bucket carries an average forward, and one carries its gradient back.
    for _ in range(epochs):
        diff = soft[:, 1] - soft[:, 0]
        each = np.add.reduceat((emb @ diff)[grams], begin) / count
        gap = np.add.reduceat(each[word], seg_at) / seg_size + (bias[1] - bias[0])
        top = np.maximum.reduceat(gap, rows_at)
        share = np.exp(sharp * (gap - top[local]))
        share /= np.add.reduceat(share, rows_at)[local]  # the soft maximum's weights
        pooled = np.add.reduceat(share * gap, rows_at)
        err = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y) * weight / len(y)
        d_gap = (share * err[local]).astype(np.float32)
        d_each = np.add.reduceat((d_gap / seg_size)[seg][by_word], word_at) / count
        back = np.add.reduceat(d_each[gram_word], gram_at)
        d_emb, toward = back[:, None] * diff, emb[used].T @ back
        d_soft, d_bias = np.stack([-toward, toward], axis=1), np.array([-d_gap.sum(), d_gap.sum()])
        seen[used, 0] += (d_emb * d_emb).mean(axis=1)
        seen_soft += d_soft * d_soft
        seen_bias += d_bias * d_bias
        emb[used] -= rate * d_emb / np.sqrt(seen[used])
        soft -= rate * d_soft / np.sqrt(seen_soft)
        bias -= (rate * d_bias / np.sqrt(seen_bias)).astype(np.float32)
        sharp = min(8.0, sharp * 1.1)
    scores = emb @ (soft[:, 1] - soft[:, 0])
    never = np.ones(BUCKETS, bool)
    never[used] = False
    scores[never] = 0
    return np.append(scores, bias[1] - bias[0]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_train: int = 1000, doc_id: str = "doc_id", text: str = "text", segment: int | None = SEGMENT) -> np.ndarray:
    """The model; the bounded sample is learnt in one task."""
    small_batches(docs)
    rows = training_rows(docs, labels, label, learn, max_train, doc_id, text, balanced=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat([pd.DataFrame({"_id": [], "_text": [], "_label": []}), *parts]).sort_values(["_id", "_label"], kind="stable")
        y = both["_label"].to_numpy(dtype=np.int64)
        texts = [t or "" for t in both["_text"]]
        fair = 0 < y.sum() < len(y) and any(map(str.strip, texts))
        model = fit(texts, y, segment) if fair else np.append(np.zeros(BUCKETS), -np.inf).astype(np.float32)
        yield pd.DataFrame({"m": [model.tobytes()]})

    found = rows.repartition(1).mapInPandas(run, "m binary").collect()
    return np.frombuffer(found[0]["m"], np.float32) if found else np.append(np.zeros(BUCKETS), -np.inf).astype(np.float32)


def score_texts(texts: pa.Array, model: np.ndarray, segment: int | None = SEGMENT) -> np.ndarray:
    gap = np.full(len(texts), -np.inf)
    for a, e in T.slices(texts):
        data, offsets = T.buffers(texts[a:e])
        row, start, end = T.spans(data, offsets, T.ALNUM)
        if not len(row):
            continue
        distinct, first, word = np.unique(T.hashes(data, start, end, True), return_index=True, return_inverse=True)
        grams, ends = subwords(data, start[first], end[first], distinct)
        begin = np.concatenate([[0], ends[:-1]])
        each = np.add.reduceat(model[grams], begin) / (ends - begin)
        seg = segments(row, segment)
        seg_at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        mean = np.add.reduceat(each[word], seg_at) / np.diff(np.append(seg_at, len(seg)))
        np.maximum.at(gap, a + row[seg_at], mean)
    gap[np.isneginf(gap)] = 0
    return 1 / (1 + np.exp(-np.clip(gap + float(model[-1]), -30, 30)))


def scored(docs: DataFrame, model: np.ndarray, text: str = "text", name: str = "score", segment: int | None = SEGMENT) -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; a column of that name is replaced."""
    shared = small_batches(docs).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_texts(texts, shared.value, segment))

    return docs.withColumn(name, score(quoted(text)))
