"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded bytes; each (query block, candidate
stripe) pair is one task's group. There, int8 codes of the unit vectors are multiplied tile by
tile; their products are whole numbers that float arithmetic holds exactly. A code is off by
half a step at most, which bounds the error of every product, so a candidate whose upper bound
is below the query's k-th best so far cannot be among the k nearest. The rest are recomputed in
double precision from the original vectors and merged into the query's k best; a last merge
over stripes keeps k of each query before and after its shuffle. The result is exact,
whatever the data.

Of candidates that are the same vector only the few that can still rank are compared, so a
vector that fills a third of all rows is met once a stripe. Original vectors travel with the
rows, once for each block of queries: bounds alone cannot tell near copies apart, and a
cluster of them would leave the tiles as all its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; a query meets only vectors of its own length; ties go to the smaller id; rows sharing
the query's id are its own; a query row that is repeated gives one list, and query rows of one id
with different vectors a list each; a candidate row that is repeated counts as often; ids are
integers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import long_id, quoted

#: bytes of original vectors in a query block and a candidate stripe, rows of a tile
QUERY_BYTES, STRIPE_BYTES, QUERY_TILE, TILE = 32 << 20, 8 << 20, 2048, 1024
EXACT_FLOAT32 = (1 << 24) // (127 * 127)
#: what float arithmetic on bounds may lose
SLACK = 2e-6
_ODD = np.random.default_rng(41).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    column = vectors.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, sum of absolute codes) of each unit vector."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    return q, step, np.abs(q.astype(np.int32)).sum(axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, summed in order of the components."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        na += a[:, d] * a[:, d]
        nb += b[:, d] * b[:, d]
    return dot / (np.sqrt(na) * np.sqrt(nb))


def contenders(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that can rank: of equal vectors, k rows of each of the k + 1 smallest ids."""
    with np.errstate(over="ignore"):
        h = (vectors.view(np.uint64) * _ODD[: vectors.shape[1]]).sum(axis=1) if vectors.shape[1] <= len(_ODD) else None
    if h is not None:
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
    if h is None or not (vectors == vectors[first[same]]).all():
        same = np.unique(vectors, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, same))
    g, i = same[order], ids[order]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_i = new_g | np.concatenate([[True], i[1:] != i[:-1]])
    nth_id = np.cumsum(new_i)
    nth_id -= np.repeat(nth_id[new_g], np.diff(np.append(np.flatnonzero(new_g), len(g))))
    at = np.arange(len(g))
    copy = at - np.repeat(at[new_i], np.diff(np.append(np.flatnonzero(new_i), len(g))))
    return np.sort(order[(nth_id <= k) & (copy < k)])


def best_k(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query place ``i``, in order."""
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], ids[keep], score[keep]


def block_nearest(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate id, score): the k nearest of each query row within one block pair."""
    some = contenders(c_id, c, k)
    c_id, c = c_id[some], c[some]
    dim = q.shape[1]
    kind = np.float32 if dim <= EXACT_FLOAT32 else np.float64  # products of codes stay exact integers
    (qc, qs, qa), (cc, cs, ca) = codes(q), codes(c)
    parts = [tuple(np.zeros(0, t) for t in (np.int64, c_id.dtype, np.float64))]
    for a in range(0, len(q), QUERY_TILE):
        z = min(a + QUERY_TILE, len(q))
        x, half = qc[a:z].astype(kind), (0.5 * qa[a:z] + 0.25 * dim).astype(kind)
        floor = np.full(z - a, -np.inf)  # each query's k-th best so far, or a lower bound of it
        best = parts[0]
        for t in range(0, len(c), TILE):
            e = min(t + TILE, len(c))
            product = x @ cc[t:e].astype(kind).T
            width = half[:, None] + (0.5 * ca[t:e]).astype(kind)
            scale = qs[a:z, None].astype(kind) * cs[t:e].astype(kind)
            high = (product + width) * scale + SLACK
            high[q_id[a:z, None] == c_id[t:e]] = -np.inf
            open_rows = np.flatnonzero((high >= floor[:, None]).any(axis=1))
            if not len(open_rows):
                continue
            high = high[open_rows]
            if e - t >= k:
                low = high - 2 * (width[open_rows] * scale[open_rows] + SLACK)
                floor[open_rows] = np.maximum(floor[open_rows], -np.partition(-low, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((high >= floor[open_rows, None]) & (high > -np.inf))
            i, j = open_rows[i], j + t
            score = np.empty(len(i))
            for s in range(0, len(i), 1 << 15):
                score[s : s + (1 << 15)] = cosines(q[a + i[s : s + (1 << 15)]], c[j[s : s + (1 << 15)]])
            best = best_k(np.concatenate([best[0], i]), np.concatenate([best[1], c_id[j]]), np.concatenate([best[2], score]), k)
            found, first, n = np.unique(best[0], return_index=True, return_counts=True)
            full = n == k
            floor[found[full]] = np.maximum(floor[found[full]], best[2][first[full] + k - 1] - 1e-12)
        parts.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows by cosine; see the module."""
    rows = vectors.select(long_id(vectors, vec_id).alias("vec_id"), quoted(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", "v", "q", F.size("v").alias("dim"))
    n, nq, dim = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.coalesce(F.max("dim"), F.lit(1))).first()
    fit = lambda size: max(1, size // (8 * dim))  # noqa: E731  rows of that many bytes
    spread = min(n // TILE, vectors.sparkSession.sparkContext.defaultParallelism)  # small tables: a stripe for each core
    stripes, blocks = max(1, -(-n // fit(STRIPE_BYTES)), spread), max(1, -(-nq // fit(QUERY_BYTES)))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.where("q").select("dim", "vec_id", "v").distinct().withColumn("row", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    queries = asked.select("dim", deal(blocks).alias("block"), every(stripes).alias("stripe"), "vec_id", "row", "v")
    candidates = rows.select("dim", every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(stripes)).cast("int").alias("stripe"), "vec_id", "v")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            at, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            at, ids, score = block_nearest(left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"]), k)
        return pa.table({"query_id": left["vec_id"].take(pa.array(at)), "row": left["row"].take(pa.array(at)), "vec_id": ids, "score": score})

    key = ["dim", "block", "stripe"]
    best = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(tile, "query_id long, row int, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
