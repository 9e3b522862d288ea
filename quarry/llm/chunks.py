"""Corpus-wide facts about hashes, found chunk by chunk.

Documents are dealt by id and text into chunks of bounded text. A chunk sends each of its distinct
hashes once, packed by hash bucket; a bucket's task sees every chunk's pack and sends back
one small number per hash, in the order received. Nothing per hash is shuffled as a row, a
hash that fills a third of the corpus is sent once per chunk, and the chunk, which
recomputes its hashes in the same order, reads the answers off. Chunks of text are
exchanged once and the exchange is reused by later steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_id, quoted, saved

CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
_U = np.uint64


#: literal repeats (same id, same text) beyond this many, or a millionth of all rows, are kept once with their number
REPEATS, REPEATED_KEYS = 64, 1_000_000


def text_key(text: str):
    """A 64-bit hash of a text, which with the id tells rows apart."""
    return F.xxhash64(quoted(text))


def often_repeated(keys: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, th, copies) of rows repeated too often for one chunk, from (doc_id, th) of all rows; a million at most, as their copies add up to all rows at most."""
    limit = max(REPEATS, n_rows // REPEATED_KEYS)
    return saved(keys.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > limit))


def chunked(docs: DataFrame, n_rows: int, total_bytes: int, doc_id: str = "doc_id", text: str = "text", keys: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, th, text, copies), and how many chunks and hash buckets suit that much text.

    ``th`` is :func:`text_key`; ``keys``: (doc_id, th) of all rows, if known already.
    """
    chunks = max(1, -(-total_bytes // CHUNK_BYTES))
    rows = docs.select(long_id(docs, doc_id).alias("doc_id"), text_key(text).alias("th"), quoted(text).alias("text"), F.lit(1).cast("long").alias("copies"))
    repeated = often_repeated(rows.select("doc_id", "th") if keys is None else keys, n_rows)
    if not repeated.isEmpty():
        listed = F.broadcast(repeated.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h")))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))
        once = rows.join(listed, same, "left_semi").groupBy("doc_id", "th").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        rows = rows.join(listed, same, "left_anti").unionByName(once)
    return rows.select(chunk_of(chunks).alias("chunk"), "*"), chunks, max(1, -(-total_bytes // BUCKET_BYTES))


def chunk_of(chunks: int):
    """Rows of one id, or of none, are dealt by their texts."""
    return F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)).cast("int")


def in_order(chunk: pa.Table) -> pa.Table:
    """A chunk's rows by doc_id (null last), then hash of the text: the same order whenever it is made."""
    return chunk.take(pc.sort_indices(chunk, [("doc_id", "ascending"), ("th", "ascending")])).combine_chunks()


def pack(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): the order that groups distinct hashes by bucket, and each bucket's end."""
    bucket = ((values >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets), "right")


def packs(chunk: int, values: np.ndarray, buckets: int) -> pa.Table:
    """(bucket, chunk, pack): the low halves of distinct hashes, which with the bucket tell 32 + log2(buckets) bits."""
    order, ends = pack(values, buckets)
    low = (values[order] & _U(0xFFFFFFFF)).astype(np.uint32)
    begin = np.concatenate([[0], ends[:-1]])
    used = np.flatnonzero(ends > begin)
    return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk), pa.int32()), "pack": pa.array([low[begin[b] : ends[b]].tobytes() for b in used], pa.binary())})


PACKS = "bucket int, chunk int, pack binary"


def chunk_counts(packed: DataFrame) -> DataFrame:
    """(bucket, chunk, pack): for each hash, how many chunks hold it, as a level from 1; 1 only for one chunk, growing with the logarithm."""

    def count(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in rows["pack"].to_pylist()]
        _, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        level = np.minimum(255, 1 + np.ceil(6 * np.log2(n))).astype(np.uint8)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "pack": pa.array([level[e - len(p) : e].tobytes() for p, e in zip(parts, ends)], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(count, PACKS)


def unpacked(answers: pa.Table, values: np.ndarray, buckets: int, kind: type = np.uint8) -> np.ndarray:
    """The answers to a chunk's distinct hashes, in the order of ``values``."""
    order, _ = pack(values, buckets)
    out = np.zeros(len(values), kind)
    if len(values):
        by_bucket = answers.take(pc.sort_indices(answers, [("bucket", "ascending")]))
        out[order] = np.frombuffer(b"".join(by_bucket["pack"].to_pylist()), kind)
    return out
