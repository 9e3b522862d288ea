"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's sketch is its n - ceil(t*n) + 1 smallest shingle hashes, n being its number of
distinct shingles and t the threshold. A document holding t*n of the shingles can miss only
n - ceil(t*n) of them, so it holds one of the sketch: the search loses nothing. Sketches
are kept in partitions by item size; a document probes only partitions whose items it is
large enough to contain, with all hashes of its whole text. A candidate's containment is
then computed exactly over all shingles of the item.

A plain MinHash banding cannot do this: the Jaccard similarity of a 30-word item and a
20,000-word document is about 0.001, where banding misses most pairs.

A benchmark of up to ``BLOCK_BYTES`` of text is broadcast and searched in one lazy pass. A
larger one is searched block by block, a pass each: the driver makes one block at a time, its
matches go to the shared folder, and its broadcast is destroyed before the next is made.

Defined results: an item of 1 to k-1 words is one shingle of its own length and matches that word
sequence; items and documents that are null or without words match nothing; repeated rows
match each; ids may be of any type and null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_sql

from . import text as T
from .shared import quoted, saved, small_batches

BLOCK_BYTES = 32 << 20


class Sketches:
    """The items of one block: shingle sets and, by size partition, their sketches."""

    def __init__(self, item_ids: pa.Array, texts: list[str], k: int, threshold: float):
        row, h = T.row_shingles(pa.array(texts, pa.large_string()), k)
        words = np.bincount(T.words(pa.array(texts, pa.large_string()), fold=True)[0], minlength=len(texts))
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        self.ids, self.length = item_ids, np.minimum(words, k)
        self.sets = [h[ends[i] : ends[i + 1]] for i in range(len(texts))]
        self.need = np.array([needed(len(s), threshold) for s in self.sets], np.int64)
        # partition: (shingle length, size class) -> smallest need, sketch hashes and their items
        parts: dict[tuple[int, int], list] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                sketch = s[: len(s) - self.need[i] + 1]  # sets are sorted: the smallest hashes
                parts.setdefault((int(self.length[i]), len(s).bit_length()), []).append((i, sketch))
        self.parts = []
        for (length, _), members in sorted(parts.items()):
            hashes = np.concatenate([s for _, s in members])
            owners = np.repeat([i for i, _ in members], [len(s) for _, s in members])
            order = np.argsort(hashes, kind="stable")
            self.parts.append((length, min(int(self.need[i]) for i, _ in members), hashes[order], owners[order]))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every row that holds enough of an item."""
        row, word = T.words(texts, fold=True)
        for length in sorted({p[0] for p in self.parts}):
            at, h = T.shingles(row, word, length)
            rows = row[at]
            order = np.lexsort((h, rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
            rows, h = rows[new], h[new]
            ends = np.searchsorted(rows, np.arange(len(texts) + 1))
            size = np.diff(ends)
            for p_length, least, hashes, owners in self.parts:
                if p_length != length:
                    continue
                probe = np.flatnonzero(size[rows] >= least) if len(rows) else np.zeros(0, np.int64)
                left, right = np.searchsorted(hashes, h[probe], "left"), np.searchsorted(hashes, h[probe], "right")
                hit = np.flatnonzero(right > left)
                found = {(int(rows[probe[x]]), int(i)) for x in hit for i in owners[left[x] : right[x]]}
                for r, i in sorted(found):
                    shared = int(np.isin(self.sets[i], h[ends[r] : ends[r + 1]], assume_unique=True).sum())
                    if shared >= self.need[i]:
                        yield r, i, shared


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that is threshold*n or more."""
    return -(-n * round(threshold * 10_000) // 10_000)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds an item; see the module."""
    spark = small_batches(docs)
    items = benchmark.select(quoted(item_id).alias("i"), quoted(item_text).alias("t")).where("t is not null")
    rows = docs.select(quoted(doc_id).alias("d"), quoted(text).alias("t"))
    fields = T_sql.StructType([
        T_sql.StructField("doc_id", rows.schema["d"].dataType), T_sql.StructField("item_id", items.schema["i"].dataType),
        T_sql.StructField("n_shared", T_sql.LongType()), T_sql.StructField("n_item", T_sql.LongType()),
    ])
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        block = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)).orderBy("i", "t").toArrow()
        sketches = spark.sparkContext.broadcast(Sketches(block["i"].combine_chunks(), block["t"].to_pylist(), k, threshold))
        del block

        def search(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            s = sketches.value
            for batch in batches:
                for a, e in T.slices(batch["t"]):
                    found = list(s.search(batch["t"][a:e]))
                    item = [i for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        batch["d"][a:e].take(pa.array([r for r, _, _ in found], pa.int64())), s.ids.take(pa.array(item, pa.int64())), pa.array([n for _, _, n in found], pa.int64()),
                        pa.array([len(s.sets[i]) for i in item], pa.int64()),
                    ], ["doc_id", "item_id", "n_shared", "n_item"])

        found = rows.mapInArrow(search, fields)
        if blocks > 1:
            found = saved(found)
            sketches.destroy()
        parts.append(found)
    return reduce(DataFrame.unionByName, parts).withColumn("containment", F.col("n_shared") / F.col("n_item"))
