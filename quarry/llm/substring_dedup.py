r"""Substring dedup by difference-cover anchors.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Every word covered by a window of 20 words that
also starts earlier (smaller doc_id, or same document, earlier start) is removed.

Positions whose remainder modulo ``PERIOD`` is in ``COVER`` carry an anchor: the hash of
the next 20 - PERIOD + 1 words. COVER is a perfect difference set, so for any two positions
some shift below PERIOD brings both to cover positions: two equal windows share an aligned
anchor. Anchors are 4 of 13 positions; those that occur once in the corpus rule out every
window around them. What is left extends to whole windows, whose 80-bit hashes are
compared across chunks to find the first start of each.

Defined results: a null text has no words; texts shorter than a window keep all; rows that
share a doc_id count as documents in order of a hash of their texts; a null doc_id sorts last;
ids are integers; an empty table gives an empty result; other columns are not read. Rows of
equal id and text beyond a few are worked on once, as all but the first lose every word
that a window covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import text as T
from .shared import small_batches, text_bytes

# a perfect difference set: every remainder modulo 13 is a difference of two members
PERIOD, COVER = 13, (0, 1, 3, 9)
_U = np.uint64


class Chunk:
    """The words of a chunk's documents, in order, and the two hash families."""

    def __init__(self, rows: pa.Table, window: int):
        self.rows = C.in_order(rows)
        self.window, self.length = window, window - PERIOD + 1
        texts = self.rows["text"]
        row, word = [], []
        for a, e in T.slices(texts):
            r, w = T.words(texts[a:e])
            row.append(r + a)
            word.append(w)
        self.row = np.concatenate([*row, np.zeros(0, np.int64)])
        self.word = np.concatenate([*word, np.zeros(0, np.uint64)])
        self.count = np.bincount(self.row, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def anchors(self) -> None:
        """Sets anchor places, their distinct hashes and which of those the chunk repeats."""
        at, h = T.shingles(self.row, self.word, self.length)
        covered = np.isin((at - self.first[self.row[at]]) % PERIOD, COVER)
        self.anchor_at = at[covered]
        self.anchor, self.anchor_of, n = np.unique(h[covered], return_inverse=True, return_counts=True)
        self.anchor_again = n > 1

    def windows(self, levels: np.ndarray) -> None:
        """Sets the windows around repeated anchors, their distinct hashes and first starts."""
        again = (self.anchor_again | (levels > 1))[self.anchor_of]
        edge = np.zeros(len(self.word) + 1, np.int32)
        at = self.anchor_at[again]
        np.add.at(edge, np.maximum(at - PERIOD + 1, self.first[self.row[at]] if len(at) else at), 1)
        np.add.at(edge, at + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        at, h = T.shingles(self.row, self.word, self.window)
        h = h[near[at]]
        self.window_at = at[near[at]]
        self.hash, first, self.window_of = np.unique(h, return_index=True, return_inverse=True)
        self.hash_first = first  # window_at ascends, so this is the earliest start in the chunk
        begin = self.window_at[first]
        with np.errstate(over="ignore"):
            more = np.zeros(len(first), np.uint64)  # further bits, from other words of the window
            for j in range(0, self.window, 3):
                more = (more + self.word[begin + j]) * _U(0xD6E8FEB86659FD93)
            for j in range(1, self.window, 3):
                more = (more ^ self.word[begin + j]) * _U(0x9FB21C651E98DF25)
            self.extra = (T.mix(more) >> _U(48)).astype(np.uint16)
        self.hash_row = self.row[begin]

    def kept(self, later: np.ndarray) -> pa.Table:
        """Each document with the words left; ``later``: whether an earlier document has the hash."""
        again = later[self.window_of].astype(bool)
        again |= np.arange(len(self.window_of)) != self.hash_first[self.window_of]
        edge = np.zeros(len(self.word) + self.window + 1, np.int32)
        np.add.at(edge, self.window_at[again], 1)
        np.add.at(edge, self.window_at[again] + self.window, -1)
        gone = np.cumsum(edge)[: len(self.word)] > 0
        removed = np.bincount(self.row, gone, len(self.rows)).astype(np.int64)
        texts, parts = self.rows["text"], []
        for a, e in T.slices(texts):
            data, offsets = T.buffers(texts[a:e])
            row, start, end = T.spans(data, offsets, T.SPACED)
            lo = int(self.first[a]) if len(self.first) else 0
            keep = ~gone[lo : lo + len(row)]
            row, start, size = row[keep], start[keep], (end - start)[keep]
            step = size + 1
            begin = np.cumsum(step) - step
            out = np.full(int(step.sum()), 32, np.uint8)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(begin, size) + inner] = data[np.repeat(start, size) + inner]
            # a document's text ends before the blank after its last word
            at = np.searchsorted(row, np.arange(e - a + 1))
            edges = np.append(begin, len(out))
            raw = out.tobytes()
            parts += [raw[edges[x] : max(edges[x], edges[y] - 1)].decode("utf-8", "surrogatepass") for x, y in zip(at[:-1], at[1:])]
        return pa.table({"doc_id": self.rows["doc_id"], "copies": self.rows["copies"], "n_words": pa.array(self.count), "n_removed": pa.array(removed), "kept": pa.array(parts, pa.string())})


def _first_starts(sent: DataFrame) -> DataFrame:
    """(bucket, chunk, pack): for each hash of each chunk, whether another chunk has it in an earlier document."""

    def compare(rows: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
        h, extra = read("pack", np.uint64), read("extra", np.uint16)
        docs, texts, runs = (np.concatenate(read(*x)) for x in (("docs", np.int64), ("texts", np.int64), ("runs", np.int32)))
        place = np.empty(len(docs), np.int32)  # of each document among all that are named here
        place[np.lexsort((texts, docs))] = np.arange(len(docs), dtype=np.int32)
        all_h, all_x, all_d = np.concatenate(h), np.concatenate(extra), np.repeat(place, runs)
        order = np.lexsort((all_d, all_x, all_h))
        s_h, s_x = all_h[order], all_x[order]
        later = np.zeros(len(order), np.uint8)
        later[order[1:]] = (s_h[1:] == s_h[:-1]) & (s_x[1:] == s_x[:-1])
        ends = np.cumsum([len(x) for x in h])
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "pack": pa.array([later[e - len(x) : e].tobytes() for x, e in zip(h, ends)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(compare, C.PACKS)


def substring_dedup(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; see the module. ``window``: PERIOD + 1 words or more."""
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    small_batches(docs)
    rows, _, buckets = C.chunked(docs, *text_bytes(docs, text), doc_id, text)
    by_chunk = rows.groupBy("chunk")

    def send_anchors(chunk: pa.Table) -> pa.Table:
        c = Chunk(chunk, window)
        c.anchors()
        return C.packs(chunk["chunk"][0].as_py(), c.anchor, buckets)

    levels = C.chunk_counts(by_chunk.applyInArrow(send_anchors, C.PACKS)).select("chunk", "bucket", "pack", F.lit(1).alias("step"))

    def with_windows(chunk: pa.Table, answers: pa.Table) -> Chunk:
        c = Chunk(chunk, window)
        c.anchors()
        c.windows(C.unpacked(answers.filter(pa.compute.equal(answers["step"], 1)), c.anchor, buckets))
        return c

    def send_windows(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "pack", "extra", "docs", "texts", "runs")}
        if chunk.num_rows:
            c = with_windows(chunk, answers)
            by_doc, ends = _window_order(c, buckets)
            begin = np.concatenate([[0], ends[:-1]])
            docs, texts = c.rows["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), c.rows["th"].to_numpy()
            for b in np.flatnonzero(ends > begin):
                part = by_doc[begin[b] : ends[b]]
                d = c.hash_row[part]
                cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                values = int(b), chunk["chunk"][0].as_py(), c.hash[part].tobytes(), c.extra[part].tobytes(), docs[d[cut]].tobytes(), texts[d[cut]].tobytes(), np.diff(np.append(cut, len(d))).astype(np.int32).tobytes()
                for k, v in zip(out, values):
                    out[k].append(v)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    sent = by_chunk.cogroup(levels.groupBy("chunk")).applyInArrow(send_windows, "bucket int, chunk int, pack binary, extra binary, docs binary, texts binary, runs binary")
    later = _first_starts(sent).select("chunk", "bucket", "pack", F.lit(2).alias("step"))

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = with_windows(chunk, answers)
        mine = answers.filter(pa.compute.equal(answers["step"], 2))
        flags = np.zeros(len(c.hash), np.uint8)
        if len(c.hash):
            mine = mine.take(pa.compute.sort_indices(mine, [("bucket", "ascending")]))
            flags[_window_order(c, buckets)[0]] = np.frombuffer(b"".join(mine["pack"].to_pylist()), np.uint8)
        return c.kept(flags)

    done = by_chunk.cogroup(levels.unionByName(later).groupBy("chunk")).applyInArrow(finish, "doc_id long, copies long, n_words long, n_removed long, kept string")
    again = (F.col("_copy") > 1) & (F.col("n_words") >= window)  # every window of a later copy starts earlier too
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(again, "").otherwise(F.col("kept")).alias("kept"))


def _window_order(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): distinct window hashes by bucket, then document, so that a pack names each document once."""
    bucket = ((c.hash >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((c.hash_first, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets), "right")
