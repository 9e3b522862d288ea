"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct five-word shingles (64-bit hashes); two documents link
when 100 * |intersection| >= 80 * |union|.

1. Equal sets are one class, found by a 128-bit fingerprint; its smallest doc_id stands for it.
2. Across the chunks of the corpus, every shingle gets a level: 1 if one class alone has it.
   A class with too few shared shingles to reach the threshold with anyone is linked with
   nothing and leaves; in most corpora that is nearly all of them.
3. The rest are partitioned into groups of similar documents: blocks of about ``GROUP``
   classes with one MinHash, linked exactly inside, again for the blocks' roots. Every block
   of one MinHash also gets that MinHash's hub, the class with the most shared shingles, so
   that copies of one original come together across blocks.
4. Groups now are blocks of what is linked so far. The token-group matrix has a row for each
   rare shingle of a group (the prefix that two sets of enough overlap must share). A class
   meets the groups, not yet linked with its own, that share one of its rare shingles. The
   group's token union bounds the overlap; only groups whose bound reaches the threshold
   are opened and compared exactly.
5. Links between groups become components by alternating large and small stars.

A link is only left unemitted when both ends are already known to be connected. No group
is capped: larger ones are split, all pairs of blocks that the matrix names are met. Keys that
hold many rows (a set with many copies, a MinHash, a root, a token) are joined by
:func:`shared.spread_join` or dealt into parts, so that none of them fills a task.

Defined results: null texts and texts without words have the empty set and link with nothing;
fewer than ``k`` words are one shingle; repeated rows are equal sets; rows that share a
doc_id each get the component of their own text; a component of rows without doc_id has none;
ids are integers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import text as T
from .shared import long_id, quoted, saved, small_batches, spread_join, text_bytes

GROUP, PART, ROUNDS = 256, 2048, 3
ROWS = ["doc_id", "th", "n", "leader"]
_U = np.uint64


def prints(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A fingerprint of each set; ``ends``: n + 1 offsets into ``h``."""
    sums = np.zeros((2, len(h) + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(T.mix(h ^ _U(0x3C6EF372FE94F82B)), out=sums[0, 1:])
        np.cumsum(T.mix(h + _U(0xBB67AE8584CAA73B)), out=sums[1, 1:])
        both = np.ascontiguousarray((sums[:, ends[1:]] - sums[:, ends[:-1]]).T)
    return [row.tobytes() for row in both]


def set_sizes(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, n, fp): each row's hash of the text, number of distinct shingles and its set's fingerprint."""

    small_batches(docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in T.slices(batch["t"]):
                row, h = T.row_shingles(batch["t"][a:e], k)
                ends = np.searchsorted(row, np.arange(e - a + 1))
                yield pa.RecordBatch.from_arrays([batch["d"][a:e], batch["th"][a:e], pa.array(np.diff(ends)), pa.array(prints(h, ends), pa.binary())], ["doc_id", "th", "n", "fp"])

    return docs.select(long_id(docs, doc_id).alias("d"), C.text_key(text).alias("th"), quoted(text).alias("t")).mapInArrow(measure, "doc_id long, th long, n long, fp binary")


class Chunk:
    """The sets of the classes that a chunk's documents stand for."""

    def __init__(self, rows: pa.Table, stands: pa.Table, k: int):
        rows = C.in_order(rows)
        wanted = {(d, f) for d, f in zip(stands["doc_id"].to_pylist(), stands["fp"].to_pylist())}
        ids = rows["doc_id"].to_pylist()
        self.fp, self.doc_id, self.sets = [], [], []
        for a, e in T.slices(rows["text"]):
            row, h = T.row_shingles(rows["text"][a:e], k)
            ends = np.searchsorted(row, np.arange(e - a + 1))
            for r, fp in enumerate(prints(h, ends)):
                if (key := (ids[a + r], fp)) in wanted:
                    wanted.discard(key)
                    self.fp.append(fp)
                    self.doc_id.append(ids[a + r])
                    self.sets.append(h[ends[r] : ends[r + 1]])
        every = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        self.hash, self.of, n = np.unique(every, return_inverse=True, return_counts=True)
        self.again = n > 1

    def candidates(self, levels: np.ndarray, threshold: int) -> pa.Table:
        """Classes with enough shared shingles: those, rarest first, and how many of the rarest any link must share one of."""
        out: dict[str, list] = {k: [] for k in ("fp", "n", "prefix", "minhash", "tokens", "hub")}
        shared = (levels > 1) | self.again
        at = 0
        for fp, s in zip(self.fp, self.sets):
            of = self.of[at : at + len(s)]
            at += len(s)
            keep = shared[of]
            need = -(-len(s) * threshold // 100)
            m = int(keep.sum())
            if m >= need:
                tokens, rank = s[keep], levels[of][keep]
                tokens = tokens[np.lexsort((tokens, rank))]
                for name, v in zip(out, (fp, len(s), m - need + 1, minhashes(tokens), tokens.tobytes(), m / len(s) + rank.mean() / 1000)):
                    out[name].append(v)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.float64()))})


def minhashes(tokens: np.ndarray) -> list[int]:
    return [int(T.mix(tokens ^ T._MUL[r]).min().astype(np.int64)) for r in range(ROUNDS)]


class Sets:
    """A table's (id, n, tokens) rows, for overlaps of one set with all."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")]))
        self.id, self.n = rows["id"].to_numpy(), rows["n"].to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
        self.begin = np.cumsum([0, *map(len, parts)])
        self.union, self.of = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)

    def own(self, i: int) -> np.ndarray:
        return self.of[self.begin[i] : self.begin[i + 1]]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the union of those tokens that are in it."""
        if not len(self.union):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        return at[self.union[at] == tokens]

    def linked(self, places: np.ndarray, n: int, threshold: int) -> np.ndarray:
        """Which sets link with a set of n shingles that has these places of the union."""
        mark = np.zeros(len(self.union), np.int64)
        mark[places] = 1
        shared = np.add.reduceat(mark[self.of], self.begin[:-1])
        return np.flatnonzero(100 * shared >= threshold * (self.n + n - shared))


def link_block(rows: pa.Table, threshold: int) -> pa.Table:
    """(id, root): for each set the hub, if it is reachable inside the block, else the smallest id that is."""
    s = Sets(rows)
    hub = rows["hub"][0].as_py()
    root = np.arange(len(s.id))
    for i in range(len(s.id)):
        if (root == root[0]).all():
            break
        near = s.linked(s.own(i), int(s.n[i]), threshold)
        old = np.unique(root[near])
        if len(old) > 1:
            root[np.isin(root, old)] = old[0]
    named = s.id[root]
    named[root == root[np.searchsorted(s.id, hub)]] = hub
    return pa.table({"id": s.id, "root": named})


def open_group(queries: pa.Table, members: pa.Table, threshold: int) -> pa.Table:
    """(a, b): the roots of query sets that link with one of the group's, and the group's root."""
    linked: set[int] = set()
    if queries.num_rows and members.num_rows:
        s = Sets(members)
        for own, n, raw in zip(queries["own"].to_pylist(), queries["n"].to_pylist(), queries["tokens"].to_pylist()):
            if own in linked:
                continue
            places = s.find(np.frombuffer(raw, np.uint64))
            # the bound: no member shares more than the union does
            if 100 * len(places) >= threshold * n and len(s.linked(places, n, threshold)):
                linked.add(own)
    roots = queries["root"].slice(0, 1).to_pylist() * len(linked)
    return pa.table({"a": pa.array(sorted(linked), pa.int64()), "b": pa.array(roots, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id in ``edges`` (a, b)."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, count = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        edges = spread_join(both.where("v > u"), least, ["u"], 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # large star
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = spread_join(edges, least, ["u"], 2 * count)
        edges = saved(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())  # small star
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen, count = now, now[0]


def fresh(df: DataFrame) -> DataFrame:
    """df under new column ids, so that it can meet what it was made from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def relabelled(labels: DataFrame, step: DataFrame, total: int) -> DataFrame:
    """``labels`` (id, root) with each root replaced by its own root in ``step``, where it has one."""
    step = step.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("_to"))
    roots = labels.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).join(step, "root", "left")
    return spread_join(labels, roots, ["root"], total).select("id", F.coalesce("_to", "root").alias("root"))


def similar_classes(docs: DataFrame, measured: DataFrame, classes: DataFrame, total: int, k: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """(id, fp, n, prefix, minhash, tokens, hub) of the classes that may link with another, of classes (fp, doc_id, th)."""
    _, size = text_bytes(docs, text)
    rows, count, buckets = C.chunked(docs, total, size, doc_id, text, measured.select("doc_id", "th"))
    by_chunk = rows.select("chunk", "doc_id", "th", "text").groupBy("chunk")
    stands = classes.select(C.chunk_of(count).alias("chunk"), "doc_id", "fp", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("pack"))

    def send(chunk: pa.Table, stand: pa.Table) -> pa.Table:
        if not chunk.num_rows or not stand.num_rows:
            return C.packs(0, np.zeros(0, np.uint64), buckets)
        return C.packs(chunk["chunk"][0].as_py(), Chunk(chunk, stand, k).hash, buckets)

    levels = C.chunk_counts(by_chunk.cogroup(stands.groupBy("chunk")).applyInArrow(send, C.PACKS))
    answers = stands.unionByName(levels.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("fp"), "bucket", "pack"))

    def keep(chunk: pa.Table, rest: pa.Table) -> pa.Table:
        packed = pc.is_valid(rest["bucket"])
        c = Chunk(chunk, rest.filter(pc.invert(packed)), k)
        return c.candidates(C.unpacked(rest.filter(packed), c.hash, buckets), threshold)

    kept = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(keep, "fp binary, n long, prefix long, minhash array<long>, tokens binary, hub double")
    return saved(kept.withColumn("id", F.monotonically_increasing_id()))


def part_of(column: str, size: int):
    """Which part of ``size`` rows or so a row of ``_n`` rows falls into."""
    return F.pmod(F.xxhash64(column), F.ceil(F.col("_n") / size)).cast("int")


def class_components(sets: DataFrame, threshold: int) -> DataFrame:
    """(id, root) for the classes of :func:`similar_classes`."""
    total = sets.count()
    counted = F.count(F.lit(1)).alias("_n")
    moved, roots = [], sets
    for r in range(ROUNDS):
        named = roots.select("id", F.element_at("minhash", r + 1).alias("m"), F.col("hub").alias("_fit"))
        same = named.groupBy("m").agg(counted, F.max_by("id", F.struct("_fit", "id")).alias("hub")).where("_n > 1")
        named = spread_join(named, same, ["m"], total).select("m", part_of("id", GROUP).alias("block"), "id", "hub")
        named = named.unionByName(named.select("m", "block", F.col("hub").alias("id"), "hub").distinct()).distinct()
        found = fresh(roots.select("id", "n", "tokens").join(named, "id")).groupBy("m", "block").applyInArrow(lambda rows: link_block(rows, threshold), "id long, root long")
        moved.append(saved(found.where("id <> root").distinct()))
        roots = roots.join(moved[-1].select("id"), "id", "left_anti")
    last = moved.pop()
    while moved:  # where a round's roots went in later rounds
        step = moved.pop()
        last = saved(last.unionByName(relabelled(step, last, total)))
    labels = saved(sets.select("id").join(last, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    sizes = labels.groupBy("root").agg(counted)
    groups = saved(spread_join(labels, sizes, ["root"], total).select("id", "root", part_of("id", GROUP).alias("block")))

    def rare(tokens: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return np.frombuffer(tokens, np.int64)[: int(prefix)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["tokens"].to_pylist()
            parts = [rare(t, p) for t, p in zip(raw, batch["prefix"].to_pylist())]
            rest = [len(t) // 8 - np.arange(len(x)) for t, x in zip(raw, parts)]
            of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts + none)), pa.array(np.concatenate(rest + none)), *(batch[c].take(pa.array(of)) for c in ("id", "n", "root", "block"))], ["token", "rest", "id", "n", "root", "block"])

    named = sets.select("id", "n", "prefix", "tokens").join(groups, "id")
    tokens = saved(named.mapInArrow(explode, "token long, rest long, id long, n long, root long, block int"))
    several = tokens.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), counted)
    shared = spread_join(tokens, several, ["token"], tokens.count()).where("_a < _b").withColumn("part", part_of("id", PART))
    matrix = shared.groupBy("token", "root", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.first("_n").alias("_n"))
    matrix = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / PART) - 1).cast("int")))).drop("_n")
    # The larger root queries the smaller, so each pair of groups meets once. A link needs sizes within the threshold and an
    # overlap of threshold / (100 + threshold) of both sizes; at the first token two sets have in common, it must fit into
    # what either has from there on in the common order.
    q = shared.select("token", "part", "id", "n", F.col("rest").alias("own_rest"), F.col("root").alias("own"))
    fits = (F.col("own") > F.col("root")) & (100 * F.col("n") >= threshold * F.col("least")) & (threshold * F.col("n") <= 100 * F.col("most"))
    fits &= (100 + threshold) * F.least("own_rest", "rest") >= threshold * (F.col("n") + F.col("least"))
    meets = saved(q.join(matrix, ["token", "part"]).where(fits).select("id", "own", "root", "block").distinct())
    if not (n_meets := meets.count()):
        return labels
    opened = meets.groupBy("root", "block").agg(counted)
    asked = spread_join(meets, opened, ["root", "block"], n_meets).withColumn("part", part_of("id", GROUP))
    queries = fresh(asked.select("id", "own", "root", "block", "part").join(sets.select("id", "n", "tokens"), "id"))
    opened = opened.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / GROUP) - 1).cast("int")))).drop("_n")
    members = fresh(sets.select("id", "n", "tokens").join(groups, "id").join(opened, ["root", "block"]))
    key = ["root", "block", "part"]
    links = queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(lambda q, m: open_group(q, m, threshold), "a long, b long")
    return relabelled(labels, components(links), total)


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, leader) of every document; see the module. ``leader``: (none, doc_id, th) of the first row of
    the component, ordered by doc_id (those without one last), then ``th``, the hash of the text."""
    measured = saved(set_sizes(docs, k, doc_id, text))
    total = measured.count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = measured.where("n > 0").groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("_n"))
    classes = saved(classes.select("fp", "first", "first.doc_id", "first.th", "_n"))
    sets = similar_classes(docs, measured, classes, total, k, threshold, doc_id, text)
    labels = class_components(sets.select("id", "n", "prefix", "minhash", "tokens", "hub"), threshold)
    named = sets.select("id", "fp").join(labels, "id").join(classes.select("fp", "first"), "fp")
    roots = named.groupBy("root").agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("_n"))
    leaders = spread_join(named.select("fp", "root"), roots, ["root"], total).select("fp", "leader")
    leaders = classes.join(leaders, "fp", "left").select("fp", F.coalesce("leader", "first").alias("leader"), "_n")
    alone = measured.where("n = 0").withColumn("leader", first)
    linked = spread_join(measured.where("n > 0"), leaders, ["fp"], total)
    return linked.select(*ROWS).unionByName(alone.select(*ROWS)).withColumnRenamed("n", "n_shingles")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see the module. ``threshold``: in hundredths."""
    return jaccard_classes(docs, k, threshold, doc_id, text).select("doc_id", "n_shingles", F.col("leader.doc_id").alias("component_id"))
