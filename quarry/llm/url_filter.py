r"""URL filter over a sorted digest array.

Rules and blocked host words are kept in one file of sorted blocks: 64-bit xxhash keys, then the
full strings. A table of rules is sorted and packed by Spark; the driver only passes the blocks
on, one partition at a time. Tasks memory-map the file, hash every (host suffix, path prefix) a url could be
listed under, find the keys by vectorised binary search and confirm each hit against the
stored string, so a hash collision cannot decide a url.

A rule fits its host and all subdomains when the url's path starts with the rule's path;
the longest rule (host plus path, then host) wins, block before allow for the same rule. A url without a fitting rule is blocked
if a dot- or hyphen-separated part of its host is a blocked word, else allowed.

Defined results: a null url or one without ``://`` has empty host and path and is allowed;
repeated rows are judged each; an empty table gives an empty result; rules without host, path or
verdict are left out; other columns are passed through. Rules beyond ``max_index_bytes``, which no
executor should have to hold, are matched by an equi-join instead of the file, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns_of, folded, quoted, side_file, spare_name

PARTITION_BYTES = 8 << 20

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED_WORDS = """
ads adserver adult bets betting bingo camgirl camgirls casino casinos cialis clickbank doubleclick erotic erotica escort escorts fetish gambling
hentai hookup jackpot keygen keygens lotto malware nudes payday phentermine phishing pills poker popunder porn porno roulette sex sexcam sexy slots
spam sportsbook spyware torrent torrents viagra warez xvideos xxx
""".split()


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.coalesce(quoted(url), F.lit(""))
    return df.withColumns({
        "host": folded(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)),
        "path": F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    })


def _key(s: str) -> int:
    """Spark's own xxhash64 of a string, unsigned."""
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42)


def pack(keys: np.ndarray, texts: list[bytes], blocks: np.ndarray) -> bytes:
    """A block of the file: count and size, then keys in order, string ends, verdicts, strings; padded to whole words."""
    body = b"".join([keys.astype(np.int64).tobytes(), np.cumsum([0, *map(len, texts)]).astype(np.uint64).tobytes(), blocks.astype(np.uint8).tobytes(), *texts])
    body += bytes(-len(body) % 8)
    return np.array([len(texts), len(body)], np.uint64).tobytes() + body


def header(lengths: Iterable[int]) -> bytes:
    lengths = sorted(set(lengths))
    return np.array([len(lengths), *lengths], np.uint64).tobytes()


def build_index(rules: list[tuple[str, str, str]], words: list[str]) -> bytes:
    """The file of a list of rules. Host and path are joined by a blank, which no host holds."""
    items = {f"r{h} {p}": v for h, p, v in sorted(rules, key=lambda r: r[2])} | {f"w{w}": "block" for w in words}
    keys = np.array([_key(s) for s in items], np.uint64).view(np.int64)
    order = np.argsort(keys, kind="stable")
    listed, verdicts = list(items), list(items.values())
    return header(len(p) for _, p, _ in rules) + pack(keys[order], [listed[i].encode() for i in order], np.array([verdicts[i] == "block" for i in order], bool))


def packed_rules(rules: DataFrame, words: list[str], size: int) -> Iterator[bytes]:
    """The file of a table of rules, in pieces."""
    yield header(r[0] for r in rules.select(F.length("path")).distinct().collect())
    listed = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block")).select(F.concat(F.lit("r"), "host", F.lit(" "), "path").alias("text"), "block")
    own = rules.sparkSession.createDataFrame([(f"w{w}", True) for w in dict.fromkeys(words)], "text string, block boolean")
    keyed = listed.unionByName(own).select(F.xxhash64("text").alias("key"), "text", "block")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                raw = pack(rows["key"].to_numpy(), [t.encode("utf-8", "surrogatepass") for t in rows["text"].to_pylist()], rows["block"].to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    ranged = keyed.repartitionByRange(max(1, size // PARTITION_BYTES), "key").sortWithinPartitions("key", "text")
    for row in ranged.mapInArrow(blocks, "raw binary").toLocalIterator():
        yield bytes(row["raw"])


class Index:
    """The memory-mapped file and its probes."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        m = int(raw[:8].view(np.uint64)[0])
        at = 8 + 8 * m
        self.lengths = [int(x) for x in raw[8:at].view(np.uint64)]
        self.blocks = []
        while at < len(raw):
            n, size = (int(x) for x in raw[at : at + 16].view(np.uint64))
            body = raw[at + 16 : at + 16 + size]
            self.blocks.append((body[: 8 * n].view(np.int64), body[8 * n : 16 * n + 8].view(np.uint64), body[16 * n + 8 : 17 * n + 8], body[17 * n + 8 :]))
            at += 16 + size
        self.last = np.array([int(keys[-1]) for keys, *_ in self.blocks if len(keys)], np.int64)
        self.blocks = [b for b in self.blocks if len(b[0])]

    def find(self, probes: list[str]) -> list[bool | None]:
        """For each string, whether it stands for block, or None where it is not in the array."""
        out: list[bool | None] = [None] * len(probes)
        if not probes or not self.blocks:
            return out
        wanted = np.fromiter(map(_key, probes), np.uint64, len(probes)).view(np.int64)
        block_of = np.searchsorted(self.last, wanted)
        for b in np.unique(block_of[block_of < len(self.blocks)]):
            mine, keys = np.flatnonzero(block_of == b), self.blocks[b][0]
            at = np.searchsorted(keys, wanted[mine])
            for p, j in zip(mine[keys[at] == wanted[mine]].tolist(), at[keys[at] == wanted[mine]].tolist()):
                out[p] = self._confirmed(probes[p].encode("utf-8", "surrogatepass"), int(wanted[p]), int(b), j)
        return out

    def _confirmed(self, text: bytes, key: int, b: int, j: int) -> bool | None:
        """The verdict of the stored string that equals ``text``, among those of its key; they may go on in the next block."""
        while b < len(self.blocks):
            keys, ends, block, texts = self.blocks[b]
            while j < len(keys) and keys[j] == key:
                if texts[int(ends[j]) : int(ends[j + 1])].tobytes() == text:
                    return bool(block[j])
                j += 1
            if j < len(keys):
                return None
            b, j = b + 1, 0
        return None

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        probes, owner, rank = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for suffix in suffixes(host):
                for n in self.lengths:
                    if n <= len(path):
                        probes.append(f"r{suffix} {path[:n]}")
                        owner.append(i)
                        rank.append((len(suffix) + n, len(suffix)))
            for word in host_words(host):
                probes.append(f"w{word}")
                owner.append(i)
                rank.append((-1, 0))
        best: dict[int, tuple] = {}
        for p, block in enumerate(self.find(probes)):
            if block is not None and (owner[p] not in best or rank[p] > best[owner[p]][0]):
                best[owner[p]] = (rank[p], probes[p], block)
        rules, verdicts = [None] * len(hosts), ["allow"] * len(hosts)
        for i, (r, text, block) in best.items():
            rules[i] = text[1:].replace(" ", "", 1) if r[0] >= 0 else None
            verdicts[i] = "block" if block else "allow"
        return rules, verdicts


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def host_words(host: str) -> set[str]:
    return {w for label in host.split(".") for w in label.split("-") if w}


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, words: list[str] = BLOCKED_WORDS, url: str = "url", max_index_bytes: int = 256 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict; see the module. ``rules``: a list, or a DataFrame (host, path, verdict) of any size.

    Columns of ``pages`` with these four names are replaced.
    """
    spark = pages.sparkSession
    pages = split_url(pages.drop("rule", "verdict"), url)
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
        if size > max_index_bytes:
            return _joined(pages, rules, words)
        name = side_file(spark, packed_rules(rules, words, size), ".urls")
    else:
        name = side_file(spark, build_index(list(rules), list(words)), ".urls")

    @F.pandas_udf(T.StructType().add("rule", "string").add("verdict", "string"))
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for host, path in batches:
            rule, verdict = index.judge(host.tolist(), path.tolist())
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    both = spare_name(pages, "_judged")
    return pages.select("*", judged("host", "path").alias(both)).select(*columns_of(pages), F.col(both)["rule"].alias("rule"), F.col(both)["verdict"].alias("verdict"))


def _joined(pages: DataFrame, rules: DataFrame, words: list[str]) -> DataFrame:
    """The same by equi-join on digest and strings, for rule sets too large to ship to each executor."""
    rules = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")).distinct()
    lengths = [r[0] for r in rules.select(F.length("_p")).distinct().collect()]
    labels = F.split("host", r"\.")
    probes = (
        pages.select("host", "path").distinct()
        .select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_i"), labels.alias("_l"))
        .select("host", "path", F.array_join(F.slice("_l", F.col("_i"), F.size("_l")), ".").alias("_h"))
        .select("host", "path", "_h", F.explode(F.array(*map(F.lit, lengths))).alias("_n"))
        .where(F.col("_n") <= F.length("path"))
        .select("host", "path", "_h", F.expr("left(path, _n)").alias("_p"))
    )
    hits = probes.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict")), F.struct(F.length("_h") + F.length("_p"), F.length("_h"), "_v")).alias("_hit"))
    own = F.when(F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, words))), "block").otherwise("allow")
    hit = spare_name(pages, "_hit")
    found = pages.join(hits.withColumnRenamed("_hit", hit), ["host", "path"], "left")
    return found.select(*columns_of(pages), F.col(hit)["rule"].alias("rule"), F.coalesce(F.col(hit)["verdict"], own).alias("verdict"))
