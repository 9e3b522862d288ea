"""Cluster helpers: side files, batch sizes, text sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import saved, shared_dir, table

BATCH_BYTES = str(8 << 20)
#: rows that a task may well get of one key; the share of all rows beyond which a key is hot; rows that need no care at all
HOT_ROWS, HOT_SHARE, FEW_ROWS = 256, 1000, 10_000
__all__ = ["columns_of", "folded", "long_id", "quoted", "saved", "shared_dir", "side_file", "small_batches", "spare_name", "spread_join", "table", "text_bytes"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def side_file(spark: SparkSession, content: bytes | Iterable[bytes], suffix: str) -> str:
    """Puts a bounded file into the shared folder and has Spark hand it to every executor; returns its name for SparkFiles.get.

    ``content``: whole, or in pieces that are written one after the other and never held together.
    """
    whole = isinstance(content, bytes)
    name = f"{hashlib.sha256(content).hexdigest()[:24] if whole else uuid4().hex}{suffix}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/side/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = path.suffix(f".{uuid4().hex}")  # a file appears under its name only once it is whole
        out = fs.create(part, True)
        for piece in [content] if whole else content:
            for i in range(0, len(piece), 1 << 20):
                out.write(bytearray(piece[i : i + (1 << 20)]))
        out.close()
        fs.rename(part, path)
    uri = fs.makeQualified(path).toString()
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(uri)
    return name


def small_batches(df: DataFrame) -> SparkSession:
    """The session of ``df``, set to hand texts to Python in batches of a few megabytes, which bounds the memory of executors whatever the texts' lengths."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def folded(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text): one aggregate, used to size partitions."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def columns_of(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def long_id(df: DataFrame, name: str) -> Column:
    """An integer id column as long; others are refused before anything runs."""
    kind = dict(df.dtypes).get(name)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name}: ids are integers here, not {kind}")
    return quoted(name).cast("long")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, n: str = "_n") -> DataFrame:
    """``rows`` joined with ``facts``, which has every key once with its number of rows ``n``; ``total``: of all rows.

    Keys of more than a thousandth of all rows are fewer than a thousand, so they are joined by
    broadcast and their rows stay where they are; the rest are joined by key.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if total <= max(limit, FEW_ROWS):
        return rows.join(facts, keys)
    hot = facts.where(F.col(n) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
