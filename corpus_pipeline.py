"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, source mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Labels and benchmark are read from ``sf_dir``.

Defined results: a row is told from others by its doc_id and text, so rows that share an id are
judged one by one and rows without id like any other. Null and empty texts are scored like any
text by the first stage, link with nothing, hold no item and no secret, and have size 0. Where
no quality label can be learnt from, every document stays. Other columns are passed through
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.decontaminate import contamination
from quarry.llm.jaccard_join import jaccard_classes
from quarry.llm.mixing import mix_sources
from quarry.llm.queries import PREDICT_AT
from quarry.llm.secret_scan import secret_scan
from quarry.llm.shared import columns_of, saved, shared_dir, table

#: SQL cannot express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None
SECRET = "[SECRET]"
MAX_BROADCAST_ROWS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; trained on labelled documents of the input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return docs.where(quality.score_of(docs, model) >= PREDICT_AT) if model.any() else docs


def _among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is, or is not, in ``keys`` (_d, _h); few keys spare moving the texts."""
    if keys.count() <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_d"]) & (F.xxhash64(docs["text"]) == keys["_h"]), how)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, literal repeats included, one document: with the smallest doc_id, then the smallest hash of its text. Rows without words link with nothing and stay."""
    rows = jaccard_classes(docs).where("n_shingles > 0")
    first = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("th") == F.col("leader.th"))
    counted = saved(rows.groupBy("doc_id", "th").agg(F.bool_or(first).alias("_first"), F.count(F.lit(1)).alias("_n")).where("not _first or _n > 1"))
    key = [F.col("doc_id").alias("_d"), F.col("th").alias("_h")]
    kept = _among(docs, counted.where("not _first").select(*key), "left_anti")
    again = counted.where("_first").select(*key)
    if again.isEmpty():
        return kept
    # of a row that is repeated as it is, one stays: the columns of one row, taken together
    names = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns_of(docs))))
    one = _among(kept, again, "left_semi").groupBy(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h")).agg(F.first(row).alias("_row"))
    return _among(kept, again, "left_anti").unionByName(one.select(*names))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    row = docs.select(F.struct(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h")).alias("row"), "text")
    found = contamination(row, table(spark, sf_dir, "benchmark"), doc_id="row")
    return _among(docs, saved(found.select("doc_id._d", "doc_id._h").distinct()), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text where it changes. Columns of ``docs`` named as one the scan adds come back as they were."""
    plain = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(columns_of(docs))))
    text, n_chars = (f"c{docs.columns.index(n)}" for n in ("text", "n_chars"))
    found = secret_scan(plain, text=text, redacted=SECRET)
    found = found.withColumn(n_chars, F.when(F.col("spans") != "", F.length(text).cast("long")).otherwise(F.col(n_chars)))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("decontaminate", decontamination_stage), ("secrets", secrets_stage), ("mix", mixing_stage)]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again, and goes once the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs
