"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .license_scan import license_scan
from .mixing import mix_sources
from .quality import scored as quality_scored
from .quality import train as train_quality
from .secret_scan import secret_scan
from .shared import table
from .substring_dedup import substring_dedup
from .toxicity import scored as toxicity_scored
from .toxicity import train as train_toxicity
from .url_filter import BLOCKED_WORDS, RULES, url_filter

PREDICT_AT = 0.7


def fold_of(doc_id, n: int):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def held_out_scores(docs: DataFrame, held_out, score: DataFrame) -> DataFrame:
    return score.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = train_quality(docs, labels, "quality", ~held_out)
    return held_out_scores(docs, held_out, quality_scored(docs, model))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = train_toxicity(docs, labels, "toxic", ~held_out)
    return held_out_scores(docs, held_out, toxicity_scored(docs, model))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_quality, op4_license_scan, op5_decontaminate, op6_substring_dedup, op7_toxicity, op8_mixing, op9_jaccard_join, op10_nearest)}


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {UPPER_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         row_number() OVER () AS rn
  FROM pages
), rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
hit AS (
  SELECT rn, h || p AS rule, v, row_number() OVER (PARTITION BY rn ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{_list(BLOCKED_WORDS)}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit ON u.rn = hit.rn AND k = 1
"""

OP5_SQL = f"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM words, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE kind = 'i' AND len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
docs AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM words, (SELECT DISTINCT k FROM items), unnest(range(1, len(w) - k + 2)) AS r(i) WHERE kind = 'd' AND len(w) >= k
), found AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM found JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM d, unnest(range(1, len(w) - 18)) AS r(i) WHERE len(w) >= 20
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(20) AS t(j)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
         coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '') AS kept
  FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY word.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total,
         row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s
), f AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= cap AS capped FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap
         ELSE (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT capped THEN w END) OVER () END AS target FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t
), g AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS cum, sum(size)::BIGINT AS own FROM d GROUP BY source, h
)
SELECT doc_id, size, source_size, target,
       (size * (times + (CASE WHEN 2 * cum - own <= 2 * (target - times * source_size) THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM d JOIN g ON d.h = g.h AND d.source IS NOT DISTINCT FROM g.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, y FROM reach r JOIN link ON r.other = x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op5_decontaminate": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op10_nearest": OP10_SQL}
