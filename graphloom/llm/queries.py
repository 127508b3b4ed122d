"""The thin contract queries of the operators, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    fingerprints,
    html_extract,
    jaccard_join,
    langid,
    licenses,
    mixing,
    packing,
    quality,
    warc,
)
from graphloom.storage import table


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    """Where the public tokenizer files lie; GRAPHLOOM_TOKENIZERS names another folder that has them."""
    folder = os.environ.get("GRAPHLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.resolve(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.plan_records(table(spark, sf_dir, "pages")))
    return warc.summary(warc.read(archives))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", "n_matches")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = learn_quality(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(docs, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def learn_quality(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """From labelled documents that aren't held out. The bound on them comes before texts are read, by a join of ids."""
    some = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = quality.choose(some)
    texts = docs.join(F.broadcast(few), "doc_id")  # 2 * quality.LEARN_DOCS rows at most, about
    return quality.learn(texts)


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.schedule(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "training_position")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def fingerprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's other half, which op10's columns have no place for: bands joined, links verified."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST, r)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (((coalesce(doc_id, -1) % 2147483648 + 2147483648) % 2147483648) * 2654435761) % 4294967296 AS spot
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM t
), w AS (
  SELECT *, CAST([5, 2, 1][CAST(rk % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS capacity FROM r
), f AS (
  SELECT *, capacity / weight AS fills_at FROM w
), l AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(capacity) OVER b, 0)) /
      (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level_here
  FROM f WINDOW b AS (ORDER BY fills_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT min_by(level_here, (fills_at, rk)) AS level FROM l WHERE level_here <= fills_at
), g AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN capacity ELSE least(capacity, weight * level) END AS target,
    CASE WHEN rk % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE WHEN rk % 2 = 0 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS w1
  FROM l LEFT JOIN v ON true
), q AS (
  SELECT d.*, source_size, target, w0, w1, CAST(floor(target) AS BIGINT) AS whole,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, CAST(before AS DOUBLE) / target) ELSE 0.0::DOUBLE END * (w0 + w1) / 2 AS area
  FROM q
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, whole - passes * source_size - before)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND whole > before THEN
         least(1.0::DOUBLE, 2 * area / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * (w1 - w0) * area)))) END AS training_position
FROM p
"""

QUERIES = {
    "op1_pack": op1_pack,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_mix": op9_mix,
    "op10_fingerprints": op10_fingerprints,
    "fingerprint_links": fingerprint_links,
}

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS stored FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < stored THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < stored THEN stored END AS refers_to
FROM m
"""

# By plain search for the statements that the tables' texts have; shares nothing with the operator's sentences and rules.
OP5_SQL = """
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
k AS (SELECT * FROM (VALUES ('All-Rights-Reserved', 'all rights reserved'), ('Apache-2.0', 'licensed under the apache license, version 2.0'),
  ('CC-BY-NC', 'licensed under cc by-nc 4.0'), ('GPL-3.0', 'licensed under the gnu general public license, version 3'),
  ('MIT', 'released under the mit license')) v(name, words)),
c AS (SELECT d.doc_id, d.t, name, (length(t) - length(replace(t, words, ''))) // length(words) AS n FROM d CROSS JOIN k)
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (n > 0), '') AS licenses, CAST(sum(n) AS BIGINT) AS n_matches
FROM c GROUP BY doc_id
"""

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op5_license_scan": OP5_SQL, "op9_mix": OP9_SQL}
