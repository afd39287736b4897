"""One query for each operator of this package over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import alignment, decontamination, html_text, language_id, line_dedup, minhash, pii, sentencepiece_codec, sharding, simhash, spelling, suffix_dedup, token_files
from weftline.llm.common import written

PII_KEY = "weftline demonstration key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.kind_counts(pii.pii_pseudonyms(_documents(spark, sf_dir), PII_KEY))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = written(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "matches")
    return decontamination.verdicts(docs, found)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(_documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("url",))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digests(sentencepiece_codec.sentencepiece(_documents(spark, sf_dir), model))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_columns(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(spark)
    manifest = written(token_files.write_token_files(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 2), "manifest")
    return token_files.read_token_files(manifest, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", language_id.held_out())
    profiles = written(language_id.learn_profiles(docs.where(~F.col("held_out"))), "profiles")
    return language_id.predict_languages(docs, profiles, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shard_documents(_documents(spark, sf_dir), 8)[0])


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: Windows of 50 bytes as 100 hex digits, cut from pieces of 256 starts each; removed runs as islands of overlapping windows; what is kept as the pieces between them.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 512 * j + 1, 610) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS j FROM d)),
w AS (SELECT doc_id, 256 * j + i AS i, substr(t, 2 * i + 1, 100) AS g FROM (SELECT doc_id, j, t, unnest(range(0, least(256, greatest(0, length(t) // 2 - 49)))) AS i FROM c)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM w) WHERE first_doc < doc_id),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM r),
n AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM o),
s AS (SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, island),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT p.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": OP6_SQL}
