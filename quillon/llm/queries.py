"""Queries opN_<name> of this subpackage, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontamination, jaccard, merkle, variants
from quillon.llm.html_text import extract_pages
from quillon.llm.licenses import scan_licenses
from quillon.llm.media import media_digest, store_texts
from quillon.llm.mixing import mix_sources
from quillon.llm.packing import pack_documents
from quillon.llm.quality import judge_quality
from quillon.llm.token_counts import count_tokens
from quillon.llm.token_files import new_folder, read_token_files, write_token_files

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(store_texts(_table(spark, sf_dir, "documents")))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(_table(spark, sf_dir, "conversations"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary())


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), vocabulary(), 1, new_folder(spark)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).withColumn("n_base", F.col("n_base").cast("long"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(merkle.merkle_manifest(_table(spark, sf_dir, "documents")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS gone, sum(w) OVER () AS all_w, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (budget - used) / (all_w - gone) AS level FROM l),
t AS (SELECT source, source_size, w, cap, max(CASE WHEN level * w <= cap THEN level END) OVER () AS level FROM v),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM t),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
h AS (SELECT d.source, h, sum(size) AS t FROM d GROUP BY ALL),
c AS (SELECT source, h, t, sum(t) OVER (PARTITION BY source ORDER BY h) AS upto FROM h),
b AS (SELECT c.*, upto - t AS below, target - whole * source_size AS rest FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source),
f AS (SELECT source, h FROM b WHERE (upto <= rest) OR (below <= rest AND upto > rest AND (upto - rest) < (rest - below)))
SELECT d.doc_id, d.size, k.source_size, k.target, ((k.whole + (f.h IS NOT NULL)::BIGINT) * d.size)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN f ON f.h = d.h AND f.source IS NOT DISTINCT FROM d.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_media, op2_chat, op3_token_counts, op4_jaccard, op5_html, op6_quality, op7_packing, op8_mixing, op9_token_files, op10_licenses, op11_merkle, op12_decontamination, op13_variants)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE_SQL, "op4_jaccard": jaccard.ORACLE_SQL, "op8_mixing": MIX_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL, "op13_variants": variants.ORACLE_SQL}
