"""One query per operator, with production parameters, over whole tables; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyweft.llm import (
    conversation_repair, language_id, line_dedup, mixing, nearest_vectors, ngram_join, packed_output, quality, sharding,
    slack_packing, token_alignment, token_counts, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, table_dir: str) -> DataFrame:
    return spark.read.parquet(f"{table_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, table_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    found = ngram_join.ngram_components(_documents(spark, table_dir), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_slack_packing(spark: SparkSession, table_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 2048 tokens."""
    return slack_packing.pack_documents(_documents(spark, table_dir), tokenizer_path("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, table_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, table_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_nearest_vectors(spark: SparkSession, table_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = nearest_vectors.usable(spark.read.parquet(f"{table_dir}/embeddings.parquet"))
    return nearest_vectors.search(vectors, F.col("vec_id") % 20 == 0)


def op5_quality_rules(spark: SparkSession, table_dir: str) -> DataFrame:
    judged = quality.judge_quality(_documents(spark, table_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_source_mix(spark: SparkSession, table_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_documents(spark, table_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, table_dir: str) -> DataFrame:
    """Every document's text without passages that an earlier document has, and what was removed."""
    cleaned = line_dedup.dedup_lines(_documents(spark, table_dir))
    return cleaned.select(
        "doc_id", "text", F.col("_n_units").alias("n_units"), F.size("_removed").alias("n_removed"),
        F.col("_removed").alias("removed"))


def op8_packed_output(spark: SparkSession, table_dir: str) -> DataFrame:
    """Rows of the packed id matrix, 2048 ids each."""
    return packed_output.pack_matrix(_documents(spark, table_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, table_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(spark.read.parquet(f"{table_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, table_dir: str) -> DataFrame:
    docs = _documents(spark, table_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op11_conversation_repair(spark: SparkSession, table_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after damage."""
    return conversation_repair.repair_damaged(spark.read.parquet(f"{table_dir}/conversations.parquet"))


def op12_token_alignment(spark: SparkSession, table_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every text."""
    return token_alignment.align_tokens(
        _documents(spark, table_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_byte_shards(spark: SparkSession, table_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes."""
    sharded = sharding.shard_documents(_documents(spark, table_dir))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return sharded.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, table_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, table_dir)


def queries() -> dict[str, Query]:
    own = (
        op1_ngram_join, op2_slack_packing, op3_token_counts, op4_nearest_vectors, op5_quality_rules, op6_source_mix,
        op7_line_dedup, op8_packed_output, op9_url_filter, op10_language_id,
        op11_conversation_repair, op12_token_alignment, op13_byte_shards, pipeline,
    )
    return {function.__name__: function for function in own}


QUALITY_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, generate_subscripts(w, 1) AS place, unnest(w) AS word
  FROM (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base)
), windows AS (
  SELECT row_id, place, word, lead(word, 1) OVER p AS word2, lead(word, 2) OVER p AS word3
  FROM words WINDOW p AS (PARTITION BY row_id ORDER BY place)
), repeated AS (
  SELECT row_id, place, count(*) OVER (PARTITION BY row_id, word, word2, word3) > 1 AS again
  FROM windows WHERE word3 IS NOT NULL
), covered AS (
  SELECT row_id, count(DISTINCT place + k) AS n_repeat_words
  FROM repeated, (SELECT unnest([0, 1, 2]) AS k) WHERE again GROUP BY row_id
), counted AS (
  SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY row_id
), lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
), measured AS (
  SELECT base.row_id, doc_id, lang, source, coalesce(n_words, 0) AS n_words,
         CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base LEFT JOIN counted USING (row_id) LEFT JOIN lines USING (row_id) LEFT JOIN covered USING (row_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), measures AS (
  SELECT row_id, lang, source, base_failed, measure, width, value,
         CASE WHEN value <= 0 THEN -1000 ELSE CAST(floor(round(ln(value) / ln({growth}), 6)) AS INTEGER) END AS step
  FROM (
    SELECT row_id, lang, source, base_failed, unnest([{names}]) AS measure, unnest([{widths}]) AS width,
           unnest([word_chars::DOUBLE / greatest(n_words, 1), n_symbols::DOUBLE / greatest(n_words, 1),
                   n_dup_lines::DOUBLE / greatest(n_lines, 1), n_repeat_words::DOUBLE / greatest(n_words, 1)]) AS value
    FROM failed)
), sketch AS (
  SELECT lang, source, measure, width, step, count(*) AS n FROM measures WHERE NOT base_failed GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, width, step, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, measure, width, step, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, width, step, sum(n) FROM sketch GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY step) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels
), quartiles AS (
  SELECT level, lang, source, measure, width, any_value(total) AS total,
         min(CASE WHEN 4 * upto >= total THEN step END) AS s1, min(CASE WHEN 4 * upto >= 3 * total THEN step END) AS s3
  FROM ranked GROUP BY ALL
), fences AS (
  SELECT level, lang, source, measure, q1 - greatest({fence} * (q3 - q1), width) AS low,
         q3 + greatest({fence} * (q3 - q1), width) AS high
  FROM (SELECT *, CASE WHEN s1 = -1000 THEN 0.0 ELSE pow({growth}, s1 + 0.5) END AS q1,
               CASE WHEN s3 = -1000 THEN 0.0 ELSE pow({growth}, s3 + 0.5) END AS q3
        FROM quartiles WHERE level = 3 OR total >= {least_rows})
), outside AS (
  SELECT m.row_id FROM measures m
  LEFT JOIN fences s ON s.level = 1 AND s.lang IS NOT DISTINCT FROM m.lang
    AND s.source IS NOT DISTINCT FROM m.source AND s.measure = m.measure
  LEFT JOIN fences l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM m.lang AND l.measure = m.measure
  LEFT JOIN fences a ON a.level = 3 AND a.measure = m.measure
  WHERE m.value < coalesce(s.low, l.low, a.low) OR m.value > coalesce(s.high, l.high, a.high)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND row_id NOT IN (SELECT row_id FROM outside) AS kept
FROM failed
"""


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"'{m}'" for m in quality.MEASURES)
    widths = ", ".join(f"{w}::DOUBLE" for w in quality.MEASURES.values())
    return {
        "op5_quality_rules": QUALITY_SQL.format(
            names=names, widths=widths, growth=quality.GROWTH, fence=quality.FENCE, least_rows=quality.LEAST_ROWS),
    }
