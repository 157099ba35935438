"""The contract's queries: thin digests of the operators' outputs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, idfiles, importance, near_dedup, ngram_lm, packing, pu_quality, quality, substring_dedup, vector_codes, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.harmonic_packing(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")


def op2_elias_fano_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.robust_quality(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idfiles.write_id_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return idfiles.read_id_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.extendible_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.col("books_sha256").alias("codebooks_sha256"))


def op12_csr_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pu_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_harmonic_packing": op1_harmonic_packing,
        "op2_elias_fano_trigrams": op2_elias_fano_trigrams,
        "op3_warc_segments": op3_warc_segments,
        "op4_two_stage_suffixes": op4_two_stage_suffixes,
        "op5_mcd_outliers": op5_mcd_outliers,
        "op6_probminhash": op6_probminhash,
        "op7_mixing_coder": op7_mixing_coder,
        "op8_extendible_dedup": op8_extendible_dedup,
        "op9_layout_text": op9_layout_text,
        "op10_word_table_bpe": op10_word_table_bpe,
        "op11_partial_distance_codes": op11_partial_distance_codes,
        "op12_csr_importance": op12_csr_importance,
        "op13_positive_unlabelled": op13_positive_unlabelled,
    }


#: A-Z to a-z as a translate() call, as lower() would change other letters too.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """op11 in SQL, a round at a time: every part against every entry of its codebook."""
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k AS part, list_slice(v, k * len(v) // {parts} + 1, (k + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) r(k))",
        f"b0 AS MATERIALIZED (SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    distance = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        ctes.append(f"n{k} AS (SELECT p.vec_id, p.label, p.part, p.x, min({distance} * {entries} + b.entry) AS n FROM p JOIN b{k} b USING (part) GROUP BY ALL)")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, n // {entries} AS d, n % {entries} AS e FROM n{k})")
        if k < rounds:
            ctes.append(f"m{k} AS (SELECT part, e AS entry, list(m ORDER BY j) AS c FROM (SELECT part, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, (SELECT max(len(x)) + 1 FROM p)) r(j) GROUP BY ALL) GROUP BY ALL)")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    ctes.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    ctes.append(f"coded AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, s"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_partial_distance_codes": _codes_sql(),
        "op8_extendible_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM d""",
    }
