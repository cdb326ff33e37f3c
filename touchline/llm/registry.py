"""Driver queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe_codec, conversations, edit_counts, line_dedup, lm_score, main_text, mixing, nn_descent, piece_codec, quality_rules, simhash, spelling, token_files
from touchline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"
    )


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = lm_score.score(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 9).alias("rate"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), keep_ids=False).drop("text")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = edit_counts.trial_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edit_counts.count_edits(docs, vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), trial=spelling.TRIAL)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.reports(turns, conversations.damage(turns))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Query]:
    early = (op1_main_text, op2_mixing, op3_lm_score, op4_nn_descent, op5_token_files, op6_line_dedup, op7_piece_codec, op8_quality_rules, op9_edit_counts, op10_simhash)
    return {f.__name__: f for f in (*early, op11_spelling, op12_conversation_repair, op13_bpe_codec)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL, "op3_lm_score": lm_score.ORACLE_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "op8_quality_rules": quality_rules.oracle_sql(), "op11_spelling": spelling.ORACLE_SQL, "op12_conversation_repair": conversations.oracle_sql()}
