"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and rereads it as the next
stage's docs. All stages but the last return the columns of documents; the last adds the token ids.

Defined results, for every stage: an empty table gives no rows; other columns of docs, whatever their names, are not returned; very long texts are
processed whole; the columns of documents are found whatever their case. What a stage makes of nulls, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import line_dedup, mixing, piece_codec, quality_rules, registry, simhash
from touchline.llm.common import DOCUMENT_COLUMNS, deleted, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts have no words and go; repeated rows are judged each."""
    return quality_rules.apply_quality_rules(docs).where("kept").select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows; one of which nothing is left goes.

    Null and blank texts stay as they are; the first document in doc_id order (null first, ties by the text's hash) keeps a window; rows equal in doc_id and text change alike.
    """
    return line_dedup.dedup_lines(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: of the smallest doc_id (of its rows the one with the smallest text).

    Null and blank texts share fingerprint zero, so that one of them stays; documents whose doc_id is null stay only if all of their component's are null.
    """
    return simhash.one_of_each(docs).select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to the target weights of sources, languages and topics.

    Null levels are levels of their own; a cell of documents without tokens goes; rows with equal doc_id stay or go together.
    """
    return mixing.mix(docs).select(*DOCUMENT_COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the checks of the codec; null and empty texts have none; repeated rows are encoded each."""
    encoded = piece_codec.encode_pieces(docs, registry.vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_crc32", "parity", "decoded_ok", "ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mix), ("SentencePiece codec", pieces)]

#: The suffix array and SimHash stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole of documents; a stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if before is not None:
            deleted(spark, before)
        before = docs
    return docs
