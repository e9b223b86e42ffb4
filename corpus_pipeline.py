"""The corpus pipeline: toxicity, near duplicates, repeated strings, benchmark contamination, token ids.

Each stage takes the documents that its predecessor kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import bpe, minhash, suffix_array, toxicity, winnow
from chronolake.llm.common import read, stored
from chronolake.llm.queries import tokenizer


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents and drops those that score 0.5 or more.

    Null and empty texts have the score of a text without terms and rows that stand twice one score, so they stay or go alike; without
    labels of both kinds nothing that the labels' share does not say is dropped. No rows give no rows.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of texts that are linked by five-word shingles at a similarity of 0.80 or more.

    Texts without words are no group and stay, as do null ids; rows that stand twice are one, and texts of one id are documents of
    their own. No rows give no rows.
    """
    return minhash.keep_one(docs)


def repeated_strings_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of more than 50 words out of the texts, wherever they stand; all documents stay.

    A passage is a run of repeated strings of 200 bytes, a length at which 99 % of the shared runs of over 50 words are found (400
    bytes find 58 %). Null and empty texts stay as they are; a text may become empty; rows that stand twice lose all that they share. No
    rows give no rows.
    """
    return suffix_array.without_repeats(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows.

    Texts without words stay; rows that stand twice are judged alike; null ids are documents like others. No rows give no rows.
    """
    return winnow.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document, one row for each row.

    Null and empty texts have no ids and decode to an empty text. No rows give no rows.
    """
    encoded = bpe.encode(docs, tokenizer("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxic_documents_out),
    ("near_duplicates", near_duplicates_out),
    ("repeated_strings", repeated_strings_out),
    ("decontamination", contaminated_out),
    ("token_ids", token_ids),
]

#: Learned models, components and byte strings are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
