"""A training corpus from raw documents, in five stages of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import bpe, language, mixing, simhash, similar, substring
from quern.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the model knows, or hardly, go.

    Null texts, empty ones and such without a letter go, too; documents without a lang only aren't learned from. Rows
    that repeat have one fate, and null ids are like others. Columns of any other name are carried along.
    """
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five-word Jaccard of 0.8) stays.

    Null, empty and wordless texts are copies of each other. Rows that repeat an id that stays stay all; rows without an id stay.
    """
    return simhash.keep_one_each(docs, similar.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in an earlier place go; every document stays, n_chars follows its text.

    Null texts stay null and have null n_chars. Of rows that repeat an id and a text all have the same fate; rows without an id come last.
    """
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's rate says.

    Null texts have size 0, null sources are one source, and sources without words are left out. Rows that repeat get the same number of copies.
    """
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids as little-endian unsigned 32-bit integers, their digest and that of the decoded text.

    A row for each row, repeats and null ids included; null and empty texts have no tokens.
    """
    coded = bpe.encode(docs, decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "n_tokens", "ids", *digests)


STAGES = [
    ("language identification", identify_language),
    ("SimHash near-deduplication", drop_near_copies),
    ("substring deduplication", cut_repeats),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: SQL can express neither the classifier nor BPE; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
