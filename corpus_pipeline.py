"""The corpus pipeline: documents in, token digests out.  Each stage applies one operator of codeprint.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeprint.llm import bpe, exact, langid, mixing, ngram_join
from codeprint.llm.common import dataset, prepare
from codeprint.llm.queries import BLOCK_ROWS, WEIGHTS, vocabulary
from codeprint.scratch import clear_scratch, materialize, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; the others get the predicted language."""
    prepare(spark)
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; of rows that repeat id and text, one."""
    return exact.drop_exact_duplicates(docs)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those linked by a Jaccard similarity of 0.8 over five-word shingles."""
    prepare(spark)
    return ngram_join.keep_one_of_each(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the sources reach their target weights."""
    return mixing.in_mixed_order(docs, WEIGHTS, other=2, block_rows=BLOCK_ROWS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.digest_documents(docs, vocabulary())


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_dedup), ("mixing", mix), ("BPE", tokenize)]

#: The language model and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote on its way, and its input, go once its result is written."""
    docs, before = dataset(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
        clear_scratch(spark, before, written() - 1)
    return docs
