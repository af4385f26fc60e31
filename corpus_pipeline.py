"""From raw documents to token ids, in five stages of the training-data operators.

Every stage takes all that the one before kept. The first four return the
columns of `documents`; the last returns the tokens of every document that is
left, and the digests of its ids and of the text they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadkin.llm import bpe, decontamination, line_dedup, simhash, toxicity
from leadkin.llm.common import crc_mod, table
from leadkin.session import cut

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None  # a trained classifier and 64-bit hashes of shingles cannot be written in SQL


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels of held-out documents are not learned."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks and runs of lines that an earlier place has; later exact copies of several lines become empty."""
    return line_dedup.dedup_runs(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles are linked by at most 3 differing bits."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, ids."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)  # stored in the shared folder, as later stages read it several times
    return docs
